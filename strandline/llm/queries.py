"""The queries op1 to op13 over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, exactdedup, infill, langid, licenses, mixing, pii, preference, quality, simhash, spotsigs, urlrules, vectorcodes

BPE_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "byte_bpe_multi_50k.tiktoken"

#: The rules of the contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are the pair k."""
    turns = table(spark, sf_dir, "conversations")
    return preference.pairs(turns.select(F.floor(F.col("conv_id") / 2).alias("pair"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = exactdedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", "keep_id", "group_size", exactdedup.kept().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("score", F.round("score", 6))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, public_tokenizers.path(PIECE_FILE))
    held_out = F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), model, keep=("doc_id", "held_out"))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fingerprints = F.array_join("signatures", "").alias("fingerprint"), F.array_join("edited_signatures", "").alias("edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", *fingerprints, *(F.round(c, 6).alias(c) for c in ("near_edited", "near_next")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcodes.fit(rows)
    coded = vectorcodes.with_group_error(vectorcodes.encode(rows, books, keep=("vec_id", "label")))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licenses_sql() -> str:
    """The scan of ``licenses`` over its own templates and phrases."""
    prepared = licenses.prepare()
    templates = ",\n  ".join(f"({n}, '{t['label']}', {_listed(t['words'])}, {_listed(t['key'])}, {t['key_at']})" for n, t in enumerate(prepared))
    phrases = ", ".join(f"('{label}', {_listed(phrase.split())})" for label, phrase in licenses.PHRASES.items())
    keys = _listed(sorted({w for t in prepared for w in t["key"]}))
    return rf"""
WITH templates(n, label, ws, key, key_at) AS (VALUES
  {templates}),
phrases(label, ws) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
slots AS (SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM templates),
own AS (SELECT DISTINCT word FROM slots),
held AS (SELECT k, unnest(list_distinct(ws)) AS word FROM d),
idf AS (SELECT own.word, ln(((SELECT count(*) FROM d) + 1) / (count(held.k) + 1)) + 1e-6::DOUBLE AS idf FROM own LEFT JOIN held USING (word) GROUP BY own.word),
found AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d WHERE list_has_any(ws, {keys})),
begins AS (SELECT DISTINCT found.k, t.n, found.i - t.key_at AS o FROM found JOIN templates t ON found.word = t.key[1]),
sure AS (SELECT b.k, b.n, b.o, t.label, d.ws FROM begins b JOIN templates t USING (n) JOIN d USING (k) WHERE b.o + t.key_at >= 0 AND list_slice(d.ws, b.o + t.key_at + 1, b.o + t.key_at + len(t.key)) = t.key),
weighted AS (SELECT n, ws AS slots, list(idf ORDER BY p) AS weights FROM templates JOIN slots USING (n) JOIN idf USING (word) GROUP BY n, ws),
aligned AS (
  SELECT k, label, n, o, weights, list_transform(range(0, len(slots)), lambda p: list_transform(range(0, {2 * licenses.SLACK + 1}), lambda q:
           CASE WHEN o + p + q >= {licenses.SLACK} AND ws[(o + p + q - {licenses.SLACK - 1})::INT] = slots[p + 1] THEN weights[p + 1] ELSE 0::DOUBLE END)) AS hits
  FROM sure JOIN weighted USING (n)),
scored AS (
  SELECT k, label, n, o, list_reduce(hits, lambda f, x: list_transform(range(1, {2 * licenses.SLACK + 2}), lambda q: list_max(list_transform(range(1, q + 1), lambda r: greatest(f[least(r + 1, {2 * licenses.SLACK + 1})], f[r] + x[r])))),
           list_transform(range(0, {2 * licenses.SLACK + 1}), lambda q: 0::DOUBLE))[{2 * licenses.SLACK + 1}] / list_sum(weights) AS score FROM aligned),
best AS (SELECT k, list(DISTINCT label) AS labels, max(score) AS score FROM scored WHERE score >= {licenses.MIN_SCORE} GROUP BY k),
places AS (SELECT d.k, f.label, i.i FROM d, phrases f, LATERAL (SELECT unnest(range(0, len(d.ws))) AS i) i WHERE list_has_any(d.ws, {keys}) AND list_slice(d.ws, i.i + 1, i.i + len(f.ws)) = f.ws),
base AS (SELECT k, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(best.labels, []))), ','), '') AS labels, round(least(coalesce(best.score, 0), 1), 6) AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN best USING (k)
"""


def _spotsigs_sql() -> str:
    anchors = ", ".join(f"'{w}'" for w in spotsigs.ANCHORS)
    signatures = lambda text, name: rf"""{name} AS (
  SELECT doc_id, CASE WHEN len(sigs) = 0 AND len(ws) > 0 THEN [left(md5(array_to_string(ws, ' ')), 16)] ELSE sigs END AS sigs FROM (
    SELECT doc_id, ws, list_sort(list_distinct(list_filter(list_transform(units, lambda u, i: CASE WHEN contains(u, chr(2)) THEN
             left(md5(array_to_string([u] || list_transform(units[i + 1:i + {spotsigs.CHAIN - 1}], lambda v: string_split(v, chr(2))[-1]), ' ')), 16) END), lambda s: s IS NOT NULL))) AS sigs
    FROM (SELECT doc_id, ws, string_split(array_to_string(list_transform(ws, lambda w: w || CASE WHEN w IN ({anchors}) THEN chr(2) ELSE ' ' END), ''), ' ')[:-2] AS units
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower({text}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM e))))"""
    like = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) < {spotsigs.LEAST} * greatest(len({a}), len({b})) THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER o, max(doc_id) OVER ()) AS next_id, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next
  FROM documents WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, next_id, text, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS edited FROM d),
{signatures("text", "own")},
{signatures("edited", "other")}
SELECT e.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own.sigs, '') AS fingerprint, array_to_string(other.sigs, '') AS edited_fingerprint,
       round(({like("own.sigs", "other.sigs")})::DOUBLE, 6) AS near_edited, round(({like("own.sigs", "after.sigs")})::DOUBLE, 6) AS near_next
FROM e JOIN own USING (doc_id) JOIN other USING (doc_id) JOIN own after ON after.doc_id = e.next_id
"""


def _vector_codes_sql() -> str:
    """The codebooks' rounds written out one after the other."""
    assigned = """a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT p.k, vec_id, label, p.part, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts p JOIN b{r} b ON p.part = b.part) GROUP BY k, vec_id, label, part)"""
    refined = """s{r} AS MATERIALIZED (
  SELECT part, entry, list(x ORDER BY i) AS v FROM (
    SELECT a.part, a.entry, i, (sum(p.v[i]) - ((sum(p.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM a{r} a JOIN parts p USING (vec_id, part), range(1, (SELECT max(len(v)) FROM parts) + 1) n(i) GROUP BY a.part, a.entry, i) GROUP BY part, entry),
b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s ON b.part = s.part AND b.entry = s.entry)"""
    steps = ",\n".join([assigned.format(r=0), refined.format(r=0, n=1), assigned.format(r=1), refined.format(r=1, n=2), assigned.format(r=2)])
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT k, vec_id, label, p AS part, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS v FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT part, k - 1 AS entry, v FROM parts WHERE k <= 64),
{steps},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded
"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_preference": op4_preference,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_spotsigs": op11_spotsigs,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, left(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 16) AS hash, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM sources WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce(max(CASE WHEN level * weight < source_size * 3 THEN level END) OVER () * weight, (source_size * 3)::DOUBLE)) AS target FROM levels),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (
    PARTITION BY source ORDER BY length(bin(size)) * 16 + list_reduce(list_transform(string_split(left(bin(size), 4), ''), lambda b: b::INT), lambda a, b: a * 2 + b),
    hash, doc_id, size) AS place
  FROM sized)
SELECT doc_id, size, source_size, target,
  ((floor(place * (target / source_size) + start) - floor((place - 1) * (target / source_size) + start)) * size)::BIGINT AS taken
FROM (SELECT r.*, source_size, target, ('0x' || substr(md5('0/' || coalesce(r.source, '')), 1, 8))::UBIGINT / 4294967296.0 AS start
      FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
""",
    "op4_preference": r"""
WITH turns AS (
  SELECT conv_id // 2 AS pair, conv_id % 2 = 0 AS chosen, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT pair, count(*) FILTER (chosen) AS c, count(*) FILTER (NOT chosen) AS r FROM turns GROUP BY pair HAVING c > 0 AND r > 0),
common AS (
  SELECT s.pair, coalesce(min(a.pos) FILTER (a.role <> b.role OR a.text <> b.text) - 1, any_value(least(s.c, s.r))) AS n
  FROM sizes s JOIN turns a ON a.pair = s.pair AND a.chosen JOIN turns b ON b.pair = s.pair AND NOT b.chosen AND b.pos = a.pos GROUP BY s.pair),
escaped AS (
  SELECT pair, chosen, pos, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text FROM turns),
rendered AS (
  SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said,
         coalesce(sum(length(role) + length(text) + 13) OVER (PARTITION BY t.pair, chosen, pos > n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS begins
  FROM escaped t JOIN common USING (pair))
SELECT pair, any_value(n) AS n_common,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (chosen AND pos <= n), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (chosen AND pos > n), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (NOT chosen AND pos > n), '') AS rejected,
  coalesce(string_agg(begins || ':' || begins + length(text) + 7, ',' ORDER BY pos) FILTER (chosen AND pos > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(begins || ':' || begins + length(text) + 7, ',' ORDER BY pos) FILTER (NOT chosen AND pos > n AND role = 'assistant'), '') AS rejected_mask
FROM rendered GROUP BY pair
""",
    "op5_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op6_url_filters": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
""",
    "op8_quality": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS low,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(low) AS word FROM w) GROUP BY lang, word),
lists AS (SELECT lang, list(word ORDER BY word) AS common FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts) WHERE r <= 24 GROUP BY lang),
grams AS (SELECT k, i, list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams WHERE len(g) = 8) WHERE c > 1),
covered AS (SELECT k, sum(c)::BIGINT AS n FROM (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS c FROM again) GROUP BY k),
f AS (
  SELECT k, doc_id, w.lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         list_transform(['[a-z]', '[A-Z]', '[0-9]', '[.,;:!?]', '[\x22-\x2B\x2D\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7E]'], lambda c: length(text) - length(regexp_replace(text, c, '', 'g'))) AS classes,
         list_transform(common, lambda c: len(list_filter(low, lambda x: x = c))) AS common
  FROM w LEFT JOIN lists ON w.lang IS NOT DISTINCT FROM lists.lang),
u AS (
  SELECT lang, list_transform(range(1, 6), lambda i: list_sum(list_transform(cs, lambda x: x[i]))) AS uc, list_transform(range(1, any_common + 1), lambda i: list_sum(list_transform(ws, lambda x: x[i]))) AS uw, chars, words
  FROM (SELECT lang, list(classes) AS cs, list(common) AS ws, max(len(common)) AS any_common, sum(word_chars) AS chars, sum(n_words) AS words FROM f GROUP BY lang)),
h AS (
  SELECT f.*, list_transform(classes || [word_chars - list_sum(classes)], lambda x: x / nullif(word_chars, 0)) AS p, list_transform(uc || [chars - list_sum(uc)], lambda x: x / nullif(chars, 0)) AS q,
         list_transform(common || [n_words - list_sum(common)], lambda x: x / nullif(n_words, 0)) AS pw, list_transform(uw || [words - list_sum(uw)], lambda x: x / nullif(words, 0)) AS qw
  FROM f JOIN u ON f.lang IS NOT DISTINCT FROM u.lang),
j AS (
  SELECT h.*, CASE WHEN n_words > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i] > 0 THEN p[i] * log2(2 * p[i] / (p[i] + q[i])) ELSE 0 END + CASE WHEN q[i] > 0 THEN q[i] * log2(2 * q[i] / (p[i] + q[i])) ELSE 0 END)) / 2, 0)) END AS cd,
         CASE WHEN n_words > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len(pw) + 1), lambda i: CASE WHEN pw[i] > 0 THEN pw[i] * log2(2 * pw[i] / (pw[i] + qw[i])) ELSE 0 END + CASE WHEN qw[i] > 0 THEN qw[i] * log2(2 * qw[i] / (pw[i] + qw[i])) ELSE 0 END)) / 2, 0)) END AS wd
  FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(covered.n, 0) > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * coalesce(covered.n, 0) > 30 * n_words) AND NOT coalesce(n_words >= 50 AND (cd > 0.3 OR wd > 0.45), false) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM j LEFT JOIN covered USING (k)
""",
    "op7_licenses": _licenses_sql(),
    "op11_spotsigs": _spotsigs_sql(),
    "op12_vector_codes": _vector_codes_sql(),
    # the parts by their first and last characters, from running lengths of the units
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT doc_id, text, len(units) AS n, list_transform(units, lambda u: length(u)) AS sizes, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, 8 * i + 1, 8))::UBIGINT) AS h FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(list_sum(list_slice(sizes, 1, least(h[1] % (n + 1), h[2] % (n + 1))::BIGINT)), 0)::BIGINT AS a, coalesce(list_sum(list_slice(sizes, 1, greatest(h[1] % (n + 1), h[2] % (n + 1))::BIGINT)), 0)::BIGINT AS b FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
""",
}
