"""Queries over the driver's tables, with the same in DuckDB SQL.

Documents stand for files (one file each) and, uncut, for chunks whose content
type is their language; embeddings belong to the document with the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import paths, text, vectors
from strandline.operators import ann, changes, chunking, embedding, images, metadata, search, store
from strandline.streaming import chat
from strandline.workspace import materialize

TOP = 10
QUERY_WORDS = "The that license under"
TODAY = "2024-02-10"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the driver's tables as the engine's

_FILES = """files AS (
  SELECT md5('/' || source || '/' || doc_id || '.txt') AS file_id, '/' || source || '/' || doc_id || '.txt' AS path, lang AS file_type, sha256(text) AS file_hash,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS modified_at, strlen(text)::BIGINT AS size, doc_id, source, text
  FROM documents)"""
_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, '/' || source || '/' || doc_id || '.txt' AS file_path, lang AS content_type, text AS content FROM documents)"""
_NEAR = """q AS (SELECT embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS chunk_id, array_cosine_distance(embedding::DOUBLE[64], v) AS distance FROM embeddings, q)"""


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = read(spark, sf_dir, "documents").withColumn("path", path)
    return docs.select(
        paths.file_id("path").alias("file_id"), "path", F.col("lang").alias("file_type"), F.sha2("text", 256).alias("file_hash"),
        F.expr("timestampadd(HOUR, doc_id, timestamp_ntz'2024-01-01 00:00:00')").alias("modified_at"), F.octet_length("text").cast("bigint").alias("size"), "doc_id", "source", "text",
    )


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.col("lang").alias("content_type"), F.col("text").alias("content"))


def embeddings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str) -> Column:
    """The vector of a search, which the caller of the engine would give."""
    row = read(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(v)) for v in row[0]]) if row else F.lit(None).cast("array<double>")


def hits(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", "file_path", "content_type", F.length("content").cast("bigint").alias("n_chars"), F.round("distance", 6).alias("distance"))


_HIT = "chunk_id, file_path, content_type, length(content) AS n_chars, round(distance, 6) AS distance"


# search


@query(f"WITH {_CHUNKS}, {_NEAR}, ranked AS (SELECT * FROM near ORDER BY distance NULLS LAST, chunk_id LIMIT {TOP}) SELECT {_HIT} FROM ranked JOIN chunks USING (chunk_id) ORDER BY distance, chunk_id LIMIT {TOP}")
def semantic_topk(spark, sf_dir):
    return hits(search.semantic(chunks_of(spark, sf_dir), embeddings_of(spark, sf_dir), query_vector(spark, sf_dir), TOP))


@query(f"WITH {_CHUNKS}, {_NEAR}, ranked AS (SELECT * FROM near ORDER BY distance NULLS LAST, chunk_id LIMIT 50) SELECT {_HIT} FROM ranked JOIN chunks USING (chunk_id) WHERE content_type = 'de' ORDER BY distance, chunk_id LIMIT {TOP}")
def semantic_topk_filtered(spark, sf_dir):
    return hits(search.semantic(chunks_of(spark, sf_dir), embeddings_of(spark, sf_dir), query_vector(spark, sf_dir), TOP, "de"))


@query(f"WITH {_CHUNKS}, {_NEAR} SELECT {_HIT} FROM near JOIN chunks USING (chunk_id) WHERE content_type = 'de' ORDER BY near.distance NULLS LAST, chunk_id LIMIT {TOP}")
def semantic_topk_exact_prefilter(spark, sf_dir):
    return hits(search.semantic(chunks_of(spark, sf_dir), embeddings_of(spark, sf_dir), query_vector(spark, sf_dir), TOP, "de", exact=True))


def _score(words: list[str]) -> str:
    return " + ".join(f"((length(lower(content)) - length(replace(lower(content), '{w}', ''))) / length('{w}') * {text.keyword_weight(w):.2f})" for w in words)


def _keyword_sql(words: str, k: int, more: str = "") -> str:
    kept = text.keywords(words)
    test = " AND ".join(f"lower(content) LIKE '%{w}%'" for w in kept)
    return f"(SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + relevance) AS distance FROM (SELECT *, ({_score(kept)})::DOUBLE AS relevance FROM chunks WHERE {test}{more}) ORDER BY relevance DESC, chunk_id LIMIT {k})"


@query(f"WITH {_CHUNKS} SELECT {_HIT} FROM {_keyword_sql(QUERY_WORDS, TOP)}")
def keyword_search(spark, sf_dir):
    return hits(search.keyword(chunks_of(spark, sf_dir), QUERY_WORDS, TOP))


@query(f"WITH {_CHUNKS} SELECT {_HIT} FROM {_keyword_sql('license', TOP, chr(32) + 'AND content_type = ' + chr(39) + 'fr' + chr(39))}")
def keyword_search_filtered(spark, sf_dir):
    return hits(search.keyword(chunks_of(spark, sf_dir), "license", TOP, "fr"))


@query(f"WITH {_CHUNKS} SELECT {_HIT} FROM (SELECT *, 0.5::DOUBLE AS distance FROM chunks) WHERE false")
def keyword_empty_query(spark, sf_dir):
    return hits(search.keyword(chunks_of(spark, sf_dir), "the and or", TOP))


def _hybrid_sql(words: str, ws: float, wk: float) -> str:
    return f"""WITH {_CHUNKS}, {_NEAR},
s AS (SELECT chunks.*, distance FROM (SELECT * FROM near ORDER BY distance NULLS LAST, chunk_id LIMIT {2 * TOP}) JOIN chunks USING (chunk_id)),
w AS (SELECT chunk_id, file_path, content_type, content, distance FROM {_keyword_sql(words, 2 * TOP)}),
merged AS (SELECT coalesce(s.chunk_id, w.chunk_id) AS chunk_id, coalesce(s.file_path, w.file_path) AS file_path, coalesce(s.content_type, w.content_type) AS content_type, coalesce(s.content, w.content) AS content,
  1.0::DOUBLE - coalesce((1.0::DOUBLE - s.distance) * {ws}::DOUBLE, 0.0::DOUBLE) - coalesce((1.0::DOUBLE - w.distance) * {wk}::DOUBLE, 0.0::DOUBLE) AS distance FROM s FULL OUTER JOIN w ON s.chunk_id = w.chunk_id)
SELECT {_HIT} FROM merged ORDER BY merged.distance, chunk_id LIMIT {TOP}"""


@query(_hybrid_sql("that license", 0.7, 0.3))
def hybrid_search(spark, sf_dir):
    return hits(search.hybrid(chunks_of(spark, sf_dir), embeddings_of(spark, sf_dir), "that license", query_vector(spark, sf_dir), TOP))


@query(_hybrid_sql("under license", 0.9, 0.1))
def hybrid_custom_weights(spark, sf_dir):
    return hits(search.hybrid(chunks_of(spark, sf_dir), embeddings_of(spark, sf_dir), "under license", query_vector(spark, sf_dir), TOP, weights=(0.9, 0.1)))


@query(f"""WITH {_CHUNKS}, {_NEAR},
s AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM (SELECT near.* FROM near JOIN chunks USING (chunk_id) ORDER BY distance NULLS LAST, chunk_id LIMIT {2 * TOP})),
w AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM {_keyword_sql("license", 2 * TOP)})
SELECT chunk_id, round(sum(1.0::DOUBLE / (r + 60)), 9) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM w) GROUP BY chunk_id ORDER BY sum(1.0::DOUBLE / (r + 60)) DESC, chunk_id LIMIT {TOP}""")
def hybrid_rrf(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir)
    near = search.semantic(chunks, embeddings_of(spark, sf_dir), query_vector(spark, sf_dir), 2 * TOP)
    return search.fuse_ranks(near, search.keyword(chunks, "license", 2 * TOP), TOP).select("chunk_id", F.round("score", 9).alias("score"))


@query(f"""WITH {_CHUNKS}, found AS (SELECT chunk_id, content FROM {_keyword_sql("license", 2 * TOP)}),
scored AS (SELECT chunk_id, least(list_sum(list_transform(range(0, 32), lambda i: (substr(sha256('license'), (2 * i + 1)::INT, 2) = substr(sha256(content), (2 * i + 1)::INT, 2))::INT)) / 32.0::DOUBLE
  + (('0x' || substr(sha256(content), 1, 8))::UBIGINT % 100) / 1000.0::DOUBLE, 1.0::DOUBLE) AS score FROM found)
SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT {TOP}""")
def rerank_mock(spark, sf_dir):
    found = search.keyword(chunks_of(spark, sf_dir), "license", 2 * TOP)
    return search.rerank(found, "license", TOP).select("chunk_id", F.round("relevance_score", 6).alias("score"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS n_results, count(DISTINCT file_path) AS n_files FROM {_keyword_sql('license', 20)}")
def files_in_results(spark, sf_dir):
    return search.files_in(search.keyword(chunks_of(spark, sf_dir), "license", 20))


# text


@query("SELECT doc_id, ((strlen(text) + 2) // 3)::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


_SENTENCES = r"""ss AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, chr(10), '. '), '(?s).*?[.!?](?: |\z)|.+\z'), lambda s: trim(s)), lambda s: s <> '') AS list FROM documents)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, len(list) AS n_sentences, list[1] AS first, list[-1] AS last, md5(array_to_string(list, chr(10))) AS digest FROM ss WHERE len(list) > 0")
def sentence_split(spark, sf_dir):
    split = read(spark, sf_dir, "documents").select("doc_id", text.sentences("text").alias("list"))
    return split.select("doc_id", F.size("list").cast("bigint").alias("n_sentences"), F.col("list")[0].alias("first"), F.element_at("list", -1).alias("last"), F.md5(F.array_join("list", "\n")).alias("digest"))


_CUT = f"""{_SENTENCES},
each AS (SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) AS i FROM ss WHERE doc_id IN (SELECT doc_id FROM documents WHERE strlen(text) + 2 >= 3003)),
summed AS (SELECT *, (strlen(s) + 2) // 3 AS t, sum((strlen(s) + 2) // 3) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM each),
repeated AS (SELECT a.doc_id, a.i, coalesce(string_agg(b.s, ' ' ORDER BY b.i DESC), '') AS r FROM summed a LEFT JOIN summed b ON b.doc_id = a.doc_id AND b.i < a.i AND b.i >= a.i - 10 AND (a.c - a.t) - (b.c - b.t) <= 10 GROUP BY a.doc_id, a.i),
rows AS (SELECT s.doc_id, s.i, s.s, s.t, r FROM summed s JOIN repeated p ON p.doc_id = s.doc_id AND p.i = s.i),
folded AS (
  WITH RECURSIVE f(doc_id, i, full_, chunk) AS (
    SELECT doc_id, i, t::BIGINT, 0 FROM rows WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, CASE WHEN f.full_ > 0 AND f.full_ + n.t > 300 THEN (strlen(n.r) + 2) // 3 + n.t ELSE f.full_ + n.t END, f.chunk + (f.full_ > 0 AND f.full_ + n.t > 300)::INT
    FROM f JOIN rows n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
  SELECT * FROM f),
pieces AS (SELECT f.doc_id, f.chunk, f.i, CASE WHEN f.i > 1 AND f.chunk > lag(f.chunk) OVER (PARTITION BY f.doc_id ORDER BY f.i) AND r <> '' THEN r || ' ' || s ELSE s END AS piece FROM folded f JOIN rows n ON n.doc_id = f.doc_id AND n.i = f.i),
cut AS (
  SELECT doc_id, chunk AS chunk_index, trim(string_agg(piece, ' ' ORDER BY i)) AS content FROM pieces GROUP BY doc_id, chunk
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE strlen(text) + 2 < 3003 AND text <> '')"""


@query(f"WITH {_CUT} SELECT md5(md5('/' || source || '/' || doc_id || '.txt') || ':chunk:' || chunk_index) AS chunk_id, doc_id, chunk_index::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks, content FROM cut JOIN documents USING (doc_id) WHERE strlen(text) <= 512000")
def chunk_text(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return chunking.chunk_text_files(files).select("chunk_id", F.regexp_extract("file_path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "chunk_index", "total_chunks", "content")


@query(f"WITH {_CUT}, totals AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) SELECT n AS total_chunks, count(*) AS n_docs FROM totals GROUP BY n")
def chunk_totals(spark, sf_dir):
    chunks = chunking.chunk_text_files(files_of(spark, sf_dir))
    return chunks.filter("chunk_index = 0").groupBy(F.col("total_chunks").cast("bigint").alias("total_chunks")).agg(F.count("*").alias("n_docs"))


@query(f"WITH {_FILES} SELECT path, file_id, md5(file_id || ':chunk:0') AS chunk_id FROM files")
def file_ids_and_chunk_ids(spark, sf_dir):
    return files_of(spark, sf_dir).select("path", "file_id", paths.chunk_id("file_id", F.lit(0)).alias("chunk_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND strlen(source) > 0 THEN sha256(source) ELSE sha256(text) END AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "image").otherwise("text")
    return docs.select("doc_id", paths.content_hash("text", kind, F.encode("source", "UTF-8")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 500 THEN left(text, list_max(list_filter(range(0, 501), lambda n: strlen(left(text, n)) <= 500))) || '...' ELSE text END AS shown FROM documents")
def preview_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("shown"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_text("text").alias("cleaned"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def pdf_date_parse(spark, sf_dir):
    """The events' times in the layouts that PDFs have them in."""
    n, written = F.col("event_id") % 5, lambda layout: F.date_format("ts", layout)
    stamp = F.when(n == 0, written("'D:'yyyyMMddHHmmss")).when(n == 1, F.concat(written("'(D:'yyyyMMddHHmmss"), F.lit("+00'00')"))).when(n == 2, written("yyyyMMdd")).when(n == 3, written("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("invalid")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(paths.pdf_date(stamp), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("""WITH v AS (SELECT doc_id, list_transform(range(0, 16), lambda i: (('0x' || substr(sha256(text), ((i * 8) % 64 + 1)::INT, 8))::UBIGINT)::DOUBLE / 4294967295.0::DOUBLE * 2 - 1) AS raw FROM documents),
n AS (SELECT doc_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS size FROM v)
SELECT doc_id, array_to_string(list_transform(raw, lambda x: round(x / size * 1000000)::BIGINT), ',') AS millionths FROM n""")
def mock_embedding(spark, sf_dir):
    millionths = F.transform(vectors.hash_embedding("text", 16), lambda v: F.round(v * 1_000_000).cast("bigint").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(millionths, ",").alias("millionths"))


# files


def _found(df: DataFrame) -> DataFrame:
    return df.select("path", "file_name", "file_type", "size_bytes", "modified_at")


_FOUND = "SELECT path, regexp_extract(path, '[^/]*$') AS file_name, file_type, size AS size_bytes, strftime(modified_at, '%Y-%m-%d') AS modified_at FROM files"


@query(f"WITH {_FILES} {_FOUND} WHERE lower(file_type) = 'de' ORDER BY path LIMIT 50")
def find_files_type(spark, sf_dir):
    return _found(metadata.agent_find_files(files_of(spark, sf_dir), file_type=".DE"))


@query(f"WITH {_FILES} {_FOUND} WHERE contains(lower(path), 'src1/1') ORDER BY path LIMIT 200")
def find_files_name(spark, sf_dir):
    return _found(metadata.agent_find_files(files_of(spark, sf_dir), name_contains="SRC1/1", limit=900))


@query(f"WITH {_FILES} {_FOUND} WHERE modified_at >= TIMESTAMP '2024-01-03' AND modified_at < TIMESTAMP '2024-01-06' ORDER BY path LIMIT 100")
def find_files_date(spark, sf_dir):
    return _found(metadata.agent_find_files(files_of(spark, sf_dir), modified_after="2024-01-03", modified_before="2024-01-05", limit=100))


@query(f"WITH {_FILES} {_FOUND} WHERE starts_with(lower(path), '/src3/') ORDER BY path LIMIT 50")
def find_files_subfolder(spark, sf_dir):
    return _found(metadata.agent_find_files(files_of(spark, sf_dir), root="/", subfolder="src3"))


@query(f"WITH {_FILES} SELECT path, size FROM files WHERE lower(file_type) = 'en' AND contains(lower(path), '7') AND modified_at >= TIMESTAMP '2024-01-02' AND modified_at < TIMESTAMP '2025-01-01' AND starts_with(lower(path), '/src')")
def find_files_all(spark, sf_dir):
    return metadata.find_files(files_of(spark, sf_dir), "EN", "7", "2024-01-02 00:00:00", "2025-01-01 00:00:00", "/src").select("path", "size")


@query(f"WITH {_CUT} SELECT chunk_index::INT AS chunk_index, content FROM cut WHERE doc_id = 0")
def file_chunks(spark, sf_dir):
    files = files_of(spark, sf_dir).filter("path = '/src0/0.txt'")
    return metadata.file_chunks(files, chunking.chunk_text_files(files), "/src0/0.txt").select("chunk_index", "content")


@query(f"""WITH {_FILES}, counts AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS images FROM documents GROUP BY source)
SELECT path, regexp_extract(path, '[^/]*$') AS file_name, file_type, size, coalesce(n, 0) AS chunk_count, CASE WHEN images > 0 THEN n - images END AS text_chunks, CASE WHEN images > 0 THEN images END AS image_chunks
FROM files LEFT JOIN counts USING (source)""")
def file_info(spark, sf_dir):
    """A file's chunks are played by the documents of its source, English ones as images."""
    files = files_of(spark, sf_dir).withColumn("file_id", F.col("source"))
    chunks = read(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.when(F.col("lang") == "en", "image").otherwise("text").alias("content_type"))
    return metadata.file_info(files, chunks)


@query(f"""WITH {_CUT}, names AS (SELECT DISTINCT source FROM documents)
SELECT n.source AS index_name, '/' || n.source AS folder_path, count(c.doc_id) AS chunks FROM names n LEFT JOIN (SELECT doc_id, source FROM cut JOIN documents USING (doc_id)) c ON c.source = n.source GROUP BY n.source""")
def list_indexes(spark, sf_dir):
    files = files_of(spark, sf_dir)
    indexes = files.select(F.col("source").alias("index_name"), F.concat(F.lit("/"), "source").alias("folder_path")).distinct()
    chunks = chunking.chunk_text_files(files).select(F.split("file_path", "/")[1].alias("index_name"))
    return metadata.list_indexes(indexes, chunks)


@query(f"WITH {_CUT} SELECT (SELECT count(*) FROM cut) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM documents) AS files")
def index_stats(spark, sf_dir):
    files = files_of(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
    return count(chunking.chunk_text_files(files), "chunks").crossJoin(count(read(spark, sf_dir, "embeddings"), "embeddings")).crossJoin(count(files, "files"))


@query(f"WITH {_FILES} SELECT source AS name, true AS is_dir, NULL::BIGINT AS size FROM (SELECT DISTINCT source FROM files)")
def list_dir_root(spark, sf_dir):
    return metadata.list_dir(files_of(spark, sf_dir), "/")


@query(f"WITH {_FILES} SELECT doc_id || '.txt' AS name, false AS is_dir, size FROM files WHERE source = 'src2'")
def list_dir(spark, sf_dir):
    return metadata.list_dir(files_of(spark, sf_dir), "/src2")


@query("""WITH entries AS (SELECT '/d/' || doc_id AS path, CASE doc_id % 11 WHEN 0 THEN '.hidden' WHEN 1 THEN 'Node_Modules' ELSE 'n' || doc_id END AS name, doc_id % 3 = 0 AS is_dir, doc_id FROM documents),
shown AS (SELECT * FROM entries WHERE doc_id % 11 > 1)
SELECT path, name, is_dir, doc_id % 5 = 0 AS is_indexed, (SELECT count(*) FROM shown) AS total, (SELECT count(*) > 500 FROM shown) AS truncated FROM shown ORDER BY is_dir DESC, name, path LIMIT 500""")
def browse_dir(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, ".hidden").when(F.col("doc_id") % 11 == 1, "Node_Modules").otherwise(F.concat(F.lit("n"), F.col("doc_id")))
    entries = docs.select(F.concat(F.lit("/d/"), F.col("doc_id")).alias("path"), name.alias("name"), (F.col("doc_id") % 3 == 0).alias("is_dir"))
    return metadata.browse(entries, docs.filter("doc_id % 5 = 0").select(F.concat(F.lit("/d/"), F.col("doc_id")).alias("path")))


@query(f"WITH {_FILES} SELECT path FROM files WHERE doc_id % 7 = 0 AND doc_id % 2 = 0")
def file_exists(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return metadata.exists_in(files.filter("doc_id % 2 = 0"), files.filter("doc_id % 7 = 0").select("path"))


# changes

_DIFF = f"""{_FILES},
l AS (SELECT path, size + (doc_id % 13 = 0)::INT AS size, CASE WHEN doc_id % 5 = 0 THEN modified_at + INTERVAL 1 HOUR ELSE modified_at END AS modified_at, CASE WHEN doc_id % 10 = 0 THEN sha256('x' || text) ELSE file_hash END AS file_hash, doc_id FROM files WHERE doc_id % 11 <> 0),
f AS (SELECT * FROM files WHERE doc_id % 7 <> 0),
compared AS (
  SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'deleted' WHEN l.size <> f.size THEN 'modified' WHEN l.modified_at = f.modified_at THEN 'unchanged'
    WHEN coalesce(l.doc_id, f.doc_id) % 20 = 5 THEN 'modified' WHEN l.file_hash = f.file_hash THEN 'unchanged' ELSE 'modified' END AS reason,
    coalesce(l.size, f.size) AS size, coalesce(l.modified_at, f.modified_at) AS modified_at
  FROM l FULL OUTER JOIN f ON l.path = f.path)"""


def _both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """A listing and a files table in which every kind of change occurs; some paths count as network paths."""
    files = files_of(spark, sf_dir)
    n = F.col("doc_id")
    listing = files.filter(n % 11 != 0).select(
        "path", (F.col("size") + F.when(n % 13 == 0, 1).otherwise(0)).alias("size"), F.when(n % 5 == 0, F.expr("timestampadd(HOUR, 1, modified_at)")).otherwise(F.col("modified_at")).alias("modified_at"),
        F.when(n % 10 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.col("file_hash")).alias("file_hash"),
    )
    network = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint") % 20 == 5
    return listing, files.filter(n % 7 != 0).select("file_id", "path", "file_type", "file_hash", "modified_at", "size"), network


def _compared(spark, sf_dir):
    listing, files, network = _both_sides(spark, sf_dir)
    return changes.compare(listing, files, network)


@query(f"WITH {_DIFF} SELECT path, reason, 'txt' AS file_type, size, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at FROM compared")
def detect_changes(spark, sf_dir):
    return _compared(spark, sf_dir).withColumn("modified_at", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_DIFF}, n AS (SELECT (SELECT count(*) FROM f) AS total, count(*) FILTER (reason = 'new') AS pending_add, count(*) FILTER (reason = 'modified') AS pending_update, count(*) FILTER (reason = 'deleted') AS pending_delete FROM compared)
SELECT *, total - pending_update - pending_delete AS up_to_date FROM n""")
def index_status(spark, sf_dir):
    return changes.status(_compared(spark, sf_dir), _both_sides(spark, sf_dir)[1])


@query(f"""WITH {_DIFF}, ranked AS (SELECT reason, path, row_number() OVER (PARTITION BY reason ORDER BY path) AS r, count(*) OVER (PARTITION BY reason) AS n FROM compared WHERE reason <> 'unchanged')
SELECT reason, string_agg(regexp_extract(path, '[^/]*$'), ', ' ORDER BY path) FILTER (r <= 10) || CASE WHEN any_value(n) > 10 THEN ', ...and ' || (any_value(n) - 10) || ' more' ELSE '' END AS preview FROM ranked GROUP BY reason""")
def status_preview(spark, sf_dir):
    return changes.name_preview(_compared(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT path, reason IN ('new', 'modified') AS process, reason IN ('modified', 'deleted') AS remove FROM compared WHERE reason <> 'unchanged'")
def resolve_incremental(spark, sf_dir):
    wanted, outdated = changes.resolve(_compared(spark, sf_dir))
    both = wanted.withColumn("p", F.lit(True)).join(outdated.withColumn("r", F.lit(True)), "path", "full_outer")
    return both.select("path", F.coalesce("p", F.lit(False)).alias("process"), F.coalesce("r", F.lit(False)).alias("remove"))


# writes


@query(f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS size FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert_files(spark, sf_dir):
    files = files_of(spark, sf_dir).select("file_id", "path", "size", "doc_id")
    return store.upsert(files.filter("doc_id % 2 = 0"), files.filter("doc_id % 3 = 0").withColumn("size", F.col("size") + 1), "file_id").select("path", "size")


@query("SELECT 'files' AS of, doc_id AS id FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'chunks', doc_id FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'embeddings', vec_id FROM embeddings WHERE NOT (vec_id % 4 = 0 AND vec_id IN (SELECT doc_id FROM documents))")
def delete_cascade(spark, sf_dir):
    """What is left of the three tables without every fourth file."""
    files = files_of(spark, sf_dir)
    chunks = files.select("file_id", F.col("doc_id").alias("chunk_id"))
    left = store.delete_files(files, chunks, embeddings_of(spark, sf_dir), files.filter("doc_id % 4 = 0"))
    ids = [df.select(F.lit(name).alias("of"), F.col(key).alias("id")) for (name, key), df in zip((("files", "doc_id"), ("chunks", "chunk_id"), ("embeddings", "chunk_id")), left, strict=True)]
    return ids[0].unionByName(ids[1]).unionByName(ids[2])


@query("SELECT doc_id, vec_id IS NOT NULL AS cached FROM documents LEFT JOIN (SELECT vec_id, sha256(text) AS h FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY vec_id) = 1) ON h = sha256(text)")
def cache_probe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    entries = docs.join(read(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0"), F.col("vec_id") == F.col("doc_id")).select("content_hash", F.col("embedding").alias("vector"), F.col("doc_id").alias("chunk_id"))
    cache = entries.groupBy("content_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return store.probe_cache(docs, cache).select("doc_id", F.col("vector").isNotNull().alias("cached"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents JOIN embeddings ON vec_id = doc_id WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)")
def cache_store_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    entries = docs.join(read(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("content_hash", F.col("embedding").alias("vector"), F.col("doc_id").alias("chunk_id"))
    return store.new_cache_rows(docs.filter("doc_id % 5 = 0").select("content_hash"), entries).select("content_hash")


@query("""WITH RECURSIVE inputs AS (SELECT source, doc_id, (strlen(text) + 2) // 3 * 20 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE (strlen(text) + 2) // 3 * 20 <= 32000),
f(source, doc_id, i, t, n, full_, batch) AS (
  SELECT source, doc_id, i, t, 1, t::BIGINT, 0 FROM inputs WHERE i = 1
  UNION ALL
  SELECT x.source, x.doc_id, x.i, x.t, CASE WHEN f.n >= 950 OR f.full_ + x.t > 120000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 950 OR f.full_ + x.t > 120000 THEN x.t ELSE f.full_ + x.t END, f.batch + (f.n >= 950 OR f.full_ + x.t > 120000)::INT
  FROM f JOIN inputs x ON x.source = f.source AND x.i = f.i + 1)
SELECT source AS "group", batch, count(*) AS inputs, sum(t)::BIGINT AS tokens FROM f GROUP BY source, batch""")
def embed_batches(spark, sf_dir):
    tokens = (embedding.input_tokens(F.lit("text"), F.col("text"), F.lit(0)) * 20).cast("bigint")
    return embedding.batch_summary(embedding.batches(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", tokens.alias("tokens")), "source"))


@query("""WITH RECURSIVE inputs AS (SELECT doc_id, (strlen(text) + 2) // 3 * 4 AS t, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE (strlen(text) + 2) // 3 * 4 <= 32000),
f(doc_id, i, t, n, full_, batch) AS (
  SELECT doc_id, i, t, 1, t::BIGINT, 0 FROM inputs WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, x.t, CASE WHEN f.n >= 950 OR f.full_ + x.t > 120000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 950 OR f.full_ + x.t > 120000 THEN x.t ELSE f.full_ + x.t END, f.batch + (f.n >= 950 OR f.full_ + x.t > 120000)::INT
  FROM f JOIN inputs x ON x.i = f.i + 1)
SELECT doc_id AS id, batch, t::BIGINT AS tokens FROM f""")
def embed_batches_ungrouped(spark, sf_dir):
    """All inputs as one sequence."""
    tokens = (embedding.input_tokens(F.lit("text"), F.col("text"), F.lit(0)) * 4).cast("bigint")
    return embedding.batches(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens.alias("tokens"))).drop("group")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


@query("""SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, array_cosine_distance(e.embedding::DOUBLE[64], q.embedding::DOUBLE[64]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def ann_all_lists(spark, sf_dir):
    """The ten nearest of every twentieth vector, with all lists of the trained index looked into: the exact answer."""
    centers = materialize(ann.train(_vectors(spark, sf_dir)), "centers")
    dealt = materialize(ann.deal(_vectors(spark, sf_dir), centers), "lists")
    found = ann.nearest_of_many(dealt, centers, _asked(spark, sf_dir), TOP, centers.count())
    return found.withColumn("distance", F.round("distance", 6))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, sf_dir):
    """Whether searches of as many lists as were measured to be enough find nine tenths of the ten nearest of every twentieth vector."""
    centers = materialize(ann.train(_vectors(spark, sf_dir)), "centers")
    dealt = materialize(ann.deal(_vectors(spark, sf_dir), centers), "lists")
    asked = _asked(spark, sf_dir)
    found = ann.nearest_of_many(dealt, centers, asked, TOP, ann.calibrate(dealt, centers))
    exact = ann.nearest_of_many(dealt, centers, asked, TOP, centers.count())
    return asked.agg(F.count("*").alias("queries")).withColumn("reached", F.lit(ann.recall(found, exact) >= 0.9))


# modes, images, order


@query("""WITH modes(mode, t, a, p) AS (VALUES ('text', true, false, false), ('images', false, true, false), ('text_images', true, true, false), ('text_pdfimages', true, false, true), ('both', true, true, true))
SELECT mode, count(*) AS n FROM documents, modes WHERE CASE WHEN lang IN ('en', 'de') THEN t WHEN lang = 'fr' THEN a ELSE p END GROUP BY mode""")
def mode_routing(spark, sf_dir):
    """English and German documents as texts, French ones as pictures, others as pictures in PDFs."""
    lang = F.col("lang")
    docs = read(spark, sf_dir, "documents").select(F.when(lang.isin("en", "de"), "text").otherwise("image").alias("kind"), (F.coalesce(lang, F.lit("")) != "fr").alias("from_pdf"))
    fits = docs.select(F.explode(F.array_compact(F.array(*[F.when(chunking.takes(mode, F.col("kind"), F.col("from_pdf")), mode) for mode in chunking.MODES]))).alias("mode"))
    return fits.groupBy("mode").agg(F.count("*").alias("n"))


#: Pictures as wide and high as their texts are long, in some sense.
_W, _H = "((length(text) * 37) % 5000)", "((length(text) * 91 + length(source)) % 3600)"


@query(f"SELECT doc_id, {_W} AS width, {_H} AS height FROM documents WHERE {_W} BETWEEN 500 AND 4000 AND {_H} BETWEEN 350 AND 3000 AND {_W} * {_H} BETWEEN 175000 AND 12000000")
def image_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_W).cast("long").alias("width"), F.expr(_H).cast("long").alias("height"))
    return docs.filter(chunking.image_fits("width", "height"))


@query(f"""WITH i AS (SELECT strlen(text) * 900 AS size, {_W} AS w, {_H} + 1 AS h FROM documents)
SELECT CASE WHEN size < 100 THEN 'too_small_bytes' WHEN size > 10485760 THEN 'too_large_bytes' WHEN w < 500 OR h < 350 OR w * h < 175000 THEN 'too_small_dims' WHEN w > 4000 OR h > 3000 OR w * h > 12000000 THEN 'too_large_dims'
  WHEN w / h < 0.1 OR w / h > 10 THEN 'bad_aspect_ratio' ELSE 'accepted' END AS reason, count(*) AS n FROM i GROUP BY 1""")
def validator_histogram(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return images.histogram(docs.select(images.size_reason(F.octet_length("text") * 900, F.expr(_W), F.expr(f"{_H} + 1")).alias("reason")))


@query("""WITH c AS (SELECT source, doc_id, n_chars // 2000 AS page, CASE WHEN lang = 'en' THEN 'text' ELSE 'image' END AS kind FROM documents)
SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY page, kind <> 'text', doc_id) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY source))::INT AS total_chunks FROM c""")
def multimodal_order(spark, sf_dir):
    """A source's documents as one file's chunks: pages by length, none for the short ones, English ones as texts."""
    page = F.floor(F.col("n_chars") / 2000).cast("int")
    chunks = read(spark, sf_dir, "documents").select(
        F.col("source").alias("file_id"), "doc_id", F.when(page > 0, F.array(page)).alias("page_numbers"), F.when(F.col("lang") == "en", "text").otherwise("image").alias("content_type"), F.col("doc_id").cast("int").alias("chunk_index")
    )
    return chunking.merge_multimodal(chunks, "doc_id").select("doc_id", "chunk_index", "total_chunks")


# events


@query("""WITH s AS (SELECT 'index' || user_id % 7 AS index_path, event_type AS query, 's' || user_id % 3 AS strategy, (event_id % 5)::INT AS top_k, max(ts) AS ts FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY index_path ORDER BY ts DESC, query, strategy, top_k) AS place FROM s)
SELECT index_path, query, strategy, top_k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, place::INT AS place FROM r WHERE place <= 10""")
def recent_searches(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.concat(F.lit("index"), F.col("user_id") % 7).alias("index_path"), F.col("event_type").alias("query"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("strategy"), F.lit("").alias("content_filter"), (F.col("event_id") % 5).cast("int").alias("top_k"), "ts")
    return metadata.recent_searches(events).drop("content_filter").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_tail(spark, sf_dir):
    return metadata.log_tail(read(spark, sf_dir, "events")).select("event_id", "event_type")


@query("SELECT CASE WHEN event_type = 'view' THEN 'warning' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'success' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1")
def log_levels(spark, sf_dir):
    message = F.when(F.col("event_type") == "view", "Warning: slow").when(F.col("event_type") == "purchase", "✅ paid").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(text.log_level(message).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN d >= DATE '2024-01-30' THEN 'Today' WHEN d >= DATE '2024-01-29' THEN 'Yesterday' WHEN d >= DATE '2024-01-23' THEN 'Last 7 Days' ELSE 'Older' END AS bucket, count(*) AS n
FROM (SELECT CAST(ts AS DATE) AS d FROM events) GROUP BY 1""")
def index_age_buckets(spark, sf_dir):
    return read(spark, sf_dir, "events").select(paths.age_bucket(F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-30")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS preview,
  regexp_replace(source || ' (' || lang || ').d', '[^A-Za-z0-9_-]', '_', 'g') AS safe, lower(replace('C:\\Docs\\' || source, '\\', '/')) AS normal,
  CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 7 * 86400 THEN s // 86400 || 'd ago' ELSE strftime(t, '%Y-%m-%d') END AS age,
  round(CASE WHEN r < 0 THEN abs(r) * 100 ELSE (1 - r) * 100 END, 6) AS relevance
FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS t, epoch(TIMESTAMP '{TODAY} 00:00:00')::BIGINT - epoch(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT))::BIGINT AS s, n_chars / 10000.0::DOUBLE - 0.2::DOUBLE AS r FROM documents)""")
def display_fields(spark, sf_dir):
    """What lists and logs show of a file."""
    docs = read(spark, sf_dir, "documents")
    then = F.expr("timestampadd(HOUR, doc_id, timestamp'2024-01-01 00:00:00')")
    return docs.select(
        "doc_id", text.line_count("text").alias("lines"), text.argument_preview("text").alias("preview"), paths.safe_name(F.concat("source", F.lit(" ("), "lang", F.lit(").d"))).alias("safe"),
        paths.normalized(F.concat(F.lit("C:\\Docs\\"), "source")).alias("normal"), paths.relative_time(then, F.lit(f"{TODAY} 00:00:00")).alias("age"),
        F.round(vectors.relevance_percent(F.col("n_chars") / 10000.0 - 0.2), 6).alias("relevance"),
    )


_KIND = "CASE (turn * 7 + conv_id) % 5 WHEN 0 THEN 'thinking' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool_result' ELSE 'text' END"


@query(f"""WITH e AS (SELECT conv_id::VARCHAR AS chat_id, turn AS seq, {_KIND} AS kind, coalesce(text, '') AS body FROM conversations),
said AS (SELECT *, CASE WHEN kind IN ('thinking', 'text') AND lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS begins FROM e WHERE kind <> 'tool_result' WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
stepped AS (SELECT *, sum(begins) OVER (PARTITION BY chat_id ORDER BY seq) - 1 AS step, count(*) FILTER (kind = 'tool_call') OVER (PARTITION BY chat_id ORDER BY seq) AS call FROM said),
steps AS (SELECT chat_id, step::INT AS step, kind, string_agg(body, '' ORDER BY seq) AS body, CASE WHEN kind = 'tool_call' THEN max(call) END AS call FROM stepped GROUP BY chat_id, step, kind),
tools AS (SELECT *, sum(CASE kind WHEN 'tool_result' THEN 1 ELSE -1 END) OVER (PARTITION BY chat_id ORDER BY seq) AS excess, count(*) FILTER (kind = 'tool_result') OVER (PARTITION BY chat_id ORDER BY seq) AS n FROM e WHERE kind LIKE 'tool%'),
lost AS (SELECT *, greatest(0, max(excess) OVER (PARTITION BY chat_id ORDER BY seq)) AS lost FROM tools),
kept AS (SELECT chat_id, n - lost AS call, body AS result FROM (SELECT *, coalesce(lag(lost) OVER (PARTITION BY chat_id ORDER BY seq), 0) AS before FROM lost) WHERE kind = 'tool_result' AND lost = before)
SELECT steps.chat_id, step, kind, body, result FROM steps LEFT JOIN kept ON steps.chat_id = kept.chat_id AND steps.call = kept.call""")
def chat_steps(spark, sf_dir):
    """Turns as events of a chat: their kinds go round."""
    turns = read(spark, sf_dir, "conversations")
    return chat.chat_steps(turns.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("seq"), F.expr(_KIND).alias("kind"), F.col("text").alias("body")))


@query("SELECT conv_id, turn, role, length(text) AS n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 3")
def chat_history_tail(spark, sf_dir):
    """The last three turns of each conversation; kept in each task's part before they meet."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))
    return turns.withColumn("rank", F.row_number().over(last).cast("bigint")).filter("rank <= 3")


@query(f"""WITH {_CHUNKS}, {_NEAR}, found AS (SELECT chunk_id, content, distance FROM {_keyword_sql("license", 2 * TOP)}),
scored AS (SELECT chunk_id, distance, least(list_sum(list_transform(range(0, 32), lambda i: (substr(sha256('license'), (2 * i + 1)::INT, 2) = substr(sha256(content), (2 * i + 1)::INT, 2))::INT)) / 32.0::DOUBLE
  + (('0x' || substr(sha256(content), 1, 8))::UBIGINT % 100) / 1000.0::DOUBLE, 1.0::DOUBLE) AS score FROM found),
r AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS was, row_number() OVER (ORDER BY score DESC, chunk_id) AS now FROM scored)
SELECT chunk_id, was::INT AS was, now::INT AS now, (was - now)::INT AS rose FROM r""")
def rerank_rank_change(spark, sf_dir):
    found = search.keyword(chunks_of(spark, sf_dir), "license", 2 * TOP)
    return search.rank_change(found, search.rerank(found, "license"))


@query(f"WITH {_FILES} SELECT file_id, path, size FROM files WHERE path = '/src1/1.txt'")
def file_by_path(spark, sf_dir):
    return metadata.get_file(files_of(spark, sf_dir), path="/src1/1.txt").select("file_id", "path", "size")


@query("SELECT conv_id, to_json(list({'role': role, 'n': length(text)} ORDER BY turn))::VARCHAR AS body FROM conversations GROUP BY conv_id")
def json_results(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("n")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.to_json(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["n"].alias("n")))).alias("body"))
