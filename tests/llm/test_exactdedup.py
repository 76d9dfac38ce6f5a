import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import exactdedup

ROWS = [(1, "a"), (2, "a"), (3, "b"), (9, "a"), (4, None), (5, ""), (None, "a"), (None, "only"), (7, "x" * 300_000), (8, "x" * 300_000), (3, "b"), (10, "A"), (11, "a ")]


def expected():
    groups = {}
    for doc, text in ROWS:
        groups.setdefault(text or "", []).append(doc)
    return sorted(((doc, max((d for d in groups[text or ""] if d is not None), default=None), len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()) for doc, text in ROWS), key=str)


def docs(spark):
    return spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, digest string").repartition(3)


def test_groups(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "in"))
    for df in (docs(spark), spark.read.parquet(str(tmp_path / "in"))):
        rows = exactdedup.groups(df).withColumn("kept", exactdedup.kept()).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in rows), key=str) == expected()
        assert sorted(str(r.doc_id) for r in rows if r.kept) == sorted(map(str, [9, 3, 5, None, 8, 10, 11]))


def test_texts_that_share_a_digest(spark):
    weak = lambda text: F.substring(exactdedup.sha256(text), 1, 0)  # noqa: E731  all the same
    rows = exactdedup.groups(docs(spark), digest=weak).withColumn("kept", exactdedup.kept()).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == sorted((e[:3] for e in expected()), key=str)
    assert sum(r.kept for r in rows) == 7


WEAK = lambda text: F.substring(exactdedup.sha256(text), 1, 0)  # noqa: E731  all the same


@pytest.mark.parametrize("digest", [exactdedup.sha256, WEAK])
@pytest.mark.parametrize("lost", [False, True])
def test_state_goes_on(spark, tmp_path, digest, lost):
    """Two runs into one state; the second's texts are compared with what the first's locators lead to."""
    folder, seen = str(tmp_path / "strandline" / "state"), []
    for run, texts in enumerate((["a", "b"], ["a", "c", "a"], ["d", "b"])):
        rows = [(10 * run + i, t) for i, t in enumerate(texts)]
        seen += rows
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in{run}"))
        docs = spark.read.parquet(str(tmp_path / f"in{run}"))
        if lost and run == 1:
            # only the arrivals were written before the run was lost
            rows = exactdedup.located(docs).select("doc_id", F.col("__at").alias("at"), digest(F.col("text")).alias("digest"))
            rows.select("digest", "doc_id", "at").write.parquet(f"{folder}/arrivals/run=1")
        else:
            assert exactdedup.ingest(docs, folder, digest) == run
    groups = {}
    for doc, text in seen:
        groups.setdefault(text, []).append(doc)
    found = exactdedup.state_of(spark, folder, digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == sorted((doc, max(groups[t]), len(groups[t])) for doc, t in seen)
    clashes = spark.read.parquet(f"{folder}/clashes").count()
    assert bool(clashes) == (digest is WEAK)


def test_text_that_changed_behind_its_locator(spark, tmp_path):
    folder = str(tmp_path / "strandline" / "state")
    first = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    first.write.parquet(str(tmp_path / "in"))
    exactdedup.ingest(spark.read.parquet(str(tmp_path / "in")), folder)
    file = next((tmp_path / "in").glob("*.parquet"))
    pq.write_table(pa.table({"doc_id": [1], "text": ["x"]}), file)
    (tmp_path / "in" / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="no longer the text"):
        exactdedup.ingest(spark.createDataFrame([(2, "a")], "doc_id long, text string"), folder)


def test_texts_are_read_back_without_moving_the_others(spark, tmp_path, monkeypatch):
    """Few places are sent to the files; a place that is there no more is an error; folders stand in for very many files."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    seen = exactdedup.located(spark.read.parquet(str(tmp_path / "in"))).select(F.col("__at").alias("at"), exactdedup.sha256(F.col("text")).alias("digest"), "text")
    places = seen.filter("text in ('text 3', 'text 33')").select("digest", "at").cache()
    found = exactdedup.read_back(places, exactdedup.sha256)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Union")[-1].split("LeftAnti")[0]
    assert sorted(r.text for r in found.collect()) == ["text 3", "text 33"]
    monkeypatch.setattr(exactdedup, "MANY_FILES", 0)
    assert sorted(r.text for r in exactdedup.read_back(places, exactdedup.sha256).collect()) == ["text 3", "text 33"]
    lost = places.withColumn("at", F.struct(F.col("at.file").alias("file"), F.col("at.row") + 1000).cast("struct<file: string, row: bigint>"))
    with pytest.raises(Exception, match="no longer the text"):
        exactdedup.read_back(lost, exactdedup.sha256).collect()


def test_settings_stay(spark):
    before = spark.conf.getAll
    exactdedup.groups(docs(spark)).count()
    assert spark.conf.getAll == before


def test_distinct_and_empty(spark):
    kept = exactdedup.distinct(docs(spark))
    assert kept.columns == ["doc_id", "text", "digest"] and kept.count() == 7
    assert exactdedup.groups(docs(spark).limit(0)).count() == 0 and exactdedup.distinct(docs(spark).limit(0)).count() == 0
