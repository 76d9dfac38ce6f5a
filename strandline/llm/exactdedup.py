"""Exact deduplication as a stateful stream.

A stream of digests runs into keyed state that never expires and lies on disk
(RocksDB): for each digest the number of texts seen, the content locator (run,
file and row) of the first one, and the identifier and locator of the one that
stays. Each batch's digests that were hit are checked on their full bytes: the
new texts against the one that the first locator leads to. Digests under which
texts differ are remembered, and there the texts themselves decide. A later run
with the same folder goes on with the state and meets all earlier texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.text import whole
from strandline.workspace import exists, fresh_path, materialize, scratch

#: Digests of at most this many hits are sent to all executors (32 bytes each); more are joined by a shuffle.
SENT_DIGESTS = 200_000
#: Files that are named one by one when texts are read back.
MANY_FILES = 10_000
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # else each partition's store sets aside megabytes for its logs before it has a row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_AT = "struct<file: string, row: bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of the stream's own, with the settings of ``spark`` and those of its state."""
    own = spark.newSession()
    for key, value in (spark.conf.getAll | _ROCKSDB).items():
        if key in _ROCKSDB or spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__at``: the file and the row in it that each row comes from.

    Rows that don't come straight from files are first written to some.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__at")
    try:
        return docs.select("*", at)
    except AnalysisException:
        return materialize(docs, "dedup-input").select("*", at)


def read_back(places: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``places`` (digest and at) with the whole texts that stand there.

    Only the files named are read, or their folders where there are very many; up to
    SENT_DIGESTS places are sent to the files' rows, so that no other text is shuffled.
    A text that is gone or no longer has its digest is an error.
    """
    spark = places.sparkSession
    places = materialize(places.select("digest", "at").distinct(), "dedup-places")
    files = places.select("at.file").distinct()
    if places.isEmpty():
        return places.select("digest", "at", F.lit("").alias("text"))
    if files.count() > MANY_FILES:
        files = files.select(F.regexp_replace("file", "/[^/]*$", "").alias("file")).distinct()
    stored = located(spark.read.parquet(*[r.file for r in files.collect()]).select("text")).select(F.col("__at").alias("at"), whole("text").alias("text"))
    sent = F.broadcast(places) if places.count() <= SENT_DIGESTS else places
    found = stored.join(sent, "at").select("digest", "at", "text")
    changed = lambda at: F.raise_error(F.concat(F.lit("no longer the text that was seen: "), F.to_json(at))).cast("string")
    gone = places.join(stored.select("at").join(sent.select("at"), "at", "left_semi"), "at", "left_anti").select("digest", "at", changed(F.col("at")).alias("text"))
    return found.withColumn("text", F.when(digest(F.col("text")) == F.col("digest"), F.col("text")).otherwise(changed(F.col("at")))).unionByName(gone)


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that ever arrived, without their texts: digest, doc_id, at and the run they came with."""
    return spark.read.parquet(f"{folder}/arrivals")


def ingest(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> int:
    """Take the rows of ``docs`` (doc_id, text) into the state under ``folder``; returns the number of this run.

    A run that was lost on the way is finished first, from its locators. The
    texts have to stay where they are, as column text, for as long as the folder is used.
    """
    spark = docs.sparkSession
    run = 0
    while exists(spark, f"{folder}/arrivals/run={run}"):
        if not exists(spark, f"{folder}/done/run={run}"):
            _advance(spark, folder, run, digest)
        run += 1
    rows = located(docs.select("doc_id", "text")).select("doc_id", F.col("__at").alias("at"), whole("text").alias("text")).withColumn("digest", digest(F.col("text")))
    rows.select("digest", "doc_id", "at").write.mode("overwrite").parquet(f"{folder}/arrivals/run={run}")
    _advance(spark, folder, run, digest, rows)
    return run


def _advance(spark: SparkSession, folder: str, run: int, digest: Callable[[Column], Column], rows: DataFrame | None = None) -> None:
    """Run what has arrived through the state and check the hits of ``run``, whose texts are in ``rows`` if at hand."""
    schema = _arrivals(spark, folder).schema
    arrivals = _stream_session(spark).readStream.schema(schema).parquet(f"{folder}/arrivals")
    state = arrivals.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("run", "at")).alias("first"), F.max(F.struct("doc_id", "run", "at")).alias("last"))

    def check(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):  # this runs on a thread of the stream, outside its caller's scratch
            compare(batch, batch_id)

    def compare(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch_id}")
        hits = spark.read.parquet(f"{folder}/groups/batch={batch_id}").filter("n > 1").select("digest", "first")
        sent = hits.select("digest")
        if hits.count() <= SENT_DIGESTS:
            sent = F.broadcast(sent)
        if rows is None:
            new = read_back(_arrivals(spark, folder).filter(F.col("run") == run).join(sent, "digest", "left_semi"), digest).select("digest", "text")
        else:
            new = rows.join(sent, "digest", "left_semi").select("digest", "text")
        earlier = hits.filter(F.col("first.run") < run).select("digest", F.col("first.at").alias("at"))
        texts = new if earlier.isEmpty() else new.unionByName(read_back(earlier, digest).select("digest", "text"))
        # texts of one digest are all equal if the least is the greatest
        checked = texts.groupBy("digest").agg((F.min("text") != F.max("text")).alias("differ"))
        checked.filter("differ").select("digest").write.mode("overwrite").parquet(f"{folder}/clashes/batch={batch_id}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(check).start()
    query.awaitTermination()
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/run={run}")


def state_of(spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each row that ever arrived: doc_id, at, run and digest with its group's keep_id, keep_at and group_size."""
    if not exists(spark, f"{folder}/groups"):
        empty = f"digest binary, doc_id bigint, at {_AT}, run int, keep_id bigint, keep_at {_AT}, group_size bigint"
        return spark.createDataFrame([], empty)
    newest = spark.read.parquet(f"{folder}/groups").groupBy("digest").agg(F.max("n").alias("group_size"), F.max("last").alias("last"))
    newest = materialize(newest.select("digest", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.at").alias("keep_at")), "dedup-found")
    grouped = _arrivals(spark, folder).join(newest, "digest")
    clashing = materialize(spark.read.parquet(f"{folder}/clashes").select("digest").distinct(), "dedup-clashes")
    if clashing.isEmpty():
        return grouped
    members = _arrivals(spark, folder).join(clashing, "digest", "left_semi")
    apart = materialize(members.join(read_back(members, digest), ["digest", "at"]), "dedup-apart")
    by_text = apart.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "run", "at")).alias("last"))
    by_text = by_text.select("digest", "text", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.at").alias("keep_at"))
    return grouped.join(clashing, "digest", "left_anti").unionByName(apart.join(by_text, ["digest", "text"]).drop("text"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each row's doc_id, locator ``at`` and digest with its group's keep_id, keep_at and group_size.

    ``docs`` has doc_id and text. Texts are equal if all their bytes are; null
    counts as empty. Of a group the row with the largest doc_id stays (null is
    smaller than any), of rows with the same id the one that is last by locator.
    An empty table gives no rows; very long texts are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "dedup")
    ingest(docs, folder, digest)
    return state_of(spark, folder, digest).drop("run")


def kept() -> Column:
    return F.col("at") == F.col("keep_at")


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called."""
    rows = located(docs)
    dropped = groups(rows.drop("__at")).filter(~kept()).select(F.col("at").alias("__at"))
    return rows.join(dropped, "__at", "left_anti").drop("__at")
