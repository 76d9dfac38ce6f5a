"""Change detection between a folder listing and the files table, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths


def compare(listing: DataFrame, files: DataFrame, network: Column | None = None) -> DataFrame:
    """path and reason (new, modified, deleted, unchanged) for every path of either side.

    ``listing`` has path, size, modified_at, file_hash (null where it could not be
    read) and may have ``failed``: a path that could not be looked at is neither
    changed nor deleted. A changed size is a change; an equal time is none; for
    another time the hashes decide, on network paths the time alone.
    """
    on_network = paths.is_network("path") if network is None else network
    failed = F.coalesce(F.col("l.failed"), F.lit(False)) if "failed" in listing.columns else F.lit(False)
    both = listing.withColumn("listed", F.lit(True)).alias("l").join(files.withColumn("stored", F.lit(True)).alias("f"), "path", "full_outer")
    reason = (
        F.when(failed, "failed")
        .when(F.col("stored").isNull(), "new")
        .when(F.col("listed").isNull(), "deleted")
        .when(F.col("l.size") != F.col("f.size"), "modified")
        .when(F.col("l.modified_at") == F.col("f.modified_at"), "unchanged")
        .when(on_network, "modified")
        .when(F.col("l.file_hash") == F.col("f.file_hash"), "unchanged")
        .otherwise("modified")
    )
    live = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(f"f.{c}"))  # noqa: E731  deleted ones as stored
    return both.select("path", reason.alias("reason"), paths.file_type("path").alias("file_type"), live("size").alias("size"), live("modified_at").alias("modified_at"))


def to_hash(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Paths whose bytes have to be read: new ones, and those of equal size with another time that are not on a network."""
    stored = files.select("path", F.col("size").alias("__size"), F.col("modified_at").alias("__time"))
    residual = (F.col("size") == F.col("__size")) & (F.col("modified_at") != F.col("__time")) & ~paths.is_network("path")
    return listing.join(stored, "path", "left").filter(F.col("__size").isNull() | residual).select("path")


def changes(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("reason").isin("new", "modified", "deleted"))


def status(compared: DataFrame, files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: total stored files, those up to date, what waits to be added, updated and deleted, and chunks."""
    count = lambda reason: F.count_if(F.col("reason") == reason)
    row = compared.agg(count("new").alias("pending_add"), count("modified").alias("pending_update"), count("deleted").alias("pending_delete"))
    total = files.agg(F.count("*").alias("total"))
    out = total.crossJoin(row).withColumn("up_to_date", F.col("total") - F.col("pending_update") - F.col("pending_delete"))
    return out.crossJoin(chunks.agg(F.count("*").alias("chunks"))) if chunks is not None else out  # one row each


def name_preview(compared: DataFrame, shown: int = 10) -> DataFrame:
    """For each kind of change the first ten names by path, and how many more there are.

    Each task keeps its own first ten before they meet.
    """
    from pyspark.sql import Window

    rows = changes(compared).withColumn("__part", F.spark_partition_id())
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy("reason", "__part").orderBy("path"))).filter(F.col("__own") <= shown)
    first = own.withColumn("__at", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).filter(F.col("__at") <= shown)
    names = first.groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("path"))), lambda x: paths.basename(x["path"])).alias("names"))
    counts = rows.groupBy("reason").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.array(F.format_string("...and %d more", F.col("n") - shown))).otherwise(F.array().cast("array<string>"))
    return counts.join(names, "reason").select("reason", F.array_join(F.concat("names", more), ", ").alias("preview"))


def resolve(compared: DataFrame, incremental: bool = True) -> tuple[DataFrame, DataFrame]:
    """(paths to process, paths whose rows go first): a full run takes all that is listed."""
    if not incremental:
        return compared.filter("reason not in ('deleted', 'failed')").select("path"), compared.select("path").limit(0)
    return compared.filter("reason in ('new', 'modified')").select("path"), compared.filter("reason in ('modified', 'deleted')").select("path")
