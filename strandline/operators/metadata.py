"""Lookups and listings over the files and chunks of an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import paths

#: Directory names that browsing leaves out, case aside.
SKIPPED_NAMES = [
    "node_modules", ".npm", ".yarn", ".pnpm-store", "__pycache__", ".venv", "venv", "env", "dist",
    "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".cargo", ".gradle", ".git",
    ".svn", ".hg", ".bzr", "$recycle.bin", "recycler", "system volume information", "~snapshot", ".snapshot", "dfsrprivate",
    ".spotlight-v100", ".trashes", ".fseventsd", ".temporaryitems", "windows", "program files", "program files (x86)", "programdata", "recovery",
    "winsxs",
]
BROWSE_MOST = 500


def find_files(files: DataFrame, file_type: str = "", name_contains: str = "", modified_after: Column | str | None = None, modified_before: Column | str | None = None, subfolder: str = "", limit: int | None = None) -> DataFrame:
    """Files that meet all given conditions, by path.

    Type, part of the path and subfolder don't mind case; the subfolder is a path
    prefix; times are from ``modified_after`` on and before ``modified_before``.
    """
    tests = []
    time = lambda t: F.lit(t).cast("timestamp_ntz") if isinstance(t, str) else t
    if file_type:
        tests.append(F.lower("file_type") == file_type.lower())
    if name_contains:
        tests.append(F.contains(F.lower("path"), F.lit(name_contains.lower())))
    if modified_after is not None:
        tests.append(F.col("modified_at") >= time(modified_after))
    if modified_before is not None:
        tests.append(F.col("modified_at") < time(modified_before))
    if subfolder:
        tests.append(F.startswith(F.lower("path"), F.lit(subfolder.lower())))
    found = files.filter(reduce(lambda a, b: a & b, tests)) if tests else files
    found = found.orderBy("path")
    return found.limit(limit) if limit else found


def agent_find_files(files: DataFrame, root: str = "", file_type: str = "", name_contains: str = "", modified_after: str = "", modified_before: str = "", subfolder: str = "", limit: int = 0) -> DataFrame:
    """``find_files`` with the agent's rules: dates name whole days, a dot before the type goes, 50 rows unless asked, 200 at most.

    ``truncated`` says that there may be more.
    """
    limit = min(limit if limit > 0 else 50, 200)
    day_after = F.date_add(F.lit(modified_before).cast("date"), 1).cast("timestamp_ntz") if modified_before else None
    folder = (subfolder if subfolder.startswith("/") else f"{root.rstrip('/')}/{subfolder}").rstrip("/") + "/" if subfolder else ""
    found = find_files(files, file_type.removeprefix("."), name_contains, modified_after or None, day_after, folder, limit)
    rows = found.select("path", paths.basename("path").alias("file_name"), "file_type", F.col("size").alias("size_bytes"), F.date_format("modified_at", "yyyy-MM-dd").alias("modified_at"))
    return rows.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= limit)  # at most 200 rows


def get_file(files: DataFrame, file_id: str = "", path: str = "") -> DataFrame:
    """The file with this id, or else this path."""
    return files.filter(F.col("file_id") == file_id if file_id else F.col("path") == path)


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def newest_indexes(indexes: DataFrame, today: Column | str) -> DataFrame:
    """Indexes (index_name, last_modified), newest first, with the bucket of their age."""
    return indexes.withColumn("bucket", paths.age_bucket("last_modified", today)).orderBy(F.desc("last_modified"), "index_name")


def file_chunks(files: DataFrame, chunks: DataFrame, path: str, content_type: str = "") -> DataFrame:
    found = chunks.join(files.filter(F.col("path") == path).select("file_id"), "file_id", "left_semi")
    found = found.filter(F.col("content_type") == content_type) if content_type else found
    return found.orderBy("chunk_index")


def file_info(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file with its chunks; text and image chunks apart only where there are images."""
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("content_type") == "image").alias("images"))
    rows = files.join(counts, "file_id", "left")
    n, images = F.coalesce("chunks", F.lit(0)), F.coalesce("images", F.lit(0))
    return rows.select("path", paths.basename("path").alias("file_name"), "file_type", "size", n.alias("chunk_count"), F.when(images > 0, n - images).alias("text_chunks"), F.when(images > 0, images).alias("image_chunks"))


def list_indexes(indexes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each index (index_name, folder_path) with its number of chunks, 0 if it has none."""
    counts = chunks.groupBy("index_name").agg(F.count("*").alias("chunks"))
    return indexes.join(counts, "index_name", "left").select("index_name", "folder_path", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def list_dir(files: DataFrame, root: str) -> DataFrame:
    """What lies directly in ``root``: name, is_dir and size (of a file)."""
    top = root.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(top) + 1, 1 << 30)
    below = files.filter(F.col("path").startswith(top)).select(F.split(rest, "/")[0].alias("name"), rest.contains("/").alias("is_dir"), "size")
    return below.groupBy("name", "is_dir").agg(F.max(F.when(~F.col("is_dir"), F.col("size"))).alias("size"))


def browse(entries: DataFrame, indexed: DataFrame, most: int = BROWSE_MOST) -> DataFrame:
    """Entries (path, name, is_dir) to choose a folder from: folders first, by name, 500 at most.

    Dot names and SKIPPED_NAMES go. is_indexed says that ``indexed`` (path) has it;
    total counts what there is, truncated says that it is more than is shown.
    """
    shown = entries.filter(~F.col("name").startswith(".") & ~F.lower("name").isin(SKIPPED_NAMES))
    total = shown.agg(F.count("*").alias("total"))
    marks = indexed.select("path", F.lit(True).alias("mark")).distinct()
    first = shown.orderBy(F.desc("is_dir"), "name", "path").limit(most)
    rows = first.join(marks, "path", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("path", "name", "is_dir", F.coalesce("mark", F.lit(False)).alias("is_indexed"), "total", (F.col("total") > most).alias("truncated"))


def exists_in(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted paths that some index has."""
    return wanted.join(files.select("path"), "path", "left_semi")


def recent_searches(searches: DataFrame, kept: int = 10) -> DataFrame:
    """The last ten different searches of each index, newest first.

    ``searches`` has index_path, query, strategy, content_filter, top_k and ts. The
    latest time of each search is found before the ten are.
    """
    same = ["index_path", "query", "strategy", "content_filter", "top_k"]
    latest = searches.groupBy(*same).agg(F.max("ts").alias("ts"))
    place = Window.partitionBy("index_path").orderBy(F.desc("ts"), "query", "strategy", "content_filter", "top_k")
    return latest.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= kept)


def log_tail(logs: DataFrame, kept: int = 500) -> DataFrame:
    """The last 500 lines by time, then id."""
    return logs.orderBy(F.desc("ts"), F.desc("event_id")).limit(kept)
