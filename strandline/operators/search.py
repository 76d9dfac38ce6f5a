"""Semantic, keyword and hybrid top-k search, with reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths, vectors
from strandline.functions.text import contains_all, keywords, preview, relevance, trim_space

#: Columns of a result; image_data only travels for the few rows that are left.
RESULT = ["chunk_id", "file_path", "file_type", "content", "chunk_index", "total_chunks", "page_numbers", "content_type", "image_data", "distance"]
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
#: How many rows a caller gets without asking, and at most.
DEFAULT_TOP = {"http": 5, "agent": 8, "cli": 5, "ui": 10}
AGENT_MOST = 20
#: Up to so many ranked ids are sent to all executors.
SENT_ROWS = 10_000


def clamp_top(top: int | None, caller: str = "agent") -> int:
    """The number of results for a caller; the agent's is between 1 and 20."""
    if not top or top < 0:
        top = DEFAULT_TOP[caller]
    return max(1, min(top, AGENT_MOST)) if caller == "agent" else top


def candidates(k: int, filtered: bool) -> int:
    """How many nearest vectors are fetched before a filter on the content type."""
    return max(50, min(3 * k, 1000)) if filtered else k


def nearest(embeddings: DataFrame, query: Column, k: int, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """The k nearest vectors by exact cosine distance, ties by id; only ids and vectors are read."""
    scored = embeddings.select(F.col(id_col), vectors.cosine_distance(vector_col, query).alias("distance"))
    return scored.orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


Near = Callable[[int], DataFrame]


def semantic(chunks: DataFrame, embeddings: DataFrame, query: Column, k: int, content_type: str = "", exact: bool = False, id_col: str = "chunk_id", vector_col: str = "vector", near: Near | None = None) -> DataFrame:
    """The nearest chunks to a query vector.

    A content type is looked at after ``candidates`` have been cut off, so there may
    be fewer than k rows; ``exact`` looks first. The cut comes before the join, which sends its few rows to the chunks.
    ``near`` finds the nearest ids and distances in place of the exact search.
    """
    if content_type and exact:
        embeddings = embeddings.join(chunks.filter(F.col("content_type") == content_type).select(id_col), id_col, "left_semi")
    count = candidates(k, bool(content_type) and not exact)
    ranked = near(count) if near else nearest(embeddings, query, count, id_col, vector_col)
    found = chunks.join(F.broadcast(ranked) if k <= SENT_ROWS else ranked, id_col)
    if content_type:
        found = found.filter(F.col("content_type") == content_type)
    return found.orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def keyword(chunks: DataFrame, query: str, k: int, content_type: str = "", id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """The chunks that hold all keywords, by how often and how long they are; none without keywords."""
    words = keywords(query)
    if not words:
        return chunks.withColumn("distance", F.lit(None).cast("double")).limit(0)
    found = chunks.filter(contains_all(content, words))
    if content_type:
        found = found.filter(F.col("content_type") == content_type)
    scored = found.withColumn("relevance", relevance(content, words))
    top = scored.orderBy(F.desc("relevance"), id_col).limit(k)
    return top.withColumn("distance", 1.0 / (1.0 + F.col("relevance"))).drop("relevance")


def fuse(by_vector: DataFrame, by_word: DataFrame, k: int, weights: tuple[float, float] = (SEMANTIC_WEIGHT, KEYWORD_WEIGHT), id_col: str = "chunk_id") -> DataFrame:
    """One list from two: 1 - the weighted sum of (1 - distance); a hit that one arm lacks counts nothing there."""
    payload = [c for c in by_vector.columns if c not in (id_col, "distance")]
    s, w = by_vector.alias("s"), by_word.alias("w")
    both = s.join(w, id_col, "full_outer")
    share = lambda side, weight: F.coalesce((1.0 - F.col(f"{side}.distance")) * weight, F.lit(0.0))
    merged = both.select(id_col, *[F.coalesce(f"s.{c}", f"w.{c}").alias(c) for c in payload], (1.0 - share("s", weights[0]) - share("w", weights[1])).alias("distance"))
    return merged.orderBy("distance", id_col).limit(k)


def hybrid(chunks: DataFrame, embeddings: DataFrame, query: str, vector: Column, k: int, content_type: str = "", weights: tuple[float, float] = (SEMANTIC_WEIGHT, KEYWORD_WEIGHT), id_col: str = "chunk_id", vector_col: str = "vector", content: str = "content", near: Near | None = None) -> DataFrame:
    """Both searches at twice the rows, fused."""
    by_vector = semantic(chunks, embeddings, vector, 2 * k, content_type, id_col=id_col, vector_col=vector_col, near=near)
    return fuse(by_vector, keyword(chunks, query, 2 * k, content_type, id_col, content), k, weights, id_col)


def fuse_ranks(by_vector: DataFrame, by_word: DataFrame, k: int, constant: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion, a further strategy: the sum of 1 / (constant + rank) over the lists a hit is in."""
    from pyspark.sql import Window

    ranked = lambda df: df.select(id_col, F.row_number().over(Window.orderBy("distance", id_col)).alias("rank"))  # noqa: E731  a few rows
    both = ranked(by_vector).unionByName(ranked(by_word))
    return both.groupBy(id_col).agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


Scorer = Callable[[Column, Column], Column]


def rerank(results: DataFrame, query: str, k: int | None = None, score: Scorer = vectors.hash_rerank_score, id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """Results by a reranker's score, best first; the distance becomes minus the score, without a score they go."""
    scored = results.withColumn("relevance_score", score(F.lit(query), F.col(content))).filter("relevance_score is not null")
    best = scored.withColumn("distance", -F.col("relevance_score")).orderBy(F.desc("relevance_score"), id_col)
    return best.limit(k) if k else best


def ranked(results: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The few rows of a result with their place from 1."""
    from pyspark.sql import Window

    return results.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def rank_change(before: DataFrame, after: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Each reranked hit's place before and now, and how far it rose."""
    old = ranked(before, id_col).select(id_col, F.col("rank").alias("was"))
    new = ranked(after, id_col).select(id_col, F.col("rank").alias("now"))
    return new.join(old, id_col).select(id_col, "was", "now", (F.col("was") - F.col("now")).alias("rose"))


def search(chunks: DataFrame, embeddings: DataFrame, query: str, k: int, strategy: str = "semantic", content_type: str = "", embed: Callable[[Column], Column] | None = None, dimension: int = 64, near: Near | None = None) -> DataFrame:
    """Any strategy by name: keyword, hybrid, or else semantic."""
    vector = (embed or (lambda text: vectors.hash_embedding(text, dimension)))(F.lit(query))
    if strategy == "keyword":
        return keyword(chunks, query, k, content_type)
    if strategy == "hybrid":
        return hybrid(chunks, embeddings, query, vector, k, content_type, near=near)
    return semantic(chunks, embeddings, vector, k, content_type, near=near)


def api_projection(results: DataFrame, files: DataFrame) -> DataFrame:
    """What the HTTP search returns: names, trimmed text, whether there is an image, size and time of the file."""
    about = files.select(F.col("path").alias("file_path"), "size", "modified_at")
    few = results.limit(SENT_ROWS)  # a result has k rows; a limit tells the optimizer so
    return few.join(about, "file_path", "left").select("chunk_id", "file_path", paths.basename("file_path").alias("file_name"), trim_space("content").alias("content"), (F.length("image_data") > 0).alias("has_image"), "content_type", "size", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), "distance")


def agent_projection(results: DataFrame) -> DataFrame:
    return results.select("file_path", preview("content").alias("content"), "distance")


def files_in(results: DataFrame) -> DataFrame:
    """How many results, from how many files."""
    return results.agg(F.count("*").alias("n_results"), F.count_distinct("file_path").alias("n_files"))
