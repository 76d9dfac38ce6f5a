"""Chunks from texts, PDF pages and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.functions.text import as_column, sentences, token_estimate, trim_space

#: Tokens of a chunk and of the sentences that it repeats from the one before; a file up to WHOLE_FILE stays in one piece.
CHUNK_TOKENS, OVERLAP_TOKENS, WHOLE_FILE = 300, 10, 1000
#: A page with fewer tokens is left out.
PAGE_TOKENS = 30
#: Bytes beyond which a text file gets a row but no chunks.
TEXT_LIMIT = 500 * 1024
#: The sizes of images that are kept.
IMAGE_SIZES = {"width": (500, 4000), "height": (350, 3000), "pixels": (175_000, 12_000_000)}
#: What each mode takes in: texts, images on their own, images in PDFs.
MODES = {
    "text": (True, False, False),
    "images": (False, True, False),
    "text_images": (True, True, False),
    "text_pdfimages": (True, False, True),
    "both": (True, True, True),
}


def pack(ss: str, tokens: str, size: int, overlap: int) -> Column:
    """Chunk texts of the sentences in array column ``ss`` with their token counts in ``tokens``.

    The fold keeps only where chunks begin and what each repeats: sentences that
    lie directly before it, nearest first, as long as they fit into ``overlap``.
    """
    back = f"reverse(slice({tokens}, greatest(1, i - {overlap - 1}), least({overlap}, i)))"
    fits = f"aggregate({back}, named_struct('sum', cast(0 as bigint), 'n', 0, 'on', true), (b, t) -> IF(b.on AND b.sum + t <= {overlap}, named_struct('sum', b.sum + t, 'n', b.n + 1, 'on', true), named_struct('sum', b.sum, 'n', b.n, 'on', false)), b -> b.n)"
    # what a new chunk begins with
    repeated = f"array_join(reverse(slice({ss}, i - ({fits}) + 1, {fits})), ' ')"
    fresh = f"transform(array({repeated}), r -> named_struct('full', (octet_length(r) + 2) div 3 + {tokens}[i], 'begins', concat(a.begins, array(named_struct('at', i, 'repeated', r)))))[0]"
    more = f"named_struct('full', a.full + {tokens}[i], 'begins', a.begins)"
    start = "named_struct('full', cast(0 as bigint), 'begins', array(named_struct('at', 0, 'repeated', '')))"
    folded = f"aggregate(sequence(0, size({ss}) - 1), {start}, (a, i) -> IF(a.full > 0 AND a.full + {tokens}[i] > {size}, {fresh}, {more}), a -> a.begins)"
    ends = f"coalesce(get(begins, n + 1).at, size({ss}))"
    piece = f"concat_ws(' ', IF(b.repeated = '', null, b.repeated), array_join(slice({ss}, b.at + 1, {ends} - b.at), ' '))"
    return F.expr(f"transform(array({folded}), begins -> transform(begins, (b, n) -> {piece}))[0]")


def split_texts(texts: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, whole: int | None = None) -> DataFrame:
    """``texts`` with ``__chunks``: the chunk texts of each row.

    Up to ``whole`` tokens (``size`` if not given) the text stays as it is, even if empty;
    a single sentence is never cut.
    """
    limit = size if whole is None else whole
    large = token_estimate(text) > limit
    cut = texts.withColumn("__ss", F.when(large, F.filter(sentences(text), lambda s: s != "")))
    cut = cut.withColumn("__tokens", F.transform("__ss", lambda s: token_estimate(s).cast("bigint")))
    chunks = F.transform(pack("__ss", "__tokens", size, overlap), trim_space)
    return cut.withColumn("__chunks", F.when(large & (F.size("__ss") > 0), chunks).when(large, F.array().cast("array<string>")).otherwise(F.array(text))).drop("__ss", "__tokens")


def as_chunks(rows: DataFrame) -> DataFrame:
    """Rows with the file's columns and ``__chunks`` become rows of the chunks table."""
    # a plain explode has the optimizer test the list's size first, which packs each text a second time
    each = rows.select("file_id", "path", "file_type", "__chunks", F.posexplode_outer("__chunks").alias("chunk_index", "content")).filter("chunk_index is not null")
    return each.select(
        paths.chunk_id("file_id", "chunk_index").alias("chunk_id"),
        "file_id",
        F.col("path").alias("file_path"),
        "file_type",
        "chunk_index",
        F.size("__chunks").alias("total_chunks"),
        "content",
        F.lit(None).cast("array<int>").alias("page_numbers"),
        F.lit("text").alias("content_type"),
        F.lit(None).cast("binary").alias("image_data"),
    )


def chunk_text_files(files: DataFrame) -> DataFrame:
    """Chunks of text files (file_id, path, file_type, text); empty and over-long ones have none."""
    some = files.filter((F.col("text") != "") & (F.octet_length("text") <= TEXT_LIMIT))
    return as_chunks(split_texts(some, whole=WHOLE_FILE))


def chunk_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of PDFs, page by page; a PDF whose pages all are sparse gets one empty chunk, one of blank pages none.

    ``files`` has file_id, path and file_type, ``pages`` file_id, page_number and text.
    """
    text = trim_space("text")
    tokens = token_estimate(text)
    rich = pages.filter((text != "") & (tokens >= PAGE_TOKENS))
    rich = rich.withColumn("text", F.when(tokens <= CHUNK_TOKENS, text).otherwise(F.col("text")))
    cut = split_texts(rich).select("file_id", "page_number", F.posexplode_outer("__chunks").alias("at", "content")).filter("at is not null")
    by_file = Window.partitionBy("file_id")
    numbered = cut.withColumn("chunk_index", F.row_number().over(by_file.orderBy("page_number", "at")) - 1).withColumn("total_chunks", F.count("*").over(by_file).cast("int"))
    some = pages.groupBy("file_id").agg(F.max(text != "").alias("some")).filter("some").select("file_id")
    rows = files.select("file_id", "path", "file_type").join(some, "file_id").join(numbered, "file_id", "left")
    return rows.select(
        paths.chunk_id("file_id", F.coalesce("chunk_index", F.lit(0))).alias("chunk_id"),
        "file_id",
        F.col("path").alias("file_path"),
        "file_type",
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("total_chunks", F.lit(1)).alias("total_chunks"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.when(F.col("page_number").isNotNull(), F.array("page_number")).alias("page_numbers"),
        F.lit("text").alias("content_type"),
        F.lit(None).cast("binary").alias("image_data"),
    )


def page_class(pages: DataFrame) -> DataFrame:
    """``pages`` with ``page_class``: rich, sparse (some text, or a PDF of at most three pages) or null."""
    tokens = token_estimate(trim_space("text"))
    few = F.count("*").over(Window.partitionBy("file_id")) <= 3
    return pages.withColumn("page_class", F.when(tokens >= PAGE_TOKENS, "rich").when((tokens > 0) | few, "sparse"))


def image_fits(width: Column | str, height: Column | str) -> Column:
    """Whether an image's sizes are within IMAGE_SIZES."""
    w, h = as_column(width), as_column(height)
    return w.between(*IMAGE_SIZES["width"]) & h.between(*IMAGE_SIZES["height"]) & (w * h).between(*IMAGE_SIZES["pixels"])


def image_chunks(files: DataFrame, images: DataFrame) -> DataFrame:
    """One chunk for each image of a PDF that fits, in no order yet (see ``merge_multimodal``)."""
    # fixed value: the caption's format
    caption = F.format_string("Image from page %d (%dx%d, %s)", "page_number", "width", "height", "format")
    rows = images.filter(image_fits("width", "height")).join(files.select("file_id", "path", "file_type"), "file_id")
    return rows.select(
        "file_id", F.col("path").alias("file_path"), "file_type", F.lit(0).alias("chunk_index"), caption.alias("content"), F.array("page_number").alias("page_numbers"), F.lit("image").alias("content_type"), F.encode("base64", "UTF-8").alias("image_data")
    )


def standalone_image_chunks(images: DataFrame) -> DataFrame:
    """One chunk for each image file (file_id, path, file_type, width, height, format, content)."""
    from strandline.functions.text import plain_base64

    # fixed value: the caption's format
    caption = F.format_string("Image file: %s (%dx%d, %s)", paths.basename("path"), "width", "height", "format")
    return images.select(
        paths.chunk_id("file_id", F.lit(0)).alias("chunk_id"), "file_id", F.col("path").alias("file_path"), "file_type", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), caption.alias("content"), F.lit(None).cast("array<int>").alias("page_numbers"), F.lit("image").alias("content_type"), F.encode(plain_base64("content"), "UTF-8").alias("image_data")
    )


def merge_multimodal(chunks: DataFrame, *tie: str) -> DataFrame:
    """Put text and image chunks of each file in order and number them again.

    By first page (0 without one), texts before images, then the index so far;
    equal ones by ``tie`` columns, content if none are named.
    """
    page = F.coalesce(F.get("page_numbers", F.lit(0)), F.lit(0))
    by_file = Window.partitionBy("file_id")
    order = by_file.orderBy(page, F.col("content_type") != "text", "chunk_index", *(tie or ("content",)))
    numbered = chunks.withColumn("__at", F.row_number().over(order) - 1).withColumn("total_chunks", F.count("*").over(by_file).cast("int"))
    return numbered.withColumn("chunk_index", F.col("__at")).withColumn("chunk_id", paths.chunk_id("file_id", "__at")).drop("__at")


def takes(mode: str, kind: Column, from_pdf: Column) -> Column:
    """Whether a mode takes in a file or chunk of this kind (text or image)."""
    text, alone, in_pdf = MODES[mode]
    return F.when(kind == "text", text).when(from_pdf, in_pdf).otherwise(alone)


def filter_mode(chunks: DataFrame, mode: str) -> DataFrame:
    """Of a file's chunks those that a mode asks for: texts, images, or all."""
    return {"text": chunks.filter("content_type = 'text'"), "images": chunks.filter("content_type = 'image'"), "text_images": chunks.filter("content_type in ('text', 'image')")}.get(mode, chunks)
