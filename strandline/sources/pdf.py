"""PDF text, metadata, images and pages, by whatever reader is plugged in.

No PDF library is part of the engine. A reader is a function from a file's bytes
to its parts; ``pypdf`` is used if it can be imported, else reading raises
``PdfUnavailable`` unless a reader is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.schemas import PDF_IMAGES, PDF_PAGES

Pages = Callable[[bytes], list[str]]
#: (page, format, width, height, base64) of each image in a file; the base64 picture of one page, from 1, or nothing.
Images = Callable[[bytes], list[tuple[int, str, int, int, str]]]
Renderer = Callable[[bytes, int], str | None]


class PdfUnavailable(RuntimeError):
    """No PDF reader is installed and none was given."""


def default_reader() -> Pages:
    try:
        import io

        from pypdf import PdfReader
    except ImportError as missing:
        raise PdfUnavailable("install pypdf or pass a reader") from missing

    def read(data: bytes) -> list[str]:
        texts = []
        for page in PdfReader(io.BytesIO(data)).pages:
            try:
                texts.append(page.extract_text() or "")
            except Exception:  # a malformed page is an empty one
                texts.append("")
        return texts

    return read


def read_pages(files: DataFrame, reader: Pages | None = None) -> DataFrame:
    """file_id, page_number (from 1) and text of each page of the PDFs in ``files`` (file_id, content).

    A file that can't be opened has no pages. One task works through its files one by one.
    """
    read = reader or default_reader()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, content in frame.itertuples(index=False, name=None):
                try:
                    rows += [(file_id, n, " ".join(text.split())) for n, text in enumerate(read(bytes(content)), 1)]
                except Exception:  # one broken file doesn't end the job
                    continue
            yield pd.DataFrame(rows, columns=["file_id", "page_number", "text"])

    return files.select("file_id", "content").mapInPandas(run, PDF_PAGES)


def read_images(files: DataFrame, reader: Images) -> DataFrame:
    """Images in PDFs by a reader that gives (page, format, width, height, base64) for each; errors give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, content in frame.itertuples(index=False, name=None):
                try:
                    rows += [(file_id, *found) for found in reader(bytes(content))]
                except Exception:  # errors give no images
                    continue
            yield pd.DataFrame(rows, columns=["file_id", "page_number", "format", "width", "height", "base64"])

    return files.select("file_id", "content").mapInPandas(run, PDF_IMAGES)


def render_pages(pages: DataFrame, renderer: Renderer | None = None) -> DataFrame:
    """Base64 pictures of pages (file_id, page_number, content) by an outside renderer; a failure gives none."""
    if renderer is None:
        raise PdfUnavailable("pass a renderer, for instance around pdftoppm")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, page, content in frame.itertuples(index=False, name=None):
                try:
                    rows.append((file_id, page, renderer(bytes(content), page)))
                except Exception:  # the page stays without a picture
                    continue
            yield pd.DataFrame(rows, columns=["file_id", "page_number", "base64"])

    return pages.select("file_id", "page_number", "content").mapInPandas(run, "file_id string, page_number int, base64 string")


def document_metadata(info: DataFrame) -> DataFrame:
    """Titles and dates from a reader's raw fields: the file's name stands in for a missing title."""
    return info.select("file_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), paths.basename("path")).alias("title"), "creator", paths.pdf_date("created").alias("created"), paths.pdf_date("modified").alias("modified"), "page_count")
