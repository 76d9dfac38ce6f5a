"""The engine: index folders, search them, and the tools an agent calls."""

from __future__ import annotations

import hashlib
import posixpath
import threading
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandline import workspace
from strandline.functions import paths
from strandline.functions.text import read_head
from strandline.operators import ann, changes, chunking, embedding, metadata, search, store
from strandline.plans import service
from strandline.sources import folder, pdf
from strandline.workspace import materialize

#: How long a writer that vanished keeps others out; a running one renews its lease.
LEASE_SECONDS = 600.0
COUNTED = ("new", "modified", "deleted")
#: Fixed value: what the file reader returns of a file at most.
READ_BYTES = 50 * 1024
#: Types that the file reader refuses.
UNREADABLE = {".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico", ".webp", ".exe", ".dll", ".so", ".dylib", ".bin", ".zip", ".gz", ".tar", ".rar", ".7z"}


class Index:
    """One folder's index under ``root``; the embedder can be replaced.

    PDFs take outside helpers: ``pdf_reader`` gives their pages' texts, ``pdf_images``
    the images in them, ``renderer`` a picture of a whole page. ``approximate`` keeps
    trained lists of the vectors beside them. ``progress`` tells how far ``update`` is.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, dimension: int = 64, embed: embedding.Embedder | None = None, model: str = "offline", pdf_reader: pdf.Pages | None = None, pdf_images: pdf.Images | None = None, renderer: pdf.Renderer | None = None, approximate: bool = False, progress: service.Progress | None = None):
        self.spark, self.source, self.embed, self.model, self.pdf_reader = spark, source.rstrip("/"), embed or embedding.offline(dimension), model, pdf_reader
        self.pdf_images, self.renderer, self.approximate = pdf_images, renderer, approximate
        self.progress, self.answers = progress or service.Progress(), service.ResultCache()
        self._stop = threading.Event()
        self.store = store.Store(spark, f"{root.rstrip('/')}/{paths.plain_name(self.source.rsplit('/', 1)[-1])}-{hash_name(self.source)}")
        self.tag = f"update-{hash_name(self.store.root)}"

    @cached_property
    def dimension(self) -> int:
        return embedding.detect_dimension(self.spark, self.embed)

    def _listing(self, files: DataFrame) -> DataFrame:
        """The folder now; bytes are read only of stored files whose hash decides. A file that can't be read is neither changed nor deleted."""
        listing = materialize(folder.scan(self.spark, self.source), "listing")
        deciding = changes.to_hash(listing, files).join(files.select("path"), "path", "left_semi")
        hashes = materialize(folder.contents(listing.join(deciding, "path", "left_semi"), F.lit(False)), "hashes")
        hashes = hashes.select("path", "file_hash", F.col("file_hash").isNull().alias("failed"))
        return listing.join(hashes, "path", "left")

    def compared(self, files: DataFrame) -> DataFrame:
        return materialize(changes.compare(self._listing(files), files), "compared")

    def update(self, mode: str = "both", incremental: bool = True) -> dict[str, int]:
        """Bring the index up to date; returns the counts of files added, updated and deleted.

        All tables change in one commit, under the index's lease: readers see the
        whole run or nothing of it, another writer is told that the index is Busy.
        Nothing is written when nothing changed.
        """
        self._stop.clear()
        with workspace.scratch(self.spark), service.tagged(self.spark, self.tag):
            before = self.store.snapshot()
            same = before.get_metadata("model") == self.model and before.get_metadata("dimension") == str(self.dimension)
            if incremental and same:
                compared = self.compared(before.read("files"))
                if changes.changes(compared).isEmpty():
                    return dict.fromkeys(COUNTED, 0)
            with self.store.log.lease(LEASE_SECONDS) as fence:
                index = self.store.begin(fence)
                if index.get_metadata("model") is not None and not same:
                    index.drop()
                if not incremental:
                    index.clear()
                if not (incremental and same and index.base.tables == before.state.tables):
                    compared = self.compared(index.read("files"))
                counts = self._update(index, compared, mode, incremental)
                self._go_on()
                self.store.commit(index)
        return counts

    def _update(self, index: store.Transaction, compared: DataFrame, mode: str, incremental: bool) -> dict[str, int]:
        wanted, outdated = changes.resolve(compared, incremental)
        counts = dict(compared.groupBy("reason").count().collect())
        if incremental and (counts.get("modified", 0) or counts.get("deleted", 0)):
            index.delete_files(materialize(outdated.select(paths.file_id("path").alias("file_id")), "outdated"))
        files = wanted.join(compared.select("path", "file_type", "size", "modified_at"), "path")
        files = files.withColumn("file_id", paths.file_id("path")).withColumn("kind", paths.kind("file_type"))
        files = materialize(files.filter(chunking.takes(mode, F.when(F.col("kind") == "image", "image").otherwise("text"), F.lit(False))), "wanted")
        long = (F.col("kind") == "text") & (F.col("size") > chunking.TEXT_LIMIT)
        counted, total = self.spark.sparkContext.accumulator(0), files.count()
        with self.progress.phase("read", total, lambda: counted.value):
            read = folder.contents(files.select("path", "size", "kind"), ~long, counted)
            files = materialize(files.join(read.filter("file_hash is not null"), "path"), "contents")
        self._go_on()
        with self.progress.phase("chunk", total, lambda: 0):
            chunks = materialize(self._chunks(files, mode), "chunks")
        self._go_on()
        vectors, fresh = embedding.resolve(chunks, index.read("embedding_cache"), self.embed)
        fresh = materialize(fresh, "fresh")
        with self.progress.phase("embed", chunks.count(), lambda: 0):
            vectors = materialize(vectors.select("chunk_id", "vector"), "vectors")
        # a file whose chunks failed is not recorded, so the next run takes it up again; one that is too large to be held has a row without chunks
        done = files.join(chunks.select("file_id").distinct().withColumn("has", F.lit(True)), "file_id", "left").filter(F.col("has") | F.col("content").isNull())
        new = store.embedding_rows(vectors)
        index.append("chunks", chunks)
        index.append("embeddings", new)
        index.append("embedding_cache", store.new_cache_rows(index.read("embedding_cache"), fresh.withColumn("chunk_id", F.lit(""))).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")))
        index.append("files", done.withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz")))
        told = {"model": self.model, "dimension": str(self.dimension), "folder_path": self.source, "schema_version": "2"}
        index.set_metadata(**told, **(self._lists(index, new, incremental) if self.approximate else {}))
        return {k: counts.get(k, 0) for k in COUNTED}

    def _lists(self, index: store.Transaction, new: DataFrame, incremental: bool) -> dict[str, str]:
        """The approximate index after a run: trained again, or new vectors dealt to the present lists and the index marked stale; returns its metadata."""
        vectors = index.read("embeddings")
        total, trained = vectors.count(), int(index.get_metadata("lists_trained") or 0)
        todo = embedding.rebuild_policy(trained, total) if incremental and trained else "rebuild"
        if todo == "rebuild":
            centers = materialize(ann.train(vectors, total), "centers")
            index.clear("lists")
            index.replace("centers", centers)
            index.append("lists", ann.deal(vectors, centers))
            return {"lists_trained": str(total), "lists_stale": "false", "lists_probed": str(ann.calibrate(index.read("lists"), centers))}
        if not new.isEmpty():
            index.append("lists", ann.deal(new, index.read("centers")))
            return {"lists_stale": "true"}
        return {}

    def rebuild_if_stale(self) -> bool:
        """Train the approximate index again if vectors came since; whether it was."""
        if self.store.get_metadata("lists_stale") != "true":
            return False
        with workspace.scratch(self.spark), self.store.log.lease(LEASE_SECONDS) as fence:
            index = self.store.begin(fence)
            index.set_metadata(**self._lists(index, index.read("embeddings"), incremental=False))
            self.store.commit(index)
        return True

    def _chunks(self, files: DataFrame, mode: str) -> DataFrame:
        files = files.filter("content is not null")
        texts = files.filter("kind = 'text'").withColumn("text", folder.decode_text("content"))
        chunks = chunking.chunk_text_files(texts)
        images = files.filter("kind = 'image'").withColumns({"format": folder.image_format("content"), "s": folder.image_size("content")}).filter("s is not null")
        chunks = chunks.unionByName(chunking.standalone_image_chunks(images.withColumns({"width": F.col("s.width"), "height": F.col("s.height")})))
        pdfs = files.filter("kind = 'pdf'")
        try:
            reader = self.pdf_reader or pdf.default_reader()
        except pdf.PdfUnavailable:
            return chunks  # PDFs stay unrecorded until a reader is there
        pages = materialize(pdf.read_pages(pdfs, reader), "pages")
        of_pdfs = chunking.chunk_pages(pdfs, pages)
        pictures = self._pictures(pdfs, pages) if chunking.MODES[mode][2] else None
        if pictures is not None:
            both = of_pdfs.unionByName(chunking.image_chunks(pdfs, pictures), allowMissingColumns=True)
            of_pdfs = chunking.merge_multimodal(both, "content", "image_data")
        return chunks.unionByName(chunking.filter_mode(of_pdfs, mode))

    def _pictures(self, pdfs: DataFrame, pages: DataFrame) -> DataFrame | None:
        """Pictures of sparse pages, and the images in all other pages of some class; a page that can't be drawn is read for its images."""
        at, found = ["file_id", "page_number"], None
        classed = chunking.page_class(pages).filter("page_class is not null")
        if self.renderer:
            sparse = classed.filter("page_class = 'sparse'").join(pdfs.select("file_id", "content"), "file_id")
            drawn = materialize(pdf.render_pages(sparse, self.renderer).filter("base64 is not null"), "drawn")
            data = F.unbase64("base64")
            sized = drawn.withColumns({"format": folder.image_format(data), "s": folder.image_size(data)})
            found = sized.select(*at, "format", "s.width", "s.height", "base64")
            classed = classed.join(drawn, at, "left_anti")
        if self.pdf_images:
            inside = pdf.read_images(pdfs, self.pdf_images).join(classed.select(*at), at, "left_semi")
            found = inside if found is None else found.unionByName(inside)
        return found

    # what an agent can call

    def search(self, query: str, top: int | None = None, strategy: str = "semantic", content_type: str = "", caller: str = "agent", approximate: bool = False) -> DataFrame:
        """``approximate`` looks into the trained lists nearest to the query where the index has such."""
        k, index = search.clamp_top(top, caller), self.store.snapshot()
        if (stored := index.get_metadata("dimension")) and int(stored) != self.dimension:
            raise ValueError(f"the index holds vectors of {stored} values, the embedder makes {self.dimension}")
        near = None
        if approximate and (probes := index.get_metadata("lists_probed")):
            vector = self.embed(F.lit(query))
            near = lambda count: ann.nearest(index.read("lists"), index.read("centers"), vector, count, int(probes))
        return search.search(index.read("chunks"), index.read("embeddings"), query, k, strategy, content_type, self.embed, self.dimension, near)

    def answer(self, query: str, top: int | None = None, strategy: str = "semantic", content_type: str = "", caller: str = "agent") -> list[Row]:
        """A search's few rows as a caller gets them: what HTTP returns, or what an agent reads.

        Answers stay for five minutes, as long as no commit comes in between.
        """
        index = self.store.snapshot()
        changed = (index.state.version, query, top, strategy, content_type, caller)

        def find() -> list[Row]:
            found = self.search(query, top, strategy, content_type, caller)
            shown = search.api_projection(found, index.read("files")) if caller == "http" else search.agent_projection(found)
            return sorted(shown.collect(), key=lambda r: (r.distance is None, r.distance))

        return self.answers.get(self.store.root, changed, find)

    def cancel(self) -> None:
        """End the ``update`` that another thread runs: its jobs now, else at its next step; its changes never land."""
        self._stop.set()
        service.cancel(self.spark, self.tag)

    def _go_on(self) -> None:
        if self._stop.is_set():
            raise service.Cancelled("the update was cancelled")

    def status(self) -> DataFrame:
        with workspace.scratch(self.spark):
            index = self.store.snapshot()
            row = changes.status(self.compared(index.read("files")), index.read("files"), index.read("chunks"))
            return self.spark.createDataFrame(row.collect(), row.schema)  # one row

    def status_preview(self) -> DataFrame:
        with workspace.scratch(self.spark):
            rows = changes.name_preview(self.compared(self.store.read("files")))
            return self.spark.createDataFrame(rows.collect(), rows.schema)  # a row for each kind of change

    def read_file(self, path: str) -> str:
        """The first 50 KB of a text file inside the folder; ``..``, ``.`` and links are resolved before the path is judged."""
        path, source = folder.resolved(path), folder.resolved(self.source)
        if not (path + "/").startswith(source + "/"):
            raise ValueError("the path is outside the index")
        if posixpath.splitext(path)[1].lower() in UNREADABLE:
            raise ValueError("files of this type are not read as text; use get_file_chunks")
        data, size = folder.head(path, READ_BYTES + 8)
        row = self.spark.createDataFrame([(bytearray(data), size)], "content binary, size long")
        return row.select(read_head(folder.decode_text("content"), READ_BYTES, F.col("size"))).first()[0]

    def list_dir(self, path: str | None = None) -> DataFrame:
        return metadata.list_dir(self.store.read("files"), path or self.source)

    def get_file_chunks(self, path: str) -> DataFrame:
        return metadata.file_chunks(self.store.read("files"), self.store.read("chunks"), path)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return metadata.get_chunk(self.store.read("chunks"), chunk_id)

    def all_files(self) -> DataFrame:
        return metadata.all_files(self.store.read("files"))

    def get_file_info(self, path: str) -> DataFrame:
        files = self.store.read("files")
        return metadata.file_info(files.filter(F.col("path") == path), self.store.read("chunks"))

    def find_files(self, **wanted) -> DataFrame:
        return metadata.agent_find_files(self.store.read("files"), self.source, **wanted)

    TOOLS = ("search", "status", "read_file", "list_dir", "update", "get_file_chunks", "get_file_info", "find_files")

    def call(self, tool: str, **arguments):
        if tool not in self.TOOLS:
            raise ValueError(f"unknown tool: {tool}")
        return getattr(self, tool)(**arguments)


def hash_name(path: str) -> str:
    """A whole folder path in short, so that equal names of different folders don't meet."""
    return hashlib.sha256(path.encode()).hexdigest()[:32]


