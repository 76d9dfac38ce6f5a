"""The engine's tables."""

from __future__ import annotations

FILES = "file_id string, path string, file_type string, file_hash string, modified_at timestamp_ntz, size bigint, indexed_at timestamp_ntz"
CHUNKS = "chunk_id string, file_id string, file_path string, file_type string, chunk_index int, total_chunks int, content string, page_numbers array<int>, content_type string, image_data binary"
EMBEDDINGS = "chunk_id string, vector array<float>"
CACHE = "content_hash string, vector array<float>, created_at timestamp_ntz"
METADATA = "key string, value string"
LISTING = "path string, size bigint, modified_at timestamp_ntz, file_hash string"
PDF_PAGES = "file_id string, page_number int, text string"
PDF_IMAGES = "file_id string, page_number int, format string, width int, height int, base64 string"

LISTS = "chunk_id string, vector array<float>, list int"
CENTERS = "list int, center array<float>"

TABLES = {"files": FILES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "embedding_cache": CACHE, "metadata": METADATA, "lists": LISTS, "centers": CENTERS}
KEYS = {"files": "file_id", "chunks": "chunk_id", "embeddings": "chunk_id", "embedding_cache": "content_hash", "metadata": "key", "lists": "chunk_id", "centers": "list"}
#: Tables whose files are dealt out by a column.
PARTITIONED = {"lists": ["list"]}
