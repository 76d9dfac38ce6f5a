"""Fill-in-middle transformation in DuckDB inside mapInArrow.

Each text is cut into words with the white space before them; two hash values
of the id choose where the middle begins and ends. DuckDB cuts, chooses, orders
and hashes a whole batch at once, Arrow in and Arrow out; Python only registers
batches, cut into slices of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that DuckDB gets together; a longer text comes alone.
SLICE_BYTES = 16 << 20

_CUT = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256($seed || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch),
chosen AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(h, 1, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS y,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= $rate THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(x, y)::BIGINT), '') AS prefix,
         array_to_string(list_slice(units, least(x, y)::BIGINT + 1, greatest(x, y)::BIGINT), '') AS middle, array_to_string(list_slice(units, greatest(x, y)::BIGINT + 1, n), '') AS suffix
  FROM chosen)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts"""

# no part holds a marker, so the first of each kind is the one that was put there
_RESTORED = f"""
SELECT * REPLACE (coalesce(output, '') AS output), CASE form
         WHEN 'psm' THEN substr(string_split(output, '{SUFFIX}')[1], {len(PREFIX) + 1}) || string_split(output, '{MIDDLE}')[2] || string_split(string_split(output, '{SUFFIX}')[2], '{MIDDLE}')[1]
         WHEN 'spm' THEN string_split(string_split(output, '{PREFIX}')[2], '{MIDDLE}')[1] || string_split(output, '{MIDDLE}')[2] || substr(string_split(output, '{PREFIX}')[1], {len(SUFFIX) + 1})
         ELSE coalesce(output, '') END AS restored
FROM {{rows}}"""

_COLUMNS = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long"


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about SLICE_BYTES; at least one row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _in_duckdb(rows: DataFrame, text: str, sql: str, values: dict, schema: str) -> DataFrame:
    """``sql`` over ``batch``, the rows slice by slice; one thread and no files of its own in each task."""
    column, id_type = rows.columns.index(text), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}) as db:
            for batch in batches:
                for some in _slices(batch, column):
                    db.register("batch", pa.Table.from_batches([some]))
                    yield from db.sql(sql, params=values).to_arrow_table().to_batches()
                    db.unregister("batch")

    return rows.mapInArrow(run, schema.format(id=id_type))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output for each row of ``docs`` (doc_id, text).

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these with the
    suffix first; the choice follows the id alone. A null or empty text and one
    that holds a marker stay plain, with null as prefix_chars and middle_chars.
    Repeated rows come out alike, a null id counts as an empty one, other columns
    are not read. No row is shuffled; a task holds SLICE_BYTES of texts, or one text.
    """
    return _in_duckdb(docs.select("doc_id", "text"), "text", _CUT, {"seed": str(seed), "rate": rate, "spm": spm}, _COLUMNS + ", output string")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id and text rebuilt from output and form (of ``transform``); a null output is empty, a null form plain."""
    sql = f"SELECT doc_id, restored AS text FROM ({_RESTORED.format(rows='batch')})"
    return _in_duckdb(rows.select("doc_id", "form", "output"), "output", sql, {}, "doc_id {id}, text string")


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``transform`` with output_sha256 and restored_sha256 (``restore`` of each output) in place of the output, in one pass."""
    sql = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({_RESTORED.format(rows=f'({_CUT})')})"
    return _in_duckdb(docs.select("doc_id", "text"), "text", sql, {"seed": str(seed), "rate": rate, "spm": spm}, _COLUMNS + ", output_sha256 string, restored_sha256 string")

