"""The row-log format: ``key SP (column SP length SP bytes SP)* LF``, repeated.

Values may hold line feeds, so records are parsed by lengths and a file is the unit of
work: each file is one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.session import prepare


def decode(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(key, column, value) of each cell in order. A record without cells gives none."""
    at = 0
    while at < len(data):
        space = data.index(b" ", at)
        key, at = data[at:space].decode(), space + 1
        while data[at : at + 1] not in (b"\n", b""):
            space = data.index(b" ", at)
            column = data[at:space].decode()
            stop = data.index(b" ", space + 1)
            n = int(data[space + 1 : stop])
            yield key, column, data[stop + 1 : stop + 1 + n]
            at = stop + 1 + n + 1
        at += 1


def encode(rows: Iterable[tuple[str, dict[str, bytes]]]) -> bytes:
    """The bytes of rows; keys and columns must have no space."""
    out = bytearray()
    for key, cells in rows:
        if " " in key or any(" " in c for c in cells):
            raise ValueError("a key or column with a space")
        out += key.encode() + b" "
        for column, value in cells.items():
            out += f"{column} {len(value)} ".encode() + value + b" "
        out += b"\n"
    return bytes(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            cells = list(decode(content.as_py()))
            if cells:
                keys, columns, values = zip(*cells, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(columns), pa.array([v.decode("utf-8", "replace") for v in values]), pa.array(range(len(keys)), pa.int64())], names=["row_key", "col", "value", "seq"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Change rows (row_key, col, value, seq) of row-log files; later records of a file win."""
    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, "row_key string, col string, value string, seq long")
