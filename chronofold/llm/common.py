"""Shared helpers of the corpus operators: table access, lineage cuts, vectorised word scanning."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_dir, written

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_BLOCK = 1 << 18
_pow: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[df[c] for c in cols]) if cols else df


def cut(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation.
    drop: an earlier cut that nothing reads any more."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    out = written(df, path)
    out._cut_path = path
    if drop is not None:
        uncut(drop)
    return out


def uncut(df: DataFrame) -> None:
    """Delete the files of a cut."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = byte_rows(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def ascii_lower(body: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[body]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def alnum_bytes() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (after lower-casing)."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[97:123] = ok[128:] = True
    return ok


def nonspace_bytes() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    ok = np.ones(256, bool)
    ok[9:14] = ok[32] = False
    return ok


def word_spans(body: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in all rows, and the index of the first word of each row (n + 1).
    A word never crosses rows."""
    inside = ok[body]
    edge = np.empty(len(body) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, at)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if len(_pow.get(key, ())) < n:
        p = np.full(max(n, _BLOCK * 2), base, np.uint64)
        p[0] = 1
        _pow[key] = np.multiply.accumulate(p)
    return _pow[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of body[start:end], for spans in rising order that don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        n = hi - lo
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((body[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_B, n + 1)[:n], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _powers(_BINV, n + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def rows_of(at: np.ndarray) -> np.ndarray:
    """For each element, the row it is in, given the n + 1 offsets of rows."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
