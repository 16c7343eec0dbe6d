"""Helpers that the corpus operators share: lineage cuts, text blocks and hashed words in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose id is null take part under this id, so that joins and orders hold for them too.
NULL_ID = -(2**63)
#: Bytes of text that a task works on at once in numpy.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where none is set, a temporary one serves a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and returns it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession):
    """A function that writes a DataFrame as a Parquet table in the shared folder and returns it read again. Its shuffle files go once it is written, the tables at the end, so what leaves the block must be cut."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    names = iter(range(1_000_000))

    def written(df: DataFrame) -> DataFrame:
        path, key = f"{folder}/{next(names)}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(key)
        spark.conf.set(key, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(key, before)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield written
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the Arrow batches that go to Python by bytes, as one text may be very long. The setting stays in the session, since plans run after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others stay behind."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def with_place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, text): a row's id and its text's hash, which together name the row."""
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def id_of(did: Column | str) -> Column:
    """The id that with_place() took, null again where it was null."""
    return F.nullif(F.col(did) if isinstance(did, str) else did, F.lit(NULL_ID))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit number for each byte.
_BYTES = mix64(np.arange(1, 257, dtype=_U) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE), np.full(m, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with the end; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: start and end bytes, first word of each text, 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = text_buffers(column)
        self._find(_LOWER[data] if lower else data, offsets)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The words of texts that lie one after the other in data."""
        words = cls.__new__(cls)
        words._find(data, offsets)
        return words

    def _find(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~_SPACE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (edge[:n] | ~before))
        self.ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        self.first = np.searchsorted(self.starts, offsets)  # first word of each text, and the end
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), _U)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + BLOCK_BYTES, "right")))
            end = self.ends[stop - 1]
            up, down = powers(end - begin + 1)
            total = np.zeros(end - begin + 1, _U)
            np.cumsum(_BYTES[self.data[begin:end]] * up[:-1], out=total[1:], dtype=_U)
            s, e = self.starts[at:stop] - begin, self.ends[at:stop] - begin
            out[at:stop] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(_U))
            at = stop
        return out

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n items from each position on, for all positions from which n items are left."""
    if len(hashes) < n:
        return np.empty(0, _U)
    up, _ = powers(n)
    out = np.zeros(len(hashes) - n + 1, _U)
    for k in range(n):
        out += hashes[k : k + len(out)] * up[k]
    return mix64(out + _U(n))
