"""What the text operators share: Arrow columns as numpy bytes, hashed words, the shared folder.

Texts reach Python as Arrow batches.  Words are found and hashed for a whole
batch at once on its byte buffer, in blocks of bounded size, so memory follows
the batch and not the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one step works on; a longer document is a chunk of its own.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: 0-9, a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD and its inverse to the powers 0 to n, modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 1024)
        out = []
        for base in (_ODD, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[0] = have = (out[0], out[1])
    return have


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and past-the-last byte of all words of the rows, and the n+1 bounds of each row's words.

    Words are the maximal runs of WORD bytes after lower-casing A-Z.  Blocks of
    CHUNK bytes that end between words keep the work arrays small for any text.
    """
    n = len(data)
    low = LOWER[data]
    inside = WORD[low]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(first), np.uint64)
    w = 0
    while w < len(first):
        top = max(w + 1, int(np.searchsorted(last, first[w] + CHUNK, "right")))
        lo, hi = int(first[w]), int(last[top - 1])
        up, down = _powers(hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[low[lo:hi]] * up[: hi - lo], out=sums[1:])
        hashes[w:top] = mix((sums[last[w:top] - lo] - sums[first[w:top] - lo]) * down[first[w:top] - lo])
        w = top
    return hashes, first, last, np.searchsorted(first, offsets)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all k neighbouring entries; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_ODD) + hashes[j : j + n]
    return mix(out)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(df: DataFrame, text: str, kind: str, make: Callable[[], Callable], keep: list[str] | None = None, chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """df's columns `keep` (all, if None) and one more, a struct of the DDL fields `kind`, whose name is returned too.

    `make()` is called once per task and gives f(data, offsets) -> list of Arrow
    arrays, one per field of `kind`, for a chunk of rows.  Nothing is shuffled
    and rows are neither dropped nor repeated.
    """
    kind = T.StructType.fromDDL(kind)
    keep = list(df.columns) if keep is None else keep
    name = fresh(df, "found")
    need = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind, True)])
    arrow = to_arrow_schema(kind)
    fields = [arrow.field(i) for i in range(len(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            data, offsets = text_buffer(batch.column(need.index(text)))
            for lo, hi in row_chunks(offsets, chunk):
                part = data[offsets[lo] : offsets[hi]]
                arrays = f(part, offsets[lo : hi + 1] - offsets[lo])
                struct = pa.StructArray.from_arrays([a.cast(x.type) for a, x in zip(arrays, fields, strict=True)], fields=fields)
                yield pa.RecordBatch.from_arrays([*(batch.column(need.index(c)).slice(lo, hi - lo) for c in keep), struct], names=[*keep, name])

    return df.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(run, schema), name


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a folder of our own in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/tidemark-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
