"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids and one end id.  Only documents longer than
the capacity are cut, the remainder first.  Which piece goes where depends on
lengths alone, so the plan is made from the histogram of lengths (at most
`capacity` rows, whatever the corpus) and pieces find their places by rank among
the pieces of their length:

1. tokenise once, write the pieces (no ids, a few bytes each) to the shared folder;
2. count pieces by (length, bucket); offsets of buckets give every piece its rank;
3. plan on the histogram: pieces above a third of the capacity pair greedily, the
   largest with the largest that fits, at most two a sequence; smaller pieces,
   longest first, best-fit the remaining gaps.  Equal lengths are planned together
   by count, so the plan's size is bounded by the capacity, not by the rows;
4. each piece looks its rank up in the plan.

Null texts count as empty: one piece that holds the end id.  Repeated rows are
packed each.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import written

CAPACITY = 2048
END_ID = 0
#: Pieces that one rank window may hold before more buckets are used.
BUCKET_ROWS = 100_000



def tokenizer_files() -> tuple[str, str, str]:
    """Ranks and split pattern of byte_bpe_50k, and the JSON file with the same vocabulary and ids."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("byte_bpe_50k.json")


class Encoder:
    """The JSON file's ids, by the ranks' faster library where that can split a text, else by the JSON file itself."""

    def __init__(self, files: tuple[str, str, str]):
        with open(files[0], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=files[1], mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self.json = files[2]
        self.slow: Tokenizer | None = None

    def encode(self, text: str) -> list[int]:
        """Special tokens' strings are read as such, as the JSON file's tokenizer does."""
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # about a million white-space characters in a row are too many for its split pattern
            self.slow = self.slow or Tokenizer.from_file(self.json)
            return self.slow.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def encoder(files: tuple[str, str, str]) -> Encoder:
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(files)
    return _ENCODERS[files]


def token_ids(enc: Encoder, text: str | None, end_id: int = END_ID) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit numbers, the end id last."""
    ids = enc.encode(text) if text else []
    return np.append(np.asarray(ids, "<u4"), np.asarray([end_id], "<u4"))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % capacity
    starts = [0] * (head > 0) + list(range(head, n, capacity))
    return [(s, min(head or capacity, n) if s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, *, id_col: str, text: str, capacity: int, files: tuple[str, str, str], end_id: int = END_ID) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32."""
    kind = f"doc {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        enc = encoder(files)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, number, start, length, crc = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = token_ids(enc, t, end_id)
                    for k, (s, m) in enumerate(cuts(len(ids), capacity)):
                        row.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(ids[s : s + m].tobytes()))
                yield pa.RecordBatch.from_arrays([pc.take(part.column(0), pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, kind)


class Gaps:
    """Groups of equal sequences by what room they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(self, gap: int, count: int, items: list[tuple[int, int]]) -> None:
        if gap not in self.groups:
            insort(self.sizes, gap)
            self.groups[gap] = []
        self.groups[gap].append((count, items))

    def take(self, least: int) -> tuple[int, int, list[tuple[int, int]]] | None:
        """A group with the smallest room of at least `least`."""
        k = bisect_left(self.sizes, least)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        count, items = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.sizes.pop(k)
        return gap, count, items


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, pieces of it in each)]) groups that hold all counted pieces."""
    left = {n: c for n, c in histogram.items() if c}
    gaps = Gaps()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # the largest with the largest partner that fits
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            gaps.add(capacity - a, left.pop(a), [(a, 1)])
            large.pop()
            continue
        b = large[k]
        if a == b and left[a] > 1:
            pairs = left[a] // 2
            gaps.add(capacity - 2 * a, pairs, [(a, 2)])
            left[a] -= 2 * pairs
        elif a == b:
            if k == 0:
                gaps.add(capacity - a, left.pop(a), [(a, 1)])
                large.pop()
                continue
            b = large[k - 1]
        if a != b:
            pairs = min(left[a], left[b])
            gaps.add(capacity - a - b, pairs, [(a, 1), (b, 1)])
            left[a] -= pairs
            left[b] -= pairs
        for n in {a, b}:
            if not left[n]:
                del left[n]
                large.remove(n)
    for n in sorted(left, reverse=True):  # smaller pieces into the tightest gap
        c = left[n]
        while c:
            gap, count, items = gaps.take(n) or (capacity, c, [])
            each = gap // n
            full = min(count, c // each)
            if full:
                gaps.add(gap - each * n, full, [*items, (n, each)])
                c -= full * each
                rest = count - full
            else:
                gaps.add(gap - c * n, 1, [*items, (n, c)])
                c, rest = 0, count - 1
            if rest and items:
                gaps.add(gap, rest, items)
    return [g for groups in gaps.groups.values() for g in groups]


def segments(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the columns first rank, pieces in a sequence, first sequence, first offset, by rank."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for count, items in groups:
        offset = 0
        for n, each in items:
            first = used.get(n, 0)
            out.setdefault(n, []).append((first, each, base, offset))
            used[n] = first + count * each
            offset += n * each
        base += count
    return {n: np.asarray(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    table = written(pieces(docs, id_col=id_col, text=text, capacity=capacity, files=files or tokenizer_files(), end_id=end_id))
    buckets = max(64, table.count() // bucket_rows)
    table = table.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = table.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    where = table.sparkSession.sparkContext.broadcast(segments(plan(histogram, capacity)))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32")) - 1
    ranked = table.withColumn("rank", rank).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges):
                if len(own):
                    n = int(length[own[0]])
                    seg = where.value[n]
                    s = seg[np.searchsorted(seg[:, 0], rank[own], "right") - 1]
                    copy, nth = np.divmod(rank[own] - s[:, 0], s[:, 1])
                    sequence[own], offset[own] = s[:, 2] + copy, s[:, 3] + nth * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kind = f"doc {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ranked.select(*columns, "rank").mapInArrow(place, kind)
    return out.withColumnRenamed("doc", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
