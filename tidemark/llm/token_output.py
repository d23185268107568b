"""Token ids in training order, as fixed-stride binary shards.

Documents are tokenised, ended by one id and cut into sequences of at most
`length` ids.  A keyed Feistel permutation with cycle-walking gives every sequence
a global slot: its number among all sequences, 0 to N - 1, is permuted within the
smallest even-bit domain that holds N and walked on until it falls below N.  Slots
are dealt by ranges: a shard holds `per_shard` slots in a row, and its file holds a
record of fixed stride per slot, so slot s is at byte (s % per_shard) * stride of
shard s // per_shard, and a reader resumes anywhere with one seek.

A record is little-endian unsigned 16-bit: how many ids count, the ids, zeros.

Sequences are written once to a table in the shared folder; their number is the
table file's offset plus their place in it (a task that writes several files counts
on from one to the next, so a file's own first number is taken off), and nothing is
sorted to count.  Tokens
travel in compressed blobs, one per task and shard, recoded by how often they occur.
Shard files are written under a name of their own and then moved, so a task that
runs twice leaves one whole file.  Paths may be of any store that pyarrow opens.

Null texts count as empty: one sequence that holds the end id.  Repeated rows are
all written.  An empty table writes a manifest and no shards.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import mix, shared_folder, written
from tidemark.llm.packing import END_ID, encoder, token_ids, tokenizer_files

LENGTH, PER_SHARD, KEY = 256, 8192, 0x5EED
ROUNDS = 6


def permuted(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of the numbers x below n: a permutation of 0 to n - 1 that the key picks."""
    if len(x) and not 0 <= int(x.min()) <= int(x.max()) < n:
        raise ValueError(f"sequence numbers must lie in 0 to {n - 1}")
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = x.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pack_ids(parts: list[np.ndarray]) -> bytes:
    """16-bit ids as compressed bytes: ranked by how often they occur, one byte each, 255 pointing to a longer rank."""
    ids = np.concatenate(parts).astype(np.int64)
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.int64)
    rank[order] = np.arange(len(order))
    r = rank[ids]
    rest = (r[r >= 255] - 255).astype("<u2").view(np.uint8).reshape(-1, 2)
    low, high = (pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) for x in (np.minimum(r, 255).astype(np.uint8), rest.T))
    return np.asarray([len(order), len(rest), len(low)], "<u4").tobytes() + order.astype("<u2").tobytes() + low + high


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    distinct, longer, size = np.frombuffer(raw, "<u4", 3).tolist()
    order = np.frombuffer(raw, "<u2", distinct, 12)
    at = 12 + 2 * distinct
    r = np.frombuffer(pa.decompress(raw[at : at + size], n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    if longer:
        rest = np.frombuffer(pa.decompress(raw[at + size :], 2 * longer, codec="zstd", asbytes=True), np.uint8).reshape(2, longer)
        r[r == 255] = np.ascontiguousarray(rest.T).view("<u2").ravel().astype(np.int64) + 255
    return order[r]


#: Ids that one row of the sequence table holds, about, and ids that a task deals out at once.
ROW_IDS, DEAL_IDS = 1 << 18, 1 << 24
#: Bytes of shards that a task writes, about.
TASK_BYTES = 128 << 20
_TABLE = "first long, n int, docs array<{doc}>, pieces array<int>, counts array<int>, ids binary"


def sequences(docs: DataFrame, *, id_col: str, text: str, length: int, files: tuple[str, str, str], end_id: int, row_ids: int = ROW_IDS) -> DataFrame:
    """Rows of many sequences each: the first one's number within its task, ids, pieces, numbers of tokens, and all tokens packed."""
    doc = docs.schema[id_col].dataType
    arrow = to_arrow_type(doc)

    def run(batches):
        enc = encoder(files)
        first = 0
        own, piece, count, ids, size = [], [], [], [], 0

        def row():
            out = pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([own], pa.list_(arrow)), pa.array([piece], pa.list_(pa.int32())), pa.array([count], pa.list_(pa.int32())), pa.array([pack_ids(ids)], pa.binary())], names=["first", "n", "docs", "pieces", "counts", "ids"])
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = token_ids(enc, t, end_id)
                if got.max() > 0xFFFF:
                    raise ValueError("ids do not fit 16 bits")
                for k, s in enumerate(range(0, len(got), length)):
                    own.append(d)
                    piece.append(k)
                    count.append(min(length, len(got) - s))
                ids.append(got)
                size += len(got)
                if size >= row_ids:
                    yield row()
                    first += len(own)
                    own, piece, count, ids, size = [], [], [], [], 0
        if own:
            yield row()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, _TABLE.format(doc=doc.simpleString()))


def materialise(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, files: tuple[str, str, str] | None = None, end_id: int = END_ID, row_ids: int = ROW_IDS) -> tuple[DataFrame, str]:
    """Writes shards and manifest below `path`; the index (id_col, piece, n_tokens, slot, shard, byte, ids_crc32), and the path."""
    spark = docs.sparkSession
    path = (path or shared_folder(spark)).rstrip("/")
    table = written(sequences(docs, id_col=id_col, text=text, length=length, files=files or tokenizer_files(), end_id=end_id, row_ids=row_ids))
    place = table.select("*", F.col("_metadata.file_name").alias("file"))
    per_file = sorted((r["file"], r["n"], r["least"]) for r in place.groupBy("file").agg(F.sum("n").alias("n"), F.min("first").alias("least")).collect())  # a row per file
    offsets, total = {}, 0
    for file, n, least in per_file:
        offsets[file] = total - least
        total += n
    shared = spark.sparkContext.broadcast(offsets)
    stride = 2 * (length + 1)
    store, base = opened(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"total": total, "stride": stride, "per_shard": per_shard, "length": length, "key": key}).encode())
    doc = docs.schema[id_col].dataType
    arrow = to_arrow_type(doc)
    dealt_kind = f"shard int, slots binary, docs array<{doc.simpleString()}>, pieces array<int>, counts array<int>, ids binary"

    def deal(batches):
        held, size = [], 0

        def flush():
            slot = np.concatenate([h[0] for h in held])
            docs_, piece, count = ([x for h in held for x in h[k]] for k in (1, 2, 3))
            ids = np.concatenate([h[4] for h in held])
            n = np.asarray(count, np.int64)
            end = np.cumsum(n)
            order = np.argsort(slot, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(slot[order] // per_shard)) + 1):
                rows = own.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(slot[own[0]]) // per_shard], pa.int32()), pa.array([slot[own].astype("<i8").tobytes()], pa.binary()), pa.array([[docs_[i] for i in rows]], pa.list_(arrow)),
                    pa.array([[piece[i] for i in rows]], pa.list_(pa.int32())), pa.array([n[own].tolist()], pa.list_(pa.int32())), pa.array([pack_ids([ids[end[i] - n[i] : end[i]] for i in rows])], pa.binary()),
                ], names=["shard", "slots", "docs", "pieces", "counts", "ids"])

        for batch in batches:
            for r in batch.to_pylist():
                index = shared.value[r["file"]] + r["first"] + np.arange(r["n"])
                held.append((permuted(index, total, key), r["docs"], r["pieces"], r["counts"], unpack_ids(r["ids"], sum(r["counts"]))))
                size += len(held[-1][4])
                if size >= DEAL_IDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def write(batches):
        store, base = opened(path)
        shard, parts = -1, []

        def close():
            slot = np.concatenate([np.frombuffer(r["slots"], "<i8") for r in parts])
            count = np.concatenate([np.asarray(r["counts"], np.int64) for r in parts])
            ids = np.concatenate([unpack_ids(r["ids"], sum(r["counts"])) for r in parts])
            docs_, piece = ([x for r in parts for x in r[k]] for k in ("docs", "pieces"))
            end = np.cumsum(count)
            records = np.zeros((min(per_shard, total - shard * per_shard), length + 1), "<u2")
            at = slot - shard * per_shard
            records[at, 0] = count
            records[np.repeat(at, count), 1 + np.arange(end[-1]) - np.repeat(end - count, count)] = ids
            name = f"{base}/writing-{shard:08d}-{uuid.uuid4().hex}"
            with store.open_output_stream(name) as f:
                f.write(records.tobytes())
            store.move(name, f"{base}/shard-{shard:08d}.bin")
            crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(end.tolist(), count.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(docs_, arrow), pa.array(piece, pa.int32()), pa.array(count.astype(np.int32)), pa.array(slot), pa.array(np.full(len(slot), shard, np.int32)), pa.array(crc, pa.int64())], names=["doc", "piece", "n_tokens", "slot", "shard", "ids_crc32"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard and parts:
                    yield close()
                    parts = []
                shard = r["shard"]
                parts.append(r)
        if parts:
            yield close()

    shards = -(-total // per_shard)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards * per_shard * stride // TASK_BYTES))
    dealt = place.mapInArrow(deal, dealt_kind).repartition(tasks, "shard").sortWithinPartitions("shard")
    index = written(dealt.mapInArrow(write, f"doc {doc.simpleString()}, piece int, n_tokens int, slot long, shard int, ids_crc32 long"))
    byte = (F.col("slot") % per_shard * stride).alias("byte")
    return index.select(F.col("doc").alias(id_col), "piece", "n_tokens", "slot", "shard", byte, "ids_crc32"), path


def read_slots(path: str, start: int, count: int):
    """Yields the ids of `count` sequences from slot `start` on, in training order."""
    store, base = opened(path.rstrip("/"))
    with store.open_input_file(f"{base}/manifest.json") as f:
        told = json.loads(f.read())
    slot, stop = start, min(told["total"], start + count)
    while slot < stop:
        shard, first = divmod(slot, told["per_shard"])
        n = min(stop - slot, told["per_shard"] - first)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(first * told["stride"])
            for _ in range(n):
                record = np.frombuffer(f.read(told["stride"]), "<u2")
                yield record[1 : 1 + record[0]]
        slot += n


def op8(spark, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
