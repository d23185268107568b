"""Ranked lexical search: the product of an item-term and a term-document matrix, block by block.

Rows of the left matrix are items (how often an item holds a term, or once each),
rows of the right one are terms: the int64 impact of each document that holds the
term.  A task reads its documents in blocks, builds the block's part of the right
matrix (term by term, documents rising) and multiplies by Gustavson's rule: an
item's row is the merged sum of the right matrix's rows for its terms, gathered in
one accumulator over the block's documents.  Only the k best of an item outlive a
block, and only a task's k best are shuffled, over some salts first and then by item.

Two passes over the texts, as weights need the whole corpus: one counts documents,
terms and, for the items' terms, the documents that hold them; the other scores.
Items are taken in blocks of at most `block_bytes` of text (a longer item is a block
of its own); a block's terms are what tasks load and what the driver counts.

A term is found by hash and then compared byte by byte, so unlike terms never meet.
Null and empty texts have no terms: they neither count nor are found.  Rows with a
null item id take no part; rows that share an item id are one item.  Repeated
document ids are each ranked; a null document id comes last among equal scores.
Ids are cast to long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, row_chunks, shared_folder, table, text_buffer, words

BEST = 10
#: Bytes of item text of a block; bytes of documents whose part of the product is held at once.
BLOCK_BYTES, PRODUCT_BYTES = 8 << 20, 4 << 20
#: Groups that an item's candidates pass before the last one.
SALTS = 64
#: Fixed values of the score: 1000 times the inverse document frequency, document length at nine tenths, impacts in parts of 1000 tf + 8 m.
SCALE, FLAT, LENGTH, UNIT, TF, PER_M = 1000, 10, 90, 1_000_000_000, 1000, 8
_KIND = "item int, doc_id long, score long"


class Terms:
    """A block's distinct terms, sorted by hash and bytes, and each item's terms with their multiplicities."""

    def __init__(self, items: dict, repeats: bool):
        self.ids = list(items)
        data, offsets = text_buffer(pa.array([t for i in self.ids for t in items[i]], pa.large_string()))
        hashes, first, last, bounds = words(data, offsets)
        low = LOWER[data].tobytes()
        found = [(h, low[s:e]) for h, s, e in zip(hashes.tolist(), first.tolist(), last.tolist(), strict=True)]
        own = sorted(set(found))
        place = {t: k for k, t in enumerate(own)}
        self.hashes = np.asarray([h for h, _ in own], np.uint64)
        self.start = np.cumsum([0, *(len(t) for _, t in own)])
        self.bytes = np.frombuffer(b"".join(t for _, t in own), np.uint8)
        self.rows, text = [], 0
        for i in self.ids:
            n = len(items[i])
            held, times = np.unique(np.asarray([place[t] for t in found[bounds[text] : bounds[text + n]]], np.int64), return_counts=True)
            self.rows.append((held, times if repeats else np.ones(len(held), np.int64)))
            text += n

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return out
        at = np.searchsorted(self.hashes, hashes)
        open_ = np.flatnonzero(self.hashes[np.minimum(at, len(self) - 1)] == hashes)
        at = at[open_]
        while len(open_):
            n = last[open_] - first[open_]
            same = n == self.start[at + 1] - self.start[at]
            who, n = np.flatnonzero(same), n[same]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = LOWER[data[np.repeat(first[open_[who]], n) + step]] == self.bytes[np.repeat(self.start[at[who]], n) + step]
            same[who] = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(n) else True
            out[open_[same]] = at[same]
            open_, at = open_[~same], at[~same] + 1  # another term with this hash
            more = (at < len(self)) & (self.hashes[np.minimum(at, len(self) - 1)] == hashes[open_])
            open_, at = open_[more], at[more]
        return out


def postings(terms: Terms, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document with repeats; then term, document and count of every pair, by term and document."""
    hashes, first, last, bounds = words(data, offsets)
    n = np.diff(bounds)
    term = terms.of(data, hashes, first, last)
    held = term >= 0
    key, tf = np.unique(term[held] * len(n) + np.repeat(np.arange(len(n)), n)[held], return_counts=True)
    return n, key // max(1, len(n)), key % max(1, len(n)), tf


def impacts(n: np.ndarray, doc: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """How much a term's occurrences add in a document, before the term's weight."""
    wide = LENGTH * documents * int(n.max(initial=0)) >= 1 << 63
    m = FLAT + (LENGTH * documents * (n.astype(object) if wide else n)) // length
    return (UNIT * tf) // (TF * tf + PER_M * m.astype(np.int64)[doc])


def product(terms: Terms, weight: np.ndarray, n: np.ndarray, term: np.ndarray, doc: np.ndarray, value: np.ndarray):
    """Yields (item, documents' sums) row by row: each row of the product merges the right matrix's rows of the item's terms."""
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    value = value * weight[term]
    for item, (own, times) in enumerate(terms.rows):
        size = start[own + 1] - start[own]
        total = int(size.sum())
        if not total:
            continue
        at = np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(total)
        row = np.zeros(len(n), np.int64)
        np.add.at(row, doc[at], value[at] * np.repeat(times, size))
        yield item, row


def leading(score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids and to ids that are not null."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((doc[some], missing[some], -score[some]))[:k]]


def count(at):
    def run(batches):
        terms = at.value
        df, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in row_chunks(offsets):
                n, term, _, _ = postings(terms, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                df += np.bincount(term, minlength=len(df))
                documents, length = documents + int(np.count_nonzero(n)), length + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[documents, length], df[held]]))], names=["term", "n"])

    return run


def score(at, k: int):
    def run(batches):
        terms, weight, documents, length = at.value
        held = {}
        for batch in batches:
            ids = batch.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets, PRODUCT_BYTES):
                n, term, doc, tf = postings(terms, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for item, row in product(terms, weight, n, term, doc, impacts(n, doc, tf, documents, length) if len(doc) else doc):
                    own = held.get(item)
                    some = np.flatnonzero(row >= (own[0][-1] if own and len(own[0]) == k else 1))
                    new = row[some], ids[lo + some], missing[lo + some]
                    new = [np.concatenate(p) for p in zip(own, new, strict=True)] if own else new
                    keep = leading(*new, k)
                    if len(keep):
                        held[item] = [p[keep] for p in new]
        if held:
            s, d, gone = (np.concatenate([h[c] for h in held.values()]) for c in range(3))
            item = np.repeat(np.fromiter(held, np.int32), [len(h[0]) for h in held.values()])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(d, mask=gone), pa.array(s)], names=["item", "doc_id", "score"])

    return run


def blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """{item id: its texts}, block after block; rows of one item stay together."""
    b = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("i is not null")
    total = b.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        out: dict = {}
        for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)).collect():
            out.setdefault(r.i, []).append(r.t)
        yield out


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, repeats: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents; with `repeats` a term counts as often as the item holds it."""
    spark = docs.sparkSession
    path = shared_folder(spark)
    ids, texts = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    kind = items.schema[item_id].dataType
    for block in blocks(items, item_id, item_text, block_bytes):
        terms = Terms(block, repeats)
        vocabulary = spark.sparkContext.broadcast(terms)
        told = {r["term"]: r["n"] for r in docs.select(texts).mapInArrow(count(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the block
        documents = told.get(-2, 0)
        weight = np.asarray([math.floor(SCALE * math.log((2 * documents + 2) / (2 * told.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
        at = spark.sparkContext.broadcast((terms, weight, documents, told.get(-1, 0)))
        found = docs.select(ids, texts).mapInArrow(score(at, k), _KIND).withColumn("salt", F.spark_partition_id() % SALTS)
        found = found.withColumn("rank", best("item", "salt")).where(F.col("rank") <= k)
        found = found.withColumn("rank", best("item")).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(terms.ids)), f"item int, item_id {kind.simpleString()}"))
        found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
        for b in (vocabulary, at):
            b.unpersist()
    return spark.read.schema(f"item_id {kind.simpleString()}, rank int, doc_id long, score long").parquet(path)


def op12(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
