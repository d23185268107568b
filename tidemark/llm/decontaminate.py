r"""Benchmark decontamination by suffix arrays over shards of the training text.

Each Arrow chunk of documents is a shard.  Its word suffixes are sorted into a
suffix array and the benchmark's are binary-searched in it, equal ones together:
a range of the shard's suffixes meets a range of the benchmark's, and no pair of
places is ever written out.  Suffixes that cannot start a match are left out
before sorting: all of a match's word pairs must be benchmark pairs.

A document's longest verbatim matches cover its hits from left to right: the first
matched place takes the longest benchmark match that starts there, found by binary
search among the benchmark's sorted suffixes, and the next match starts at the
first matched place whose window reaches beyond it.  Items shorter than a window
match as a whole, where they do not overlap.  Each match names one place of the
benchmark that holds it; `items` names all items with a window in the document.

The benchmark is searched in blocks of at most BLOCK_BYTES of item text, each a
bounded index that tasks load.  Up to PASS blocks are chained in one stage; a
larger benchmark takes a pass per PASS blocks, with a written table between them,
so neither the driver nor a task ever holds more.  No document text is shuffled.

Null or empty texts have no words and are clean.  Items without words or with a
null id are ignored; repeated item ids count once.  Repeated documents are each
judged.  Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _powers, annotate, fresh, mix, rolling, words, written

#: Words of a window; shorter items are one window.
WINDOW = 10
#: Bytes of item text (plus 64 a row) in one block of the benchmark.
BLOCK_BYTES = 8 << 20
#: Blocks that one stage searches; matched places that are measured at once.
PASS, MEASURED = 4, 4096

KIND = "n_words long, n_hit long, items array<string>, hits array<int>, matches array<struct<item:string,item_word:long,word:long,length:long>>"


class Suffixes:
    """Sorted benchmark suffixes of one window length: different keys, and the range of `at` that starts with each."""

    def __init__(self, index: Index, at: np.ndarray, n: int):
        if n == index.window:  # in the order of whole suffixes, for longest matches
            at = at[np.argsort(suffix_ranks(index, n)[at], kind="stable")]
        keys = packed(index.ids, at, n)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.keys, self.bounds = keys[new], np.append(np.flatnonzero(new), len(keys))
        key = np.cumsum(new) - 1
        # Which items a key is found in: keys with equal lists share one, told apart by two sums of hashes.
        pairs = np.unique(key * (len(index.items) + 1) + index.item[at])
        own, item = pairs // (len(index.items) + 1), pairs % (len(index.items) + 1)
        first = np.searchsorted(own, np.arange(len(self.keys) + 1))
        sums = [np.add.reduceat(mix(item.astype(np.uint64) * np.uint64(2) + np.uint64(k)), first[:-1]) for k in (1, 1 << 40)] if len(own) else [own.view(np.uint64)] * 2
        _, where, self.list_of = np.unique(np.stack(sums, axis=1), axis=0, return_index=True, return_inverse=True)
        self.list_of = self.list_of.ravel()
        self.lists = [item[first[k] : first[k + 1]] for k in where]
        self.at = at


class Index:
    """Suffixes of one block of benchmark items, by window length."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        rows = sorted((i, t or "") for i, t in rows if i is not None)
        raw = [t.encode() for _, t in rows]
        offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        hashes, _, _, bounds = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.window = window
        self.items = sorted({i for i, _ in rows})
        numbers = {i: k for k, i in enumerate(self.items)}
        self.vocabulary = np.unique(hashes)
        if len(self.vocabulary) >= 255**3 - 1:
            raise ValueError("a block of the benchmark has too many different words; lower the block size")
        self.hashes = hashes
        self.ids = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        self.end = np.repeat(bounds[1:], np.diff(bounds))
        self.start = np.repeat(bounds[:-1], np.diff(bounds))
        self.item = np.repeat(np.asarray([numbers[i] for i, _ in rows], np.int64), np.diff(bounds))
        self.sums = summed(hashes)
        self.lengths: dict[int, Suffixes] = {}
        sizes = np.diff(bounds)
        for n in sorted({min(int(x), window) for x in sizes if x}):
            own = np.repeat(np.minimum(sizes, window), sizes) == n
            self.lengths[n] = Suffixes(self, np.flatnonzero(own & (np.arange(len(self.ids)) + n <= self.end)), n)
        pairs = rolling(hashes, 2)
        pairs = pairs[np.arange(len(pairs)) + 2 <= self.end[: len(pairs)]]
        self.shift = np.uint64(64 - min(24, max(12, int(max(1, len(pairs)) * 16).bit_length())))
        self.pairs = np.zeros(1 << (64 - int(self.shift)), bool)
        self.pairs[pairs >> self.shift] = True
        del self.ids


def summed(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which any stretch's hash follows."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(len(hashes))[0][: len(hashes)], out=out[1:])
    return out


def suffix_ranks(index: Index, n: int) -> np.ndarray:
    """Rank of each benchmark place by all words from it to its item's end: ranks of twice as many words each time."""
    every = np.arange(len(index.ids))
    _, rank = np.unique(packed(index.ids, every, n, index.end), return_inverse=True)
    depth, classes = n, 0
    while classes < (classes := int(rank.max(initial=-1)) + 1):
        follow = every + depth
        second = np.where(follow < index.end, rank[np.minimum(follow, len(every) - 1)], -1)
        order = np.lexsort((second, rank))
        r, s = rank[order], second[order]
        new = np.zeros(len(order), np.int64)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        rank = np.empty_like(r)
        rank[order] = np.cumsum(new)
        depth *= 2
    return rank


def packed(ids: np.ndarray, at: np.ndarray, n: int, end: np.ndarray | None = None) -> np.ndarray:
    """The n ids from each place as bytes that sort as the ids do and hold no zero; id 0 stands for what is past `end`."""
    out = np.empty((len(at), 3 * n), np.uint8)
    for j in range(n):
        x = ids[at + j] if end is None else np.where(at + j < end[at], ids[np.minimum(at + j, len(ids) - 1)], 0)
        out[:, 3 * j], out[:, 3 * j + 1], out[:, 3 * j + 2] = x // 65025 + 1, x // 255 % 255 + 1, x % 255 + 1
    return np.ascontiguousarray(out).view(f"S{3 * n}").ravel()


def shard_matches(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: the shard's places, in order, that start with a benchmark key, and which key."""
    out = []
    end = np.repeat(bounds[1:], np.diff(bounds))
    pair = np.zeros(len(hashes) + 1, bool)
    if len(hashes) > 1:
        pair[: len(hashes) - 1] = index.pairs[rolling(hashes, 2) >> index.shift]
    missing = np.concatenate([[0], np.cumsum(~pair)])
    for n, own in index.lengths.items():
        place = np.arange(max(0, len(hashes) - n + 1))
        place = place[(missing[place + n - 1] == missing[place]) & (place + n <= end[: len(place)])]
        if not len(place):
            continue
        need = np.flatnonzero(np.cumsum(np.bincount(place, minlength=len(hashes) + 1) - np.bincount(place + n, minlength=len(hashes) + 1)) > 0)
        ids = np.zeros(len(hashes), np.int64)
        found = np.minimum(np.searchsorted(index.vocabulary, hashes[need]), len(index.vocabulary) - 1)
        ids[need] = np.where(index.vocabulary[found] == hashes[need], found + 1, 0)
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        place = place[known[place + n] == known[place]]
        suffixes = packed(ids, place, n)
        order = np.argsort(suffixes, kind="stable")  # the shard's suffix array, to the depth of a window
        suffixes, place = suffixes[order], place[order]
        lo, hi = np.searchsorted(suffixes, own.keys, "left"), np.searchsorted(suffixes, own.keys, "right")
        count = hi - lo  # keys differ, so ranges do not overlap
        if count.sum():
            first = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            place, key = place[first], np.repeat(np.arange(len(own.keys)), count)
            order = np.argsort(place)
            out.append((n, place[order], key[order]))
    return out


def shared_words(index: Index, sums: np.ndarray, p: np.ndarray, a: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words from p on in the shard and from a on in the benchmark are equal, `room` at most."""
    down = _powers(max(len(sums), len(index.sums)))[1]
    lo, hi = np.zeros(len(p), np.int64), room + 1  # equal for lo words, not for hi
    while (hi - lo > 1).any():
        m = (lo + hi) // 2
        same = (sums[p + m] - sums[p]) * down[p] == (index.sums[a + m] - index.sums[a]) * down[a]
        lo, hi = np.where(same, m, lo), np.where(same, hi, m)
    return lo


def measure(index: Index, own: Suffixes, hashes: np.ndarray, sums: np.ndarray, stop: int, p: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a document that ends at `stop`: a benchmark place with the longest match, and its length."""
    low, top = own.bounds[key], own.bounds[key + 1]
    lo, hi = low, top  # where the suffix at p would stand among those with its key
    while (lo < hi).any():
        m = np.minimum((lo + hi) // 2, len(own.at) - 1)
        a = own.at[m]
        room = np.minimum(stop - p, index.end[a] - a)
        n = shared_words(index, sums, p, a, room)
        over = (a + n < index.end[a]) & ((p + n >= stop) | (hashes[np.minimum(p + n, len(hashes) - 1)] < index.hashes[np.minimum(a + n, len(index.hashes) - 1)]))
        open_ = lo < hi
        lo, hi = np.where(open_ & ~over, m + 1, lo), np.where(open_ & over, m, hi)
    best, length = own.at[low], np.zeros(len(p), np.int64)
    for side in (lo - 1, lo):
        ok = (side >= low) & (side < top)
        a = own.at[np.where(ok, side, low)]
        n = np.where(ok, shared_words(index, sums, p, a, np.minimum(stop - p, index.end[a] - a)), 0)
        best, length = np.where(n > length, a, best), np.maximum(n, length)
    return best, length


def longest(index: Index, n: int, hashes: np.ndarray, sums: np.ndarray, start: int, stop: int, place: np.ndarray, key: np.ndarray) -> list[dict]:
    """The matches that cover a document's places, from left to right."""
    own, out, at = index.lengths[n], [], 0
    while at < len(place):
        some = slice(at, at + MEASURED)
        p, k = place[some], key[some]
        where, length = measure(index, own, hashes, sums, stop, p, k) if n == index.window else (own.at[own.bounds[k]], np.full(len(p), n))
        j = 0
        while j < len(p):
            m, a = int(length[j]), int(where[j])
            differ = np.flatnonzero(hashes[p[j] : p[j] + m] != index.hashes[a : a + m])
            m = int(differ[0]) if len(differ) else m
            out.append({"item": index.items[index.item[a]], "item_word": a - int(index.start[a]), "word": int(p[j]) - start, "length": m})
            front = int(p[j]) + (max(1, m - n + 1) if n == index.window else m)
            j = int(np.searchsorted(p, front))
        at = int(np.searchsorted(place, front))
    return out


def search(index: Index):
    """f(data, offsets) for annotate(): words, hits, items and longest matches of each document."""

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        hashes, _, _, bounds = words(data, offsets)
        n = len(offsets) - 1
        n_hit = np.zeros(n, np.int64)
        items: list[list[str]] = [[] for _ in range(n)]
        spans: list[list[int]] = [[] for _ in range(n)]
        matches: list[list[dict]] = [[] for _ in range(n)]
        found = shard_matches(index, hashes, bounds)
        if found:
            edge = np.zeros(len(hashes) + 1, np.int64)
            held: dict[int, np.ndarray] = {}
            sums = summed(hashes)
            for length, place, key in found:
                edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + length, minlength=len(edge))
                doc = np.searchsorted(bounds, place, "right") - 1
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for own in np.split(np.arange(len(place)), cuts):
                    d = int(doc[own[0]])
                    some = held.setdefault(d, np.zeros(len(index.items), bool))
                    for k in np.unique(index.lengths[length].list_of[key[own]]):
                        some[index.lengths[length].lists[k]] = True
                    matches[d] += longest(index, length, hashes, sums, int(bounds[d]), int(bounds[d + 1]), place[own], key[own])
            hit = np.cumsum(edge[:-1]) > 0
            n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)
            turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for s, e in turn.reshape(-1, 2):  # runs of hit words, cut where documents meet
                while s < e:
                    d = int(np.searchsorted(bounds, s, "right")) - 1
                    stop = min(int(e), int(bounds[d + 1]))
                    spans[d] += [int(s - bounds[d]), int(stop - bounds[d])]
                    s = stop
            for d, got in held.items():
                items[d] = [index.items[i] for i in np.flatnonzero(got)]
        return [pa.array(np.diff(bounds)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array(matches, pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())])))]

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (item_id as string, text), each within the block size; an item larger than that is a block."""
    b = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null")
    total = b.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): n_words, n_hit, items (sorted ids), matches, contaminated."""
    out = docs
    columns = list(docs.columns) if keep is None else list(keep)
    carried = columns if text in columns else [*columns, text]
    names: list[str] = []
    live: list = []
    more = blocks(benchmark, block_bytes)
    rows = next(more)
    while rows is not None:
        following = next(more, None)
        at = docs.sparkSession.sparkContext.broadcast(Index(rows, window))
        live.append(at)
        out, name = annotate(out, text, KIND, lambda at=at: search(at.value), keep=[*(carried if following is not None else columns), *names])
        names.append(name)
        if len(live) == PASS and following is not None:
            out = written(out)
            for b in live:
                b.unpersist()
            live = []
        rows = following
    name = fresh(docs, "found")
    if len(names) == 1:
        one = F.col(names[0])
        n_hit, items, matches = one["n_hit"], one["items"], one["matches"]
    else:  # a word hit by several blocks counts once
        flat = F.array_distinct(F.flatten(F.flatten(F.array(*(span_words(F.col(x)["hits"]) for x in names)))))
        n_hit = F.size(flat).cast("long")
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(x)["items"] for x in names)))))
        matches = F.flatten(F.array(*(F.col(x)["matches"] for x in names)))
    result = F.struct(F.col(names[0])["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), matches.alias("matches"), (n_hit > 0).alias("contaminated"))
    return out.select(*(F.col(f"`{c}`") for c in columns), result.alias(name)), name


def span_words(hits):
    """Arrays of the word numbers in [start, end) pairs."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(hits) / 2).cast("int")), lambda i: F.when(i * 2 < F.size(hits), F.sequence(hits[i * 2], hits[i * 2 + 1] - 1)).otherwise(F.array().cast("array<int>")))
    return pairs


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, c = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    r = F.col(c)
    return found.select("doc_id", r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"), F.size(r["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", r["items"]), 256).alias("items_sha256"), r["contaminated"].alias("contaminated"))
