r"""SimHash near-duplicates by anchor-point covering.

Fingerprint: words `[^\x20\x09-\x0D]+` after lower-casing A-Z, shingles of three
words joined by a space (fewer words: the whole sequence), XXH64 with seed 42 of
each; bit i is set if it is in over half the hashes, repeats included.  No words:
fingerprint zero.

Links: two fingerprints at 3 or fewer differing bits differ by at most one bit in
one of two halves of 31 bits.  The anchors of a half are the code words of the
perfect Hamming code [31, 26]: every value has exactly one within the covering
radius 1 (its home).  Each fingerprint goes to all 16 anchors within radius plus
threshold, 2 bits, of either half; the home of one of a linked pair always has
the other one too.  As both homes would do, a fingerprint keeps its own home and the
anchors above it only: the pair meets at the larger of its two homes.  Fingerprints
are compared per anchor by their full distance, and an anchor passes on a spanning
forest of its links, so output does not grow with the square of a dense group.

Only different fingerprints are compared; copies fold into one beforehand.  An
anchor with more than LIMIT members is dealt again by parts of the bits outside
its half: of four parts at least one is equal in a linked pair, so this loses
nothing.  A part that is still too large is dealt again by parts of the bits that
are left, and so on until fewer than four are, when there are few values.

similar() links by resemblance instead: five-word shingles with a Jaccard index of 0.8
or more.  Such texts may differ in ten of 64 bits, too many for any covering, so its
fingerprint is longer (WORDS numbers of 62 bits, from word pairs, of which a changed
word takes two and not five), it asks for one differing bit in one of its halves,
and what meets, or has an equal half, falls into groups, of which an anchor tells no more edges than it
has members.  Within a group all texts are then held against each other by their own
shingles, block by block, and a block passes on edges that join what is alike: no pair
is written out, and none stands for another.

Null texts count as empty.  Null ids take no part in a minimum: a component of
null ids only has a null id.  Repeated rows are each answered; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import _ODD, LOWER, mix, rolling, row_chunks, text_buffer, words, written
from tidemark.llm.components import components

SHINGLE, BITS = 3, 3
#: Members of an anchor that a task compares at once.
LIMIT = 20_000
#: Runs up to this length are compared all at once, by shifting.
SHORT = 12

_FOLD = 1 << 18


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Of lower-cased UTF-8 text."""
    own = raw.split()
    if not own:
        return 0
    size = min(size, len(own))
    line = b" ".join(own)
    length = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(own) - size + 1].tolist()
    stop = end[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(start), _FOLD):
        h = np.asarray([digest(line[a:b], 42) for a, b in zip(start[lo : lo + _FOLD], stop[lo : lo + _FOLD], strict=True)], np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed long."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                raw = LOWER[data[offsets[lo] : offsets[hi]]].tobytes()
                at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
                fp = np.asarray([fingerprint(raw[a:b], size) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _pairs_of_syndromes() -> np.ndarray:
    """For each syndrome 1 to 31, masks of what leads to a code word: its one bit, and its 15 pairs of bits."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        masks = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < (i ^ s)]
        out[s] = masks
    return out


_MASKS = _pairs_of_syndromes()
_SYNDROME_BITS = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1)) for b in range(5)]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys, 16 for each half of each fingerprint, row by row, and which of them are homes; -1 marks unused ones."""
    keys, homes = [], []
    for half, shift in enumerate((0, 31)):
        x = (fp >> np.uint64(shift)) & np.uint64((1 << 31) - 1)
        s = np.zeros(len(x), np.int64)
        for b, mask in enumerate(_SYNDROME_BITS):
            s |= (np.bitwise_count(x & mask) & 1).astype(np.int64) << b
        reach = ((x[:, None] ^ _MASKS[s]) | np.uint64(half << 32)).astype(np.int64)
        reach[s == 0, 1:] = -1  # a code word is its own only anchor
        keys.append(reach)
        home = np.zeros(reach.shape, bool)
        home[:, 0] = True
        homes.append(home)
        reach[reach < reach[:, :1]] = -1  # a linked pair meets at the larger of its homes
    return np.concatenate(keys, axis=1), np.concatenate(homes, axis=1)


#: Bits outside each half.
_OUTSIDE = [((1 << 64) - 1) ^ ((1 << 31) - 1), ((1 << 31) - 1) | (3 << 62)]


def dealt_again(fp: np.ndarray, key: np.ndarray, sub: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, sub, fp and mask of each fingerprint four times: by each quarter of the bits that its mask leaves (0: those outside its half); a linked pair agrees in one."""
    out: list[tuple[np.ndarray, ...]] = []
    mask = np.where(mask == 0, np.asarray(_OUTSIDE, np.uint64)[key >> 32], mask)
    for m in np.unique(mask).tolist():
        own = mask == m
        places = [i for i in range(64) if m >> i & 1]
        for k, part in enumerate(np.array_split(places, BITS + 1)):
            bits = np.uint64(sum(1 << int(i) for i in part))
            new = mix(sub[own] * np.uint64(_ODD) + mix((fp[own] & bits) + np.uint64(k + 1)))
            out.append((key[own], new, fp[own], np.full(int(own.sum()), np.uint64(m) & ~bits)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links within `bits` join in x."""
    left, a, b = x, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= bits
            new = left[near]
            a.append(np.full(len(new), front[0]))
            b.append(new)
            left, front = left[~near], np.concatenate([front[1:], new])
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def compare(bits: int, limit: int):
    """mapInArrow function over (key, sub, home, fp, mask) sorted by (key, sub): edges, and the members of runs above the limit that can be dealt again."""

    def out(kind, a, b, sub=None, mask=None):
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(none if c is None else c.view(np.int64)) for c in (a, b, sub, mask))], names=["kind", "a", "b", "sub", "mask"])

    def splits(mask) -> bool:
        return mask == 0 or int(mask).bit_count() > BITS

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size, over, last = 0, False, None

        def settle(parts):
            key, sub, home, fp, mask = (np.concatenate(c) for c in zip(*parts, strict=True))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            first = np.concatenate([[0], edge])
            length = np.diff(np.concatenate([first, [len(key)]]))
            run_of = np.repeat(np.arange(len(first)), length)
            small = np.flatnonzero((length[run_of] > 1) & (length[run_of] <= SHORT))
            f, r, h = fp[small], run_of[small], home[small]
            for s in range(1, SHORT):
                if len(f) <= s:
                    break
                near = (r[s:] == r[:-s]) & (h[s:] | h[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= bits)
                if near.any():
                    yield out(0, f[:-s][near], f[s:][near])
            for k in np.flatnonzero(length > SHORT):
                own = slice(first[k], first[k] + length[k])
                if length[k] > limit and splits(mask[first[k]]):
                    yield out(1, fp[own], key[own], sub[own], mask[own])
                elif home[own].any():
                    a, b = forest(np.unique(fp[own]), bits)
                    if len(a):
                        yield out(0, a, b)

        for batch in batches:
            key, sub, home, fp, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            fp, sub, mask = fp.view(np.uint64), sub.view(np.uint64), mask.view(np.uint64)
            if over:  # the rest of a run that is already too long
                same = (key == last[0]) & (sub == last[1])
                n = len(key) if same.all() else int(np.argmin(same))
                yield out(1, fp[:n], key[:n], sub[:n], mask[:n])
                key, sub, home, fp, mask = (c[n:] for c in (key, sub, home, fp, mask))
                over = not len(key)
                if over:
                    continue
            same = (key == key[-1]) & (sub == sub[-1])
            tail = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            joins = held and (held[0][0][0], held[0][1][0]) == (key[0], sub[0])
            whole, rest = (tuple(c[part] for c in (key, sub, home, fp, mask)) for part in (slice(None, tail), slice(tail, None)))
            if tail or not joins:  # what is held, and all runs that end in this batch, are complete
                done = [*held, whole] if joins or not held else None
                if done is None:
                    yield from settle(held)
                    done = [whole] if tail else []
                done = [p for p in done if len(p[0])]
                if done:
                    yield from settle(done)
                held, size = [], 0
            held.append(rest)
            size += len(key) - tail
            last = (key[-1], sub[-1])
            if size > 4 * limit and splits(mask[-1]):
                for k, s, _, f, m in held:
                    yield out(1, f, k, s, m)
                held, size, over = [], 0, True
        if held:
            yield from settle(held)

    return run


def links(spark: SparkSession, distinct: DataFrame, *, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the different fingerprints fp."""

    def row_of(key, sub, home, fp, mask):
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in (key, sub, home, fp, mask)], names=["key", "sub", "home", "fp", "mask"])

    def replicate(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(lo, 1 << 14).to_numpy(zero_copy_only=False)
                key, home = anchors(fp.view(np.uint64))
                used = key.ravel() >= 0
                none = np.zeros(int(used.sum()), np.int64)
                yield row_of(key.ravel()[used], none, home.ravel()[used], np.repeat(fp, key.shape[1])[used], none)

    def refine(batches):
        for batch in batches:
            fp, key, sub, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(fp):
                key, sub, fp, mask = dealt_again(fp.view(np.uint64), key, sub.view(np.uint64), mask.view(np.uint64))
                yield row_of(key, sub, np.ones(len(key), bool), fp, mask)

    if bits > 3:
        raise ValueError("two halves with a radius-1 code cover 3 differing bits at most")
    row, made = "key long, sub long, home boolean, fp long, mask long", "kind int, a long, b long, sub long, mask long"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").mapInArrow(replicate, row).repartition(n, "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(compare(bits, limit), made))
    edges = found.where("kind = 0").select("a", "b")
    while not (over := found.where("kind = 1")).isEmpty():  # each time there are fewer bits left to deal by
        again = over.select("a", "b", "sub", "mask").mapInArrow(refine, row).repartition(n, "key", "sub").sortWithinPartitions("key", "sub")
        found = written(again.mapInArrow(compare(bits, limit), made))
        edges = edges.union(found.where("kind = 0").select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """(id_col, fp, component_id) for each document; component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    found = written(fingerprints(docs, id_col=id_col, text=text, size=size))
    different = found.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = components(links(spark, different, bits=bits, limit=limit))
    rooted = different.join(roots, different["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    # Fingerprints that stand alone keep their own id; only the rest is grouped and joined back.
    hubs = roots.select("root").distinct()
    grouped = rooted.join(hubs, "root", "left_semi")
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(of_root, "root").select("fp", "component_id")
    copied = rooted.join(hubs, "root", "left_anti").where("n > 1").select("fp", F.col("least").alias("component_id"))
    by_fp = linked.union(copied).withColumnRenamed("fp", "own")
    return found.join(by_fp, found["fp"] == by_fp["own"], "left").select(F.col("id").alias(id_col), "fp", F.when(F.col("own").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


#: similar(): fingerprint numbers, shingle and resemblance; bits of the number met in, and of the lower half of the next one, that may differ.
WORDS, LONG_SHINGLE, SIMILARITY = 6, 5, 0.8
OWN_BITS, NEXT_BITS = 13, 10
#: Ids (32 MB) that may be broadcast to pick texts; more are met by a shuffle of the texts.
BROADCAST_IDS = 4_000_000
#: Members of an anchor that are compared by shifting; pairs a member of a larger one that are given at once; the former for groups; tasks of a frequent half.
ALL_PAIRS, MANY, FEW, SALTS = 12, 8, 6, 16
#: Shingles of a block of texts that a task compares with another (a text counts EACH more); bits of a set's bitmap.
BLOCK, EACH, BITMAP = 1 << 21, 500, 2048
#: Members compared with so many others at once.
_ROWS, _WIDE = 256, 4096
#: A bit of each of four counters in a number; the bits of a number that halves cover, and that the lower half covers.
_LANES, _USED, _HALF = np.uint64(0x0001000100010001), np.uint64((1 << 62) - 1), np.uint64((1 << 31) - 1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), by row and without repeats; a row with fewer words has its whole sequence."""
    n = np.diff(bounds)
    rows, found = [], []
    for k in range(1, size + 1):
        own = n == k if k < size else n >= size
        if own.any():
            h = rolling(hashes, k)
            ok = own[np.repeat(np.arange(len(n)), n)[: len(h)]] & (np.arange(len(h)) + k <= np.repeat(bounds[1:], n)[: len(h)])
            at = np.flatnonzero(ok)
            rows.append(np.searchsorted(bounds, at, "right") - 1)
            found.append(h[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def long_fingerprints(row: np.ndarray, h: np.ndarray, n: int, count: int = WORDS) -> np.ndarray:
    """n x count numbers: a bit is 1 if it is set in over half of the row's hashes, mixed anew for each number."""
    out = np.zeros((n, count), np.uint64)
    if not len(h):
        return out
    total = np.bincount(row, minlength=n)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    cuts = np.union1d(first, np.arange(0, len(h), 1 << 15))  # a lane counts to 65,535
    owner = row[cuts]
    for w in range(count):
        g = mix(h + np.uint64((w * _ODD) % (1 << 64)))
        for s in range(16):
            lanes = np.add.reduceat((g >> np.uint64(s)) & _LANES, cuts)
            for k in range(4):
                c = np.bincount(owner, (lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF), n)
                out[:, w] |= (2 * c > total).astype(np.uint64) << np.uint64(s + 16 * k)
    return out


def sketches(docs: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """(id, d1, d2, fps): two digests that equal word sequences share (equal texts, where there is no word), and the fingerprint (null without words)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                at, part = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                hashes, _, _, bounds = words(part, at)
                d1, d2 = (folded(hashes, bounds, k) for k in (1, 2))
                bare = np.diff(bounds) == 0
                if bare.any():
                    e1, e2 = (folded(part.astype(np.uint64) + np.uint64(1), at, k) for k in (3, 4))
                    d1, d2 = np.where(bare, e1, d1), np.where(bare, e2, d2)
                fps = long_fingerprints(*shingles(hashes, bounds, 2), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([None if b else f for b, f in zip(bare.tolist(), fps.view(np.int64), strict=True)], pa.list_(pa.int64()))], names=["id", "d1", "d2", "fps"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, "id long, d1 long, d2 long, fps array<long>")


def folded(x: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """An order-sensitive digest of each row's numbers."""
    place = np.arange(len(x)) - np.repeat(bounds[:-1], np.diff(bounds))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(x * np.uint64(2 * salt + 1) + mix(place.astype(np.uint64) + np.uint64(salt << 40))))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(_ODD))


def same_halves(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that share a whole half of a number: each id with the one before it in the order of that number."""

    def halves(batches):
        for batch in batches:
            ids, fps = batch.column(0).to_numpy(), batch.column(1)
            every = fps.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            for w in range(every.shape[1]):
                for half in range(2):
                    key = (every[:, w] >> np.uint64(31 * half)) & _HALF | np.uint64((2 * w + half) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), pa.array((every[:, w] & _USED).view(np.int64))], names=["key", "id", "fp"])

    before = F.lag("id").over(Window.partitionBy("key", F.pmod(F.xxhash64("key", "id"), F.lit(SALTS))).orderBy("fp", "id"))  # a frequent half goes to several tasks
    found = distinct.select("id", "fps").mapInArrow(halves, "key long, id long, fp long").select("id", before.alias("other")).where("other is not null")
    return found.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def dealt(distinct: DataFrame, which: list[int] | None = None) -> DataFrame:
    """(key, id, fp, following, root) of rows (id, fps, root): each number (or those of `which`), with the next one's lower half, at its anchors."""

    def replicate(batches):
        for batch in batches:
            ids, fps, roots = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            every = fps.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            for w in range(every.shape[1]) if which is None else which:
                fp, nxt = every[:, w], every[:, (w + 1) % every.shape[1]]
                key, home = anchors(fp)
                used = (key >= 0).ravel()
                key = (key + (w << 34)).ravel()[used]
                row = np.repeat(np.arange(len(ids)), home.shape[1])[used]
                for lo in range(0, len(row), 1 << 16):
                    r = row[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[lo : lo + (1 << 16)], ids[r], fp[r].view(np.int64), (nxt[r] & _HALF).astype(np.int32), roots[r])], names=["key", "id", "fp", "following", "root"])

    return distinct.select("id", "fps", "root").mapInArrow(replicate, "key long, id long, fp long, following int, root long")


def by_anchor(told):
    """mapInArrow function over rows of dealt() in order of key: told(columns) of whole anchors at a time."""

    def compare(batches):
        held = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            new[2] = new[2].view(np.uint64) & _USED
            held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
            if whole:
                yield from told([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield from told(held)

    return compare


def gathered(distinct: DataFrame, parts: int, *, own: int, following: int, which: list[int]) -> DataFrame:
    """Edges (a, b) that join, beside equal roots, all rows (id, fps, root) that meet in an anchor of the numbers `which` and differ in few enough bits.

    The groups are those of all such pairs, but a larger anchor gives fewer edges than it has roots.
    """

    def settle(key, ids, fp, nxt, root):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        differ = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        run_of = np.repeat(np.arange(len(first)), length)
        small = np.flatnonzero((differ & (length <= FEW))[run_of])
        r, i, x, y, c = run_of[small], ids[small], fp[small], nxt[small], root[small]
        for s in range(1, FEW):
            if len(r) <= s or not (same := r[s:] == r[:-s]).any():
                break
            ok = same & (c[s:] != c[:-s]) & (np.bitwise_count(x[s:] ^ x[:-s]) <= own) & (np.bitwise_count(y[s:] ^ y[:-s]) <= following)
            if ok.any():
                yield i[s:][ok], i[:-s][ok]
        for k in np.flatnonzero(differ & (length > FEW)):
            at = slice(first[k], first[k] + length[k])
            yield tied(ids[at], fp[at], nxt[at], root[at], own, following)

    def told(columns):
        for a, b in settle(*columns):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt(distinct, which).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(by_anchor(told), "a long, b long")


def tied(ids: np.ndarray, fp: np.ndarray, nxt: np.ndarray, root: np.ndarray, own: int, following: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that join what is near enough beside what has the same root already."""
    label = np.unique(root, return_inverse=True)[1]
    left, a, b = int(label.max()), [], []
    for i in range(len(ids) - 1):
        if not left:
            break
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= own]
        j = j[np.bitwise_count(nxt[j] ^ nxt[i]) <= following]
        if len(j):
            new, at = np.unique(label[j], return_index=True)
            a.append(np.full(len(at), ids[i]))
            b.append(ids[j[at]])
            label[np.isin(label, new)] = label[i]
            left -= len(new)
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def meet(distinct: DataFrame, parts: int, *, own: int, following: int, only: DataFrame | None = None) -> DataFrame:
    """(kind, a, b, bits) of rows (id, fps, root): pairs of ids with different roots that meet in an anchor and differ in few enough bits (kind 0).

    An anchor with more than MANY such pairs a member gives the nearest one of each
    member and its own key as a (kind 1), to be dealt again when links are known.  With
    `only`, the keys to deal, all pairs are given.  similar() does not ask for pairs; this
    tells what gathered() must join.
    """

    whole_runs = only is not None

    def settle(key, ids, fp, nxt, root):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        differ = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        run_of = np.repeat(np.arange(len(first)), length)
        small = np.flatnonzero((differ & (length <= ALL_PAIRS))[run_of])
        r, i, x, y, c = run_of[small], ids[small], fp[small], nxt[small], root[small]
        for s in range(1, ALL_PAIRS):
            if len(r) <= s or not (same := r[s:] == r[:-s]).any():
                break
            bits = np.bitwise_count(x[s:] ^ x[:-s])
            ok = same & (c[s:] != c[:-s]) & (bits <= own) & (np.bitwise_count(y[s:] ^ y[:-s]) <= following)
            if ok.any():
                yield 0, i[s:][ok], i[:-s][ok], bits[ok]
        for k in np.flatnonzero(differ & (length > ALL_PAIRS)):
            at = slice(first[k], first[k] + length[k])
            run = ids[at], fp[at], nxt[at], root[at]
            if not whole_runs:
                held, n = [], 0
                for p in between(*run, own, following):
                    held.append(p)
                    n += len(p[0])
                    if n > MANY * length[k]:
                        break
                else:
                    yield from ((0, run[0][i], run[0][j], bits) for i, j, bits in held)
                    continue
                held = None
                yield 0, *nearest_between(*run, own, following)
                yield 1, key[at][:1], np.zeros(1, np.int64), np.zeros(1, np.int64)
            else:
                yield from ((0, run[0][i], run[0][j], bits) for i, j, bits in between(*run, own, following))

    def told(columns):
        for kind, a, b, bits in settle(*columns):
            a, b = (np.maximum(a, b), np.minimum(a, b)) if kind == 0 else (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(bits.astype(np.int32))], names=["kind", "a", "b", "bits"])

    rows = dealt(distinct)
    if only is not None:
        rows = rows.join(only, "key", "left_semi").select("key", "id", "fp", "following", "root")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(by_anchor(told), "kind int, a long, b long, bits int").groupBy("kind", "a", "b").agg(F.min("bits").alias("bits"))


def between(ids: np.ndarray, fp: np.ndarray, nxt: np.ndarray, root: np.ndarray, own: int, following: int):
    """Blocks (i, j, bits) of all places whose roots differ and whose numbers are near enough; the members of the largest root are not compared with each other."""
    _, which, count = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((ids, which, -count[which]))
    fp, nxt, root = fp[order], nxt[order], root[order]
    n, most = len(order), int(count.max())
    for lo in range(0, n, _ROWS):
        hi = min(n, lo + _ROWS)
        for at in range(most if hi <= most else lo, n, _WIDE):
            to = min(n, at + _WIDE)
            bits = np.bitwise_count(fp[lo:hi, None] ^ fp[None, at:to])
            ok = (bits <= own) & (root[lo:hi, None] != root[None, at:to]) & (np.arange(lo, hi)[:, None] < np.arange(at, to)[None])
            i, j = np.nonzero(ok)
            near = np.bitwise_count(nxt[lo + i] ^ nxt[at + j]) <= following
            i, j = i[near], j[near]
            if len(i):
                yield order[lo + i], order[at + j], bits[i, j]


def nearest_between(ids: np.ndarray, fp: np.ndarray, nxt: np.ndarray, root: np.ndarray, own: int, following: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of those pairs the nearest one of each member, the smaller id if several are: ids and bits."""
    best = np.full(len(ids), 1 << 20)
    other = np.zeros(len(ids), np.int64)
    for i, j, bits in between(ids, fp, nxt, root, own, following):
        x, y, b = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bits, bits]).astype(np.int64)
        first = np.lexsort((ids[y], b, x))
        first = first[np.concatenate([[True], x[first][1:] != x[first][:-1]])]
        x, y, b = x[first], ids[y[first]], b[first]
        less = (b < best[x]) | ((b == best[x]) & (y < other[x]))
        best[x[less]], other[x[less]] = b[less], y[less]
    some = best < 1 << 20
    return ids[some], other[some], best[some]


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, d1, set) of docs (id, text): a digest and the 32-bit hashes of the text's shingles, once per id and digest."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                hashes, _, _, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, h = shingles(hashes, bounds, size)
                edges = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(edges), pa.array(h.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(folded(hashes, bounds, 1).view(np.int64)), sets], names=["id", "d1", "set"])

    return docs.select("id", "text").mapInArrow(run, "id long, d1 long, set array<int>").dropDuplicates(["id", "d1"])


def bitmaps(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x BITMAP / 64 numbers: a bit is the parity of the row's hashes that fall on it, so two rows differ in no more bits than hashes."""
    out = np.zeros((n, BITMAP // 8), np.uint8)
    for lo in range(0, n, 256):
        a, b = np.searchsorted(row, [lo, min(n, lo + 256)])
        size = min(n, lo + 256) - lo
        count = np.bincount((row[a:b] - lo) * BITMAP + (h[a:b] & np.uint32(BITMAP - 1)), minlength=size * BITMAP)
        out[lo : lo + size] = np.packbits((count & 1).astype(bool).reshape(size, BITMAP), axis=1)
    return out.view(np.uint64)


def linked(ids: np.ndarray, second: np.ndarray, edges: np.ndarray, h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that join what is alike: sets h[edges[i] : edges[i + 1]] of 32-bit hashes, by row; rows of a second block are compared with the others only, as are those.

    Every pair that is not joined yet is looked at, first by sizes and bitmaps, which
    tell that two sets differ in too much, and then by counting what they share.
    """
    n, size = len(ids), np.diff(edges)
    row = np.repeat(np.arange(n), size)
    code = np.unique(h, return_inverse=True)[1]
    here = np.zeros(len(code), bool)
    bits = bitmaps(row, h, n) if n > 16 else None
    label = np.unique(ids, return_inverse=True)[1]
    share = (1 - similarity) / (1 + similarity)
    left, a, b = int(label.max()), [], []
    others = np.flatnonzero(second)
    for i in np.flatnonzero(~second):
        if not left:
            break
        j = others if len(others) else np.arange(i + 1, n)
        j = j[label[j] != label[i]]
        most = share * (size[j] + size[i]) + 1e-6
        ok = (np.abs(size[j] - size[i]) <= most) & (size[j] > 0)
        j, most = j[ok], most[ok]
        if bits is not None and len(j):
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most]
        if not len(j) or not size[i]:
            continue
        mine = code[edges[i] : edges[i + 1]]
        here[mine] = True
        found = []
        for lo in range(0, len(j), 256):
            some = j[lo : lo + 256]
            start = np.cumsum(np.append(0, size[some]))[:-1]
            shared = np.add.reduceat(here[np.concatenate([code[edges[k] : edges[k + 1]] for k in some])], start, dtype=np.int64)
            found.append(some[shared >= similarity * (size[some] + size[i] - shared)])
        here[mine] = False
        j = np.concatenate(found)
        if len(j):
            new, at = np.unique(label[j], return_index=True)
            a.append(np.full(len(at), ids[i]))
            b.append(ids[j[at]])
            label[np.isin(label, new)] = label[i]
            left -= len(new)
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def alike(groups: DataFrame, sets: DataFrame, parts: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join, within each group of rows (id, root), the ids whose sets (id, d1, set) are alike.

    A group's texts are put into blocks by the sizes of their sets, and each pair of blocks
    that may hold texts alike is one comparison: none holds more than two blocks.
    """
    sized = written(groups.join(sets.select("id", "d1", F.size("set").alias("n")), "id"))
    upto = F.sum(F.col("n") + EACH).over(Window.partitionBy("root").orderBy("n", "id", "d1").rowsBetween(Window.unboundedPreceding, 0))
    placed = written(sized.withColumn("block", F.floor((upto - 1) / block).cast("int")))
    ends = placed.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = ends.select("root", F.col("block").alias("p"), "high"), ends.select("root", F.col("block").alias("q"), "low")
    both = one.join(two, "root").where((F.col("p") <= F.col("q")) & (F.col("high") >= similarity * F.col("low")))
    sides = F.array(F.struct(F.col("p").alias("block"), F.lit(False).alias("second")), F.struct(F.col("q").alias("block"), F.lit(True).alias("second")))
    asked = both.select("root", "p", "q", F.explode(sides).alias("s")).select("root", "p", "q", "s.*").where("p < q or not second")

    def compare(batches):
        key, held = None, []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and tuple(names[lo]) != key:
                    yield from settle(held)
                    held = []
                key = tuple(names[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settle(held)

    def settle(held):
        t = pa.Table.from_batches(held).select(["id", "second", "set"]).combine_chunks()
        sets_ = t["set"].combine_chunks()
        edges = np.concatenate([[0], np.cumsum(sets_.value_lengths().to_numpy())]).astype(np.int64)
        a, b = linked(t["id"].to_numpy(), t["second"].to_numpy(), edges, sets_.flatten().to_numpy().view(np.uint32), similarity)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = placed.select("id", "d1", "root", "block").join(asked, ["root", "block"]).join(sets, ["id", "d1"]).select("root", "p", "q", "second", "id", "set")
    return rows.repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(compare, "a long, b long")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = LONG_SHINGLE, similarity: float = SIMILARITY, own: int = OWN_BITS, following: int = NEXT_BITS) -> DataFrame:
    """(id_col, component_id) for each row with an id: the smallest id that links reach; ids are integers.

    Linked are equal word sequences, equal texts without words, and texts whose
    shingles of `size` words have a Jaccard index of `similarity` or more.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    found = written(sketches(known, id_col="id", text="text"))
    different = written(found.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("fps").alias("fps")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = different.where("fps is not null").select(F.col("least").alias("id"), "fps")

    # Groups of all that meets or has an equal half: the first number joins nearly all, the others then tell what that left apart.
    first = gathered(numbers.withColumn("root", F.col("id")), parts, own=own, following=following, which=[0])
    edges = written(first.union(same_halves(numbers)))
    roots = components(edges).withColumnRenamed("node", "id")
    labelled = numbers.join(roots, "id", "left").select("id", "fps", F.coalesce("root", "id").alias("root"))
    groups = components(edges.union(gathered(labelled, parts, own=own, following=following, which=list(range(1, WORDS)))))
    groups = written(groups.select(F.col("node").alias("id"), "root").union(groups.select("root", "root").distinct()))
    asked = groups.select("id")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    sets = written(shingle_sets(known.join(asked, "id", "left_semi"), size))
    roots = components(alike(groups, sets, parts, similarity))
    rooted = different.select("d1", "d2", "n", "least").join(roots, F.col("least") == F.col("node"), "left")
    moved = rooted.where("n > 1 or root is not null").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("root", "least").alias("to"))
    return found.join(moved, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left").select(F.col("id").alias(id_col), F.coalesce("to", "id").alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
