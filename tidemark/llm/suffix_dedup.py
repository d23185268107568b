"""Verbatim repeats across documents, removed by suffix arrays.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a
document with a smaller id, judged on the input.  Only strings that may repeat
are worth a suffix array, and equal strings must meet in one of them:

1. Every window of LENGTH bytes is given to its anchor, the smallest hash among
   its GRAM-byte strings.  Equal windows have equal anchors, and neighbouring
   windows share one, so a document has a run of windows per anchor, about one run
   for every 17 bytes.  Runs travel as (anchor, digest of the run's bytes,
   document), packed by column into blobs; no text moves.
2. Per anchor (48 bits): runs with equal digests (64 bits) are copies, and all but the smallest
   document's are hit as a whole (FULL).  If an anchor has runs of several digests
   and documents, each digest's smallest document is asked for its bytes (ASK).
3. The asked runs of an anchor meet in one task, which builds the suffix array of
   their windows in two stages: suffixes smaller than their successors are sorted
   directly, the rest is induced by bucket scans.  Adjacent common prefixes of
   LENGTH bytes make the groups of equal windows; a window is hit if its group has
   a smaller document.
4. The text meets what was found for it, by document id, and is cut.

Within a map task copies of a run fold into one, so a passage that very many
documents share reaches its anchor's task once per map task.  An anchor with more
than HOT asked runs (one passage between ever new neighbours) is resolved window
by window with a plain aggregation instead (HOT): exact, and spread over tasks.

Null texts count as empty.  Rows with equal ids never remove each other's bytes;
rows with a null id are compared with nothing and stay whole.  Every row is
answered.  Strings are bytes: a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _BYTE, _ODD, _powers, mix, row_chunks, text_buffer, written

LENGTH, GRAM = 50, 20
WINDOWS = LENGTH - GRAM + 1
#: Bytes of text, anchors and asked runs that one numpy step works on.
BLOCK, FLUSH, POOL = 1 << 18, 1_500_000, 60_000
#: Bytes of text whose anchors a task judges and resolves at once.
PART_BYTES = 64 << 20
#: Asked runs of one anchor beyond which its windows are aggregated.
HOT = 20_000


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """48-bit hashes of all strings of `size` bytes, by doubling."""
    square, done, out, length = _BYTE[x], 1, None, 0
    while True:
        if size & 1:
            if out is None:
                out, length = square, done
            else:
                n = len(square) - length
                out = out[:n] * np.uint64(pow(_ODD, done, 1 << 64)) + square[length : length + n]
                length += done
        size >>= 1
        if not size:
            return mix(out) >> np.uint64(16)
        n = len(square) - done
        square = square[:n] * np.uint64(pow(_ODD, done, 1 << 64)) + square[done : done + n]
        done *= 2


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    n, done, out = len(h) - width + 1, 1, h
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[:n], out[width - done : width - done + n])


def block_runs(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor, digest) of the runs in x, whose documents end at `ends`."""
    n = len(x) - LENGTH + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    least = sliding_least(gram_hashes(x, GRAM), WINDOWS)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, np.maximum(np.concatenate([[0], ends[:-1]]), ends - LENGTH + 1), 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge[:n]) == 0  # windows that end within their document
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    start = np.flatnonzero(change & whole)
    stop = np.flatnonzero(np.concatenate([(change | ~whole)[1:], [True]]) & whole) + 1
    count = stop - start
    if len(count) and count.max() > WINDOWS:  # periodic text: cut
        parts = -(-count // WINDOWS)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + k * WINDOWS
        count = np.minimum(np.repeat(stop, parts) - start, WINDOWS)
    up, down = _powers(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * up[: len(x)], out=sums[1:])
    digest = mix((sums[start + count + LENGTH - 1] - sums[start]) * down[start] + count.astype(np.uint64))
    return start, count, least[start], digest


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window's byte, number of windows, anchor, digest) of all runs; cuts depend on the document alone."""
    out = []
    for lo, hi in row_chunks(offsets, BLOCK):
        at = int(offsets[lo])
        if hi == lo + 1 and offsets[hi] - at > BLOCK:
            for s in range(at, int(offsets[hi]), BLOCK):
                x = data[s : min(int(offsets[hi]), s + BLOCK + LENGTH - 1)]
                a, n, h, c = block_runs(x, np.asarray([len(x)]))
                out.append((np.full(len(a), lo), a + s, n, h, c))
        else:
            a, n, h, c = block_runs(data[at : offsets[hi]], offsets[lo + 1 : hi + 1] - at)
            out.append((np.searchsorted(offsets, a + at, "right") - 1, a + at, n, h, c))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of x, all first bytes first: sorted values compress."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T).tobytes()


def unplanes(raw: bytes, size: int) -> np.ndarray:
    n = len(raw) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - size :] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def by_anchor(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted and without repeats: h, c, d, and where anchors and where (anchor, digest) classes begin."""
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new_c = new_h.copy()
    new_c[1:] |= c[1:] != c[:-1]
    keep = new_c.copy()
    keep[1:] |= d[1:] != d[:-1]
    return h[keep], c[keep], d[keep], new_h[keep], new_c[keep]


def told(d: np.ndarray, c: np.ndarray, status: int) -> pa.RecordBatch:
    """A row per document with the digests that the status holds for."""
    order = np.argsort(d, kind="stable")
    d, raw = d[order], c[order].astype("<u8")
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(d)) if len(d) else first
    return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(np.full(len(first), status, np.int32)), pa.array([raw[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())], names=["doc", "status", "digests"])


def deal(parts: int):
    """mapInArrow over (id, text): blobs of runs by anchor, copies within the flush folded and told apart."""

    def flush(held):
        h, c, d = (np.concatenate(p) for p in zip(*held, strict=True))
        h, c, d, _, new_c = by_anchor(h, c, d)
        full = ~new_c  # a smaller document of this very flush has the same run
        for kind, own in ((0, new_c), (1, full)):
            hh, cc, dd = h[own], c[own], d[own]
            part = (mix(hh) % np.uint64(parts)).astype(np.int64) if kind == 0 else np.arange(len(hh)) * parts // max(1, len(hh))
            order = np.argsort(part, kind="stable")
            part, hh, cc, dd = part[order], hh[order], cc[order], dd[order]
            edges = np.flatnonzero(np.diff(part)) + 1
            rows = []
            for p, a, b, e in zip(np.split(part, edges), np.split(hh, edges), np.split(cc, edges), np.split(dd, edges), strict=True):
                if len(p):
                    ids, at = np.unique(e, return_inverse=True)
                    width = 2 if len(ids) <= 1 << 16 else 4
                    rows.append((int(p[0]), kind, width, ids.astype("<i8").tobytes(), planes(a, 6) if kind == 0 else b"", planes(b, 8), planes(at.astype(np.uint64), width)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["part", "kind", "width", "ids", "h", "c", "at"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets, 1 << 22):
                row, _, _, h, c = runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.append((h, c, ids[row + lo]))
                size += len(row)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def judge(hot: int):
    """mapInArrow over a part's blobs: (doc, status, digests); status 0 FULL, 1 ASK, 2 HOT."""

    def run(batches):
        hs, cs, ds = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                c = unplanes(r["c"], 8)
                d = np.frombuffer(r["ids"], "<i8")[unplanes(r["at"], r["width"]).astype(np.int64)]
                if r["kind"] == 1:
                    yield told(d, c, 0)
                else:
                    hs.append(unplanes(r["h"], 6))
                    cs.append(c)
                    ds.append(d)
        if not hs:
            return
        h, c, d, new_h, new_c = by_anchor(np.concatenate(hs), np.concatenate(cs), np.concatenate(ds))
        full = ~new_c
        yield told(d[full], c[full], 0)
        anchor = np.cumsum(new_h) - 1
        first = np.flatnonzero(new_h)
        several = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) & (np.bincount(anchor[new_c]) > 1)
        classes = np.bincount(anchor[new_c])
        asked = new_c & several[anchor]
        for status, own in ((1, asked & (classes[anchor] <= hot)), (2, asked & (classes[anchor] > hot))):
            if own.any():
                yield told(d[own], c[own], status)

    return run


def member(row: np.ndarray, digest: np.ndarray, lists: list[list[bytes] | None]) -> np.ndarray:
    """Whether a run's digest is in its row's lists."""
    known = [(r, np.frombuffer(b"".join(x), "<u8")) for r, x in enumerate(lists) if x]
    if not known:
        return np.zeros(len(row), bool)
    keys = np.concatenate([mix(v + np.uint64(r * _ODD % (1 << 64))) for r, v in known])
    return np.isin(mix(digest + row.astype(np.uint64) * np.uint64(_ODD)), keys)


def answer_asked(batches):
    """mapInArrow over (id, text, asks, hots): the asked runs' bytes, and the hot runs' windows."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(batch.column(1))
        asks, hots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi in row_chunks(offsets, 1 << 22):
            x = data[offsets[lo] : offsets[hi]]
            row, a, n, h, c = runs(x, offsets[lo : hi + 1] - offsets[lo])
            raw = x.tobytes()
            for kind, lists in ((1, asks), (2, hots)):
                own = np.flatnonzero(member(row, c, lists[lo:hi]))
                if len(own):
                    texts = [raw[s : s + m + LENGTH - 1] for s, m in zip(a[own].tolist(), n[own].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(h[own].view(np.int64)), pa.array(ids[row[own] + lo]), pa.array(c[own].view(np.int64)), pa.array(texts, pa.binary())], names=["kind", "h", "doc", "digest", "bytes"])


def two_stage(pool: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the windows of the pool's texts, in suffix order to a depth of LENGTH bytes.

    pool: a padded text per row.  A suffix is B if it is smaller than its successor,
    the end counting as the largest.  B suffixes are sorted directly.  Buckets are
    then scanned in the order of their first byte: what precedes an entry and is A
    goes to the end of the A part of its own bucket, and A parts stand before B parts.
    """
    rows, width = pool.shape
    wide = np.full((rows, width + LENGTH), 255, np.uint8)
    wide[:, :width] = pool
    is_b = np.ones((rows, width + 1), bool)
    for i in range(width - 1, -1, -1):
        is_b[:, i] = (wide[:, i] < wide[:, i + 1]) | ((wide[:, i] == wide[:, i + 1]) & is_b[:, i + 1])
    windows = length - LENGTH + 1
    last = np.full(rows, width)
    for i in range(width - 1, -1, -1):  # the first B at or after the last window
        last = np.where((i >= windows - 1) & is_b[:, i], i, last)
    r, i = np.nonzero(is_b[:, :width] & (np.arange(width) <= last[:, None]))
    keys = wide[r[:, None], i[:, None] + np.arange(LENGTH)]
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{LENGTH}").ravel(), kind="stable")
    r, i = r[order], i[order]
    first = wide[r, i]
    edges = np.searchsorted(first, np.arange(257))
    pending: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def induce(rr: np.ndarray, ii: np.ndarray, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """Hands on the A suffixes before these; returns those of the same bucket."""
        some = ii > 0
        rr, ii = rr[some], ii[some] - 1
        a = ~is_b[rr, ii]
        rr, ii = rr[a], ii[a]
        before = wide[rr, ii]
        same = before == byte
        other = np.argsort(before[~same], kind="stable")
        ro, io, bo = rr[~same][other], ii[~same][other], before[~same][other]
        cuts = np.flatnonzero(np.diff(bo)) + 1
        for x, y, z in zip(np.split(ro, cuts), np.split(io, cuts), np.split(bo, cuts), strict=True):
            if len(z):
                pending[int(z[0])].append((x, y))
        return rr[same], ii[same]

    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for byte in range(256):
        got = [np.concatenate(p) for p in zip(*pending[byte], strict=True)] or list(none)
        pending[byte] = []
        while len(got[0]):
            out.append((got[0], got[1]))
            got = induce(got[0], got[1], byte)
        b = slice(edges[byte], edges[byte + 1])
        out.append((r[b], i[b]))
        induce(r[b], i[b], byte)
    row, column = (np.concatenate(p) for p in zip(*out, strict=True))
    window = column < windows[row]
    return row[window], column[window]


def common_prefixes(pool: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Common prefix of each window with the one before, in bytes, LENGTH at most; 0 for the first."""
    out = np.zeros(len(row), np.int64)
    for lo in range(0, max(0, len(row) - 1), 1 << 18):
        hi = min(len(row) - 1, lo + (1 << 18))
        text = pool[row[lo : hi + 1, None], column[lo : hi + 1, None] + np.arange(LENGTH)]
        differ = text[1:] != text[:-1]
        out[lo + 1 : hi + 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return out


def smaller_elsewhere(texts: list[bytes], doc: np.ndarray) -> np.ndarray:
    """For each text a bit mask of its windows that a text of a smaller document has too."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(length.max())
    pool = np.full((len(texts), width), 255, np.uint8)
    pool[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    row, column = two_stage(pool, length)
    prefix = common_prefixes(pool, row, column)
    first = np.flatnonzero(prefix < LENGTH)
    least = np.repeat(np.minimum.reduceat(doc[row], first), np.diff(np.append(first, len(row))))
    hit = least < doc[row]
    return np.bincount(row[hit], np.exp2(column[hit]), len(texts)).astype(np.int64)


def resolve(batches):
    """mapInArrow over (h, doc, digest, bytes) of whole anchors: (doc, digest, bits)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    every = pa.Table.from_batches(held)
    h = every.column("h").to_numpy()
    pools = -(-len(h) // POOL)
    share = mix(h.view(np.uint64)) % np.uint64(pools)
    order = np.argsort(share, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
        part = every.take(pa.array(own))
        # anchors are kept apart by content alone: equal windows have equal anchors
        doc = part.column("doc").to_numpy()
        bits = smaller_elsewhere(part.column("bytes").to_pylist(), doc)
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(part.column("digest").to_numpy()[some]), pa.array(bits[some])], names=["doc", "digest", "bits"])


def window_rows(batches):
    """mapInArrow over hot runs: a row (w1, w2, doc, digest, k) for each window."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            doc, digest = (batch.column(k).slice(lo, 4096).to_numpy() for k in (1, 2))
            w1, w2, who, nth = [], [], [], []
            for r, raw in enumerate(batch.column(3).slice(lo, 4096).to_pylist()):
                for k in range(len(raw) - LENGTH + 1):
                    d = hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest()
                    w1.append(int.from_bytes(d[:8], "little", signed=True))
                    w2.append(int.from_bytes(d[8:], "little", signed=True))
                    who.append(r)
                    nth.append(k)
            who = np.asarray(who, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(doc[who]), pa.array(digest[who]), pa.array(nth, pa.int32())], names=["w1", "w2", "doc", "digest", "k"])


def cut(batches):
    """mapInArrow over (id, text, fulls, answers): what is removed, and the digest of what is left."""
    for batch in batches:
        ids = batch.column(0)
        data, offsets = text_buffer(batch.column(1))
        fulls, answers = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi in row_chunks(offsets, 1 << 22):
            at = offsets[lo : hi + 1] - offsets[lo]
            x = data[offsets[lo] : offsets[hi]]
            gone = np.zeros(len(x), bool)
            some = [r for r in range(hi - lo) if fulls[lo + r] or answers[lo + r]]
            for r in some:
                x_r = x[at[r] : at[r + 1]]
                row, a, n, _, c = runs(x_r, np.asarray([0, len(x_r)]))
                edge = np.zeros(len(x_r) + 1, np.int64)
                whole = member(row, c, [fulls[lo + r]])
                np.add.at(edge, a[whole], 1)
                np.add.at(edge, a[whole] + n[whole] + LENGTH - 1, -1)
                if answers[lo + r]:
                    bits = {}
                    for s in answers[lo + r]:
                        bits[s["digest"]] = bits.get(s["digest"], 0) | s["bits"]
                    for k in np.flatnonzero(np.isin(c.view(np.int64), np.fromiter(bits, np.int64, len(bits)))):
                        b = np.flatnonzero(bits[int(c.view(np.int64)[k])] >> np.arange(int(n[k])) & 1) + a[k]
                        np.add.at(edge, b, 1)
                        np.add.at(edge, b + LENGTH, -1)
                gone[at[r] : at[r + 1]] = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = at[:-1][at[:-1] < at[1:]]
            starts[heads] = gone[heads]
            spans = np.concatenate([[0], np.cumsum(starts)])
            digest = [hashlib.sha256(x[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else x[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed[at[1:]] - removed[at[:-1]]), pa.array(spans[at[1:]] - spans[at[:-1]]), pa.array(digest)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for each document; ids are integers."""
    spark = docs.sparkSession
    both = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    known = both.where("doc is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))  # a task holds its part: parts grow in number, not in size
    blobs = known.mapInArrow(deal(4 * n), "part int, kind int, width int, ids binary, h binary, c binary, at binary")
    found = written(blobs.repartition(n, "part").mapInArrow(judge(hot), "doc long, status int, digests binary"))
    texts = known.repartition(n, "doc")
    lists = [F.filter(F.collect_list(F.when(F.col("status") == s, F.col("digests"))), lambda x: x.isNotNull()).alias(name) for s, name in ((0, "fulls"), (1, "asks"), (2, "hots"))]
    by_doc = found.groupBy("doc").agg(*lists[1:]).where("size(asks) > 0 or size(hots) > 0")
    asked = written(texts.join(by_doc, "doc").select("doc", "text", "asks", "hots").mapInArrow(answer_asked, "kind int, h long, doc long, digest long, bytes binary"))
    answers = asked.where("kind = 1").select("h", "doc", "digest", "bytes").repartition(n, "h").mapInArrow(resolve, "doc long, digest long, bits long")
    hots = asked.where("kind = 2")
    if not hots.isEmpty():
        windows = hots.select("h", "doc", "digest", "bytes").mapInArrow(window_rows, "w1 long, w2 long, doc long, digest long, k int")
        least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
        hit = windows.join(least, ["w1", "w2"]).where("least < doc")
        answers = answers.unionByName(hit.groupBy("doc", "digest").agg(F.expr("bit_or(shiftleft(1L, k))").alias("bits")))
    of_doc = answers.groupBy("doc").agg(F.collect_list(F.struct("digest", "bits")).alias("answers"))
    full = found.where("status = 0").groupBy("doc").agg(F.collect_list("digests").alias("fulls"))
    met = texts.join(full, "doc", "left").join(of_doc, "doc", "left").select("doc", "text", "fulls", "answers")
    none = both.where("doc is null").select("doc", "text", F.lit(None).cast("array<binary>").alias("fulls"), F.lit(None).cast("array<struct<digest:bigint,bits:bigint>>").alias("answers"))
    out = met.unionByName(none).mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("doc", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
