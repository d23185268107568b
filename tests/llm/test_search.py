"""Hard negatives, lexical search and archives against brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOCS
from tidemark.llm import queries

VECTORS, BENCH, PAGES = "vec_id long, embedding array<double>, label int", "item_id long, text string", "page_id long, url string, html string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]


# Hard negatives


def hard(rows, k_positive=5, k=5, share=80):
    """{(anchor, positive): [(negative, positive_score, negative_score)]} from (id, label, whole numbers)."""
    out = {}
    for a, la, q in rows:
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, la == lb) for i, lb, v in rows if i != a)
        for top, i, same in [x for x in s if x[2]][:k_positive]:
            got = [(j, -top, -n) for n, j, own in s if not own and share * -top <= 100 * -n <= 100 * -top][:k]
            if got:
                out[a, i] = got
    return out


def mined(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["anchor_id"], r["positive_id"]].append((r["negative_id"], r["positive_score"], r["negative_score"]))
        assert r["rank"] == len(out[r["anchor_id"], r["positive_id"]])
    return dict(out)


def whole(rows):
    """The contract's rows: labels of ids divisible by 7 moved on, components as whole numbers."""
    ok = [(i, lab, v) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in ok]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    centres = r.standard_normal((6, 6)) + 1
    v = centres[r.integers(0, 6, 900)] + 0.4 * r.standard_normal((900, 6))
    v[100:400] = v[50]  # a third is one vector
    v[500] = 0
    rows = [(i, x.tolist(), int(r.integers(0, 4))) for i, x in enumerate(v)]
    odd = [(900, None, 1), (1000, [1.0] * 6, None), (1100, [float("nan")] + [1.0] * 5, 1), (1200, [None] + [1.0] * 5, 1), (1300, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1400, [], 1), (-100, [2.0] * 6, 2)]
    return rows + odd


def test_op11(spark, put, vectors):
    got = mined(queries.op11(spark, put(embeddings=([(*x, 7, 7) for x in vectors], VECTORS + ", cell int, top int"))))
    assert got == hard(whole(vectors)) and any(a == -100 for a, _ in got)


def test_op11_in_many_trees_and_blocks(spark, put, vectors):
    from pyspark.sql import functions as F

    from tidemark.llm.hard_negatives import mine

    rows = whole(vectors)
    df = spark.createDataFrame([(i, [x / 256 for x in v], lab) for i, lab, v in rows], VECTORS)
    got = mined(mine(df, F.col("vec_id") % 100 == 0, block=4, part_rows=70, sample=64, k_positive=3, k=4, share=60))
    assert got == hard(rows, 3, 4, 60)


def test_op11_long_vectors_repeated_ids_and_ties(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.hard_negatives import mine

    big = [(0, [1e6, 3.0], 1), (1, [1e6, 2.0], 1), (2, [1e6 - 1, 5.0], 2), (3, [9e5, 1.0], 2), (4, [1e30, 0.0], 2), (5, [1.0, 2.0, 3.0], 2)]
    df = spark.createDataFrame(big, VECTORS)
    want = hard([(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in big[:4]])
    assert mined(mine(df, F.col("vec_id") % 100 == 0)) == want and want  # the fifth is too long, the sixth of another length
    same = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (3, [1.0, 0.0], 1), (8, [1.0, 0.0], 2), (8, [1.0, 0.0], 2), (6, [1.0, 0.0], 2)], VECTORS)
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in mine(same, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 3, 1, 6), (0, 3, 2, 8), (0, 3, 3, 8)]


def test_trees_bound_every_distance():
    from tidemark.llm.hard_negatives import Tree

    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-300, 300, (700, 5)), np.tile(r.integers(-300, 300, 5), (300, 1))])
    square = int((x**2).sum(axis=1).max())
    tree = Tree(x, square, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(1000)) and sorted(s for s, _ in tree.leaves) + [1000] == [0] + sorted(e for _, e in tree.leaves)
    q = r.integers(-400, 400, (20, 5)).astype(float)
    least, most = tree.bounds(q)
    for k, (s, e) in enumerate(tree.leaves):
        d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + square - 2 * q @ x[tree.order[s:e]].T, 0))
        assert (least[:, k] <= d.min(axis=1)).all() and (most[:, k] >= d.max(axis=1)).all()


# Lexical search


def ranked(docs, items, k=10, repeats=False):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = {}
    for i, q in items.items():
        scores = []
        for d, c in own:
            n = sum(c.values())
            if not n:
                continue
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum((times if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out[i] = [(d, -s) for s, _, _, d in sorted(scores, key=lambda x: x[:3])[:k]]
    return {i: v for i, v in out.items() if v}


def listed(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return dict(out)


@pytest.fixture(scope="module")
def items(corpus):
    r = random.Random(6)
    texts = [t for _, t, *_ in corpus if t and len(t.split()) > 12]
    bench = [(k, " ".join(r.choice(texts).split()[: r.randint(1, 30)]).upper()) for k in range(25)]
    return [*bench, (30, None), (31, ""), (32, "!!"), (33, "word that is nowhere zzz"), (0, "one more row of item nought"), (None, "two words"), (34, "two two two words")]


def together(items):
    out = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            out[i].update(terms(t))
    return out


def test_op12(spark, put, corpus, items):
    odd = [(None, "two words", "en", "s", 1), (None, None, "en", "s", 1), (5000, "two words", "en", "s", 1), (5000, "two words", "en", "s", 1)]
    rows = [(*x, 1, "x", 2) for x in [*corpus, *odd]]
    sf = put(documents=(rows, DOCS + ", score long, rank string, item_id int"), benchmark=([(*x, "y") for x in items], BENCH + ", doc_id string"))
    assert listed(queries.op12(spark, sf)) == ranked([(d, t) for d, t, *_ in [*corpus, *odd]], together(items))


def test_op12_in_blocks_with_repeats(spark, corpus, items):
    from tidemark.llm.lexical import search

    docs, bench = spark.createDataFrame(corpus, DOCS).repartition(5), spark.createDataFrame(items, BENCH)
    got = listed(search(docs, bench, k=3, repeats=True, block_bytes=400))
    assert got == ranked([(d, t) for d, t, *_ in corpus], together(items), 3, True)


def test_op12_long_texts_and_ties(spark):
    from tidemark.llm.lexical import search

    texts = [(k, "same text here") for k in range(300, 0, -1)] + [(500, "a " * 1_000_000), (501, "b" * 2_000_000), (502, " " * 2_000_000), (503, "same " + "x y " * 500_000)]
    got = listed(search(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "same here"), (2, "a"), (3, "b" * 2_000_000)], BENCH)))
    assert [d for d, _ in got[1]] == list(range(1, 11)) and got == ranked(texts, together([(1, "same here"), (2, "a"), (3, "b" * 2_000_000)]))


def test_terms_with_one_hash_are_told_apart():
    from tidemark.llm import lexical

    own = lexical.Terms({1: ["aa bb cc"]}, False)
    own.hashes[:] = 7
    data = np.frombuffer(b"bb cc aa dd b", np.uint8)
    first, last = np.asarray([0, 3, 6, 9, 12]), np.asarray([2, 5, 8, 11, 13])
    spelled = [own.bytes[own.start[k] : own.start[k + 1]].tobytes().decode() if k >= 0 else None for k in own.of(data, np.full(5, 7, np.uint64), first, last)]
    assert spelled == ["bb", "cc", "aa", None, None]


# Archives


def told(pages, least=0):
    own = [(p, (h or "").encode()) for p, _, h in pages]
    largest = {}
    for p, b in own:
        if p is not None:
            largest[b] = max(p, largest.get(b, p))
    out = []
    for p, b in own:
        top = largest.get(b) if len(b) >= least else None
        other = top if top is not None and top != p else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if other is None else "revisit", other))
    return Counter(out)


@pytest.fixture(scope="module")
def pages():
    r = random.Random(1)
    body = ["".join(r.choice("<p>abc é日\n\r ") for _ in range(r.randint(0, 400))) for _ in range(60)]
    out = [(i, f"http://h/{i} x\r\nEvil: 1", r.choice(body)) for i in range(300)]
    return [*out, *[(400 + i, None, "one very common page") for i in range(200)], (700, "", None), (701, " ", ""), (None, "u", "one very common page"), (None, "u", "only without ids"), (None, None, "only without ids"), (702, "ü", "x" * 2_000_000), (703, "ü", "x" * 2_000_000), (704, "u", "WARC/1.1\r\n\r\n"), (5, "again", out[5][2]), (800, "t", "twice"), (800, "t", "twice")]


def test_op13(spark, put, pages):
    sf = put(pages=([(*p, 1, "b") for p in pages], PAGES + ", key int, largest string"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op13(spark, sf).collect())
    assert got == told(pages)


@pytest.mark.parametrize("rows,hot", [(1_000_000, 1), (0, 1), (0, 3)])
def test_groups_however_they_are_joined(spark, pages, rows, hot):
    from tidemark.llm.warc import with_responses

    df = spark.createDataFrame(pages, "id long, url string, payload string").repartition(6)
    got = Counter((r["id"], r["payload"], r["refers_to"]) for r in with_responses(df, 12, broadcast_rows=rows, hot_groups=hot).collect())
    want = Counter()
    for p, _, h in pages:
        (row,) = [r for r in told(pages, 12) if r[0] == p and r[2] == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()]
        want[p, h, row[4]] += 1
    assert got == want


def test_archives_roll_and_come_back(spark, pages):
    from tidemark.llm.warc import opened, read, write

    archives, path = write(spark.createDataFrame(pages, PAGES).repartition(2), roll_bytes=30_000)
    got = read(archives, path).collect()
    assert len({r["file"] for r in got}) > 5 and sum(r["records"] for r in archives.collect()) == len(got) == len(pages)
    by = {(r["page_id"], r["payload_digest"]): r for r in got}
    for p, _, h in pages:
        r = by[p, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()]
        assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"] == (h or "").encode()
    assert not any("\n" in r["url"] or " " in r["url"] for r in got)
    store, base = opened(path)
    with store.open_input_stream(f"{base}/{got[0]['file']}") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"  # the dictionary leads


def archive_of(records, dictionary=b""):
    import zstandard

    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    lead = b"\x5d\x2a\x4d\x18" + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""
    return lead + b"".join(pack.compress(r) for r in records)


def test_reading_validates():
    import io

    import zstandard

    from tidemark.llm.warc import frames, page_of, page_record

    good = [page_record(k, "http://x/", f"<p>{'word ' * k}</p>".encode(), None) for k in range(400)] + [page_record(9, "u", b"<p></p>", 0)]
    plain = zstandard.train_dictionary(4096, good).as_bytes()  # a dictionary that is not compressed itself
    for dictionary, chunk in ((b"", 1), (plain, 7), (plain, 1 << 20)):
        raw = archive_of(good[:60] if chunk < 100 else good, dictionary)
        out = [page_of(r) for _, r in frames(io.BytesIO(raw), chunk)]
        assert [p[0] for p in out] == list(range(len(out)))[: len(out) - (chunk > 100)] + [9] * (chunk > 100)
    raw = archive_of(good[:3], plain)
    for broken in (raw[:-3], raw + b"rest", raw[:-1] + bytes([raw[-1] ^ 1]), raw[:8] + b"x" + raw[9:]):
        with pytest.raises(ValueError):
            list(frames(io.BytesIO(broken)))
    one = good[5]
    for broken in (one[:-1], one + b"x", one.replace(b"WARC/1.1", b"HTTP/1.1", 1), one.replace(b"word", b"work", 1), re.sub(rb"WARC-Date: [^\r]*\r\n", b"", one), one.replace(b"Content-Length: ", b"Content-Length: 1", 1), one.replace(b"Page-ID: 5", b"Page-ID: 6"), one.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(ValueError):
            page_of(broken)
