"""Hot keys, very long texts and blocks: what is large is dealt again, and nothing is lost."""

import base64
import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_contracts import closure, repeats, rows, simhash
from tidemark.llm import queries

LABELS, VECTORS = "doc_id long, quality int, toxic int", "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("limit", [4, 40])
def test_a_dense_anchor_is_dealt_again_until_it_is_small(spark, limit):
    """Thousands of fingerprints around one code word, alike in most bits, in a part too."""
    from tidemark.llm.components import components
    from tidemark.llm.simhash import links

    r = random.Random(3)
    base, fps = r.getrandbits(64), set()
    for k in range(700):
        x = base
        for b in r.sample(range(31, 64 if k % 2 else 48), r.randint(0, 9)):
            x ^= 1 << b
        fps.add(x ^ (1 << r.randrange(31)) if k % 3 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    root = {r["node"]: r["root"] for r in components(links(spark, spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit)).collect()}
    groups, other = defaultdict(set), defaultdict(set)
    parent = closure({x: x & ((1 << 64) - 1) for x in signed})
    for x in signed:
        groups[root.get(x, x)].add(x)
        other[parent[x]].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in other.values()} and max(map(len, other.values())) > 50


def token(header: str) -> str:
    return base64.urlsafe_b64encode(header.encode()).decode().rstrip("=") + "." + base64.urlsafe_b64encode(b'{"sub": 1}').decode().rstrip("=") + ".c2ln"


def test_headers_of_any_length_and_depth(spark, put):
    deep = '{"x": ' + "[" * 100_000 + "]" * 100_000 + ', "alg": "HS256"}'
    headers = ['{"alg": "HS256"}', '{"pad": "' + "p" * 50_000 + '", "alg": "HS256"}', deep, '{"x": ' + "[" * 100_000 + ', "alg": 1}', '{"x": {"alg": ' + "[" * 100_000 + "]" * 100_000 + "}}", '{"typ": "JWT"}']
    docs = [(k, f"see {token(h)} end", "en", "s", 0) for k, h in enumerate(headers)]
    got = rows(queries.op5(spark, put(documents=(docs, DOCS))))
    assert ["jwt" in got[k]["spans"] for k in range(len(headers))] == [True, True, True, False, False, False]


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\n\\u00e9", true, null, {}], "alg": {}}', "{}", "[1, {\"alg\": 2}]", "7", '"s"', "", "{", '{"a" 1}', '{"a": }', "[1,]", '{"a": 1,}', "[01]", "{'a': 1}", '{"a": 1} x', " [ ] ", '["\x01"]', "[1 2]", '{"a": 1, "a": 2}', "NaN", "]", "{]"])
def test_keys_of_json_without_recursion(text):
    from tidemark.llm.secret_scan import top_keys

    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            top_keys(text)
        return
    assert top_keys(text) == (set(want) if isinstance(want, dict) else None)


def test_op9_in_blocks_with_repeated_ids_and_clashing_columns(spark):
    from tidemark.llm.neighbours import nearest

    r = np.random.default_rng(3)
    v = r.standard_normal((300, 5)).astype("f4")
    table = [(i, x.tolist(), "a", 1.0) for i, x in enumerate(v)] + [(100, v[7].tolist(), "b", 2.0), (100, v[8].tolist(), "c", 3.0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, id string, rank double")
    for extra in ("v", "asks", "query_id", "score"):
        df = df.withColumn(extra, F.lit("x"))
    whole, parts = ([tuple(r) for r in nearest(df, F.col("vec_id") % 50 == 0, k=4, block=b).orderBy("query_id", "rank").collect()] for b in (1024, 2))
    assert whole == parts and Counter(q for q, *_ in whole) == {q: 4 for q in range(0, 300, 50)}
    first = min(v[100].tolist(), v[7].tolist(), v[8].tolist())
    for q, _, i, s in whole:
        own = np.asarray(first if q == 100 else v[q], float)
        near = [v[i]] if i != 100 else [v[100], v[7], v[8]]
        assert i != q and any(abs(s - np.sqrt(((np.asarray(x, float) - own) ** 2).sum())) < 1e-12 for x in near)


def test_op10_takes_one_row_of_a_repeated_id(spark):
    from tidemark.llm.toxicity import sample

    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(500)] + [(k, f"text {k}") for k in range(2, 40)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], LABELS)
    held, _ = sample(docs, labels, id_col="doc_id", text="text", max_positive=5, max_unlabelled=20)
    assert {r["positive"]: r["count"] for r in held.groupBy("positive").count().collect()} == {True: 5, False: 20}


def written_out(row, column, positive, prior, weights, bias):
    """The non-negative risk by its definition, document by document, with a smooth loss."""
    loss = lambda z: 1 / (1 + np.exp(z))
    z = [bias + sum(weights[c] for r, c in zip(row, column, strict=True) if r == i) for i in range(len(positive))]
    p = [i for i, y in enumerate(positive) if y]
    u = [i for i, y in enumerate(positive) if not y]
    rest = np.mean([loss(-z[i]) for i in u]) - prior * np.mean([loss(-z[i]) for i in p])
    return prior * np.mean([loss(z[i]) for i in p]) + max(0.0, rest), rest


def test_op10_fits_what_lowers_the_risk():
    from tidemark.llm.toxicity import nnpu

    r = np.random.default_rng(5)
    positive = np.asarray([True] * 60 + [False] * 240)
    row, column = [], []
    for i in range(300):
        bad = i < 60 or i >= 280
        for c in range(6):
            if r.random() < (0.8 if (c < 3) == bad else 0.1):
                row.append(i)
                column.append(c)
    w, bias = nnpu(np.asarray(row), np.asarray(column), positive, 0.1, 6)
    fitted, _ = written_out(row, column, positive, 0.1, w, bias)
    flat, _ = written_out(row, column, positive, 0.1, np.zeros(6), float(np.log(0.1 / 0.9)))
    assert fitted < flat and min(w[:3]) > max(w[3:])
    scores = np.asarray([bias + sum(w[c] for q, c in zip(row, column, strict=True) if q == i) for i in range(300)])
    hidden, clean = scores[280:], scores[60:280]
    assert np.mean(hidden[:, None] > clean[None]) > 0.95  # positives among the unlabelled rank above the rest


def test_the_toxicity_stage_drops_what_is_toxic(spark, put):
    r = random.Random(5)
    common = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(1200):
        w = [r.choice(common) for _ in range(40)]
        if i % 8 == 0:
            for _ in range(4):
                w[r.randrange(40)] = r.choice(["vile", "rotten", "wretch", "scum"])
        docs.append((i, " ".join(w), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 8 == 0)))
    docs += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0)]
    sf = put(documents=(docs, DOCS), labels=(labels, LABELS))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {x["doc_id"] for x in pipeline.remove_toxic(spark, table, sf).collect()}
    dropped = {d for d, *_ in docs} - kept
    assert {2000, 2001} <= kept and sum(d % 8 != 0 for d in dropped) <= 5 and len(dropped) >= 140


@pytest.fixture(scope="module")
def long_texts(put):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    varied = " ".join(word() for _ in range(330_000))
    texts = ["a" * 2_000_000, " " * 2_000_000, "ab " * 700_000, varied, varied + " tail", "short text of a few words", None]
    return texts, put(documents=([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), labels=([(i, 1, i % 2) for i in range(7)], LABELS))


def test_texts_of_two_million_characters(spark, long_texts):
    texts, sf = long_texts
    got = rows(queries.op2(spark, sf))
    assert all(got[i]["size"] == len(t or "") + 1 and got[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    got = rows(queries.op4(spark, sf))
    assert [got[i]["n_words"] for i in range(7)] == [1, 0, 700_000, 330_000, 330_001, 6, 0]
    got, fp = rows(queries.op7(spark, sf)), {i: simhash(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()} and {i: r["component_id"] for i, r in got.items()} == closure(fp)
    assert len(rows(queries.op10(spark, sf))) == 7
    kept = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert kept == {0, 1, 2, 3, 5, 6}


def test_repeats_in_texts_of_two_million_characters(spark, long_texts):
    texts, sf = long_texts
    got = rows(queries.op6(spark, sf))
    assert [got[i]["n_bytes"] for i in range(7)] == [len(t or "") for t in texts]
    assert [got[i]["n_removed"] for i in range(7)] == [0, 0, 0, 0, len(texts[3]), 0, 0]


def test_tokens_of_texts_of_two_million_characters(spark, long_texts):
    import public_tokenizers

    from tidemark.llm.token_output import materialise, read_slots

    texts, sf = long_texts
    index, path = materialise(spark.read.parquet(f"{sf}/documents.parquet"), length=4096, per_shard=64)
    got = index.collect()
    read = list(read_slots(path, 0, len(got)))
    tokenizer, by = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(dict)
    for r in got:
        by[r["doc_id"]][r["piece"]] = read[r["slot"]].tolist()
    for i in (2, 3, 6):
        assert list(itertools.chain.from_iterable(by[i][k] for k in sorted(by[i]))) == tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0]


def test_op6_counts_parts_from_the_data(spark, sf_hot):
    docs, path = sf_hot
    got = rows(queries.op6(spark, path))
    want = repeats({d: t for d, t, *_ in docs})
    for d, r in got.items():
        assert (r["n_removed"], r["n_spans"]) == want[d][1:3], d


@pytest.fixture(scope="module")
def sf_hot(put):
    """A third of the documents share a passage, each between other neighbours."""
    r = random.Random(4)
    passage = "the passage that many documents share and that is longer than fifty bytes"
    docs = [(i, (f"{r.random()} " + passage + f" {r.random()}") if i % 3 == 0 else f"own text {r.random()} {r.random()} {r.random()}", "en", "s", 0) for i in range(300)]
    return docs, put(documents=(docs, DOCS))

