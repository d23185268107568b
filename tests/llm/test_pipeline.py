"""The pipeline stage by stage, the SQL of what SQL can express, and odd tables for every operator."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_contracts import words
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
LABELS, BENCH, VECTORS = "doc_id long, quality int, toxic int", "item_id long, text string", "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, ([r[c] for c in names] for r in df.collect()))) == sorted(str(list(r)) for r in found.fetchall())


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set()


def groups(text, similarity=0.8):
    """{id: smallest id that links of equal texts or of shingles alike enough reach}."""
    own = {d: shingles(t) for d, t in text.items()}
    root = {d: d for d in text}
    for a, b in itertools.combinations(sorted(text), 2):
        alike = len(own[a] & own[b]) >= similarity * len(own[a] | own[b]) if own[a] and own[b] else (text[a] or "") == (text[b] or "") and own[a] == own[b]
        if alike and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_near_duplicates_of_planted_copies(spark):
    """1 to 5 % of the words changed: what is alike to 0.8 by brute force is found, and nothing else is linked."""
    from tidemark.llm.simhash import similar

    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    texts = {}
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([60, 120, 250, 500]))]
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            own = list(w)
            for k in r.sample(range(len(w)), round(share * len(w))):
                own[k] = r.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
        texts[len(texts)] = " ".join(w[: round(0.85 * len(w))])
        texts[len(texts)] = " ".join(w + w[:5])
    text = " ".join(r.choice(vocabulary) for _ in range(200)).split()
    for _ in range(120):  # a dense group
        own = list(text)
        own[r.randrange(200)] = r.choice(vocabulary)
        texts[len(texts)] = " ".join(own)
    want = groups(texts)
    found = {x["doc_id"]: x["component_id"] for x in similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(want[d] == want[c] for d, c in found.items())  # no link but true ones
    gone = [d for d in texts if want[d] != d]
    assert sum(found[d] != d for d in gone) >= 0.97 * len(gone) and len({found[d] for d in texts if d >= 420}) == 1


@pytest.mark.parametrize("many", [8, 0])
def test_a_centre_that_is_not_alike_hides_no_link(spark, monkeypatch, many):
    """A crowded anchor: all resemble the first text, but only siblings are alike to 0.8 and must be linked."""
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "MANY", many)
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [r.choice(vocabulary) for _ in range(300)]
    texts = {0: " ".join(base)}
    own = [list(base) for _ in range(40)]
    for w in own:
        for k in r.sample(range(len(w)), 12):
            w[k] = r.choice(vocabulary)
    for w in own * 2:  # siblings are far apart in the order of ids
        w[r.randrange(len(w))] = r.choice(vocabulary)
        texts[len(texts)] = " ".join(w)
    want = groups(texts)
    found = {x["doc_id"]: x["component_id"] for x in simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == want and len(set(want.values())) == 41


def test_all_pairs_of_a_crowded_anchor_are_told(spark):
    from tidemark.llm import simhash

    rows = [(i, [5 + (1 << (i % 3))] * 6, i // 2 if i < 30 else 15) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, fps array<long>, root long")
    keys = {tuple(x) for x in simhash.meet(df, 4, own=13, following=10).where("kind = 1").select("a", "kind").collect()}
    assert keys  # more than eight pairs a member
    only = spark.createDataFrame([(k,) for k, _ in keys], "key long")
    got = {(x["b"], x["a"]) for x in simhash.meet(df, 4, own=13, following=10, only=only).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if rows[i][2] != rows[j][2]}


def test_a_crowded_anchor_gives_fewer_edges_than_members(spark):
    """Groups are those of all pairs that meet, without the pairs."""
    from tidemark.llm import simhash

    r = random.Random(4)
    rows = [(i, [(i % 2) * 0x15555555 + (1 << r.randrange(20))] * 6, i if i < 250 else 250) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, fps array<long>, root long")
    got = [(x["a"], x["b"]) for x in simhash.gathered(df, 4, own=13, following=10, which=[0]).collect()]
    assert 0 < len(got) <= 40 * 300  # at most 16 anchors of either half a member; all pairs are 20,000 and more in an anchor

    def parts(edges):
        root = {i: i for i in range(300)} | {i: 250 for i in range(250, 300)}
        for a, b in edges:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    near = [(a, b) for a, b in itertools.combinations(range(300), 2) if (rows[a][1][0] ^ rows[b][1][0]).bit_count() <= 13 and ((rows[a][1][1] ^ rows[b][1][1]) & (2**31 - 1)).bit_count() <= 10]
    assert len(near) > 20_000 and parts(got) == parts(near)
    one = simhash.tied(*(np.array(c) for c in ([*range(300)], [f[0] for _, f, _ in rows], [f[1] for _, f, _ in rows], [c for *_, c in rows])), 13, 10)
    assert len(one[0]) < 300 and parts(zip(*one, strict=True)) == parts(near)


@pytest.mark.parametrize("block", [1 << 21, 3000])
def test_texts_of_a_group_are_held_against_each_other_block_by_block(spark, block):
    """Chains of sets in one group, in one block or many: edges join exactly what is alike to 0.8, and are fewer than members times blocks."""
    from tidemark.llm import simhash

    r = random.Random(9)
    sets = {}
    for c in range(12):
        own = [r.randrange(-(2**31), 2**31) for _ in range(r.choice([4, 20, 100, 300]))]
        for _ in range(8):
            sets[len(sets)] = sorted(set(own))
            for k in r.sample(range(len(own)), max(0, len(own) // (8 + c))):
                own[k] = r.randrange(-(2**31), 2**31)
    sets |= {len(sets): [], len(sets) + 1: [5]}
    shown = spark.createDataFrame([(i, i, x) for i, x in sets.items()], "id long, d1 long, set array<int>")
    groups = spark.createDataFrame([(i, 0) for i in sets], "id long, root long")
    edges = [(x["a"], x["b"]) for x in simhash.alike(groups, shown, 4, 0.8, block).collect()]
    own = {i: set(x) for i, x in sets.items()}
    true = {(a, b) for a, b in itertools.combinations(sets, 2) if own[a] and own[b] and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}

    def parts(edges):
        root = {i: i for i in sets}
        for a, b in edges:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    assert all((min(e), max(e)) in true for e in edges) and parts(edges) == parts(true)
    assert len(set(parts(true).values())) > 12 and len(true) > len(set(edges))


def test_stages_one_by_one(spark, put, corpus):
    bench = [(0, "one"), (1, " ".join(next(t for _, t, *_ in corpus if t and len(t.split()) > 30).split()[5:20]))]
    sf = put(documents=(corpus, DOCS), benchmark=(bench, BENCH), labels=([(i, 1, 0) for i in range(40)], LABELS))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {d: t for d, t, *_ in corpus}
    kept = pipeline.remove_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == len(corpus)  # no label is positive
    kept = pipeline.drop_near_duplicates(spark, docs, sf)
    root = groups(text)
    first = {d for d in text if root[d] == d}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(first)
    clean = pipeline.remove_contaminated(spark, docs, sf)
    windows = {tuple(w[k : k + min(10, len(w))]) for _, t in bench for w in [words(t)] for k in range(len(w) - min(10, len(w)) + 1)}
    dirty = {d for d, t in text.items() for w in [words(t)] if any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))}
    assert dirty and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(text) - dirty)


def test_secrets_are_blanked(spark, put):
    rows = [(1, "é token=abcdefgh1 end", "en", "s", 20), (2, None, "en", "s", 0), (3, "plain [REDACTED]", "en", "s", 5), (4, "x " + "a" * 40 + " password: qwertyuiop", "en", "s", 60)]
    sf = put(documents=(rows, DOCS))
    got = {r["doc_id"]: r for r in pipeline.redact_secrets(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert got[1]["text"] == "é [REDACTED] end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and (got[3]["text"], got[3]["n_chars"]) == ("plain [REDACTED]", 5) and got[4]["text"] == "x [REDACTED] [REDACTED]"


def test_run_packs_what_is_kept(spark, put, corpus):
    sf = put(documents=(corpus, DOCS), benchmark=([], BENCH), labels=([], LABELS))
    got = pipeline.run(spark, sf).collect()
    root = groups({d: t for d, t, *_ in corpus})
    assert {r["doc_id"] for r in got} == {d for d in root if root[d] == d}
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(p)[i][0] == sum(n for _, n in sorted(p)[:i]) for p in places.values() for i in range(len(p)))


def test_empty_tables(spark, put):
    sf = put(documents=([], DOCS), benchmark=([], BENCH), labels=([], LABELS), embeddings=([], VECTORS), pages=([], "page_id long, url string, html string"))
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() == 0, name


def test_nulls_ties_repeats_and_clashing_columns(spark, put):
    """Rows with null or repeated ids are each answered; extra columns with the operators' own names do no harm."""
    extra = ["found", "text_key", "score", "slot", "shard", "key", "component_id", "fp", "rank", "bucket", "id"]
    ddl = DOCS + "".join(f", {c} string" for c in extra)
    base = [(None, "a b c token=abcdefgh1"), (7, "same words here again and again " * 4), (7, "same words here again and again " * 4), (8, None), (None, None), (9, "")]
    rows = [(d, t, None, None, None, *["x"] * len(extra)) for d, t in base]
    sf = put(documents=(rows, ddl), benchmark=([(None, None), (1, None)], BENCH), labels=([(None, None, None), (7, 1, 1)], LABELS), embeddings=([(None, None, None)], VECTORS))
    want = Counter(d for d, _ in base)
    for name, query in queries.QUERIES.items():
        if name in ("pipeline", "op9_neighbours", "op11_hard_negatives", "op12_search", "op13_warc"):
            continue
        got = Counter(r["doc_id"] for r in query(spark, sf).select("doc_id").collect())
        assert set(got) == set(want) and (got == want or name == "op8_training_order"), (name, got)
    out = queries.QUERIES["pipeline"](spark, sf).collect()
    assert {None} <= {r["doc_id"] for r in out} and re.fullmatch(r"\d+", str(out[0]["sequence_id"]))
