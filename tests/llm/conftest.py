import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def put(spark, tmp_path_factory):
    """Writes tables {name: (rows, DDL)} as sf_dir and returns its path."""

    def write(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"file://{path}/{name}.parquet")
        return f"file://{path}"

    return write


@pytest.fixture(scope="session")
def corpus():
    """Texts with what is odd about texts: null, empty, white space only, other alphabets, copies, near copies, a long one."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(60)] + ["Été", "ΩΩ", "naïve", "日本"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = make(40)
    texts = [None, "", " \n\t ", "\x00", "one", "two words", "Two  WORDS", shared, shared, shared + " tail", "head " + shared, make(9), "x" * 3000, "é" * 400, " a b"]
    for k in range(60):
        t = make(r.randint(1, 120))
        if k % 4 == 0:
            a = r.randint(0, 20)
            t = t + "\n" + shared[a : a + r.randint(30, 150)] + "\n" + make(5)
        if k % 5 == 0:
            texts.append(t)
        if k % 7 == 0:
            texts.append(t + " more")
        texts.append(t)
    texts.append(make(6000) + " " + shared + " " + make(6000))
    r.shuffle(texts)
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
