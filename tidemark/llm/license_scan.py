r"""License scans by diagonal voting.

The rolling k-word hashes of every document are joined to the positions of the
same hashes in the license templates.  A match at word p of the document and word
q of the template votes for the diagonal p - q.  Diagonals at most GAP apart are
one span, because a word more or less moves the rest of a notice to the next
diagonal.  A span is verified by the share of the template's words that its
matches cover; at COVER or more the template's label is given.

Base phrases are counted apart, on the words themselves.  The templates are a
fixed list, so the side that is broadcast has a fixed size.  A document's votes
depend on its text alone and are keyed by the text's digest, so copies vote once
and a lost executor changes nothing.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.  Null texts
count as empty: no words, no labels, score 0.  Each row is answered, repeats too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, annotate, fresh, rolling, row_chunks, text_buffer, words, written

K, GAP, COVER = 3, 3, 0.75

# The base phrases, and the notices that licenses are known by.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

BASE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.asarray([0, len(raw)]))[0]


def phrase_counter(phrases: dict[str, str]):
    """f(data, offsets) for annotate(): where phrases stand, checked on the bytes."""
    known = [(p.split(), hashed(p), label) for p, label in phrases.items()]

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        hashes, first, last, bounds = words(data, offsets)
        low = LOWER[data].tobytes()
        n = len(offsets) - 1
        starts: list[list[int]] = [[] for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        for want, code, label in known:
            m = len(want)
            at = np.flatnonzero(hashes[: max(0, len(hashes) - m + 1)] == code[0])
            for j in range(1, m):
                at = at[hashes[at + j] == code[j]]
            row = np.searchsorted(bounds, at, "right") - 1
            for p, r in zip(at, row, strict=True):
                if p + m <= bounds[r + 1] and all(low[first[p + j] : last[p + j]] == w.encode() for j, w in enumerate(want)):
                    starts[r].append(int(p - bounds[r]))
                    labels[r].add(label)
        return [
            pa.array(np.diff(bounds)),
            pa.array([len(s) for s in starts], pa.int64()),
            pa.array([min(s, default=None) for s in starts], pa.int64()),
            pa.array([max(s, default=None) for s in starts], pa.int64()),
            pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
        ]

    return run


def votes(keyed: DataFrame, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(key, template, diagonal, places): where the text's k-word hashes meet the template's, by diagonal."""
    spark = keyed.sparkSession

    def grams(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                hashes, _, _, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                rows = rolling(hashes, k).view(np.int64)
                size = np.maximum(np.diff(bounds) - (k - 1), 0)
                at = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(bounds[:-1] - at[:-1], size) + np.arange(at[-1])
                arrays = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(rows[take] if len(take) else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), arrays], names=["key", "hashes"])

    rows = [(int(h), t, q) for t, (_, notice) in enumerate(templates) for q, h in enumerate(rolling(hashed(notice), k).view(np.int64))]
    positions = spark.createDataFrame(rows, "hash long, template int, q int")
    all_grams = keyed.mapInArrow(grams, "key string, hashes array<long>").select("key", F.posexplode("hashes").alias("p", "hash"))
    met = all_grams.join(F.broadcast(positions), "hash")  # some hundreds of rows, fixed by TEMPLATES
    return met.groupBy("key", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("p").alias("places"))  # a template's length at most


def spans(keyed: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, k: int = K, gap: int = GAP) -> DataFrame:
    """(key, label, start, end, cover): merged diagonals as spans of words, with the share of the template that they cover."""
    spark = keyed.sparkSession
    about = spark.createDataFrame([(t, label, len(hashed(notice))) for t, (label, notice) in enumerate(templates)], "template int, label string, length int")
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int")
    islands = votes(keyed, templates, k).withColumn("island", F.sum(F.coalesce(far, F.lit(0))).over(by))
    covered = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: p - F.col("diagonal") + j)))
    merged = islands.withColumn("covered", covered).groupBy("key", "template", "island").agg(
        F.min(F.array_min("places")).alias("start"), (F.max(F.array_max("places")) + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered")
    )
    cover = F.size("covered") / F.col("length")
    return merged.join(F.broadcast(about), "template").select("key", "label", "start", "end", cover.alias("cover"))


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, cover: float = COVER) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): n_words, n_base, first_word, last_word, base_labels, labels, spans, score."""
    keep = list(docs.columns) if keep is None else list(keep)
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    found = spans(keyed.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text")), templates)
    good = F.col("cover") >= cover
    by_text = found.groupBy(F.col("key").alias("own_key")).agg(
        F.collect_set(F.when(good, F.col("label"))).alias("own_labels"), F.collect_list(F.when(good, F.struct("label", "start", "end", "cover"))).alias("own_spans"), F.max("cover").alias("own_cover")
    )
    by_text = written(by_text)  # an aggregate in the join's stage would keep a text with very many copies in one task
    base, name = annotate(keyed, text, BASE, lambda: phrase_counter(phrases), keep=[*keep, key])
    out = base.join(by_text, base[key] == by_text["own_key"], "left")
    b = F.col(name)
    result = F.struct(
        *(b[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")),
        F.array_sort(F.array_union(b["base_labels"], F.coalesce(F.col("own_labels"), F.array().cast("array<string>")))).alias("labels"),
        F.col("own_spans").alias("spans"),
        F.when(b["n_base"] > 0, 1.0).otherwise(F.least(F.coalesce(F.col("own_cover"), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
    return out.select(*(base[f"`{c}`"] for c in keep), result.alias(name)), name


def op4(spark, sf_dir: str) -> DataFrame:
    out, c = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    r = F.col(c)
    told = [F.array_join(r[x], ",").alias(x) for x in ("base_labels", "labels")]
    return out.select("doc_id", *(r[x].alias(x) for x in ("n_words", "n_base", "first_word", "last_word")), *told, r["score"].alias("score"))
