"""Null ids, clashing names and very long texts, operator by operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, linededup, neardup, quality, suffixdedup, topk

SCHEMA = "doc_id long, text string"
LINE = "the same line stands in many documents here"


@pytest.fixture(scope="module")
def long_rows():
    """A text of 200,000 words, twice; null ids; rows that repeat."""
    rng = random.Random(31)
    text = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(200_000))
    own = [" ".join(f"w{i}x{j}" for j in range(40)) + "\n" + LINE for i in range(4)]
    return [(1, text), (2, text + " end"), (None, own[0]), (None, own[1]), (3, own[2]), (3, own[2]), (4, own[3]), (None, None)]


@pytest.fixture(scope="module")
def rows(spark, long_rows):
    df = spark.createDataFrame(long_rows, SCHEMA)
    for name in ("_text", "_row", "id", "n", "kept", "piece", "hash", "_at"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3).cache()


def test_encoding(rows, long_rows):
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in bpe.encode(rows).collect()), key=repr)
    codec = bpe.Codec.at(bpe.public_path()).tokenizer
    want = [(i, len(e.ids), codec.decode(e.ids, skip_special_tokens=False)) for i, t in long_rows for e in [codec.encode(t or "", add_special_tokens=False)]]
    assert got == sorted(want, key=repr)


def test_lines(rows):
    got = sorted((repr(r.doc_id), r.n_lines, r.n_dropped) for r in linededup.drop_lines(rows).collect())
    # Documents 3 and 4 hold the line beside rows without an id: whether it counts in three is told by ids.
    assert len(got) == 8 and sum(n for _, n, _ in got) == 2 * 5 + 3 and all(g == 0 for i, _, g in got if i in ("1", "2", "4"))


def test_measures(rows, long_rows):
    got = quality.measure(rows).collect()
    assert sorted(r.n_words for r in got) == sorted(len((t or "").split()) for _, t in long_rows)
    kept = quality.clean(rows)
    assert kept.columns == rows.columns and {r.hash for r in kept.collect()} == {"hash"}


def test_near_copies(rows):
    got = {(r.doc_id, r.component_id) for r in neardup.link(rows).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4)} <= got


def test_repeated_strings(spark, long_rows):
    df = spark.createDataFrame([(i, (t or "")[:300_000]) for i, t in long_rows], SCHEMA).repartition(2)
    got = suffixdedup.cut_repeats(df).collect()
    # Only documents that lose something are in it; short ones, with or without an id, share no 400 bytes.
    assert sorted((r.id, r.n_removed, r.kept) for r in got) == [(1, 300_000, b""), (2, 300_000, b"")]


def test_vectors_with_clashing_names(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(tuple(r) for r in topk.search(df).collect())
    for name in ("query_id", "rank", "score", "shard", "block", "label", "e", "id"):
        df = df.withColumn(name, F.lit(name))
    assert sorted(tuple(r) for r in topk.search(df).collect()) == plain and len(plain) == 15
