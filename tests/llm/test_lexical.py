"""Ranked search against scores worked out directly; the treap's own invariants; odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lexical

from . import brute

SF = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best(docs, items, k=20):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text)."""
    held = [(d, t, Counter(TERMS.findall(brute.lower(t)))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, _, c in held), sum(sum(c.values()) for _, _, c in held)
    df = Counter(w for _, _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, t, c in held:
            if c:
                m = 100 - 25 + 25 * sum(c.values()) * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in TERMS.findall(brute.lower(text)) if c[w])
                if score > 0:
                    scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if unknown else d, -s) for i, (s, unknown, d) in enumerate(sorted(scores)[:k])]
    return out


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


def want(docs, items, k=20):
    return sorted(best(docs, items, k), key=lambda r: (str(r[0]), r[1]))


def test_given_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = want([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(lexical.ranked(docs, items)) == expected
    assert got(lexical.ranked(docs.repartition(5), items, shard_docs=16, max_terms=400)) == expected  # many shards, several blocks of items


@pytest.mark.parametrize("seed", range(3))
def test_ties_copies_and_repeated_terms(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)]  # a large group of copies: ties by id
    rng.shuffle(docs)
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)) + ["w1", "w1"] * (i % 2))) for i in range(25)] + [("copy", docs[0][1]), ("none", "absent words"), ("empty", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert got(lexical.ranked(df, asked, shard_docs=100)) == want(docs, items)
    assert got(lexical.ranked(df, asked, k=3)) == want(docs, items, 3)


def test_treap_bounds_and_storage():
    rng = np.random.default_rng(3)
    for columns, rows, cells in ((1, 1, 1), (2, 9, 11), (37, 500, 2000), (64, 64, 4096)):
        at = rng.choice(columns * rows, min(cells, columns * rows), replace=False)
        row, column, impact = at // columns, at % columns, rng.integers(1, 10**6, len(at))
        row = np.unique(row, return_inverse=True)[1]
        treap = lexical.Treap.of(row, column, impact, columns)
        again = lexical.Treap.read(*treap.stored(), columns)
        assert (again.largest == treap.largest).all() and (again.masks == treap.masks).all() and (again.first == treap.first).all()
        table = dict(zip(zip(row.tolist(), column.tolist()), impact.tolist()))
        for r in range(row.max() + 1):  # each row by itself: every document with its exact impact
            scores = lexical.Scores(1, columns)
            _, where, value = lexical.search(treap, np.array([0]), np.array([r]), np.array([1]), scores, beam=2)
            assert dict(zip(where.tolist(), value.tolist())) == {c: v for (x, c), v in table.items() if x == r}


def test_only_promising_ranges_are_halved():
    """A rare heavy cell is found without looking at the other documents."""
    columns = 1024
    row, column = np.concatenate([np.zeros(columns, int), [1]]), np.append(np.arange(columns), 700)
    impact = np.append(np.full(columns, 10), 1000)
    treap = lexical.Treap.of(row, column, impact, columns)
    scores = lexical.Scores(1, 1)
    item, where, value = lexical.search(treap, np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), scores, beam=1)
    assert (where.tolist(), value.tolist()) == ([700], [1010])


def test_terms():
    import pyarrow as pa

    texts = ["A b-c_d", None, "", "über 東京x9", " end", "z"]
    of, packed = lexical.terms(pa.array(texts))
    assert list(zip(of.tolist(), [x.decode() for x in packed.to_pylist()])) == [(i, w) for i, t in enumerate(texts) for w in TERMS.findall(brute.lower(t))]


def test_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "the quick brown fox"), (2, "word1 part2 over 東京"), (3, None), (4, ""), (5, "ONE!"), (None, "lines here second"), (1, "the quick brown fox"), (1, "lazy")]
    asked = spark.createDataFrame([(*r, 3, 4) for r in items], "item_id long, text string, rank int, score int")
    unique = list(dict.fromkeys(items))
    assert sorted(got(lexical.ranked(odd, asked)), key=str) == sorted(want(docs, unique), key=str)
    assert lexical.ranked(nothing, asked).count() == 0
    assert lexical.ranked(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert lexical.ranked(odd, asked).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_a_file_of_the_index_holds_few_shards(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(40)], "doc_id long, text string").coalesce(1)
    index, n = lexical.grids(docs, shard_docs=2)
    assert n == 40 and index.count() == 20
    assert {r["count"] for r in index.groupBy(F.input_file_name()).count().collect()} == {lexical.FILE_SHARDS}
