"""Near-duplicates (sets and vectors), and the components under both."""

import random

import numpy as np
import pandas as pd
import pytest

from tallyspark.llm import minhash, pivots
from tallyspark.llm.graph import components

from . import brute


def edited(rng, words, share):
    return [f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    """Groups around a base text with edits of different strength, exact copies among them, and texts that share only a passage."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs, n = [], 0
    for share in (0.0, 0.01, 0.02, 0.03, 0.05):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        for _ in range(25):
            docs.append((n := n + 1, " ".join(edited(rng, base, share))))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for size in range(5, 85, 2):
        docs.append((n := n + 1, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(size))))
    rng.shuffle(docs)
    return docs


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    want = brute.components({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark, family):
    got = minhash.near_duplicates(spark.createDataFrame(family, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(family)
    assert all(r.keeper == r.kept for r in got)


def test_links_next_to_a_component_are_found(spark):
    """A node that is no neighbour of its bucket's first node but of another one must be linked, however the tables fall."""
    rng = random.Random(9)
    base = [f"a{i}" for i in range(120)]
    docs = []
    for i in range(60):  # a chain: each is near the next, the ends are far apart
        docs.append((i, " ".join(base)))
        base = base[2:] + [f"b{i}x", f"b{i}y"]
    rng.shuffle(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: v[1] for k, v in brute.near_duplicates(docs).items()}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 5, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        bits = np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == 0 and not by[1][0].kept and by[0][0].kept
    assert by[6][0].component_id == 5  # case is folded, short texts are one shingle
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[2][0].kept and by[3][0].component_id == 3
    assert by[8][0].component_id == 7
    assert {r.component_id for r in by[None]} == {0, None}
    assert [r.component_id for r in by[12]] == [12, 12] and sum(r.keeper for r in by[12]) == 1
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == [0, 2, 3, 4, 5, 7, 9, 11, 12, 13, None]


def vectors(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(first, first + len(x)), "embedding": list(x), "label": 1}))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, 700)[:, None]
    tight = base[:1] + 0.01 * rng.normal(size=(900, 32))  # a group of a third of all
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * off, tight, base[:50] * 3, base[:50] * 3])
    got = pivots.near_vectors(vectors(spark, x), block=128).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert (got.n_links.to_numpy() <= want).all()
    assert got.n_links.sum() >= 0.99 * want.sum()
    planted = near[np.arange(700), np.arange(700, 1400)]
    reached = got.component_id.to_numpy()[:700] == got.component_id.to_numpy()[700:1400]
    assert reached[planted].mean() >= 0.95
    assert got.n_links[1400:2300].min() >= 899
    assert (got.kept == (got.index == got.component_id)).all()


def test_vectors_of_extreme_length(spark):
    """Finite vectors whose squares vanish or overflow are compared like any others; nothing below the threshold is linked."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 6))
    scale = 10.0 ** rng.choice([-170, -160, -3, 0, 5, 160, 200, 300], size=(120, 1))
    x = np.concatenate([base * scale, (base + 0.05 * rng.normal(size=base.shape)) / scale, [[5e-324, 5e-324, 0, 0, 0, 0], [1.7e308, 1.7e308, 0, 0, 0, 0]]])
    got = pivots.near_vectors(vectors(spark, x)).toPandas().set_index("vec_id").sort_index()
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert (got.n_links.to_numpy() <= near.sum(axis=1)).all() and got.n_links.sum() >= 0.98 * near.sum() and near[:120, 120:240].diagonal().mean() > 0.9
    rows = [[1e-170, 1e-170], [1.0, 0.01], [1.0, 0.011], [0.3, 1.0], [1e200, 1e200], [1e200, 1.01e200]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(vectors(spark, np.array(rows))).collect()}
    assert got == {0: (2, 0), 1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 0), 5: (2, 0)}


def test_more_pivots_describe_a_vector_where_there_are_more():
    assert [pivots.nearest_of(n, 8) for n in (1, 450, 500, 1000, 20_000, 130_000)] == [8, 8, 8, 10, 18, 24]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.1]), (10, [3.0, 0.1]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, links int")
    got = pivots.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == [
        (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 4, 1), (10, 4, 1)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(4, 1, False)]
    assert pivots.near_vectors(df.limit(0)).count() == 0
