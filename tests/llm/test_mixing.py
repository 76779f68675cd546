"""Mixing: targets, sizes, rounding and odd rows; then the whole pipeline and the registered queries."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import lines, minhash, mixing, queries

from . import brute

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, share=1.5, limit=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            full.add(s)
            left -= target[s]
        if len(full) == len(names):
            return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_sums(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(3000):
        source = rng.choice(["hot"] * 8 + ["a", "ä", "Z", "\U0001f600", "b", None, "tiny"]) if i % 400 else "tiny"
        docs.append((i, source, " ".join(["w"] * int(rng.paretovariate(1.3) * 5 % 900))))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mixed(df).collect()
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == words(docs[r.doc_id][2]) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_rounding_is_fair(spark):
    """Over many draws every document is taken as often as its probability says."""
    docs = [(i, "a" if i < 20 else "b", "w " * (1 + i % 5)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    runs = 60
    total = defaultdict(int)
    for seed in range(runs):
        for r in mixing.mixed(df, seed=seed, block=8).collect():
            total[r.doc_id] += r.copies
    rows = {r.doc_id: r.target / r.source_size for r in mixing.mixed(df).collect()}
    assert all(abs(total[i] / runs - rows[i]) < 0.27 for i in rows)


def test_sources_in_order_of_code_points(spark):
    names = ["b", "a", "Z", "é", "￿", "\U00010000", None, "aa", ""]
    got = {r.source: (r.target, r.source_size) for r in mixing.source_targets(spark.createDataFrame([(n, 1000) for n in names], "source string, source_size long").repartition(4)).collect()}
    want = brute_targets(dict.fromkeys(names, 1000))
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)


def test_mixing_of_odd_rows(odd, nothing):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert len({(r.taken, r.copies) for r in rows if r.doc_id == 12}) == 1
    assert mixing.mixed(nothing).count() == 0


def test_no_python_in_the_native_operators(spark):
    from tallyspark.llm import pseudonyms

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (mixing.mixed(docs), pseudonyms.with_pseudonyms(docs, "k")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# pipeline


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.pin(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_stages_against_brute_force(spark, steps):
    documents, good, unique, apart, clean, mix = steps
    by = lambda rows: {r.doc_id: r for r in rows}
    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op1_quality"](spark, SF).collect()}
    assert set(by(good)) == {i for i, p in scored.items() if p == 1} and all(r == by(documents)[r.doc_id] for r in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in by(good) for i, q in labels.items() if q == 1)

    from .test_texts import brute_chunks

    want = {d: t for d, (t, n) in brute_chunks([(r.doc_id, r.text) for r in good], lines.NEAR_COPIES).items() if n == 0 or t.strip()}
    assert {r.doc_id: r.text for r in unique} == want
    assert all(r.n_chars == len(r.text) for r in unique)

    kept = {i for i, v in brute.near_duplicates([(r.doc_id, r.text) for r in unique], percent=80).items() if v[2]}
    assert set(by(apart)) == kept and all(r == by(unique)[r.doc_id] for r in apart)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination([(r.doc_id, r.text) for r in apart], bench)
    assert set(by(clean)) == {i for i, v in hit.items() if not v[1]} and all(r == by(apart)[r.doc_id] for r in clean)

    sizes = defaultdict(int)
    for r in clean:
        sizes[r.source] += words(r.text)
    target, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in mix:
        assert r.text == by(clean)[r.doc_id].text and r["size"] == words(r.text) and r.copies in (1, 2) and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for r in clean:
        largest[r.source] = max(largest[r.source], words(r.text))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_near_duplicate_stage_takes_a_similarity_of_80_percent(spark):
    rng = random.Random(12)
    docs, between = [], 0
    for i in range(60):  # a run of replaced words in the middle: similarities from 0.76 to 0.87
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        run = rng.randrange(9, 23)
        other = base[:90] + [f"edit{i}x{j}" for j in range(run)] + base[90 + run :]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = brute.shingles(docs[-2][1]), brute.shingles(docs[-1][1])
        between += 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    assert between > 10
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()}
    assert got == {i for i, v in brute.near_duplicates(docs, percent=80).items() if v[2]}
    assert got != {i for i, v in brute.near_duplicates(docs).items() if v[2]}
    op3 = {r.doc_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).where("kept").collect()}
    assert op3 == {i for i, v in brute.near_duplicates(docs).items() if v[2]}


def test_near_copies_of_several_lines_end_as_one_whole_document(spark):
    """60 texts of 15 to 30 lines, each with two copies in which one word of one line is edited."""
    rng = random.Random(9)
    docs = []
    for i in range(60):
        base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(rng.randrange(15, 31))]
        docs.append((3 * i, "\n".join(base)))
        for c in (1, 2):
            other = [x.split() for x in base]
            other[rng.randrange(len(base))][rng.randrange(8)] = f"edit{i}x{c}"
            docs.append((3 * i + c, "\n".join(map(" ".join, other))))
    df = spark.createDataFrame([(d, t, len(t)) for d, t in docs], "doc_id long, text string, n_chars int").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    cut = corpus_pipeline.pin(stages["line_dedup"](spark, df, SF), "cut")
    got = stages["near_duplicates"](spark, cut, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == docs[::3]


def test_the_mix_keeps_all_columns(spark):
    rows = [(i, f"some words of text {i}", f"s{i % 2}", i * 2, "kept") for i in range(20)]
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, size long, extra string"), SF)
    assert {"doc_id", "text", "source", "extra", "size", "target", "copies", "taken"} == set(out.columns) and len(out.columns) == 8
    assert all(r["size"] == 5 and r.extra == "kept" and r.taken == r.copies * 5 for r in out.collect())


def test_run_is_its_stages(spark, steps):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(steps[-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "mixing"]


def test_stages_keep_the_columns_of_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.schema == docs.schema
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


# queries


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))


COLUMNS = {
    1: "doc_id bigint, held_out boolean, score double, predicted int", 3: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    4: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", 5: "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    6: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", 7: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    8: "doc_id bigint, held_out boolean, lang_pred string, score double", 9: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    11: "item_id bigint, rank int, doc_id bigint, score bigint", 12: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    13: "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}
# Rows of a query whose result is not one row for each document.
ROWS = {5: ("embeddings", 1), 11: ("benchmark", 20), 13: ("embeddings", 4)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    number = int(re.match(r"op(\d+)_", name)[1])
    types = dict(got.dtypes)
    for column in COLUMNS.get(number, "doc_id bigint").split(", "):
        c, kind = column.split()
        assert types[c] == kind
    table, times = ROWS.get(number, ("documents", 1))
    assert got.count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_digests_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: brute.base_spans(t) for d, t in docs}
    for r in queries.QUERIES["op4_secrets"](spark, SF).collect():
        base = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == brute.sha(brute.spans_text(base)) and set(filter(None, brute.spans_text(base).split(","))) <= set(r.spans.split(","))
    want = brute.contamination(docs, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    for r in queries.QUERIES["op9_contamination"](spark, SF).collect():
        n, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.sha(",".join(items)), hit > 0)
    want = brute.repeated_bytes(docs)
    for r in queries.QUERIES["op6_repeated_bytes"](spark, SF).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[r.doc_id][:3], brute.sha(want[r.doc_id][3]))
