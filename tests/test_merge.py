import pytest
from pyspark.sql import functions as F

from tallyspark.operators import merge as mg

KEYS = ["company_id", "field"]
SCHEMA = "reading_id long, company_id long, field string, value double, confidence double, source string, reader string"


def readings(spark, *rows):
    return spark.createDataFrame([(i, 1, f, v, c, "s", r) for i, (f, v, c, r) in enumerate(rows)], SCHEMA)


def test_precedence(spark):
    r = readings(spark, ("a", 1.0, 0.9, "auto"), ("a", 2.0, 0.95, "auto"), ("a", 3.0, 0.99, "fallback"), ("b", 4.0, 0.1, "human"), ("b", 5.0, 0.99, "rules"), ("c", None, 1.0, "human"), ("c", 6.0, 0.5, "fallback"))
    got = {x["field"]: (x["value"], x["reader"]) for x in mg.precedence_merge(r, KEYS).collect()}
    assert got == {"a": (2.0, "auto"), "b": (4.0, "human"), "c": (6.0, "fallback")}


def test_fallback_never_replaces_a_rule_and_is_reported(spark):
    r = readings(spark, ("a", 100.0, 0.5, "rules"), ("a", 150.0, 0.99, "fallback"), ("a", 100.2, 0.99, "fallback"))
    merged = mg.precedence_merge(r, KEYS)
    assert merged.first()["value"] == 100.0
    assert [x["candidate_b_value"] for x in mg.detect_conflicts(r, merged, KEYS).collect()] == [150.0]
    log = {x["value"]: (x["decision"], x["disagrees"]) for x in mg.decision_log(r, merged, KEYS).collect()}
    assert log == {100.0: ("written", False), 150.0: ("kept_existing", True), 100.2: ("kept_existing", False)}


def test_resolution(spark):
    c = spark.createDataFrame([(1, "a", 5.0, 9.0), (1, "b", 5.0, 9.0), (1, "c", 5.0, 9.0)], "company_id long, field string, candidate_a_value double, candidate_b_value double")
    r = spark.createDataFrame([(1, "a", "b", None), (1, "b", "typed", 7.0)], "company_id long, field string, choice string, typed double")
    got = {x["field"]: (x["resolved_value"], x["is_open"]) for x in mg.apply_resolution(c, r, KEYS).collect()}
    assert got == {"a": (9.0, False), "b": (7.0, False), "c": (5.0, True)}


@pytest.mark.parametrize("mode,want", [
    ("replace", {1: None, 2: 20.0, 3: 30.0, 4: 4.0}), ("coalesce", {1: 1.0, 2: 20.0, 3: 30.0, 4: 4.0}), ("fill_only", {1: 1.0, 2: 20.0, 3: 30.0, 4: 4.0})])
def test_upsert_modes(spark, mode, want):
    t = spark.createDataFrame([(1, 1.0, "x"), (2, None, "x"), (4, 4.0, "x")], "k long, v double, keep string")
    u = spark.createDataFrame([(1, None), (2, 20.0), (3, 30.0)], "k long, v double")
    rows = mg.upsert(t, u, ["k"], mode).collect()
    assert {r["k"]: r["v"] for r in rows} == want
    assert {r["k"]: r["keep"] for r in rows} == {1: "x", 2: "x", 3: None, 4: "x"}


def test_upsert_is_idempotent_and_protects(spark):
    t = spark.createDataFrame([(1, 1.0, True), (2, 2.0, False)], "k long, v double, reviewed boolean")
    u = spark.createDataFrame([(1, 9.0), (2, 9.0)], "k long, v double")
    once = mg.upsert(t, u, ["k"], "replace", protect="reviewed")
    twice = mg.upsert(once, u, ["k"], "replace", protect="reviewed")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1.0, True), (2, 9.0, False)]


def test_reviewed_fields_survive_a_reupload(spark):
    old = spark.createDataFrame([(1, "a", 1.0, True), (1, "b", 2.0, False), (1, "c", 3.0, False)], "company_id long, field string, value double, reviewed boolean")
    new = spark.createDataFrame([(1, "a", 9.0), (1, "c", 3.0), (1, "d", 4.0)], "company_id long, field string, value double")
    got = {x["field"]: (x["new_value"], x["action"]) for x in mg.reupload_replace(old, new, KEYS).collect()}
    assert got == {"a": (1.0, "kept_reviewed"), "b": (None, "cleared"), "c": (3.0, "unchanged"), "d": (4.0, "added")}


def test_children_are_replaced_per_parent(spark):
    t = spark.createDataFrame([(1, "old"), (1, "old2"), (2, "keep")], "p long, v string")
    u = spark.createDataFrame([(1, "new")], "p long, v string")
    assert sorted(map(tuple, mg.replace_children(t, u, ["p"]).collect())) == [(1, "new"), (2, "keep")]


def test_copies_point_to_the_oldest(spark):
    items = spark.createDataFrame([(5, "a", None), (3, "a", None), (9, "b", 1.0)], "id long, label string, amount double")
    m = mg.exact_copies(items, ["label", "amount"])
    assert [tuple(r) for r in m.collect()] == [(5, 3)]
    child = spark.createDataFrame([(1, 5), (2, 9)], "id long, parent_id long")
    assert sorted((r["id"], r["parent_id"]) for r in mg.repoint(child, m, "parent_id").collect()) == [(1, 3), (2, 9)]


def test_most_complete_row_wins(spark):
    rows = [(1, "FY2024", 1, "2024-01-01", 5.0, 0.0), (1, "FY2024", 2, "2023-01-01", 5.0, 6.0), (1, "FY2023", 3, "2023-01-01", None, None)]
    df = spark.createDataFrame(rows, "company_id long, period string, id long, updated_at string, revenue double, net_income double")
    got = {r["period"]: (r["id"], r["copies"]) for r in mg.most_complete(df, ["company_id", "period"], ["revenue", "net_income"]).collect()}
    assert got == {"FY2024": (2, 2), "FY2023": (3, 1)}


def test_directors_are_aligned_only_when_unique(spark):
    rows = [(1, "jane doe", "ned", y) for y in ("FY2023", "FY2024")] + [(1, "john roe", "ned", y) for y in ("FY2023", "FY2024", "FY2024")] + [(1, "j", "ned", y) for y in ("FY2023", "FY2024")]
    df = spark.createDataFrame(rows, "company_id long, name_key string, table_kind string, fiscal_year string")
    assert [r["name_key"] for r in mg.align_directors(df).collect()] == ["jane doe"]


def test_comparative_column_only_fills_or_replaces_smaller(spark):
    p = spark.createDataFrame([(1, "x", False), (2, "x", True)], "k long, line string, is_primary boolean")
    c = spark.createDataFrame([(1, "a", False), (1, "b", False), (2, "a", False), (2, "b", False), (3, "a", False)], "k long, line string, is_primary boolean")
    assert sorted((r["k"], r["line"]) for r in mg.comparative_fill(p, c, ["k"]).collect()) == [(1, "a"), (1, "b"), (2, "x"), (3, "a")]


def test_change_set(spark):
    cur = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (1, "c", 5.0)], "company_id long, field string, value double")
    form = spark.createDataFrame([(1, "a", 5.0, True, 5.0), (1, "b", 6.0, False, None), (1, "d", 7.0, False, None), (1, "c", None, False, 5.0)],
                                 "company_id long, field string, value double, ok boolean, prefill double")
    ch = mg.change_set(cur, form, KEYS)
    assert {r["field"]: (r["op"], r["warn"]) for r in ch.collect()} == {"a": ("confirm", False), "b": ("update", True), "c": ("unchanged", False), "d": ("add", False)}
    done = mg.apply_changes(cur, ch.withColumn("approved", F.lit(True)), KEYS)
    assert {r["field"]: (r["value"], r["result"]) for r in done.collect()} == {"a": (5.0, "confirmed"), "b": (6.0, "applied"), "c": (5.0, "skipped"), "d": (7.0, "applied")}


def test_missing_company_years(spark):
    c = spark.createDataFrame([(1,), (2,)], "company_id long")
    s = spark.createDataFrame([(1, "FY2024")], "company_id long, fiscal_year string")
    assert sorted(map(tuple, mg.missing_company_years(c, ["FY2023", "FY2024"], s).collect())) == [(1, "FY2023"), (2, "FY2023"), (2, "FY2024")]


def test_one_to_one_takes_the_best_edges_first(spark):
    import random

    rng = random.Random(3)
    edges = [(g, rng.randrange(8), rng.randrange(8), rng.randrange(20)) for g in range(12) for _ in range(30)]
    edges = list({e[:3]: e for e in edges}.values())
    got = mg.one_to_one(spark.createDataFrame(edges, "g long, a long, b long, cost long"), ["g", "a"], ["g", "b"], ["cost"]).collect()
    want, left, right = set(), set(), set()
    for g, a, b, cost in sorted(edges, key=lambda e: (e[3], e[0], e[1], e[2])):
        if (g, a) not in left and (g, b) not in right:
            want.add((g, a, b, cost))
            left.add((g, a))
            right.add((g, b))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert mg.one_to_one(spark.createDataFrame([], "g long, a long, b long, cost long"), ["g", "a"], ["g", "b"], ["cost"]).count() == 0


def test_register_reconciled_by_person(spark):
    kind = "company_id long, director_name string, role string, gender string"
    register = [(1, "Louis Otieno", "unknown", None), (1, "Imathiu Jones", "unknown", ""), (1, "Jane Doe", "executive", "Female"), (2, "Ann Wanjiru", "executive", None), (3, "Solo Member", "unknown", None)]
    pay = [(1, "Mr. Louis Onyango Otieno", "executive", "Male"), (1, "Imahtu Jones", "non_executive", "Male"), (1, "Imathiu Jones", "executive", "Female"), (1, "John Doe", "executive", "Male"),
           (2, "Ann Wanjiru", "non_executive", "Female"), (2, "Peter Kamau", "non_executive", "Male"), (2, "Grace Njeri", None, None), (3, "Solo Member", "executive", "Male"), (3, "Other One", "executive", "Male"), (4, "A Bcde", "executive", None)]
    got = mg.reconcile_people(spark.createDataFrame(register, kind), spark.createDataFrame(pay, kind), ["company_id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "Louis Otieno", "executive", "Male", "register"), (1, "Imathiu Jones", "executive", "Female", "register"), (1, "Jane Doe", "executive", "Female", "register"),
        (2, "Ann Wanjiru", "executive", "Female", "register"), (2, "Peter Kamau", "non_executive", "Male", "pay_table"), (2, "Grace Njeri", "unknown", None, "pay_table"),
        (3, "Solo Member", "executive", "Male", "register"),  # two people are too few to take in
    ], key=str)
