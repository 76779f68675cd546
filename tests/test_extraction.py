"""Typed field extraction: numbers and their kinds, nearest phrases, fallbacks, and one sentence for one field."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.ontology import FIELD_TERMS, field_kind
from tallyspark.operators import extraction as ex
from tallyspark.operators import filings as fg


def chunks(spark, *rows):
    """(doc_id, page, heading, text)"""
    return spark.createDataFrame([(d, p, i, h, t) for i, (d, p, h, t) in enumerate(rows)], "doc_id long, page int, first_line int, heading string, text string")


def fields(spark, *rows, **options):
    return {(r.doc_id, r.field): (r.value, r.page, r.confidence) for r in ex.extract_fields(chunks(spark, *rows), **options).collect()}


def test_reading_is_dealt_to_all_tasks_and_hints_are_known_beforehand(spark):
    some = chunks(spark, (1, 1, "Board of directors", "The board comprises 9 directors."))
    plan = ex.candidates(some, FIELD_TERMS)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    scored = fg.chunk_scores(some, FIELD_TERMS)._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count("regexp_extract_all(") <= 4  # words of the chunk, never those of a hint


@pytest.mark.parametrize("sentence,want", [
    ("The board comprises eleven directors.", [("count", 11.0)]),
    ("KShs 1,250,000 was paid", [("amount", 1250000.0)]), ("a fee of $ 2.5 million and KES 300", [("amount", 2.5e6), ("amount", 300.0)]),
    ("12.5% or 14 per cent", [("percentage", 12.5), ("percentage", 14.0)]), ("aged 54 years", [("age", 54.0)]), ("In 2024 there were 9", [(None, 2024.0), ("count", 9.0)]),
    ("on 31 December 2024", [(None, 31.0), (None, 2024.0)]), ("see note 12 and page 4", [(None, 12.0), (None, 4.0)]), ("totals 10,650,400", [("amount", 10650400.0)]),
    ("for 18 months", [(None, 18.0)]), ("3.14 and 250 people", [(None, 3.14), (None, 250.0)]), ("no figures", []), ("", []), ("A1 b2b 7", [("count", 7.0)]),
])
def test_typed_numbers(spark, sentence, want):
    got = spark.createDataFrame([(sentence,)], "s string").select(ex.typed_numbers(F.col("s")).alias("n")).first()["n"]
    assert [(n["kind"], n["value"]) for n in got] == want
    assert all(sentence[n["begin"] : n["end"]].strip() and n["end"] > n["begin"] for n in got)


def test_the_nearest_number_wins_and_kinds_are_kept_apart(spark):
    got = fields(
        spark, (1, 3, "Corporate Governance", "In 2024 the board comprises 11 directors with an average tenure of 6 years and fees of KShs 5,000,000."),
        (1, 9, "Directors' Remuneration Report", "The annual retainer is KShs 2,400,000 and the sitting allowance is KShs 45,000 for each of 6 meetings."),
    )
    assert got[(1, "board_size")][:2] == (11.0, 3)
    assert got[(1, "retainer_fee")][0] == 2400000.0
    assert got[(1, "chairperson_meeting_allowance")][0] == 45000.0 and (1, "other_ned_meeting_allowance") not in got


def test_words_of_the_noun_phrase_tell_fields_apart(spark):
    got = fields(spark, (1, 2, "Board of directors", "The board has two executive directors and seven non-executive directors. Five are independent non-executive directors.\nThere are 3 women on the board, and 6 men on the board."))
    assert {f: got[(1, f)][0] for f in ("executive_directors_count", "non_executive_directors_count", "independent_neds_count", "directors_female", "directors_male")} == {
        "executive_directors_count": 2.0, "non_executive_directors_count": 7.0, "independent_neds_count": 5.0, "directors_female": 3.0, "directors_male": 6.0}


def test_answers_and_their_denials(spark):
    got = fields(
        spark, (1, 4, "Remuneration policy", "The company runs a long-term incentive plan for staff. An esop is not in place."),
        (2, 4, "Remuneration policy", "The Company does not operate a share option scheme for Directors. There were no long-term incentives granted."),
    )
    assert got[(1, "has_ltip")][0] == 1.0 and got[(1, "has_share_option_scheme")][0] == 0.0
    assert not [k for k in got if k[0] == 2]  # the absence of a scheme is no mention of one


def test_a_value_beyond_the_best_chunks_is_found(spark):
    heads = [(1, p, "Directors' Remuneration Report", "The policy on the retainer fee is reviewed by the committee.") for p in range(1, 7)]
    got = fields(spark, *heads, (1, 40, "Other matters", "A monthly retainer of KShs 90,000 is paid."), (1, 50, None, "A monthly retainer of KShs 10,000 was paid."))
    assert got[(1, "retainer_fee")][:2] == (90000.0, 40)


def test_one_number_for_one_field_by_mutual_best_choice(spark):
    """Both allowances want the first sentence; the loser takes its next best."""
    rows = [(1, 2, "Directors' Remuneration Report", "The sitting allowance is KShs 30,000."), (1, 5, "Directors' Remuneration Report", "A meeting fee of KShs 20,000 is paid.")]
    got = fields(spark, *rows)
    assert {got[(1, f)][:2] for f in ("chairperson_meeting_allowance", "other_ned_meeting_allowance")} == {(30000.0, 2), (20000.0, 5)}
    alone = fields(spark, rows[0])
    assert (1, "chairperson_meeting_allowance") in alone and (1, "other_ned_meeting_allowance") not in alone


def test_loose_mentions_count_less(spark):
    got = fields(spark, (1, 1, "Directors' Remuneration Report", "The Board Chairman is entitled to an annual fee, a retainer, of Shs 10,650,400."))
    [r] = [r for r in ex.candidates(chunks(spark, (1, 1, "Directors' Remuneration Report", "For the chairman the fee, an annual one, a retainer, is Shs 10,650,400."))).where("field = 'chairperson_annual_retainer'").collect()]
    assert r.distance == ex.LOOSE_DISTANCE and r.value == 10650400.0
    assert got[(1, "chairperson_annual_retainer")][0] == 10650400.0


def test_weak_evidence_is_dropped_and_empty_chunks_say_nothing(spark):
    assert fields(spark, (1, 1, None, None), (2, 1, "", ""), (3, 1, "Revenue", "Nothing is stated here.")) == {}
    assert fields(spark, (1, 1, None, "Revenue was KShs 5,000."), least=0.7) == {}
    assert fields(spark, (1, 1, None, "Revenue was KShs 5,000."))[(1, "turnover")] == (5000.0, 1, 0.63)


def test_every_field_of_the_table_scores_on_its_own_phrases(spark):
    """Curly quotes are folded, a negative phrase silences its field, headings weigh more than text."""
    rows = []
    for i, (field, entry) in enumerate(FIELD_TERMS.items()):
        rows += [(i, 1, entry["synonyms"][0].replace("'", "’"), ""), (i, 2, None, entry["synonyms"][0].strip())]
    scored = {(r.doc_id, r.page): r.score for r in fg.chunk_scores(chunks(spark, *rows), FIELD_TERMS).where(F.col("field") == F.element_at(F.array(*map(F.lit, FIELD_TERMS)), (F.col("doc_id") + 1).cast("int"))).collect()}
    for i, (field, entry) in enumerate(FIELD_TERMS.items()):
        assert scored[(i, 1)] >= 0.5 and (scored[(i, 1)] > scored.get((i, 2), 0.0)), field
    silent = [(i, 1, None, n) for i, n in enumerate(n for e in FIELD_TERMS.values() for n in e.get("negative_terms", []))]
    assert not fg.chunk_scores(chunks(spark, *silent), FIELD_TERMS).where("field IN ('has_ltip', 'has_share_option_scheme')").count()
    assert {field_kind(f) for f in FIELD_TERMS} == {"amount", "count", "age", "percentage", "answer", "name"}
