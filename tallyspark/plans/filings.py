"""Filing-text queries over the given documents and over filings printed from the survey rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import extraction as ex
from ..operators import filings as fg
from ..operators import matching as mt
from ..operators import readers as rd
from . import views
from .registry import query


def doc_pages(spark, sf_dir):
    return fg.paginate(views.table(spark, sf_dir, "documents").select("doc_id", "text"))


def web_pages(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), fg.strip_tags("html").alias("text"))


_WORDS = list(text.NUMBER_WORDS)


def filings(spark, sf_dir):
    """Report pages printed from each company-year: cover, governance, remuneration, income statement, pay table."""
    s = views.survey(spark, sf_dir).where("n_lines > 0")
    n = views.view(spark, sf_dir, "company").select("company_id", "name")
    w = F.array(*[F.lit(x) for x in _WORDS])

    def word(c):
        return F.try_element_at(w, (F.col(c) + 1).cast("int"))

    def money(c):
        return F.format_number(F.coalesce(F.col(c), F.lit(0.0)), 0)

    y = F.col("year_no").cast("string")
    when_stated = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*parts)).otherwise(F.lit(""))
    p1 = F.concat("name", F.lit(" Plc\nAnnual Report and Financial Statements\nFor the year ended 31 December "), y)
    p2 = F.concat(
        F.lit("Corporate Governance\n"), when_stated("board_size", F.lit("The Board comprised "), word("board_size"), F.lit(" members during the year. ")),
        when_stated("board_meetings_per_year", F.lit("The Board held "), F.col("board_meetings_per_year").cast("int").cast("string"), F.lit(" scheduled meetings. ")),
        when_stated("committees_per_board", F.lit("The Board has established "), word("committees_per_board"), F.lit(" standing committees. ")),
        when_stated("avg_age_independent_neds", F.lit("The average age of independent directors on the board is "), F.col("avg_age_independent_neds").cast("int").cast("string"), F.lit(" years.")))
    p3 = F.concat(
        F.lit("Directors' Remuneration Report\nKShs'000 KShs'000\n"),
        F.when(F.col("n_units") % 2 == 0, "The non-executive directors are given medical cover. ").otherwise("There is no medical cover for the non-executive directors. "),
        F.when(F.col("n_units") % 3 == 0, "Each director is paid a transport allowance. ").otherwise(""), F.lit("Staff receive airtime from management."))
    p4 = F.concat(
        F.lit("Statement of profit or loss\nFor the year ended 31 December "), y, F.lit("\nKShs'000 KShs'000\nShs'000\nRevenue 5 "), money("turnover"), F.lit(" 1,000\nProfit for the year "),
        F.when(F.coalesce("net_profit", F.lit(0.0)) < 0, F.concat(F.lit("("), F.format_number(F.abs("net_profit"), 0), F.lit(")"))).otherwise(money("net_profit")),
        F.lit(" (250)\nOther comprehensive items 7 2\nAt 31 December "), y, F.lit("\nStatement of financial position\nTotal assets 12,14 "), money("market_cap"), F.lit(" 2,500"))
    fee = F.format_number((F.col("n_lines") % 50 + 100).cast("double"), 0)
    sit = F.format_number((F.col("n_lines") % 7).cast("double"), 0)
    tot = F.format_number((F.col("n_lines") % 50 + 100 + F.col("n_lines") % 7).cast("double"), 0)
    p5 = F.concat(F.lit("Remuneration of non-executive directors\nFees Sitting allowance Total\nMr. John Doe "), fee, F.lit(" "), sit, F.lit(" "), tot, F.lit("\nJane Roe "), fee, F.lit(" - "), fee,
                  F.lit("\nMary Major (Chairman) 500 20 520\nLate Joiner* 10 1 11\nOne Short "), fee, F.lit(" "), fee, F.lit("\nTotal 9,999 9 9,999"))
    doc_id = (F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id")
    pages = F.posexplode(F.array(p1, p2, p3, p4, p5)).alias("pos", "text")
    return s.join(n, "company_id").select(doc_id, pages).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


_DOC = "company_id * 10000 + year_no"
_PAGES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 pg AS (SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM ln GROUP BY 1, 2)"""


@query("document_pages", f"WITH {_PAGES} SELECT doc_id, page, md5(text) AS text_hash FROM pg")
def document_pages(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("doc_id", "page", F.md5("text").alias("text_hash"))


@query("document_facts", f"""WITH {_PAGES} SELECT doc_id, count(*) AS pages, sum(length(text))::BIGINT AS text_chars, count(*) FILTER (WHERE length(text) < 120) AS thin_pages,
 round_even((count(*) - count(*) FILTER (WHERE length(text) < 120)) * 100.0::DOUBLE / count(*), 0) AS text_pages_pct FROM pg GROUP BY doc_id""")
def document_facts(spark, sf_dir):
    return fg.doc_facts(doc_pages(spark, sf_dir))


_TOPICS = {"definite": r"\bthe\b", "linking": r"\band\b|\bwith\b", "german": r" und "}


@query("topic_pages", f"""WITH {_PAGES}, h AS ({" UNION ALL ".join(f"SELECT doc_id, page, '{k}' AS topic, len(regexp_extract_all(text, '(?i){p}')) AS hits FROM pg" for k, p in _TOPICS.items())}),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY hits DESC, page) AS place FROM h WHERE hits > 0)
 SELECT doc_id, topic, page, CAST(hits AS INT) AS hits, CAST(place AS INT) AS place FROM r WHERE place <= 6""")
def topic_pages(spark, sf_dir):
    return fg.topic_hits(doc_pages(spark, sf_dir), _TOPICS).select("doc_id", "topic", "page", "hits", "place")


_HEAD = """hl AS (SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, i % 20 AS line_no, trim(line, ' ') AS line FROM ln),
 hd AS (SELECT *, regexp_split_to_array(line, '\\s+') AS w FROM hl),
 he AS (SELECT *, length(line) BETWEEN 3 AND 120 AND NOT regexp_matches(line, '[.;:,!?]$') AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{L}'))) >= greatest(1.0, len(w) * 0.6) AS is_heading FROM hd)"""


@query("heading_lines", f"WITH {_PAGES}, {_HEAD} SELECT doc_id, page, CAST(line_no AS INT) AS line_no, md5(line) AS line_hash FROM he WHERE is_heading")
def heading_lines(spark, sf_dir):
    ls = fg.page_lines(doc_pages(spark, sf_dir)).withColumn("line", F.trim("line"))
    return ls.where(fg.is_heading("line")).select("doc_id", "page", "line_no", F.md5("line").alias("line_hash"))


_CHUNKS = f"""{_PAGES}, {_HEAD}, np AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1), hs AS (SELECT doc_id, line, count(DISTINCT page) AS k FROM he WHERE is_heading GROUP BY 1, 2),
 rn AS (SELECT hs.doc_id, hs.line FROM hs JOIN np USING (doc_id) WHERE k >= greatest(3, n // 3) AND k >= n * 0.85),
 mk AS (SELECT he.*, is_heading AND rn.line IS NULL AS mark FROM he LEFT JOIN rn ON rn.doc_id = he.doc_id AND rn.line = he.line),
 cn AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS chunk_no, last_value(CASE WHEN mark THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS h FROM mk),
 ch AS (SELECT doc_id, page, CAST(min(line_no) AS INT) AS first_line, any_value(h) AS heading, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT mark), '') AS text FROM cn GROUP BY doc_id, page, chunk_no)"""


@query("headed_chunks", f"WITH {_CHUNKS} SELECT doc_id, page, first_line, heading, md5(text) AS text_hash FROM ch")
def headed_chunks(spark, sf_dir):
    return fg.chunk_lines(doc_pages(spark, sf_dir)).select("doc_id", "page", "first_line", "heading", F.md5("text").alias("text_hash"))


# words taken from the given texts, so the scoring has something to find
ONTOLOGY = {
    "definite": {"synonyms": ["the and", "that the"], "section_hints": ["whou thorreou"], "negative_terms": ["hahahaha"]},
    "linking": {"synonyms": ["and the", "with"], "section_hints": ["entering tion"], "negative_terms": []},
}


def _synonym(p: str) -> str:
    return f"CASE WHEN contains(h, '{p}') THEN 0.5::DOUBLE WHEN contains(t, '{p}') THEN 0.15::DOUBLE ELSE 0 END"


def _hint(p: str) -> str:
    both = " AND ".join("list_contains({0}, '" + w + "')" for w in p.split())  # two-word hints: one word is below the 0.6 share
    return (f"CASE WHEN contains(h, '{p}') OR ({both.format('hw')}) THEN 0.8::DOUBLE WHEN contains(t, '{p}') OR ({both.format('tw')}) THEN 0.3::DOUBLE ELSE 0 END")


def _field_score(entry: dict) -> str:
    total = " + ".join([_synonym(p) for p in entry["synonyms"]] + [_hint(p) for p in entry["section_hints"]])
    bad = " OR ".join(f"contains(t, '{p}')" for p in entry["negative_terms"])
    return f"CASE WHEN {bad} THEN 0 ELSE {total} END" if bad else total


_SCORES = " UNION ALL ".join(f"SELECT doc_id, page, first_line, '{f}' AS field, {_field_score(e)} AS score FROM lw" for f, e in ONTOLOGY.items())


@query("chunk_scores_by_field", f"""WITH {_CHUNKS}, lw AS (SELECT doc_id, page, first_line, lower(coalesce(heading, '')) AS h, lower(text) AS t, regexp_extract_all(lower(coalesce(heading, '')), '[a-z]+') AS hw, regexp_extract_all(lower(text), '[a-z]+') AS tw FROM ch),
 sc AS ({_SCORES}), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, page, first_line) AS place FROM sc WHERE score > 0)
 SELECT doc_id, field, page, first_line, round_even(score, 4) AS score, CAST(place AS INT) AS place FROM rk WHERE place <= 5""")
def chunk_scores_by_field(spark, sf_dir):
    scored = fg.chunk_scores(fg.chunk_lines(doc_pages(spark, sf_dir)), ONTOLOGY)
    return fg.rank_chunks(scored).select("doc_id", "field", "page", "first_line", F.bround("score", 4).alias("score"), "place")


def stated_pages(spark, sf_dir):
    """Report pages that state what the survey row holds, with other numbers around it; what a row lacks, its page leaves out."""
    s = views.survey(spark, sf_dir)
    num = lambda c: F.format_number(c, 0)
    said = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    whole = lambda c: F.col(c).cast("int").cast("string")
    y = F.col("year_no").cast("string")
    p1 = F.concat(F.lit("Board of directors\n"), said("board_size", "In ", y, " the board comprises ", whole("board_size"), " directors with 3 years of service.\n"), said("directors_female", "At the end of the year ", whole("directors_female"), " were women on the board."))
    p2 = F.concat(F.lit("Directors' remuneration report\nThe sitting allowance is KShs "), num(F.col("n_lines") + 20000), F.lit(" for each of 4 meetings."))
    p3 = F.when(F.col("n_units") % 2 == 1, F.concat(F.lit("Directors' remuneration report\nA meeting fee of KShs "), num(F.col("n_units") + 10000), F.lit(" is paid to others."))).otherwise("Blank page")
    p4 = F.concat(F.lit("Remuneration policy\n"), F.when(F.col("n_units") % 3 == 0, "The company runs a long-term incentive plan.").when(F.col("n_units") % 3 == 1, "The long-term incentive plan is not open to them.").otherwise("The company operates a pension scheme."))
    p5 = F.concat(F.lit("Other matters\nOn 31 December a monthly retainer of KShs "), num(F.col("n_lines") * 3 + 50000), F.lit(" fell due, see note 14."))
    return s.select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.posexplode(F.array(p1, p2, p3, p4, p5)).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


@query("extracted_fields", views.oracle(f"""SELECT {_DOC} AS doc_id, 'board_size' AS field, 'count' AS kind, 1 AS page, board_size AS value FROM survey WHERE board_size IS NOT NULL
 UNION ALL SELECT {_DOC}, 'directors_female', 'count', 1, directors_female FROM survey WHERE directors_female IS NOT NULL
 UNION ALL SELECT {_DOC}, 'chairperson_meeting_allowance', 'amount', 2, CAST(20000 + n_lines AS DOUBLE) FROM survey
 UNION ALL SELECT {_DOC}, 'other_ned_meeting_allowance', 'amount', 3, CAST(10000 + n_units AS DOUBLE) FROM survey WHERE n_units % 2 = 1
 UNION ALL SELECT {_DOC}, 'has_ltip', 'answer', 4, CAST(1 - n_units % 3 AS DOUBLE) FROM survey WHERE n_units % 3 < 2
 UNION ALL SELECT {_DOC}, 'retainer_fee', 'amount', 5, CAST(n_lines * 3 + 50000 AS DOUBLE) FROM survey"""))
def extracted_fields(spark, sf_dir):
    """Typed values read with the whole field table: the number nearest to a phrase, and no sentence for two fields."""
    return ex.extract_fields(fg.chunk_lines(stated_pages(spark, sf_dir))).select("doc_id", "field", "kind", "page", "value")


@query("first_numbers")
def first_numbers(spark, sf_dir):
    """The plainer reader: the first number of a field's best chunks."""
    ranked = fg.rank_chunks(fg.chunk_scores(fg.chunk_lines(filings(spark, sf_dir)), {
        "board_size": {"synonyms": ["board comprised"], "section_hints": ["corporate governance"]},
        "board_meetings": {"synonyms": ["board held"], "section_hints": ["corporate governance"]}}))
    return fg.extract_counts(ranked).select("doc_id", "field", "page", "value", "confidence")


_KW = [(r"\bthe\b", 1, 6), (r"\band\b", 2, 5)]


@query("selected_pages", f"""WITH {_PAGES}, s AS (SELECT doc_id, page, least(len(regexp_extract_all(lower(text), '\\bthe\\b')), 6) * 1.0::DOUBLE + least(len(regexp_extract_all(lower(text), '\\band\\b')), 5) * 2.0::DOUBLE AS score, length(text) AS chars FROM pg),
 t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page DESC) AS place FROM s WHERE score >= 4), tt AS (SELECT * FROM t WHERE place <= 3),
 c AS (SELECT doc_id, page, score, chars FROM tt UNION SELECT s.doc_id, s.page, s.score, s.chars FROM s JOIN tt ON s.doc_id = tt.doc_id AND s.page = tt.page + 1 WHERE tt.place <= 4 AND s.score >= 2),
 u AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY page) AS running_chars, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM c)
 SELECT doc_id, page, score, CAST(running_chars AS BIGINT) AS running_chars FROM u WHERE running_chars <= 6000 OR n = 1""")
def selected_pages(spark, sf_dir):
    scored = fg.topic_task_pages(doc_pages(spark, sf_dir), _KW)
    return fg.select_pages(scored, 3, 6000, 4.0).select("doc_id", "page", "score", "running_chars")


def _currency_sql() -> str:
    """Markers counted over whole texts, the most cited currency (ties in the order of the table), else the language's."""
    h = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    h = f"regexp_replace(regexp_replace({h}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        h = f"replace({h}, '{entity}', '{ch}')"
    m = text.CURRENCY_MARKERS
    counts = ", ".join(" + ".join("len(regexp_extract_all(lower(t), '" + p.replace("'", "''") + "'))" for p in ps) + f" AS {k}" for k, ps in m.items())
    top, total = f"greatest({', '.join(m)})", " + ".join(m)
    name = "CASE " + " ".join(f"WHEN {k} = k THEN '{k}'" for k in m) + " END"
    return f"""WITH d AS (SELECT page_id AS doc_id, {h} AS t, NULL AS country FROM pages UNION ALL SELECT doc_id + 1000000000, text, lang FROM documents),
 c AS (SELECT doc_id, country, {counts} FROM d), b AS (SELECT *, {top} AS k, {total} AS n FROM c),
 g AS (SELECT doc_id, CASE WHEN lower(trim(country)) IN ('de', 'fr', 'es') THEN 'EUR' END AS guess, CASE WHEN k > 0 THEN {name} END AS cur, CASE WHEN k > 0 THEN k END AS mentions,
  CASE WHEN k > 0 THEN round_even(least(0.95::DOUBLE, 0.6::DOUBLE + 0.35::DOUBLE * (k::DOUBLE / n)), 2) END AS conf FROM b)
 SELECT doc_id, coalesce(cur, guess) AS currency, mentions, CASE WHEN cur IS NULL THEN CASE WHEN guess IS NOT NULL THEN 0.5::DOUBLE END ELSE conf END AS confidence, cur IS NULL AND guess IS NOT NULL AS inferred FROM g"""


@query("document_currency", _currency_sql())
def document_currency(spark, sf_dir):
    votes = fg.document_currency(web_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)))
    country = views.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.col("lang").alias("country"))
    return fg.with_country_currency(votes, country, {"de": "EUR", "fr": "EUR", "es": "EUR"})


@query("filing_currency", views.oracle(f"SELECT {_DOC} AS doc_id, 'KES' AS currency, CAST(7 AS BIGINT) - 2 AS mentions, 0.95::DOUBLE AS confidence FROM survey JOIN company USING (company_id)"))
def filing_currency(spark, sf_dir):
    return fg.document_currency(filings(spark, sf_dir))


@query("filing_statement_unit", views.oracle(f"SELECT {_DOC} AS doc_id, 'thousands' AS statement_unit, CAST(3 AS BIGINT) AS votes FROM survey JOIN company USING (company_id)"))
def filing_statement_unit(spark, sf_dir):
    return fg.statement_unit(filings(spark, sf_dir))


@query("filing_unit", views.oracle(f"SELECT {_DOC} AS doc_id, 'thousands' AS unit FROM survey JOIN company USING (company_id)"))
def filing_unit(spark, sf_dir):
    return fg.document_unit(filings(spark, sf_dir)).select("doc_id", "unit")


@query("pay_header_unit", views.oracle(f"SELECT {_DOC} AS doc_id, 'thousands' AS unit FROM survey JOIN company USING (company_id)"))
def pay_header_unit(spark, sf_dir):
    return rd.header_unit(filings(spark, sf_dir))


@query("filing_year", views.oracle(f"SELECT {_DOC} AS doc_id, 'FY' || CAST(year_no AS VARCHAR) AS period_label, CAST(2 AS BIGINT) AS votes FROM survey JOIN company USING (company_id)"))
def filing_year(spark, sf_dir):
    return fg.document_year(filings(spark, sf_dir))


@query("interim_reports", views.oracle(f"""SELECT {_DOC} AS doc_id, CASE company_id % 3 WHEN 0 THEN 'H1 ' WHEN 1 THEN 'Q3 ' ELSE 'Q1 ' END || CAST(year_no AS VARCHAR) AS interim_label
 FROM survey JOIN company USING (company_id)"""))
def interim_reports(spark, sf_dir):
    s = views.survey(spark, sf_dir)
    months = F.when(F.col("company_id") % 3 == 0, "six").when(F.col("company_id") % 3 == 1, "nine").otherwise("three")
    p = s.select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.lit(1).alias("page"),
                 F.concat(F.lit("Results for the "), months, F.lit(" months ended 30 June "), F.col("year_no").cast("string")).alias("text"))
    return fg.interim_label(p)


def _fact(field, conf):
    return f"SELECT {_DOC} AS doc_id, '{field}' AS field, {field} AS value, {conf}::DOUBLE AS confidence FROM survey JOIN company USING (company_id) WHERE {field} IS NOT NULL"


@query("stated_facts", views.oracle(" UNION ALL ".join([
    _fact("board_size", 0.85), _fact("board_meetings_per_year", 0.85), _fact("committees_per_board", 0.7) + " AND committees_per_board BETWEEN 2 AND 12", _fact("avg_age_independent_neds", 0.7)])))
def stated_facts(spark, sf_dir):
    return fg.stated_facts(filings(spark, sf_dir)).select("doc_id", "field", "value", "confidence")


def board_pages(spark, sf_dir):
    """Governance pages that state the make-up of a board, the second form in every other row."""
    s = views.survey(spark, sf_dir).where("executive_directors_count IS NOT NULL AND non_executive_directors_count IS NOT NULL AND independent_neds_count IS NOT NULL")
    whole = lambda c: F.col(c).cast("int").cast("string")
    one = F.concat(F.lit("On the Board sit "), whole("executive_directors_count"), F.lit(" executive directors and "), whole("non_executive_directors_count"), F.lit(" non-executive directors. On our board there are "),
                   whole("independent_neds_count"), F.lit(" of whom are independent non-executive members. Seven committees were proposed to the Board."))
    two = F.concat(F.lit("The committee has 3 executive directors and 4 non-executive directors. The board maintains "), (F.col("n_lines") % 5 + 2).cast("string"), F.lit(" standing committees. One executive director left the board."))
    return s.select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("n_lines") % 2 == 0, one).otherwise(two).alias("text"))


_STATED_ALL = "FROM survey WHERE executive_directors_count IS NOT NULL AND non_executive_directors_count IS NOT NULL AND independent_neds_count IS NOT NULL AND n_lines % 2 = "


@query("stated_board_counts", views.oracle(f"""SELECT {_DOC} AS doc_id, 'executive_directors_count' AS field, executive_directors_count AS value, 0.85::DOUBLE AS confidence {_STATED_ALL} 0
 UNION ALL SELECT {_DOC}, 'non_executive_directors_count', non_executive_directors_count, 0.85 {_STATED_ALL} 0 UNION ALL SELECT {_DOC}, 'independent_neds_count', independent_neds_count, 0.8 {_STATED_ALL} 0
 UNION ALL SELECT {_DOC}, 'committees_per_board', CAST(n_lines % 5 + 2 AS DOUBLE), 0.7 {_STATED_ALL} 1"""))
def stated_board_counts(spark, sf_dir):
    """Executives and non-executives stated together, independents of whom, committees with a verb; what only looks like them is left alone."""
    return fg.stated_facts(board_pages(spark, sf_dir)).select("doc_id", "field", "value", "confidence")


@query("cross_validated_facts", views.oracle(f"""WITH f AS (UNPIVOT (SELECT {_DOC} AS doc_id, board_size, directors_male, directors_female, executive_directors_count, non_executive_directors_count, independent_neds_count FROM survey)
  ON board_size, directors_male, directors_female, executive_directors_count, non_executive_directors_count, independent_neds_count INTO NAME field VALUE value),
 g AS (SELECT {_DOC} AS doc_id, directors_male + directors_female <> board_size AS gb, executive_directors_count + non_executive_directors_count <> board_size AS rb, independent_neds_count > non_executive_directors_count AS ib FROM survey)
 SELECT doc_id, field, value, CAST(CASE WHEN (field LIKE 'directors%' AND coalesce(gb, FALSE)) OR (field LIKE '%executive_directors_count' AND coalesce(rb, FALSE)) THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence
 FROM f JOIN g USING (doc_id) WHERE NOT (field = 'independent_neds_count' AND coalesce(ib, FALSE))"""))
def cross_validated_facts(spark, sf_dir):
    fields = ["board_size", "directors_male", "directors_female", "executive_directors_count", "non_executive_directors_count", "independent_neds_count"]
    f = views.survey(spark, sf_dir).withColumn("doc_id", F.col("company_id") * 10000 + F.col("year_no")).unpivot("doc_id", fields, "field", "value").where(
        "value IS NOT NULL").withColumn("confidence", F.lit(0.8))
    return fg.cross_validate(f)


@query("benefit_mentions", views.oracle(f"""SELECT {_DOC} AS doc_id, 'MedicalCover' AS benefit_key, n_units % 2 = 0 AS provided FROM survey JOIN company USING (company_id)
 UNION ALL SELECT {_DOC}, 'TransportAllowance', TRUE FROM survey JOIN company USING (company_id) WHERE n_units % 3 = 0"""))
def benefit_mentions(spark, sf_dir):
    return fg.benefit_mentions(filings(spark, sf_dir)).select("doc_id", "benefit_key", "provided")


@query("policy_flags", views.oracle(f"SELECT {_DOC} AS doc_id, 'medical' AS policy, n_units % 2 = 0 AS answer, CAST(3 AS INT) AS page FROM survey JOIN company USING (company_id)"))
def policy_flags(spark, sf_dir):
    return fg.policy_flags(filings(spark, sf_dir), {"medical": r"medical\s+cover", "pension": r"pension scheme"}).select("doc_id", "policy", "answer", "page")


@query("statement_lines", views.oracle(f"""WITH f AS (SELECT {_DOC} AS doc_id, coalesce(turnover, 0) AS t, coalesce(net_profit, 0) AS p, coalesce(market_cap, 0) AS m FROM survey JOIN company USING (company_id))
 SELECT doc_id, 'income_statement' AS statement_type, 'Revenue' AS label, t AS amount, 1000::DOUBLE AS prior_amount, 'revenue' AS normalized_name, 0.9::DOUBLE AS confidence FROM f
 UNION ALL SELECT doc_id, 'income_statement', 'Profit for the year', p, -250, 'net_income', 0.9 FROM f UNION ALL SELECT doc_id, 'income_statement', 'Other comprehensive items', 7, 2, NULL, 0.7 FROM f
 UNION ALL SELECT doc_id, 'balance_sheet', 'Total assets', m, 2500, 'total_assets', 0.9 FROM f"""))
def statement_lines(spark, sf_dir):
    return rd.statement_lines(filings(spark, sf_dir)).select(
        "doc_id", "statement_type", "label", "amount", "prior_amount", "normalized_name", "confidence")


@query("pay_table_rows", views.oracle(f"""WITH f AS (SELECT {_DOC} AS doc_id, CAST(n_lines % 50 + 100 AS DOUBLE) AS fee, CAST(n_lines % 7 AS DOUBLE) AS sit FROM survey JOIN company USING (company_id))
 SELECT doc_id, 'Mr. John Doe' AS director_name, FALSE AS starred, FALSE AS is_total, fee + sit AS total, fee AS fees FROM f UNION ALL SELECT doc_id, 'Jane Roe', FALSE, FALSE, fee, fee FROM f
 UNION ALL SELECT doc_id, 'Mary Major (Chairman)', FALSE, FALSE, 520, 500 FROM f UNION ALL SELECT doc_id, 'Late Joiner', TRUE, FALSE, 11, 10 FROM f
 UNION ALL SELECT doc_id, 'One Short', FALSE, FALSE, fee, fee FROM f UNION ALL SELECT doc_id, 'Total', FALSE, TRUE, 9999, 9999 FROM f"""))
def pay_table_rows(spark, sf_dir):
    return rd.pay_table_rows(filings(spark, sf_dir)).select("doc_id", "director_name", "starred", "is_total", "total", F.element_at("components", F.lit("Fees")).alias("fees"))


# a table of two sections: rows short of one or two cells, a name over two lines, a prior year beside the first
_PAY_COLUMNS = {"Salary": 1, "Bonus": 2, "Fees": 3, "Sitting Allowance": 4, "Total": 5}


def section_pages(spark, sf_dir):
    s = views.survey(spark, sf_dir).select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), (F.col("n_lines") + 1000).alias("a"), (F.col("n_units") % 97 + 100).alias("b"))
    num = lambda c: F.format_number(c, 0)
    a, b = F.col("a"), F.col("b")
    text_ = F.concat(
        F.lit("Directors remuneration\nSalary Bonus Fees Sitting allowance Total\nKShs'000 KShs'000\nExecutive Directors\nPeter Chief "), num(a), F.lit(" "), num(b), F.lit(" "), num(a + b),
        F.lit("\nMary Second "), num(a), F.lit(" - - - "), num(a), F.lit("\nNon-Executive Directors\nJane Member "), num(b), F.lit(" 40 "), num(b + 40), F.lit("\nJoy Long\nOtieno Name "), num(b), F.lit(" "), num(b),
        F.lit("\nTwo Years - - "), num(b), F.lit(" 60 "), num(b + 60), F.lit(" - - 1 2 3\nNo Sum 5 6 99\nTotal 1 2 3 4 10"))
    return s.select("doc_id", F.lit(1).alias("page"), text_.alias("text"))


def _section_row(name, role, salary, bonus, fees, sitting, total):
    return f"SELECT {_DOC} AS doc_id, '{name}' AS director_name, '{role}' AS role, CAST({salary} AS DOUBLE) AS salary, CAST({bonus} AS DOUBLE) AS bonus, CAST({fees} AS DOUBLE) AS fees, CAST({sitting} AS DOUBLE) AS sitting, CAST({total} AS DOUBLE) AS total FROM survey"


_A, _B = "(n_lines + 1000)", "(n_units % 97 + 100)"


@query("pay_table_gaps", views.oracle(" UNION ALL ".join([
    _section_row("Peter Chief", "executive", _A, _B, 0, 0, f"{_A} + {_B}"), _section_row("Mary Second", "executive", _A, 0, 0, 0, _A), _section_row("Jane Member", "non_executive", 0, 0, _B, 40, f"{_B} + 40"),
    _section_row("Joy Long Otieno Name", "non_executive", 0, 0, _B, 0, _B), _section_row("Two Years", "non_executive", 0, 0, _B, 60, f"{_B} + 60"), _section_row("Total", "non_executive", 1, 2, 3, 4, 10)])))
def pay_table_gaps(spark, sf_dir):
    """Lost dashes put back where the role leaves a cell blank, wrapped names joined, the first year's block read; a row that does not add up is none."""
    rows = rd.pay_table_rows(section_pages(spark, sf_dir))
    cell = lambda label: F.element_at("components", F.lit(label if _PAY_COLUMNS[label] == 1 else f"{label} #{_PAY_COLUMNS[label]}"))
    return rows.select("doc_id", "director_name", "role", cell("Salary").alias("salary"), cell("Bonus").alias("bonus"), cell("Fees").alias("fees"), cell("Sitting Allowance").alias("sitting"), "total")


@query("fee_table", views.oracle(f"SELECT {_DOC} AS doc_id, CAST(4 AS BIGINT) AS rows, CAST(n_lines % 50 + 100 AS DOUBLE) AS ned_retainer, 500::DOUBLE AS chair_retainer FROM survey JOIN company USING (company_id)"))
def fee_table(spark, sf_dir):
    return rd.fee_table(rd.pay_table_rows(filings(spark, sf_dir)))


def _values(spark, sf_dir):
    s = views.survey(spark, sf_dir)
    return s.where("board_size IS NOT NULL").select(
        (F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.lit("board_size").alias("field"),
        F.when(F.col("n_lines") % 3 == 0, F.col("board_size") + 200).otherwise(F.col("board_size")).alias("value"),
        F.when(F.col("n_lines") % 5 == 0, "entered manually").otherwise("from the board table on page 2").alias("source"))


@query("value_evidence", views.oracle(f"""SELECT {_DOC} AS doc_id, 'board_size' AS field, board_size AS value, CAST(2 AS INT) AS page, 'beside_topic' AS kind FROM survey JOIN company USING (company_id)
 WHERE board_size IS NOT NULL AND n_lines % 3 <> 0"""))
def value_evidence(spark, sf_dir):
    return fg.value_evidence(_values(spark, sf_dir), filings(spark, sf_dir), {"board_size": r"board comprised"}).select("doc_id", "field", "value", "page", "kind")


@query("value_checks", views.oracle(f"""SELECT {_DOC} AS doc_id, 'board_size' AS field, CASE WHEN n_lines % 5 = 0 THEN 'person' WHEN n_lines % 3 <> 0 THEN 'found' ELSE 'unverified' END AS "check"
 FROM survey JOIN company USING (company_id) WHERE board_size IS NOT NULL"""))
def value_checks(spark, sf_dir):
    v, p = _values(spark, sf_dir), filings(spark, sf_dir)
    return fg.value_check(v, fg.value_evidence(v, p, {"board_size": r"board comprised"}), p).select("doc_id", "field", "check")


def _items(spark, sf_dir):
    s = views.survey(spark, sf_dir)
    return s.select(
        F.col("n_units").alias("item_id"), (F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.when(F.col("n_lines") % 7 == 0, 99).otherwise(5).alias("page"),
        F.when(F.col("n_lines") % 3 == 0, "a sentence that is nowhere printed").otherwise("Mary Major (Chairman) 500 20 520").alias("evidence"),
        F.when(F.col("n_lines") % 4 == 0, "Someone Else").otherwise("Jane ROE").alias("name"), F.when(F.col("n_lines") % 5 == 0, 777777.0).otherwise(520.0).alias("amount"))


_GROUNDED = f"""SELECT n_units AS item_id, {_DOC} AS doc_id, CASE WHEN n_lines % 7 = 0 THEN 'page not available' ELSE array_to_string(list_filter([CASE WHEN n_lines % 3 = 0 THEN 'evidence not on page' END,
 CASE WHEN n_lines % 4 = 0 THEN 'name not on page' END, CASE WHEN n_lines % 5 = 0 THEN 'amount not on page' END], lambda x: x IS NOT NULL), ';') END AS reasons FROM survey JOIN company USING (company_id)"""


@query("grounded_items", views.oracle(_GROUNDED))
def grounded_items(spark, sf_dir):
    g = fg.ground_items(_items(spark, sf_dir), filings(spark, sf_dir))
    return g.select("item_id", "doc_id", F.array_join("reasons", ";").alias("reasons"))


@query("verified_counts", views.oracle(f"WITH g AS ({_GROUNDED}) SELECT doc_id, count(*) AS items, count(*) FILTER (WHERE reasons = '') AS verified_items FROM g GROUP BY 1"))
def verified_counts(spark, sf_dir):
    return fg.verify_counts(fg.ground_items(_items(spark, sf_dir), filings(spark, sf_dir)))


def stated_items(spark, sf_dir):
    """Items read from a document: directors, a board size that is one off in some, committees, members, and a pay table whose total is off in others."""
    s = views.survey(spark, sf_dir).select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), "n_lines", "n_units")
    n, u = F.col("n_lines"), F.col("n_units")
    item = lambda kind, table, name, field, amount, ok=F.lit(True), now=F.lit(None).cast("boolean"): F.struct(
        F.lit(kind).alias("kind"), F.lit(table).cast("int").alias("table_no"), name.alias("name"), F.lit(field).cast("string").alias("field"), amount.cast("double").alias("amount"), ok.alias("verified"), now.alias("current_year"))
    blank = F.lit(None).cast("string")
    directors = F.transform(F.sequence(F.lit(1).cast("long"), n % 5 + 4), lambda i: item("director", None, F.concat(F.lit("Director "), i.cast("string")), None, F.lit(None), i != 2))
    members = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")), lambda i: item("member", 1, blank, None, i + u % 4))
    pay = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long")), lambda i: item("pay_row", 2, F.concat(F.lit("Person "), i.cast("string")), None, i * 100 + n))
    others = F.array(
        item("fact", None, blank, "board_size", n % 5 + 3 + F.when(n % 7 == 0, 1).otherwise(0)), item("committee", 1, blank, None, F.lit(5)), item("pay_row", 2, F.lit("Grand total"), None, F.lit(9)),
        item("pay_total", 2, blank, None, n * 4 + 1000 + F.when(u % 3 == 0, 5).when(u % 3 == 1, 4).otherwise(0)), item("pay_total", 3, blank, None, F.lit(1), now=F.lit(False)))
    return s.select("doc_id", F.posexplode(F.concat(directors, members, pay, others)).alias("item_id", "x")).select("doc_id", "item_id", "x.*")


@query("verification_summary", views.oracle(f"""WITH i AS (SELECT {_DOC} AS doc_id, n_lines % 5 + 4 + 3 + 4 + 5 AS items, CASE WHEN n_lines % 7 = 0 THEN 1 ELSE 0 END AS f1, CASE WHEN 3 + n_units % 4 > 5 THEN 1 ELSE 0 END AS f2, CASE WHEN n_units % 3 = 0 THEN 1 ELSE 0 END AS f3 FROM survey)
 SELECT doc_id, items, items - 1 AS verified_items, CAST(1 AS BIGINT) AS unverified_items, CAST(f1 + f2 + f3 AS BIGINT) AS checks_failed, CAST(f1 AS BIGINT) AS failed_board_size_vs_listed, CAST(f2 AS BIGINT) AS failed_eligible_le_meetings, CAST(f3 AS BIGINT) AS failed_rows_sum_to_printed_total FROM i"""))
def verification_summary(spark, sf_dir):
    """Counts of verified items, and of sums that do not fit what the document states, per rule."""
    items = stated_items(spark, sf_dir)
    return fg.verification_summary(items, fg.arithmetic_checks(items))


@query("file_checks", views.oracle(f"""WITH f AS (SELECT {_DOC} AS doc_id, n_lines FROM survey JOIN company USING (company_id))
 SELECT doc_id, 'few_pages' AS finding FROM f UNION ALL SELECT doc_id, 'year_never_appears' FROM f WHERE n_lines % 5 = 0 UNION ALL SELECT doc_id, 'name_never_appears' FROM f WHERE n_lines % 7 = 0"""))
def file_checks(spark, sf_dir):
    s = views.survey(spark, sf_dir).join(views.view(spark, sf_dir, "company").select("company_id", "name"), "company_id")
    docs = s.select((F.col("company_id") * 10000 + F.col("year_no")).alias("doc_id"), F.when(F.col("n_lines") % 7 == 0, "Some Other Business").otherwise(F.col("name")).alias("name"),
                    F.concat(F.lit("FY"), (F.col("year_no") - F.when(F.col("n_lines") % 5 == 0, 9).otherwise(0)).cast("string")).alias("fiscal_year"))
    return fg.file_checks(filings(spark, sf_dir), docs)


# ---------------------------------------------------------------- matching
@query("company_name_keys", views.oracle("""SELECT company_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(name, '&', ' and ')), '[^a-z0-9 ]+', ' ', 'g'),
 '\\b(?:plc|ltd|limited|holdings?|group|company|co|the|kenya)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM company"""))
def company_name_keys(spark, sf_dir):
    return views.view(spark, sf_dir, "company").select("company_id", names.company_key("name").alias("key"), names.slug("name").alias("slug"))


@query("fuzzy_company_matches")
def fuzzy_company_matches(spark, sf_dir):
    """Customer names with digits left out, as report titles, against a roster of as many names as there are suppliers."""
    titles = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("title_id"), F.concat(F.replace("c_name", F.lit("0000"), F.lit("00")), F.lit(" Plc - Unaudited results")).alias("title"))
    roster = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("company_id"), F.concat(F.lit("Customer#00"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("name"))
    return mt.fuzzy_company_match(titles, roster)


@query("resolved_companies", views.oracle("""WITH r AS (SELECT company_id AS ref_id, CASE company_id % 4 WHEN 0 THEN lower(name) WHEN 1 THEN name || ' Limited' WHEN 2 THEN 'Unknown Business' ELSE name END AS nm, CASE WHEN company_id % 5 = 0 THEN ticker END AS tk, ticker FROM company)
 SELECT ref_id, CASE WHEN tk IS NOT NULL OR ref_id % 4 <> 2 THEN ref_id END AS company_id, CASE WHEN tk IS NOT NULL THEN 'ticker' WHEN ref_id % 4 = 2 THEN NULL WHEN ref_id % 4 = 1 THEN 'loose' ELSE 'name' END AS stage FROM r"""))
def resolved_companies(spark, sf_dir):
    c = views.view(spark, sf_dir, "company")
    m = F.col("company_id") % 4
    refs = c.select(F.col("company_id").alias("ref_id"), F.when(m == 0, F.lower("name")).when(m == 1, F.concat("name", F.lit(" Limited"))).when(m == 2, "Unknown Business").otherwise(F.col("name")).alias("name"),
                    F.when(F.col("company_id") % 5 == 0, F.col("ticker")).alias("ticker"))
    return mt.resolve_company(refs, c)


@query("matched_files", views.oracle("""WITH s AS (SELECT DISTINCT company_id, year_no FROM survey), f AS (SELECT c.company_id AS file_id, c.company_id, c.ticker, 2018 + c.company_id % 8 AS y FROM company c)
 SELECT file_id, CASE WHEN ticker IS NOT NULL THEN company_id END AS company_id, 'FY' || CAST(CASE WHEN ticker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.company_id = f.company_id AND s.year_no = y)
  AND EXISTS (SELECT 1 FROM s WHERE s.company_id = f.company_id AND s.year_no = y + 1) THEN y + 1 ELSE y END AS VARCHAR) AS fiscal_year,
 ticker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.company_id = f.company_id AND s.year_no = y) AND EXISTS (SELECT 1 FROM s WHERE s.company_id = f.company_id AND s.year_no = y + 1) AS used_next_year FROM f"""))
def matched_files(spark, sf_dir):
    c = views.view(spark, sf_dir, "company")
    files = c.select(F.col("company_id").alias("file_id"), F.concat(F.lit("uploads/ke-"), F.lower(F.coalesce("ticker", F.lit("zz-none"))), F.lit("-"), (F.col("company_id") % 8 + 2018).cast("string"), F.lit("-ar-00.pdf")).alias("filename"))
    years = views.survey(spark, sf_dir).select("company_id", F.concat(F.lit("FY"), F.col("year_no").cast("string")).alias("fiscal_year"))
    return mt.match_filename(files, c, years).drop("stage")


@query("same_person_pairs")
def same_person_pairs(spark, sf_dir):
    """Register names against pay-table names of the same company and year."""
    reg = views.view(spark, sf_dir, "register", sorted_in=("part",)).select("company_id", "y", "director_name")
    pay = views.view(spark, sf_dir, "pay_row", sorted_in=("part",)).select("company_id", "y", "director_name")
    return mt.same_person_join(reg, pay, ["company_id", "y"])


@query("misattributed_documents", views.oracle("""SELECT company_id AS id, company_id, company_id + 1 AS matched_id FROM company WHERE company_id % 3 = 0 AND company_id + 1 <= (SELECT max(company_id) FROM company)"""))
def misattributed_documents(spark, sf_dir):
    c = views.view(spark, sf_dir, "company")
    nxt = c.select((F.col("company_id") - 1).alias("company_id"), F.col("name").alias("other"))
    docs = c.join(nxt, "company_id", "left").select(
        F.col("company_id").alias("id"), "company_id", F.concat(F.lit("reports/"), names.slug(F.when(F.col("company_id") % 3 == 0, F.coalesce("other", "name")).otherwise(F.col("name"))), F.lit("-annual-report-2024.pdf")).alias("filename"))
    return mt.misattributed_documents(docs, c).drop("score")


@query("document_companies", views.oracle(f"SELECT {_DOC} AS doc_id, company_id FROM survey JOIN company USING (company_id)"))
def document_companies(spark, sf_dir):
    """Company of each printed filing, read from its first three pages and matched with every company."""
    roster = views.view(spark, sf_dir, "company").select("company_id", "name")
    docs = filings(spark, sf_dir)
    return mt.document_company(docs, roster, least=1.0).select("doc_id", "company_id")


# Names without a common pattern, so that a misspelt one is like its own company's only: 24 letters made from a hash.
_LETTERS = "translate(md5('{tag}' || CAST({key} AS VARCHAR(20))), '0123456789', 'ghijklmnop')"


def hashed_name(key: str, tag: str = "n") -> str:
    return f"substr({_LETTERS.format(tag=tag, key=key)}, 1, 24)"


# how a title differs from its company's name, by the remainder of the customer's number
_TITLE = f"""CASE id % 8 WHEN 0 THEN upper(nm) || ' Plc - Unaudited results' WHEN 1 THEN substr(nm, 1, 9) || substr(nm, 11) WHEN 2 THEN substr(nm, 1, 9) || '-' || substr(nm, 10)
 WHEN 3 THEN substr(nm, 1, 5) || 'zz' || substr(nm, 8) WHEN 4 THEN 'the accounts and report of the directors of ' || nm WHEN 5 THEN substr(nm, 4, 12) WHEN 6 THEN {hashed_name('id', 'x')} ELSE 'Plc' END"""
_TITLES = f"SELECT id, company_id, nm, {_TITLE} AS title FROM (SELECT c_custkey AS id, s_suppkey AS company_id, {hashed_name('s_suppkey')} AS nm FROM {{customer}} JOIN {{supplier}} ON s_suppkey = 1 + c_custkey % 100) t"


def _titles(spark, sf_dir):
    return spark.sql(_TITLES, customer=views.table(spark, sf_dir, "customer"), supplier=views.table(spark, sf_dir, "supplier"))


def _roster(spark, sf_dir):
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("company_id"), F.expr(hashed_name("s_suppkey")).alias("name"))


@query("roster_matches", f"""SELECT id AS title_id, CASE WHEN id % 8 < 6 THEN company_id END AS company_id,
 CASE id % 8 WHEN 0 THEN 100 WHEN 1 THEN 98 WHEN 2 THEN 100 WHEN 3 THEN 92 WHEN 4 THEN 90 WHEN 5 THEN 90 END AS percent FROM ({_TITLES.format(customer='customer', supplier='supplier')}) t""")
def roster_matches(spark, sf_dir):
    """Titles that state, misspell, contain or lack a company's name, against every supplier's name; the scores in percent."""
    found = mt.fuzzy_company_match(_titles(spark, sf_dir).select(F.col("id").alias("title_id"), "title"), _roster(spark, sf_dir), below=False)
    return found.select("title_id", "company_id", F.round(F.col("score") * 100).cast("int").alias("percent"))


@query("companies_by_roster", views.oracle(f"""SELECT t.id AS ref_id, CASE WHEN t.id % 8 IN (0, 1, 2, 3, 4, 5) AND c.ticker IS NOT NULL THEN t.company_id END AS company_id,
 CASE WHEN t.id % 8 IN (0, 1, 2, 3, 4, 5) AND c.ticker IS NOT NULL THEN 'roster' END AS stage FROM ({_TITLES.format(customer='customer', supplier='supplier')}) t JOIN company c USING (company_id)"""))
def companies_by_roster(spark, sf_dir):
    """Names that no company has, resolved by the roster entry they are most like and its ticker."""
    refs = _titles(spark, sf_dir).select(F.col("id").alias("ref_id"), F.col("title").alias("name"), F.lit(None).cast("string").alias("ticker"))
    roster = _roster(spark, sf_dir).select(F.col("company_id").alias("entry_id"), "name", F.concat(F.lit("S"), F.col("company_id").cast("string")).alias("ticker"))
    return mt.resolve_company(refs, views.view(spark, sf_dir, "company"), roster)


# file names: a ticker, one that the file cuts short, one with more behind it, part of a name, a name inside the stem, two names, none
_FILE = """CASE company_id % 7 WHEN 0 THEN 'ke-' || tick || '-2023-ar-00.pdf' WHEN 1 THEN 'ke-' || substr(tick, 1, 5) || '-2023-ar.pdf' WHEN 2 THEN 'ke-' || tick || 'x-2023.PDF'
 WHEN 3 THEN substr(nm, 3, 9) || '_2023.pdf' WHEN 4 THEN 'scan of ' || upper(substr(nm, 1, 10)) || '-' || substr(nm, 11) || ' report 2023.pdf'
 WHEN 5 THEN 'merger ' || nm || ' and ' || other || ' 2023.pdf' ELSE 'minutes-2023.pdf' END"""
_FILES = f"SELECT company_id, nm, tick, {_FILE} AS filename FROM (SELECT s_suppkey AS company_id, {hashed_name('s_suppkey')} AS nm, substr({hashed_name('s_suppkey', 't')}, 1, 6) AS tick, {hashed_name('s_suppkey - 1')} AS other FROM {{supplier}}) t"


@query("files_by_name", f"""SELECT company_id AS file_id, CASE WHEN company_id % 7 < 5 THEN company_id END AS company_id, 'FY2023' AS fiscal_year,
 CASE company_id % 7 WHEN 0 THEN 'ticker' WHEN 1 THEN 'ticker prefix' WHEN 2 THEN 'ticker prefix' WHEN 3 THEN 'in name' WHEN 4 THEN 'name in file' END AS stage FROM ({_FILES.format(supplier='supplier')}) t""")
def files_by_name(spark, sf_dir):
    """Files whose names carry a ticker, part of one, or a company's name anywhere; two names of one length stay unresolved."""
    made = spark.sql(_FILES, supplier=views.table(spark, sf_dir, "supplier"))
    company = made.select("company_id", F.col("tick").alias("ticker"), F.col("nm").alias("name"))
    found = mt.match_filename(made.select(F.col("company_id").alias("file_id"), "filename"), company, views.survey(spark, sf_dir).where("FALSE").select("company_id", "fiscal_year"))
    return found.drop("used_next_year")


# documents filed under one company whose file name states another's, one letter off; their statements fill periods
_MISFILED = f"""SELECT company_id AS id, company_id, CASE WHEN company_id % 3 = 2 THEN substr(other, 1, 6) || substr(other, 8) ELSE nm END || '---annual-report-2024.pdf' AS filename
 FROM (SELECT s_suppkey AS company_id, {hashed_name('s_suppkey')} AS nm, {hashed_name('s_suppkey - 1')} AS other FROM {{supplier}}) t"""


@query("misfiled_periods", views.oracle("""SELECT company_id, year_no AS period_id, CAST(1 AS BIGINT) AS documents, CAST(1 + n_lines % 3 AS BIGINT) AS statements FROM survey WHERE company_id % 3 = 2 AND year_no % 2 = 0"""))
def misfiled_periods(spark, sf_dir):
    """Periods with statements from a document that belongs to another company, found by a misspelt name in the file name."""
    docs = spark.sql(_MISFILED, supplier=views.table(spark, sf_dir, "supplier"))
    flagged = mt.misattributed_documents(docs, _roster(spark, sf_dir))
    own = views.survey(spark, sf_dir).select("company_id", F.col("year_no").alias("period_id"), F.when(F.col("year_no") % 2 == 0, F.col("company_id")).alias("source_document_id"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lines") % 3)).alias("statement"))
    return mt.affected_periods(flagged, own)


@query("misspelt_document_companies", f"SELECT s_suppkey AS doc_id, s_suppkey AS company_id, CASE s_suppkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 98 ELSE 96 END AS percent FROM supplier")
def misspelt_document_companies(spark, sf_dir):
    """Company of each document whose first pages print its name with a letter missing, or another letter, among other lines."""
    name = F.col("name")
    odd = F.when(F.col("company_id") % 3 == 0, name).when(F.col("company_id") % 3 == 1, F.concat(F.substring(name, 1, 7), F.substring(name, 9, 30))).otherwise(F.concat(F.substring(name, 1, 7), F.lit("z"), F.substring(name, 9, 30)))
    text = F.concat(F.lit("Annual report\nauditors: Some Firm Limited\n"), F.upper(odd), F.lit(" PLC\nand its group of companies"))
    pages = _roster(spark, sf_dir).select(F.col("company_id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("page"), text.alias("text"))
    found = mt.document_company(pages, _roster(spark, sf_dir))
    return found.select("doc_id", "company_id", F.round(F.col("score") * 100).cast("int").alias("percent"))
