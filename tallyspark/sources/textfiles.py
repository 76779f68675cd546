"""Section text files (``===SECTION===`` then ``Field: value`` lines): condensed filings and survey files.

A file is one row; its sections, lines and fields are split inside that row, so nothing is shuffled while parsing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import text
from ..operators.carry import pin

# Sections of a condensed filing and the statement each one fills.
STATEMENT_SECTIONS = {"INCOME_STATEMENT": "income_statement", "BALANCE_SHEET": "balance_sheet", "CASH_FLOW": "cash_flow"}
# Field labels whose stored name is not their snake-case form.
SPECIAL_NAMES = {"EPS": "eps", "PPE": "ppe", "NetProfit": "net_profit"}
# Words that make a survey file.
SURVEY_SECTIONS = "PERFORMANCE|BOARD_COMPOSITION|DIRECTOR_PAY|COMMITTEE_PAY|CEO_PAY|NED_BENEFITS"
_FIELD = r"^\s*([A-Za-z][\w ]*?)\s*:\s*(.*)$"


def snake(label: str) -> str:
    if label in SPECIAL_NAMES:
        return SPECIAL_NAMES[label]
    label = label.replace("NEDs", "Neds").replace("NED", "Ned").replace("CEO", "Ceo")
    return re.sub(r"(?<!^)(?=[A-Z])", "_", label).lower()


SURVEY_FIELDS = {f: f for f in fl.NUMERIC_FIELDS}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of every text file under a path, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def sniff_format(content) -> Column:
    """condensed / survey_data / other, from the section titles anywhere in the file."""
    head = F.col(content) if isinstance(content, str) else content

    def has(names: str) -> Column:
        return head.rlike(rf"(?m)^===(?:{names})===\s*$")

    both = has("COMPANY") & has("PERIOD")
    return F.when(both & has(SURVEY_SECTIONS), "survey_data").when(both, "condensed").otherwise("other")


def with_parts(files: DataFrame) -> DataFrame:
    """The files with their content split once, at the section titles; the first part stands before any section."""
    return pin(files, __parts=F.split(F.regexp_replace("content", "\r", ""), r"(?m)^===(?=[A-Z_]+===\s*$)"))


def sections(files: DataFrame) -> DataFrame:
    """(file, section, lines) of files split into parts: comments and blank lines left out."""
    df = files.select("file", F.posexplode("__parts").alias("part_no", "part")).where("part_no > 0")
    body = F.regexp_replace("part", r"^[A-Z_]+===\s*", "")
    clean = F.filter(text.lines(body), lambda l: ~l.rlike(r"^\s*(?:#.*)?$"))
    return df.select("file", "part_no", F.regexp_extract("part", r"^([A-Z_]+)===", 1).alias("section"), clean.alias("lines"))


def fields(secs: DataFrame) -> DataFrame:
    """(file, section, order_index, label, value) of every ``Label: value`` line."""
    rows = secs.select("file", "section", F.posexplode("lines").alias("order_index", "line"))
    return rows.where(F.col("line").rlike(_FIELD)).select(
        "file", "section", "order_index", F.regexp_extract("line", _FIELD, 1).alias("label"), F.trim(F.regexp_extract("line", _FIELD, 2)).alias("value"))


def _number(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ",", "")).try_cast("double")


def _two_numbers(value) -> tuple[Column, Column]:
    """'1,234.5, 1,100' -> (1234.5, 1100): a comma followed by a blank separates current from prior."""
    p = F.split(F.col(value), r",\s+")
    return _number(F.try_element_at(p, F.lit(1))), _number(F.try_element_at(p, F.lit(2)))


def headers(files: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per file split into parts, with the wanted COMPANY / PERIOD fields, cut out inside the row (no shuffle); absent ones are NULL."""
    wanted = sorted({section for section, _ in names.values()})

    def body(section: str) -> Column:
        return F.array_join(F.filter("__parts", lambda p: p.startswith(f"{section}===")), "\n")

    df = pin(files, **{f"__{n}": body(n) for n in wanted})
    return df.select(*files.columns, *[
        F.nullif(F.trim(F.regexp_extract(f"__{section}", rf"(?m)^[ \t]*{label}[ \t]*:(.*)$", 1)), F.lit("")).alias(name)
        for name, (section, label) in names.items()])


CONDENSED_HEADER = {
    "name": ("COMPANY", "Name"), "ticker": ("COMPANY", "Ticker"), "sector": ("COMPANY", "Sector"), "exchange": ("COMPANY", "Exchange"),
    "currency": ("COMPANY", "Currency"), "unit": ("COMPANY", "Unit"), "label": ("PERIOD", "Label"),
    "fiscal_year_end": ("PERIOD", "FiscalYearEnd"), "prior_label": ("PERIOD", "PriorLabel"),
}


def parse_condensed(files: DataFrame) -> dict[str, DataFrame]:
    """Condensed filings as tables: filings, errors, line_items, market_data, guidance, risks, pay_rows."""
    head = headers(with_parts(files.select("file", "content")).drop("content"), CONDENSED_HEADER)
    problem = F.when(F.col("name").isNull(), "COMPANY section or its Name is missing").when(F.col("label").isNull(), "PERIOD section or its Label is missing")
    head = head.withColumn("error", problem)
    secs = sections(head.where(problem.isNull()))  # a malformed file gives its error row and nothing else
    flds = fields(secs)
    amount, prior = _two_numbers("value")
    kinds = F.create_map(*[F.lit(x) for p in STATEMENT_SECTIONS.items() for x in p])
    name = F.lower(F.regexp_replace("label", r"(?<=[a-z])(?=[A-Z])", "_"))
    items = flds.where(F.col("section").isin(*STATEMENT_SECTIONS)).select(
        "file", F.element_at(kinds, F.col("section")).alias("statement_type"), "label", name.alias("normalized_name"), amount.alias("amount"),
        prior.alias("prior_amount"), F.lit(1.0).alias("confidence"), "order_index").where("amount IS NOT NULL")
    market = flds.where("section = 'MARKET_DATA'").select("file", name.alias("field"), amount.alias("value"), prior.alias("prior_value")).where("value IS NOT NULL")
    period = F.nullif(F.trim(F.regexp_extract(F.array_join("lines", "\n"), r"(?m)^\s*GuidancePeriod\s*:(.*)$", 1)), F.lit(""))
    raw = secs.select("file", "section", period.alias("guidance_period"), F.posexplode("lines").alias("order_index", "line"))
    g = r"^\s*(\w+)\s*:\s*current=([-\d.]+),\s*low=([-\d.]+),\s*high=([-\d.]+)(?:,\s*commentary=(.*))?$"
    guidance = raw.where((F.col("section") == "MANAGEMENT_GUIDANCE") & F.col("line").rlike(g)).select(
        "file", "order_index", F.regexp_extract("line", g, 1).alias("metric_name"), *[F.regexp_extract("line", g, i).try_cast("double").alias(n) for i, n in
                                                                                     ((2, "current_value"), (3, "guidance_low"), (4, "guidance_high"))],
        F.nullif(F.trim(F.regexp_extract("line", g, 5)), F.lit("")).alias("commentary"), "guidance_period")
    # a risk block: '[Category]' then its Description and Mitigation; blocks are cut inside the row
    blocks = secs.where("section = 'PRINCIPAL_RISKS'").select("file", F.posexplode(F.split(F.array_join("lines", "\n"), r"(?m)^\s*\[")).alias("order_index", "block")).where("order_index > 0")
    risks = blocks.select("file", "order_index", F.regexp_extract("block", r"^([^\]]+)\]", 1).alias("category"),
                          F.trim(F.regexp_extract("block", r"(?m)^\s*Description:\s*(.*)$", 1)).alias("description"),
                          F.trim(F.regexp_extract("block", r"(?m)^\s*Mitigation:\s*(.*)$", 1)).alias("mitigation"))
    r = r"^\s*\[?([^\]:]+?)\]?\s*:\s*([\d.,]+)\s*(?:;\s*(.*))?$"
    who = F.regexp_extract("line", r, 1)
    role = F.lower(F.regexp_extract(who, r",([^,]*)$", 1))
    parts = F.filter(F.transform(F.split(F.regexp_extract("line", r, 3), r",\s*(?=[A-Za-z])"), lambda p: F.struct(
        F.trim(F.split(p, "=")[0]).alias("key"), _number(F.try_element_at(F.split(p, "="), F.lit(2))).alias("value"))), lambda e: e["value"].isNotNull())
    pay = raw.where((F.col("section") == "DIRECTOR_REMUNERATION") & F.col("line").rlike(r)).select(
        "file", "order_index", F.trim(F.regexp_replace(who, r",[^,]*$", "")).alias("director_name"),
        F.when(role.contains("executive") & ~role.contains("non"), "executive").otherwise("non_executive").alias("role"),
        _number(F.regexp_extract("line", r, 2)).alias("total"), F.map_from_entries(parts).alias("components"),
        F.upper(who).contains("GRAND TOTAL").alias("is_grand_total")).where("total IS NOT NULL")
    return {"filings": head.where("error IS NULL").drop("error", "__parts"), "errors": head.where("error IS NOT NULL").select("file", "error"),
            "line_items": items, "market_data": market, "guidance": guidance, "risks": risks, "pay_rows": pay}


def parse_survey(files: DataFrame) -> dict[str, DataFrame]:
    """Survey files as tables: values (long), sources and benefits; unknown fields and unreadable answers are skipped."""
    files = with_parts(files.select("file", "content")).drop("content")
    secs = sections(files)
    flds = fields(secs)
    head = headers(files, {
        "company_name": ("COMPANY", "Name"), "sector": ("COMPANY", "Sector"), "currency": ("COMPANY", "Currency"),
        "unit": ("COMPANY", "Unit"), "fiscal_year": ("PERIOD", "FiscalYear")}).drop("__parts")
    lab = F.regexp_replace(F.regexp_replace(F.regexp_replace("label", "NEDs", "Neds"), "NED", "Ned"), "CEO", "Ceo")
    name = F.lower(F.regexp_replace(lab, r"(?<=[a-z])(?=[A-Z])", "_"))
    known = F.col("field").isin(*SURVEY_FIELDS)
    values = flds.where(~F.col("section").isin("COMPANY", "PERIOD", "SOURCE", "NED_BENEFITS")).select(
        "file", name.alias("field"), _number(F.col("value")).alias("value")).where(known & F.col("value").isNotNull())
    sources = flds.where("section = 'SOURCE'").select("file", name.alias("field"), F.col("value").alias("source")).where(known)
    b = r"(?i)^(Yes|No|Reimbursed|Catered)\s*(?:[—-]\s*(.*))?$"
    benefits = flds.where((F.col("section") == "NED_BENEFITS") & F.col("label").isin(*fl.BENEFIT_KEYS) & F.col("value").rlike(b)).select(
        "file", F.col("label").alias("benefit_key"), (F.lower(F.regexp_extract("value", b, 1)) != "no").alias("provided"),
        F.nullif(F.trim(F.regexp_extract("value", b, 2)), F.lit("")).alias("detail"))
    return {"headers": head, "values": values, "sources": sources, "benefits": benefits}


def survey_rows(parsed: dict[str, DataFrame]) -> DataFrame:
    """One wide row per survey file with source and benefit maps."""
    wide = parsed["values"].groupBy("file").pivot("field", list(SURVEY_FIELDS)).agg(F.first("value"))
    # a file has at most one entry per known field and benefit, so these lists are small
    src = parsed["sources"].groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("field_sources"))
    ben = parsed["benefits"].groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("benefit_key", F.struct("provided", "detail")))).alias("ned_benefits"))
    return parsed["headers"].join(wide, "file", "left").join(src, "file", "left").join(ben, "file", "left")
