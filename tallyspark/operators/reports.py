"""Composed reports: dossiers, inventories, findings, coverage, trees and public rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, names
from ..functions.numeric import pct_change
from ..session import cut
from . import stats


def flatten_tree(items: DataFrame) -> DataFrame:
    """Line items in print order with depth and has_children: one equi join per level, parents to children, down to the deepest.

    ``items`` is (statement_id, id, parent_id, order_index, ...). ``path`` sorts siblings under their parent. Each level is written before
    the next is joined to it. Rows whose parent does not exist, or that are their own ancestors, hang on no root and are left out.
    """
    step = F.array(F.struct(F.col("order_index").alias("o"), F.col("id").alias("i")))
    level = out = cut(items.where(F.col("parent_id").isNull()).withColumns({"depth": F.lit(0), "path": step}))
    while not level.isEmpty():
        up = level.select(F.col("statement_id").alias("__s"), F.col("id").alias("__id"), F.col("depth").alias("__depth"), F.col("path").alias("__path"))
        level = cut(items.join(up, (F.col("statement_id") == F.col("__s")) & (F.col("parent_id") == F.col("__id"))).withColumns(
            {"depth": F.col("__depth") + 1, "path": F.concat("__path", step)}).drop("__s", "__id", "__depth", "__path"))
        out = out.unionByName(level)
    parents = items.where(F.col("parent_id").isNotNull()).select("statement_id", F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    return out.join(parents, ["statement_id", "id"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def find_amount(tree: DataFrame, name: str) -> DataFrame:
    """First amount in print order with a normalised name, at any depth."""
    return tree.where(F.col("normalized_name") == name).groupBy("statement_id").agg(F.min_by("amount", "path").alias(name))


def enrich_left(df: DataFrame, company: DataFrame) -> DataFrame:
    """Company names for ids, 'Company n' where unknown."""
    c = company.select("company_id", F.col("name").alias("__n"))
    return df.join(c, "company_id", "left").withColumn(
        "company_name", F.when(F.col("company_id").isNotNull(), F.coalesce("__n", F.concat(F.lit("Company "), F.col("company_id").cast("string"))))).drop("__n")


def coverage_stats(survey: DataFrame, directors: DataFrame) -> DataFrame:
    """Companies, years and directors on record, one row."""
    s = survey.agg(F.count_distinct("company_id").alias("companies"), F.count_distinct("fiscal_year").alias("years"),
                   F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    return s.withColumn("directors", directors.agg(F.count(F.lit(1))).scalar())


def companies_per_sector(survey: DataFrame, company: DataFrame) -> DataFrame:
    ids = survey.select("company_id").distinct()
    return company.join(ids, "company_id", "left_semi").groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.count(F.lit(1)).alias("companies"))


def women_on_boards(rows: DataFrame) -> DataFrame:
    f, m = F.sum("directors_female"), F.sum("directors_male")
    return rows.groupBy("fiscal_year").agg(F.bround(F.try_divide(f * 100.0, f + m), 1).alias("women_on_boards_pct"), F.count(F.lit(1)).alias("companies_surveyed"))


def public_board_rows(survey: DataFrame, company: DataFrame) -> DataFrame:
    """Full years with a stated board size; companies without any are absent."""
    r = survey.where(labels.is_full_year("fiscal_year") & (F.col("board_size") != 0))
    return r.join(company.select("company_id", "name"), "company_id").select(
        "company_id", "name", "fiscal_year", "board_size", "executive_directors_count", "non_executive_directors_count", "directors_female", "directors_male",
        labels.year_of("fiscal_year").alias("year"))


def unique_slugs(company: DataFrame) -> DataFrame:
    """First company keeps the slug, the others get their id appended; a count per slug, then one equi join."""
    s = company.select("company_id", F.when(names.slug("name") == "", "company").otherwise(names.slug("name")).alias("slug"))
    first = s.groupBy("slug").agg(F.min("company_id").alias("__f"))
    return s.join(first, "slug").select("company_id", F.when((F.col("company_id") != F.col("__f")) | F.col("slug").rlike("^[0-9]+$"),
                                                             F.concat("slug", F.lit("-"), F.col("company_id").cast("string"))).otherwise(F.col("slug")).alias("slug"))


def representative_year(survey: DataFrame) -> DataFrame:
    """Each company's latest year that at least half as many companies reported as its best-covered year."""
    per_year = survey.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("__n"))
    mine = survey.select("company_id", "fiscal_year").join(per_year, "fiscal_year")
    best = mine.groupBy("company_id").agg(F.max("__n").alias("__b"))
    return mine.join(best, "company_id").where(F.col("__n") >= F.col("__b") / 2).groupBy("company_id").agg(F.max("fiscal_year").alias("fiscal_year"))


def file_inventory(survey: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per company and file, from survey rows and stored documents (a row per file, never a list per company)."""
    a = survey.select("company_id", F.lower("source_filename").alias("file_key"), F.col("fiscal_year").alias("label"), F.lit(True).alias("has_survey"), F.lit(False).alias("has_document"))
    b = docs.select("company_id", F.lower("filename").alias("file_key"), F.col("period_label").alias("label"), F.lit(False).alias("has_survey"), F.lit(True).alias("has_document"))
    return a.unionByName(b).groupBy("company_id", "file_key").agg(
        F.max("label").alias("fiscal_year"), F.bool_or("has_survey").alias("has_survey"), F.bool_or("has_document").alias("has_document"), F.count(F.lit(1)).alias("records"))


def remuneration_history(pay: DataFrame) -> DataFrame:
    """Named rows and total pay per company and year; the printed grand total wins over the sum."""
    return pay.groupBy("company_id", "y").agg(
        F.count_if(~F.col("is_total")).alias("named_rows"), F.sum(F.when(~F.col("is_total"), F.col("amount"))).alias("named_total"),
        F.max(F.when(F.col("is_total"), F.col("amount"))).alias("printed_total"))


def occurrence_number(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Numbers repeated names within their printed table."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def director_series(pay: DataFrame, candidates: DataFrame) -> DataFrame:
    """Total and component pay per year of directors identified across years."""
    c = candidates.select("company_id", "name_key", "table_kind")
    return pay.join(c, ["company_id", "name_key", "table_kind"], "left_semi").select(
        "company_id", "name_key", "table_kind", "y", F.explode(F.map_concat(F.create_map(F.lit("total"), F.col("total")), "components")).alias("component", "amount"))


def policy_from_pay(survey: DataFrame, pay: DataFrame, reviewed: Column) -> DataFrame:
    """Empty retainers filled from pay tables: the typical fee of the directors, the chair's fee when marked; confidence .45."""
    ned = stats.mode_or_median(pay.where(~F.col("is_chair") & (F.col("fee") > 0)), ["company_id", "fiscal_year"], "fee", "__ned").drop("values")
    chair = pay.where(F.col("is_chair") & (F.col("fee") > 0)).groupBy("company_id", "fiscal_year").agg(F.max("fee").alias("__chair"))
    j = survey.join(ned, ["company_id", "fiscal_year"], "left").join(chair, ["company_id", "fiscal_year"], "left")
    use = F.col("other_ned_annual_retainer").isNull() & F.col("__ned").isNotNull() & ~reviewed
    use_chair = F.col("chairperson_annual_retainer").isNull() & F.col("__chair").isNotNull() & ~reviewed
    return j.select("company_id", "fiscal_year", F.when(use, F.col("__ned")).otherwise(F.col("other_ned_annual_retainer")).alias("other_ned_annual_retainer"),
                    F.when(use_chair, F.col("__chair")).otherwise(F.col("chairperson_annual_retainer")).alias("chairperson_annual_retainer"),
                    F.when(use | use_chair, 0.45).alias("confidence"))


def key_findings(rows: DataFrame) -> DataFrame:
    """Headline inputs per year: pay leader, boards meeting the one-third benchmarks, companies ranked."""
    ind, gen = F.col("governance.independence_pct").isNotNull(), F.col("governance.gender_pct").isNotNull()
    top = F.max(F.when(F.col("total_director_remuneration") > 0, F.struct("total_director_remuneration", (-F.col("company_id")).alias("c"), "name")))
    return rows.groupBy("fiscal_year").agg(
        top["name"].alias("highest_paying"), F.count_if(F.col("total_director_remuneration") > 0).alias("ranked_companies"),
        F.count_if(ind).alias("independence_known"), F.count_if(F.col("governance.independence_compliant")).alias("independence_met"),
        F.count_if(gen).alias("gender_known"), F.count_if(F.col("governance.gender_compliant")).alias("gender_met"))


def sector_extremes(sectors: DataFrame, metric: str) -> DataFrame:
    """Best- and worst-paying sector per year."""
    s = sectors.where(F.col(metric).isNotNull())
    return s.groupBy("fiscal_year").agg(F.max(F.struct(metric, "sector"))["sector"].alias("best_sector"), F.min(F.struct(metric, "sector"))["sector"].alias("lowest_sector"), F.count(F.lit(1)).alias("sectors"))


def market_lines(metrics: DataFrame, kinds: DataFrame) -> DataFrame:
    """Display lines of the market report: median and middle half, or nothing below the gate."""
    j = metrics.join(F.broadcast(kinds), "metric")  # the field catalogue, under a hundred rows
    return j.where(F.col("p50").isNotNull()).select(
        "fiscal_year", "metric", labels.format_value("p50", "kind").alias("headline"),
        F.concat(labels.format_value("p25", "kind"), F.lit(" - "), labels.format_value("p75", "kind")).alias("detail"), F.col("company_count").alias("companies"))


def gap_tasks(status: DataFrame, mentions: DataFrame) -> DataFrame:
    """Empty fields per company-year that the report text does mention, one row per section task."""
    return status.where("status = 'missing'").join(mentions, ["company_id", "fiscal_year", "field"], "left_semi").groupBy(
        "company_id", "fiscal_year", "section").agg(F.count(F.lit(1)).alias("fields_to_read"))


def needs_attention(imports: DataFrame, scores: DataFrame, threshold: float = 60.0) -> DataFrame:
    s = scores.select("doc_id", "extraction_score")
    return imports.join(s, "doc_id", "left").withColumn("needs_attention", F.coalesce(F.col("extraction_score") < threshold, F.lit(True)))


def period_report(rows: DataFrame) -> DataFrame:
    """Named lines of a period with the amount and change against the as-of prior period, nested per period."""
    named = ["revenue", "net_income", "total_assets", "total_equity"]
    lines = F.array(*[F.struct(F.lit(n).alias("line"), F.col(n).alias("current"), F.col(f"prior_{n}").alias("prior"),
                               pct_change(n, f"prior_{n}").alias("change_pct")) for n in named])
    return rows.select("company_id", "period", F.filter(lines, lambda x: x["current"].isNotNull() & x["prior"].isNotNull()).alias("yoy"))


def company_dossier(parts: dict[str, DataFrame]) -> DataFrame:
    """Everything on file for each company-year as (company_id, fiscal_year, section, record): one JSON record per row.

    Sections stay rows, so a company-year with most of the documents is never gathered into one list.
    """
    out = None
    for name, df in parts.items():
        rest = [c for c in df.columns if c not in ("company_id", "fiscal_year")]
        rows = df.select("company_id", "fiscal_year", F.lit(name).alias("section"), F.to_json(F.struct(*rest)).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def flatten_record(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, value) for every leaf of a nested struct column; paths are joined with ' / '."""
    leaves = []

    def walk(dtype, col: Column, path: str) -> None:
        for f in dtype.fields:
            p = f"{path} / {f.name}" if path else f.name
            if f.dataType.typeName() == "struct":
                walk(f.dataType, col[f.name], p)
            else:
                leaves.append(F.struct(F.lit(p).alias("path"), col[f.name].cast("string").alias("value")))

    walk(df.schema[column].dataType, F.col(column), "")
    return df.select(*keys, F.explode(F.array(*leaves)).alias("x")).select(*keys, "x.*")


def tables_open(company_years: DataFrame, present: dict[str, DataFrame], conflicts: DataFrame) -> DataFrame:
    """What is still empty per company-year: one flag per missing row set, plus open conflicts."""
    out = company_years.select("company_id", "fiscal_year")
    for name, df in present.items():
        have = df.select("company_id", "fiscal_year").distinct().withColumn(f"__{name}", F.lit(True))
        out = out.join(have, ["company_id", "fiscal_year"], "left")
    n = conflicts.groupBy("company_id", "fiscal_year").agg(F.count(F.lit(1)).alias("open_conflicts"))
    out = out.join(n, ["company_id", "fiscal_year"], "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(f"__{k}").isNull(), k) for k in present]))
    return out.select("company_id", "fiscal_year", gaps.alias("empty_tables"), F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"))
