"""One company against its own past and the market against last year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import pct_change
from . import stats


def own_change(long: DataFrame) -> DataFrame:
    """Long (company_id, fiscal_year, metric, kind, value) with the change against the year before."""
    y = labels.year_of("fiscal_year")
    past = long.select("company_id", "metric", F.col("value").alias("prior_value"), (y + 1).alias("__y"))
    joined = long.withColumn("__y", y).join(past, ["company_id", "metric", "__y"]).drop("__y")
    pts = F.col("kind") == "pct"
    return joined.withColumns({
        "change_pts": F.when(pts, F.bround(F.col("value") - F.col("prior_value"), 1)),
        "change_pct": F.when(~pts, F.bround(pct_change("value", "prior_value"), 1)),
    })


def like_for_like(long: DataFrame, year: str, previous: str, least: int = 3) -> DataFrame:
    """Medians of the companies disclosing a metric in both years, and how many rose or fell."""
    picked = long.where(F.col("fiscal_year").isin(year, previous)).groupBy("company_id", "metric", "kind").agg(
        F.max(F.when(F.col("fiscal_year") == year, F.col("value"))).alias("now"),
        F.max(F.when(F.col("fiscal_year") == previous, F.col("value"))).alias("prev"),
    ).where("now IS NOT NULL AND prev IS NOT NULL")
    # both years in one pass: the side is part of the group
    sides = picked.select("metric", "kind", "now", "prev", F.explode(F.map_from_arrays(F.array(F.lit("now"), F.lit("prev")), F.array("now", "prev"))).alias("side", "v"))
    med = stats.percentiles(sides, ["metric", "kind", "side"], "v", (0.5,), ["m"], least, None, extra=[
        F.count_if(F.col("now") > F.col("prev")).alias("rose"), F.count_if(F.col("now") < F.col("prev")).alias("fell")])
    now = med.groupBy("metric", "kind").agg(
        F.max("n").alias("n"), F.max("rose").alias("rose"), F.max("fell").alias("fell"),
        F.max(F.when(F.col("side") == "now", F.col("m"))).alias("m_now"), F.max(F.when(F.col("side") == "prev", F.col("m"))).alias("m_prev"))
    enough, pts = F.col("n") >= least, F.col("kind") == "pct"
    return now.select(
        "metric", F.col("n").alias("like_for_like"),
        F.when(~pts, F.bround(pct_change("m_now", "m_prev"), 1)).alias("change_pct"),
        F.when(pts, F.bround(F.col("m_now") - F.col("m_prev"), 1)).alias("change_pts"),
        F.when(enough, F.col("rose")).alias("rose"), F.when(enough, F.col("fell")).alias("fell"))
