"""Units, currencies and exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import _c

# Multiplier per stated unit of a headline figure.
HEADLINE_SCALE = {"units": 1.0, "ones": 1.0, "": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9}
# Multiplier per stated unit of a pay figure.
PAY_SCALE = {"units": 1.0, "ones": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9, "trillions": 1e12}
# Highest credible headline figure, in millions of KES.
CEILING_MILLIONS = {"turnover": 2_000_000, "net_profit": 1_000_000, "market_cap": 3_000_000}
# Lowest figure (whole KES) used only when suggesting a unit.
FLOOR_FULL = {"turnover": 5_000_000, "market_cap": 20_000_000}
# Units offered when suggesting a unit.
UNIT_CHOICES = ("units", "thousands", "millions", "billions")
HOME_CURRENCY = "KES"

# Official exchange rates, local currency per US dollar, yearly average (World Bank PA.NUS.FCRF).
RATES_PER_USD = [
    ("KES", 2021, 109.637746592367), ("KES", 2022, 117.865989201682), ("KES", 2023, 139.846383759616),
    ("KES", 2024, 134.822483279332), ("KES", 2025, 129.302572099377),
    ("RWF", 2021, 988.624806551768), ("RWF", 2022, 1030.30829974206), ("RWF", 2023, 1160.09869425),
    ("RWF", 2024, 1318.12835733333), ("RWF", 2025, 1428.47827558333),
    ("UGX", 2021, 3587.05170733908), ("UGX", 2022, 3689.81738566862), ("UGX", 2023, 3726.14045997085),
    ("UGX", 2024, 3757.2625354215), ("UGX", 2025, 3602.98994206813),
]


def _lookup(key: Column, table: dict[str, float]) -> Column:
    mapping = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.try_element_at(mapping, key)


def currency_of(col) -> Column:
    """Stated currency, upper case; a missing one is the home currency."""
    return F.upper(F.trim(F.coalesce(F.when(_c(col) != "", _c(col)), F.lit(HOME_CURRENCY))))


def scale_headline(unit) -> Column:
    """Multiplier to whole units; a three-letter unit is a currency code (1); unknown is NULL."""
    u = F.lower(F.trim(F.coalesce(_c(unit), F.lit(""))))
    known = _lookup(u, HEADLINE_SCALE)
    return F.coalesce(known, F.when(u.rlike("^[a-z]{3}$"), F.lit(1.0)))


def scale_pay(unit) -> Column:
    """Multiplier of pay figures; missing or unknown counts as whole currency."""
    u = F.lower(F.trim(F.coalesce(F.when(_c(unit) != "", _c(unit)), F.lit("units"))))
    return F.coalesce(_lookup(u, PAY_SCALE), F.lit(1.0))


def convert_pay(value, source, target) -> Column:
    """Struct(value, reason): convert between pay units; an unknown source unit gives a reason, not a guess."""
    s = _lookup(F.lower(F.trim(F.coalesce(_c(source), F.lit("")))), PAY_SCALE)
    out = F.try_divide(_c(value).cast("double") * s, scale_pay(target))
    reason = (
        F.when(_c(value).isNull(), F.lit(None).cast("string"))
        .when(s.isNull(), F.lit("missing or unknown source pay unit"))
        .when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit("non-finite pay amount"))
    )
    return F.struct(F.when(reason.isNull(), out).alias("value"), reason.alias("reason"))


def rate_table(spark: SparkSession) -> DataFrame:
    """(currency, year, per_usd): fifteen fixed rows; pass your own table of the same shape to add rates."""
    return spark.createDataFrame(RATES_PER_USD, "currency string, year int, per_usd double")


def plausible(value_millions, field: str, survey_currency) -> Column:
    """NULL for a figure above the credible ceiling; the ceilings only apply to a KES survey."""
    v = _c(value_millions)
    if field not in CEILING_MILLIONS:
        return v
    too_big = (_c(survey_currency) == HOME_CURRENCY) & (F.abs(v) > CEILING_MILLIONS[field])
    return F.when(~F.coalesce(too_big, F.lit(False)), v)


def suggest_units(fields: dict[str, Column] | None = None) -> Column:
    """Array of units that make every present headline figure believable (empty when none or nothing present)."""
    cols = fields or {f: F.col(f) for f in CEILING_MILLIONS}
    choices = F.array(*[
        F.struct(F.lit(u).alias("unit"), F.lit(HEADLINE_SCALE[u]).alias("scale")) for u in UNIT_CHOICES
    ])

    def fits(choice: Column) -> Column:
        ok = F.lit(True)
        for name, raw in cols.items():
            full = F.abs(raw * choice["scale"])
            good = (full <= CEILING_MILLIONS[name] * 1e6) & (full >= float(FLOOR_FULL.get(name, 0)))
            ok = ok & F.coalesce(good, F.lit(True))
        return ok & F.coalesce(*list(cols.values())).isNotNull()

    return F.transform(F.filter(choices, fits), lambda s: s["unit"])
