"""Period labels, yes/no answers and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c


# Words that mark a half-year, quarter or interim label.
PART_YEAR = r"(?i)(?:^|[^a-z])(?:h[12]|[12]h|hy|q[1-4]|half|interim|semi)"


def is_full_year(label) -> Column:
    """False for missing, half-year, quarter and interim labels."""
    return F.coalesce((_c(label) != "") & ~_c(label).rlike(PART_YEAR), F.lit(False))


def year_of(label) -> Column:
    """First 19xx/20xx in a label, else NULL."""
    return F.regexp_extract(F.coalesce(_c(label), F.lit("")), r"((?:19|20)\d{2})", 1).try_cast("int")


def rate_year(label) -> Column:
    """First four digits of a label, the year exchange rates are looked up by."""
    digits = F.regexp_replace(F.coalesce(_c(label), F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4)).try_cast("int")


def fy_key(label) -> Column:
    """Sortable (year, label) struct."""
    return F.struct(F.coalesce(year_of(label), F.lit(0)).alias("y"), F.coalesce(_c(label), F.lit("")).alias("label"))


def period_key(label, fiscal_year=None) -> Column:
    """Sortable (year, annual first) struct of the normalised period order."""
    y = F.coalesce(_c(fiscal_year) if fiscal_year is not None else F.lit(None).cast("int"), year_of(label), F.lit(0))
    annual = F.when(F.upper(F.coalesce(_c(label), F.lit(""))).startswith("FY"), 1).otherwise(0)
    return F.struct(y.alias("y"), annual.alias("annual"), F.coalesce(_c(label), F.lit("")).alias("label"))


def prior_label(label) -> Column:
    """'FY2024' -> 'FY2023', 'H1 2024' -> 'H1 2023'; NULL without a year."""
    y = year_of(label)
    return F.when(y.isNotNull(), F.regexp_replace(_c(label), r"(?:19|20)\d{2}", (y - 1).cast("string")))


def is_quarterly(label) -> Column:
    return F.upper(F.coalesce(_c(label), F.lit(""))).rlike(r"\bQ[1-4]\b|\b[369]M\b")


def yes_no(raw) -> Column:
    """Yes / No for the usual spellings, otherwise the trimmed text."""
    t = F.trim(F.coalesce(_c(raw).cast("string"), F.lit("")))
    low = F.regexp_replace(F.lower(t), r"\.+$", "")
    return (
        F.when(low.isin("y", "yes", "true", "1"), "Yes")
        .when(low.isin("n", "no", "false", "0", "none"), "No")
        .otherwise(t)
    )


def answer_side(raw) -> Column:
    """'y', 'n' or NULL, by first letter."""
    first = F.substring(F.lower(F.trim(_c(raw))), 1, 1)
    return F.when(first.isin("y", "n"), first)


def share_key(label) -> Column:
    """One key for a firm written several ways."""
    s = F.lower(F.replace(_c(label), F.lit("&"), F.lit("and")))
    s = F.replace(F.replace(s, F.lit("llp"), F.lit("")), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def has_value(x) -> Column:
    return _c(x).isNotNull() & (F.trim(_c(x).cast("string")) != "")


def format_value(x, kind, currency="KES") -> Column:
    """Display text by kind: money / pershare / pct / pct2 / count / num1; text passes through."""
    x, kind = _c(x), _c(kind)
    cur = F.lit(currency) if isinstance(currency, str) else currency
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(kind == "money", F.concat(cur, F.lit(" "), F.format_number(x, 0)))
        .when(kind == "pershare", F.concat(cur, F.lit(" "), F.format_number(x, 2)))
        .when(kind == "pct", F.concat(F.format_number(x, 1), F.lit("%")))
        .when(kind == "pct2", F.concat(F.format_number(x, 2), F.lit("%")))
        .when(kind == "count", F.format_number(x, 0))
        .otherwise(F.format_number(x, 1))
    )


def join_names(names) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    a = _c(names)
    n = F.size(a)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.try_element_at(a, F.lit(1)))
        .otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "),
                            F.try_element_at(a, F.lit(-1))))
    )


def relative_phrase(value, benchmark, band: float = 3.0) -> Column:
    """'in line with', 'x% above' or 'x% below' a benchmark."""
    pct = F.try_divide(_c(value) - _c(benchmark), F.abs(_c(benchmark))) * 100
    return (
        F.when(F.abs(pct) < band, F.lit("in line with"))
        .when(pct > 0, F.concat(F.format_number(pct, 0), F.lit("% above")))
        .when(pct < 0, F.concat(F.format_number(-pct, 0), F.lit("% below")))
    )


def skewed(average, median, n, times: float = 3.0, least: int = 3) -> Column:
    """True when an average over at least ``least`` companies lies far above the median."""
    a, m = _c(average), _c(median)
    return F.coalesce((_c(n) >= least) & (m != 0) & (a > m * times), F.lit(False))


def json_map(text) -> Column:
    """A JSON object as a map of texts; anything unreadable is an empty map."""
    return F.coalesce(F.from_json(_c(text), "map<string,string>"), F.create_map().cast("map<string,string>"))


def content_hash(text) -> Column:
    return F.sha2(_c(text), 256)
