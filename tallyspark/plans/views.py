"""Survey, filing, activity and billing tables derived from the given tables.

Each view is one SQL text that Spark and the oracle engine both read, so a query and its oracle start from the same
rows. All amounts are whole numbers, so sums do not depend on the order rows arrive in. ``survey`` is one map-side
combined aggregation of ``lineitem`` per (supplier, year); ``financials`` one of ``orders`` per (customer, year).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fl
from ..session import shuffled

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

COMPANY = """
SELECT s.s_suppkey AS company_id,
       CASE WHEN s.s_suppkey % 20 = 7 THEN 'The ' || s.s_name || ' Plc' ELSE s.s_name END AS name,
       CASE WHEN s.s_suppkey % 11 = 4 THEN NULL ELSE 'S' || CAST(s.s_suppkey AS VARCHAR(20)) END AS ticker,
       CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE r.r_name END AS sector,
       n.n_name AS country, n.n_nationkey AS nationkey
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

_BASE = """
SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INT) + 24 AS y, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS na,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS nr
FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate)
"""


def _formula(field: str, i: int) -> str:
    """A whole-number rule per field, with its own missing pattern."""
    kind = fl.KIND[field]
    special = {
        "turnover": "c", "net_profit": "(d - t) * 40000", "market_cap": "q * 1000000",
        "board_size": "n % 9 + 5", "directors_female": "na % 5 + 1", "directors_male": "nr % 7 + 3",
        "executive_directors_count": "n % 3 + 1", "non_executive_directors_count": "q % 6 + 4",
        "independent_neds_count": "nr % 5 + 1", "non_independent_neds_count": "q % 4 + 1",
        "employees_count": "n * 20 + q % 37", "staff_costs": "n * 40 + q", "earnings_per_share": "(d - t) % 40",
        "dividend_per_share": "q % 9", "ceo_monthly_cost_of_employment": "(q * 13 + n) % 4000 + 900",
    }
    if field in special:
        value = special[field]
    elif kind == "pay":
        value = f"(q * {i % 7 + 3} + n * 11) % {900 + 17 * i} + {100 + i}"
    elif kind == "headline":
        value = f"n * {200 + i} + q"
    elif kind == "pct":
        value = f"(q + n * {i}) % 61 + 20"
    elif field.startswith("avg_age"):
        value = f"(q + {i}) % 23 + 41"
    else:
        value = f"(q + n * {i % 5 + 1}) % 11 + 2"
    return f"CASE WHEN (company_id * {i % 3 + 1} + y + {i}) % {5 + i % 6} = 0 THEN NULL ELSE CAST({value} AS DOUBLE) END AS {field}"


def _survey_sql() -> str:
    cols = [_formula(f, i) for i, f in enumerate(fl.NUMERIC_FIELDS)]
    for i, f in enumerate(fl.YESNO_FIELDS):
        cols.append(f"CASE (q + n * {i + 1}) % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'yes ' WHEN 3 THEN '' END AS {f}")
    cols.append("CASE n % 4 WHEN 0 THEN 'Smith & Jones LLP' WHEN 1 THEN 'Smith and Jones' WHEN 2 THEN 'Acme Audit Co.' END AS auditor_name")
    cols.append("CASE q % 4 WHEN 0 THEN 'unmodified' WHEN 1 THEN 'Unmodified ' WHEN 2 THEN 'Qualified' END AS audit_opinion")
    cols.append("CASE q % 3 WHEN 0 THEN 'Board Review Ltd' WHEN 1 THEN '' END AS governance_audit_by")
    cols.append("CASE n % 3 WHEN 0 THEN 'annual / 12' WHEN 1 THEN '  ' END AS ceo_monthly_conversion_basis")
    return f"""
SELECT b.company_id,
       CASE WHEN y = 2025 AND b.company_id % 11 = 5 THEN 'H1 2025' ELSE 'FY' || CAST(y AS VARCHAR(4)) END AS fiscal_year,
       y AS year_no, n AS n_lines, q AS n_units,
       CASE WHEN s.s_nationkey % 5 = 1 THEN 'RWF' WHEN s.s_nationkey % 5 = 2 THEN ' ugx' WHEN s.s_nationkey % 5 = 3 THEN NULL ELSE 'KES' END AS currency,
       CASE b.company_id % 6 WHEN 0 THEN 'units' WHEN 1 THEN 'Thousands ' WHEN 2 THEN 'KES' WHEN 3 THEN NULL
            WHEN 4 THEN 'thousands' ELSE CASE WHEN b.company_id % 30 = 5 THEN 'lakhs' ELSE 'millions' END END AS unit,
       CASE b.company_id % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN NULL ELSE 'units' END AS director_figures_unit,
       'report-' || CAST(b.company_id AS VARCHAR(20)) || '-' || CAST(y AS VARCHAR(4)) || '.pdf' AS source_filename,
       CASE WHEN b.company_id % 9 = 2 THEN 'Special Sector' END AS sector,
       {", ".join(cols)}
FROM ({_BASE}) b JOIN {{supplier}} s ON b.company_id = s.s_suppkey
"""


SURVEY = _survey_sql()

# one row per (company-year, benefit) that the company addressed at all (oracle side; Spark explodes the map column)
BENEFITS = f"""
SELECT company_id, fiscal_year, benefit_key, (n_lines + pos) % 3 = 0 AS provided,
       CASE WHEN (n_units + pos) % 4 = 0 THEN 'see note ' || CAST(pos AS VARCHAR(4)) END AS detail
FROM ({SURVEY}) v CROSS JOIN (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(fl.BENEFIT_KEYS))}) AS k(pos, benefit_key)
WHERE (n_units + pos * 3) % 4 <> 1
"""

# confidence is stated for about half of the fields of a row
CONFIDENCE_RULE = "CASE WHEN (n_lines + length('{f}')) % 2 = 0 THEN CAST((n_units + length('{f}') * 3) % 10 AS DOUBLE) / 10.0 + 0.05 END"

_FIN = """
SELECT o_custkey AS company_id, CAST(year(o_orderdate) AS INT) + 24 AS y, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS f,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS o,
       CAST(max(o_orderkey) AS BIGINT) AS k, max(o_orderdate) AS last_date
FROM {orders} GROUP BY o_custkey, year(o_orderdate)
"""

FINANCIALS = f"""
SELECT k AS id, company_id,
       CASE WHEN k % 12 = 3 THEN 'H1 ' || CAST(y AS VARCHAR(4)) WHEN k % 12 = 4 THEN 'Q2 ' || CAST(y AS VARCHAR(4)) || ' 6M'
            ELSE 'FY' || CAST(y AS VARCHAR(4)) END AS period,
       y AS fiscal_year, 'KES' AS currency,
       CASE WHEN k % 17 = 0 THEN NULL WHEN k % 17 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) END AS revenue,
       CASE WHEN k % 19 = 0 THEN NULL ELSE CAST((f - o) AS DOUBLE) END AS net_income,
       CAST(c * 3 + 1000 AS DOUBLE) AS total_assets,
       CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(c + f AS DOUBLE) END AS total_liabilities,
       CASE WHEN k % 29 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c * 2 + 1000 - f AS DOUBLE) END AS total_equity,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(c - o AS DOUBLE) END AS gross_profit,
       CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(f AS DOUBLE) END AS operating_profit,
       CASE WHEN k % 5 = 0 THEN CAST(k % 97 AS DOUBLE) END AS eps,
       CASE WHEN k % 2 = 0 THEN CAST(k % 1000 + 10 AS DOUBLE) END AS shares_outstanding,
       CASE WHEN k % 3 = 1 THEN 'manual' WHEN k % 3 = 2 THEN 'pdf_upload' END AS source,
       last_date AS updated_at
FROM ({_FIN}) g
"""

FIN_COMPANY = """
SELECT c.c_custkey AS company_id, c.c_name AS name, 'C' || CAST(c.c_custkey AS VARCHAR(20)) AS ticker,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS sector,
       n.n_name AS country
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

ACTIVITY = """
SELECT event_id AS id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 37 = 0 THEN 'Guest' WHEN event_id % 2 = 0 THEN 'User ' || CAST(user_id AS VARCHAR(20))
            ELSE 'user' || CAST(user_id AS VARCHAR(20)) END AS actor,
       'u' || CAST(user_id AS VARCHAR(20)) || '@example.com' AS actor_email,
       event_type AS action,
       CASE event_type WHEN 'signup' THEN 'Sign-in & Accounts' WHEN 'purchase' THEN 'Billing'
            WHEN 'error' THEN 'Other' ELSE 'Viewing' END AS category,
       CASE WHEN event_type = 'view' THEN CAST(event_id % 50 AS BIGINT) END AS company_id,
       CASE event_type WHEN 'view' THEN '/api/companies/' || CAST(event_id % 50 AS VARCHAR(20))
            WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN '/api/export/combined-report.pdf' WHEN 1 THEN '/api/export/portfolio.xlsx'
                 WHEN 2 THEN '/api/market/workbook.xlsx' ELSE '/api/export/company-report.pdf' END
            WHEN 'signup' THEN '/api/login' ELSE '/api/other' END AS path,
       CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS http_method,
       'value ' || CAST(event_id % 10 AS VARCHAR(4)) AS detail, value, event_type, ts AS created_at
FROM {events}
"""

# organisations are customers, an invoice per order, payments on finished and part-paid orders
SUBSCRIPTION = """
SELECT o_custkey AS org_id, o_orderkey AS sub_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'standard' ELSE 'premium' END AS plan,
       CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS plan_rank,
       CASE WHEN o_orderkey % 4 = 0 THEN 12 WHEN o_orderkey % 4 = 1 THEN 3 ELSE 1 END AS interval_months,
       CASE o_orderkey % 2 WHEN 0 THEN 'KES' ELSE 'USD' END AS currency,
       CAST(floor(o_totalprice) AS BIGINT) AS price,
       CASE WHEN o_orderkey % 23 = 0 THEN 'pending' WHEN o_orderkey % 23 = 1 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'trialing' ELSE 'active' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '14' DAY END AS trial_end,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '12' MONTH
            WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL '3' MONTH ELSE o_orderdate + INTERVAL '1' MONTH END AS current_period_end,
       o_orderpriority = '5-LOW' AS cancel_at_period_end, o_orderdate AS created_at
FROM {orders}
"""

INVOICE = """
SELECT o_orderkey AS invoice_id, o_custkey AS org_id, CASE o_orderkey % 2 WHEN 0 THEN 'KES' ELSE 'USD' END AS currency,
       CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderdate AS issued_at, o_orderdate + INTERVAL '14' DAY AS due_at,
       CASE WHEN o_orderkey % 10 = 9 THEN 'void' ELSE 'open' END AS status
FROM {orders}
"""

PAYMENT = """
SELECT o_orderkey AS invoice_id, o_custkey AS org_id, 'REF' || CAST(o_orderkey AS VARCHAR(20)) AS reference,
       CASE o_orderkey % 2 WHEN 0 THEN 'KES' ELSE 'USD' END AS currency,
       CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice / 2) AS BIGINT) END AS amount,
       o_orderdate AS paid_at
FROM {orders} WHERE o_orderstatus IN ('F', 'P')
"""

# printed pay rows: one per line, the "director" is the part; order = period, linenumber 7 = printed total
PAY_ROW = """
SELECT l_orderkey AS period_id, l_suppkey AS company_id, l_partkey AS person_no, p.p_name AS director_name, l_linenumber AS order_index,
       CASE l_returnflag WHEN 'A' THEN 'executive' WHEN 'R' THEN 'non_executive' ELSE 'all' END AS table_kind,
       CAST(l_quantity AS BIGINT) AS amount, CAST(round(l_extendedprice) AS BIGINT) AS fees,
       CAST(round(l_tax * 100) AS BIGINT) AS pension, CAST(year(l_shipdate) AS INT) + 24 AS y,
       l_linestatus AS mark
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# competing readings of a field, one per order
READING = """
SELECT o_orderkey AS reading_id, o_custkey % 200 AS company_id, 'FY' || CAST(year(o_orderdate) + 24 AS VARCHAR(4)) AS fiscal_year,
       CASE o_orderkey % 5 WHEN 0 THEN 'board_size' WHEN 1 THEN 'turnover' WHEN 2 THEN 'net_profit' WHEN 3 THEN 'audit_fee' ELSE 'kmp_count' END AS field,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS value,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10.0 + 0.05 END AS confidence,
       CASE WHEN o_orderkey % 37 = 0 THEN 'human' WHEN o_orderpriority = '2-HIGH' THEN 'rules' WHEN o_orderpriority = '5-LOW' THEN 'fallback' ELSE 'auto' END AS reader,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'from the document scan (page 3)' WHEN '2-HIGH' THEN 'from the board table on page 2' WHEN '3-MEDIUM' THEN ''
            WHEN '5-LOW' THEN 'from AI extraction' ELSE 'entered manually: form upload 7' END AS source
FROM {orders}
"""

DOC_META = """
SELECT doc_id AS id, length(text) % 40 AS company_id, md5(text) AS content_hash, 'https://example.com/' || CAST(doc_id AS VARCHAR(20)) AS url,
       'f' || CAST(doc_id % 90 AS VARCHAR(20)) || '.pdf' AS filename, 'FY' || CAST(2020 + length(text) % 3 AS VARCHAR(4)) AS period_label, n_chars
FROM {documents}
"""

# a directors' register: person = part, one row per printed line
REGISTER = """
SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INT) + 24 AS y, l_partkey AS person_no, p_name || ' ' || p_brand AS director_name,
       CASE WHEN l_suppkey % 9 = 3 AND l_linenumber = 1 THEN 'unknown' WHEN l_linenumber <= 2 THEN 'executive' ELSE 'non_executive' END AS role,
       CASE WHEN l_suppkey % 5 = 2 AND l_linenumber = 3 THEN NULL ELSE l_discount > 0.05 END AS independent,
       CASE WHEN l_suppkey % 7 = 4 AND l_linenumber = 2 THEN '' WHEN l_tax > 0.04 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL WHEN l_returnflag = 'A' THEN 'Kenyan ' ELSE 'British' END AS nationality,
       CASE WHEN l_suppkey % 3 = 1 AND l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) + 30 END AS age
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

VIEWS = {
    "reading": READING, "doc_meta": DOC_META, "register": REGISTER,
    "company": COMPANY, "survey": SURVEY, "benefits": BENEFITS, "financials": FINANCIALS, "fin_company": FIN_COMPANY,
    "activity": ACTIVITY, "subscription": SUBSCRIPTION, "invoice": INVOICE, "payment": PAYMENT, "pay_row": PAY_ROW,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; timestamps without zone are read as UTC timestamps so watermarks work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fixes = [
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*fixes)


def survey(spark: SparkSession, sf_dir: str, maps: bool = False) -> DataFrame:
    """The wide survey table; ``maps`` adds the benefit and confidence map columns."""
    df = view(spark, sf_dir, "survey")
    if not maps:
        return df
    benefits = ", ".join(
        f"CASE WHEN (n_units + {i * 3}) % 4 <> 1 THEN struct('{k}' AS key, struct((n_lines + {i}) % 3 = 0 AS provided, "
        f"CASE WHEN (n_units + {i}) % 4 = 0 THEN 'see note {i}' END AS detail) AS value) END" for i, k in enumerate(fl.BENEFIT_KEYS))
    confidence = ", ".join(
        f"CASE WHEN (n_lines + {len(f)}) % 2 = 0 THEN struct('{f}' AS key, CAST((n_units + {len(f) * 3}) % 10 AS DOUBLE) / 10.0D + 0.05D AS value) END"
        for f in fl.KIND)
    return df.select(
        "*", F.expr(f"map_from_entries(array_compact(array({benefits}))) AS ned_benefits"),
        F.expr(f"map_from_entries(array_compact(array({confidence}))) AS field_confidence"))


def _used(sql: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str, sorted_in: tuple[str, ...] = ()) -> DataFrame:
    """One derived view; the tables that ``sorted_in`` names are joined by shuffles, not broadcast, however small their files."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: shuffled(table(spark, sf_dir, t)) if t in sorted_in else table(spark, sf_dir, t) for t in _used(sql)})


def oracle(sql: str) -> str:
    """Prefix a query with the derived views it names."""
    import re

    ctes, names = [], [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    for n in names:
        body = VIEWS[n].format(**{t: t for t in TABLES})
        ctes.append(f"{n} AS ({body})")
    head = ", ".join(ctes)
    sql = sql.strip()
    if not head:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"
