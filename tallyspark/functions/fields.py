"""The field registry: which metrics a company-year survey row has, in which section, and how each is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field, label, section, kind (how it is scaled), extended (not scored for quality).
BOARD = [
    ("board_size", "Board size"), ("board_meetings_per_year", "Board meetings held"),
    ("committees_per_board", "Committees"), ("committee_meetings_per_year", "Committee meetings"),
    ("directors_female", "Female directors"), ("directors_male", "Male directors"),
    ("executive_directors_count", "Executive directors"), ("non_executive_directors_count", "Non-executive directors"),
    ("independent_neds_count", "Independent NEDs"), ("non_independent_neds_count", "Non-independent NEDs"),
    ("neds_kenyan_count", "Kenyan NEDs"), ("neds_non_kenyan_count", "Non-Kenyan NEDs"),
    ("avg_age_executive_directors", "Avg age - executives"), ("avg_age_non_executive_directors", "Avg age - NEDs"),
    ("avg_age_independent_neds", "Avg age - independent NEDs"),
    ("avg_age_non_independent_neds", "Avg age - non-independent NEDs"),
]
OVERVIEW = [("turnover", "Turnover / revenue"), ("net_profit", "Net profit"), ("market_cap", "Market cap")]
POLICY = [
    ("chairperson_annual_retainer", "Chairperson annual retainer"),
    ("other_ned_annual_retainer", "Other NED annual retainer"),
    ("chairperson_meeting_allowance", "Chairperson meeting allowance"),
    ("other_ned_meeting_allowance", "Other NED meeting allowance"),
    ("executive_director_annual_retainer", "Executive director annual retainer"),
    ("executive_director_meeting_allowance", "Executive director meeting allowance"),
    ("committee_chair_annual_retainer", "Committee chair annual retainer"),
    ("committee_member_annual_retainer", "Committee member annual retainer"),
    ("committee_chair_meeting_allowance", "Committee chair meeting allowance"),
    ("committee_member_meeting_allowance", "Committee member meeting allowance"),
]
CEO = [
    ("ceo_monthly_salary", "CEO monthly salary"), ("ceo_monthly_allowances", "CEO monthly allowances"),
    ("ceo_monthly_incentive_bonus", "CEO monthly incentive bonus"),
    ("ceo_monthly_deferred_incentive", "CEO monthly deferred incentive"),
    ("ceo_monthly_non_cash_benefits", "CEO monthly non-cash benefits"), ("ceo_monthly_pension", "CEO monthly pension"),
    ("ceo_monthly_gratuity", "CEO monthly gratuity"), ("ceo_monthly_share_value", "CEO monthly share value"),
    ("ceo_monthly_cost_of_employment", "CEO monthly cost of employment"),
    ("ceo_annual_salary_as_stated", "CEO annual salary (as stated in the report)"),
]
CEO_TEXT = [("ceo_monthly_conversion_basis", "CEO monthly conversion basis (text, e.g. annual / 12)")]
EXECUTIVE_PAY = [
    ("kmp_count", "Key management personnel (number of people)", "count"),
    ("kmp_short_term_benefits", "Key management: salaries and short-term benefits", "pay"),
    ("kmp_post_employment_benefits", "Key management: pension / post-employment benefits", "pay"),
    ("kmp_share_based_payments", "Key management: share-based payments", "pay"),
    ("kmp_termination_benefits", "Key management: termination benefits", "pay"),
    ("kmp_total_compensation", "Key management: total compensation", "pay"),
    ("total_directors_fees", "Total non-executive directors' fees", "pay"),
    ("total_executive_directors_emoluments", "Total executive directors' emoluments", "pay"),
    ("cfo_annual_total_pay", "CFO / finance director total pay for the year", "pay"),
    ("loans_to_directors", "Loans to directors (balance at year end)", "pay"),
]
BOARD_EFFECTIVENESS = [
    ("board_attendance_pct", "Average board meeting attendance (%)", "pct"),
    ("independent_neds_over_9_years", "Independent NEDs serving more than 9 years", "count"),
    ("chair_ceo_separate", "Chair and CEO roles held by different people (Yes / No)", "yesno"),
    ("chair_independent", "Chairperson is independent (Yes / No)", "yesno"),
    ("lead_independent_director", "Lead / senior independent director appointed (Yes / No)", "yesno"),
    ("governance_audit_done", "Governance audit carried out (Yes / No)", "yesno"),
    ("governance_audit_by", "Governance auditor (firm)", "text"),
]
AUDIT = [
    ("audit_fee", "Audit fee", "headline"), ("non_audit_fees", "Non-audit fees paid to the auditor", "headline"),
    ("auditor_tenure_years", "Years the auditor has been in office", "years"),
    ("key_audit_matters_count", "Key audit matters (number)", "count"),
    ("auditor_name", "External auditor (firm)", "text"),
    ("audit_opinion", "Audit opinion (Unmodified / Qualified / Adverse / Disclaimer)", "text"),
    ("going_concern_uncertainty", "Material uncertainty on going concern (Yes / No)", "yesno"),
]
WORKFORCE = [
    ("employees_count", "Employees (number)", "count"), ("staff_costs", "Staff costs", "headline"),
    ("women_in_workforce_pct", "Women in the workforce (%)", "pct"),
    ("women_in_senior_management_pct", "Women in senior management (%)", "pct"),
    ("staff_turnover_pct", "Staff turnover (%)", "pct"),
]
SHAREHOLDERS = [
    ("earnings_per_share", "Earnings per share", "pershare"), ("dividend_per_share", "Dividend per share", "pershare"),
    ("shareholders_count", "Shareholders (number)", "count"),
    ("top10_shareholding_pct", "Top 10 shareholders - combined holding (%)", "pct"),
    ("free_float_pct", "Free float (%)", "pct"), ("directors_shareholding_pct", "Directors - combined holding (%)", "pct"),
]
BENEFIT_KEYS = [
    "MedicalCover", "IndemnityInsurance", "TravelAccommodation", "TelephoneAllowance", "TransportAllowance",
    "MealAllowance", "ClubMembership", "DutyDayAllowance", "GroupPersonalAccident", "ShareSchemeParticipation",
]
# Fields counted in the portfolio-wide quality figure.
PORTFOLIO_QUALITY_FIELDS = [
    "board_size", "board_meetings_per_year", "committees_per_board", "committee_meetings_per_year",
    "directors_female", "directors_male", "executive_directors_count", "non_executive_directors_count",
    "independent_neds_count", "non_independent_neds_count", "chairperson_annual_retainer",
    "other_ned_annual_retainer", "chairperson_meeting_allowance", "other_ned_meeting_allowance",
    "executive_director_annual_retainer", "executive_director_meeting_allowance",
    "committee_chair_annual_retainer", "committee_member_annual_retainer",
    "committee_chair_meeting_allowance", "committee_member_meeting_allowance",
    "turnover", "net_profit", "market_cap",
]


def _rows():
    for f, label in OVERVIEW:
        yield f, label, "Company Overview", "headline", False
    for f, label in BOARD:
        yield f, label, "Board Composition", "number", False
    for f, label in POLICY + CEO:
        yield f, label, "Remuneration", "pay", False
    for f, label in CEO_TEXT:
        yield f, label, "Remuneration", "text", False
    groups = [
        ("Executive pay (key management)", EXECUTIVE_PAY), ("Board effectiveness", BOARD_EFFECTIVENESS),
        ("Audit", AUDIT), ("Workforce", WORKFORCE), ("Shareholders & returns", SHAREHOLDERS),
    ]
    for section, fields in groups:
        for f, label, kind in fields:
            yield f, label, section, kind, True


CATALOG = list(_rows())
CORE_FIELDS = [r[0] for r in CATALOG if not r[4]]
EXTENDED_FIELDS = [r[0] for r in CATALOG if r[4]]
KIND = {r[0]: r[3] for r in CATALOG}
SECTION = {r[0]: r[2] for r in CATALOG}
NUMERIC_FIELDS = [f for f in KIND if KIND[f] not in ("text", "yesno")]
YESNO_FIELDS = [f for f in KIND if KIND[f] == "yesno"]
TEXT_FIELDS = [f for f in KIND if KIND[f] == "text"]
PAY_FIELDS = [f for f, _ in POLICY] + [f for f, _ in CEO if f != "ceo_annual_salary_as_stated"]


def field_catalog(spark: SparkSession) -> DataFrame:
    """The registry as a table (about 76 rows)."""
    return spark.createDataFrame(
        CATALOG, "field string, label string, section string, kind string, extended boolean"
    )
