"""What the fields of a company-year are called in reports: a configuration table, which callers may replace or extend."""

from __future__ import annotations

# Phrases of each field, titles of the sections it stands in, and phrases that state its absence.
FIELD_TERMS: dict[str, dict[str, list[str]]] = {
    "turnover": {"synonyms": ["turnover", "total revenue", "group revenue", "revenue"], "section_hints": ["financial highlights", "statement of profit or loss", "income statement"]},
    "net_profit": {"synonyms": ["profit for the year", "net profit", "profit after tax"], "section_hints": ["financial highlights", "statement of profit or loss"]},
    "market_cap": {"synonyms": ["market capitalisation", "market capitalization", "market cap"], "section_hints": ["shareholder information", "share performance"]},
    "board_size": {"synonyms": ["constitution of the board", "board consists of", "number of directors", "board comprises", "members of the board"], "section_hints": ["who governs us", "board of directors", "corporate governance"]},
    "board_meetings_per_year": {"synonyms": ["board meetings held", "meetings of the board", "number of board meetings"], "section_hints": ["board meetings", "meeting attendance", "attendance profile"]},
    "committees_per_board": {"synonyms": ["board committees", "committees of the board"], "section_hints": ["board committees"]},
    "committee_meetings_per_year": {"synonyms": ["committee meetings held", "number of committee meetings"], "section_hints": ["committee attendance", "meeting attendance"]},
    "directors_female": {"synonyms": ["female directors", "women on the board", "gender diversity"], "section_hints": ["board diversity", "diversity"]},
    "directors_male": {"synonyms": ["male directors", "men on the board"], "section_hints": ["board diversity", "diversity"]},
    "executive_directors_count": {"synonyms": ["executive director", "executive directors"], "section_hints": ["board of directors", "who governs us"]},
    "non_executive_directors_count": {"synonyms": ["non-executive director", "non-executive directors"], "section_hints": ["board of directors", "who governs us"]},
    "independent_neds_count": {"synonyms": ["independent non-executive director", "independent director", "independence of directors"], "section_hints": ["director independence", "independent directors"]},
    "non_independent_neds_count": {"synonyms": ["non-independent director", "non-independent non-executive"], "section_hints": ["director independence"]},
    "neds_kenyan_count": {"synonyms": ["kenyan director", "kenyan national", "nationality: kenyan"], "section_hints": ["board of directors", "director nationality"]},
    "neds_non_kenyan_count": {"synonyms": ["non-kenyan director", "foreign director", "nationality:"], "section_hints": ["board of directors", "director nationality"]},
    "avg_age_executive_directors": {"synonyms": ["average age", "age of executive directors"], "section_hints": ["board of directors", "average age"]},
    "avg_age_non_executive_directors": {"synonyms": ["average age", "age of non-executive directors"], "section_hints": ["board of directors", "average age"]},
    "chairperson_annual_retainer": {"synonyms": ["chairman fee", "chairperson retainer", "chair remuneration", "chairman's annual fee", "annual retainer fee for the chairman"], "section_hints": ["directors' remuneration report", "remuneration for non-executive directors"]},
    "other_ned_annual_retainer": {"synonyms": ["director fee", "non-executive fee", "ned fee", "annual retainer fee for the chairman and other non-executive", "fees for non-executive directors"], "section_hints": ["directors' remuneration report", "remuneration for non-executive directors"]},
    "chairperson_meeting_allowance": {"synonyms": ["sitting allowance", "attendance fee", "meeting fee", "board meeting allowance"], "section_hints": ["directors' remuneration report"]},
    "other_ned_meeting_allowance": {"synonyms": ["sitting allowance", "attendance fee", "meeting fee"], "section_hints": ["directors' remuneration report"]},
    "executive_director_annual_retainer": {"synonyms": ["executive director's remuneration", "executive director salary", "as executives"], "section_hints": ["directors' remuneration report", "directors' emoluments"]},
    "pension_contribution": {"synonyms": ["pension contribution", "retirement benefit", "pension scheme contribution", "defined contribution scheme", "staff pension fund"], "section_hints": ["directors' remuneration report", "directors' emoluments", "employee benefits"]},
    "gratuity": {"synonyms": ["gratuity", "end of service benefit", "terminal benefit"], "section_hints": ["directors' remuneration report", "directors' emoluments"]},
    "medical_cover": {"synonyms": ["medical insurance", "medical cover", "medical aid", "health insurance cover"], "section_hints": ["directors' remuneration report", "employee benefits"]},
    "vehicle_benefit": {"synonyms": ["car benefit", "vehicle allowance", "company car", "car allowance"], "section_hints": ["directors' remuneration report", "employee benefits"]},
    "housing_benefit": {"synonyms": ["housing allowance", "housing benefit", "accommodation allowance"], "section_hints": ["directors' remuneration report", "employee benefits"]},
    "leave_allowance": {"synonyms": ["leave allowance", "annual leave pay", "leave pay"], "section_hints": ["directors' remuneration report", "employee benefits"]},
    "bonus_or_performance_pay": {"synonyms": ["performance bonus", "annual bonus", "incentive pay", "performance-based pay", "short-term incentive", "sti award"], "section_hints": ["directors' remuneration report", "directors' emoluments"]},
    "retainer_fee": {"synonyms": ["annual retainer", "monthly retainer", "board retainer", "retainer fee"], "section_hints": ["directors' remuneration report"]},
    "committee_chair_fee": {"synonyms": ["committee chair fee", "committee chairman fee", "committee chairperson fee"], "section_hints": ["committee remuneration"]},
    "share_award_value": {"synonyms": ["share award", "share grant", "equity award", "restricted share award"], "section_hints": ["directors' remuneration report", "long-term incentive plan"]},
    "stock_option_value": {"synonyms": ["stock option", "share option grant", "option grant value"], "section_hints": ["directors' remuneration report", "long-term incentive plan"]},
    "total_director_remuneration": {"synonyms": ["total directors remuneration", "aggregate directors remuneration", "total emoluments of directors"], "section_hints": ["directors' remuneration report", "directors' emoluments"]},
    "key_management_compensation_total": {"synonyms": ["key management personnel compensation", "total key management compensation"], "section_hints": ["key management compensation", "directors' emoluments"]},
    "committee_chair_annual_retainer": {"synonyms": ["committee chair fee", "committee chairperson retainer"], "section_hints": ["committee remuneration"]},
    "committee_member_annual_retainer": {"synonyms": ["committee member fee", "committee member retainer"], "section_hints": ["committee remuneration"]},
    "ceo_monthly_salary": {"synonyms": ["chief executive officer salary", "ceo's remuneration", "md salary", "managing director salary", "key management compensation", "key management personnel"], "section_hints": ["directors' emoluments", "key management compensation"]},
    "ceo_monthly_cost_of_employment": {"synonyms": ["total compensation", "cost to company", "total remuneration package"], "section_hints": ["directors' emoluments", "key management compensation"]},
    "has_share_option_scheme": {
        "synonyms": ["share option scheme", "employee share ownership plan", "esop", "stock option plan", "share-based payment scheme"], "section_hints": ["directors' remuneration report", "remuneration policy"],
        "negative_terms": ["does not operate a share option scheme", "no share option scheme", "not operate any share option scheme", "does not have a share option scheme"],
    },
    "has_ltip": {
        "synonyms": ["long-term incentive plan", "long term incentive", " ltip ", " ltip.", " ltip,", "(ltip)"], "section_hints": ["directors' remuneration report", "remuneration policy"],
        "negative_terms": ["no long-term incentive", "no long term incentive", "not operate a long-term incentive", "does not operate a long-term incentive", "no ltip"],
    },
    "remuneration_benchmark_percentile": {"synonyms": ["market percentile", "percentile of the market", "benchmarking exercise", "salary survey", "remuneration survey"], "section_hints": ["directors' remuneration report", "remuneration policy"]},
    "remuneration_benchmark_provider": {
        "synonyms": ["pwc", "deloitte", "ey benchmarking", "kpmg survey", "mercer", "korn ferry", "benchmarking consultant", "independent remuneration consultant"], "section_hints": ["directors' remuneration report", "remuneration policy"],
    },
}

# Words that the count's own noun phrase must hold, or may not, where fields differ in them alone.
NOUNS: dict[str, tuple[str, str]] = {
    "executive_directors_count": (r"\bexecutive", r"non-?\s?executive"),
    "non_executive_directors_count": (r"non-?\s?executive", r"\bindependent"),
    "independent_neds_count": (r"\bindependent", r"non-?\s?independent"),
    "non_independent_neds_count": (r"non-?\s?independent", r"^$"),
    "directors_male": (r"\bm[ae]le|\bmen\b", r"fe-?male|wo-?men"),
    "avg_age_executive_directors": (r"\bexecutive", r"non-?\s?executive"),
    "avg_age_non_executive_directors": (r"non-?\s?executive", r"^$"),
}


def field_kind(field: str) -> str:
    """Whether a field is a count, an age, a percentage, an answer (yes or no), a name, or else an amount."""
    if field.startswith("has_"):
        return "answer"
    if field.startswith("avg_age"):
        return "age"
    if field.endswith("_percentile"):
        return "percentage"
    if field.endswith("_provider"):
        return "name"
    counted = field.endswith(("_count", "_per_year", "_per_board")) or field.startswith("directors_") or field == "board_size"
    return "count" if counted else "amount"
