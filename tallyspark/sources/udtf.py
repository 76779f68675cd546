"""The condensed-filing parser as a table function: one call a file, for SQL and lateral joins.

``condensed(content, 'line_items')`` gives the rows of one table of a file, with that table's columns; ``condensed(content, 'all')`` those of all
tables as ``kind, order_index, label, amount, note``, so that a file is parsed once for everything. The second argument must be a constant: the columns
follow from it while the query is analysed. A malformed file gives one row with ``error`` set and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .textfiles import STATEMENT_SECTIONS

_SCHEMAS = {
    "line_items": "statement_type string, label string, normalized_name string, amount double, prior_amount double, order_index int, error string",
    "market_data": "field string, value double, prior_value double, error string",
    "guidance": "order_index int, metric_name string, current_value double, guidance_low double, guidance_high double, commentary string, guidance_period string, error string",
    "risks": "order_index int, category string, description string, mitigation string, error string",
    "pay_rows": "order_index int, director_name string, role string, total double, components map<string,double>, is_grand_total boolean, error string",
    "filings": "name string, ticker string, sector string, exchange string, currency string, unit string, label string, fiscal_year_end string, prior_label string, error string",
    "all": "kind string, order_index int, label string, amount double, note string, error string",
}
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "map<string,double>": T.MapType(T.StringType(), T.DoubleType())}
_FIELD = re.compile(r"\s*([A-Za-z][\w ]*?)\s*:\s*(.*)")
_GUIDANCE = re.compile(r"\s*(\w+)\s*:\s*current=([-\d.]+),\s*low=([-\d.]+),\s*high=([-\d.]+)(?:,\s*commentary=(.*))?")
_PAY = re.compile(r"\s*\[?([^\]:]+?)\]?\s*:\s*([\d.,]+)\s*(?:;\s*(.*))?")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_HEADER = {
    "name": ("COMPANY", "Name"), "ticker": ("COMPANY", "Ticker"), "sector": ("COMPANY", "Sector"), "exchange": ("COMPANY", "Exchange"), "currency": ("COMPANY", "Currency"),
    "unit": ("COMPANY", "Unit"), "label": ("PERIOD", "Label"), "fiscal_year_end": ("PERIOD", "FiscalYearEnd"), "prior_label": ("PERIOD", "PriorLabel"),
}


def _schema(part: str) -> T.StructType:
    columns = (c.split(" ") for c in _SCHEMAS[part].split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


def _number(text: str | None) -> float | None:
    bare = (text or "").replace(",", "").strip()
    return float(bare) if _NUMBER.fullmatch(bare) else None


def _pair(value: str) -> tuple[float | None, float | None]:
    parts = re.split(r",\s+", value)
    return _number(parts[0]), _number(parts[1]) if len(parts) > 1 else None


def _snake(label: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", label).lower()


class Filing:
    """A file's sections, cut once."""

    def __init__(self, content: str):
        parts = re.split(r"(?m)^===(?=[A-Z_]+===\s*$)", content.replace("\r", ""))[1:]
        self.sections = []
        for part in parts:
            name, _, body = part.partition("===")
            lines = [x for x in body.lstrip().split("\n") if x.strip() and not x.lstrip().startswith("#")]
            self.sections.append((name, lines))

    def header(self) -> dict[str, str | None]:
        head: dict[str, str | None] = {}
        for name, (section, label) in _HEADER.items():
            found = (re.match(rf"[ \t]*{label}[ \t]*:(.*)", x) for s, lines in self.sections if s == section for x in lines)
            head[name] = next((m[1].strip() or None for m in found if m), None)
        head["error"] = "COMPANY section or its Name is missing" if head["name"] is None else "PERIOD section or its Label is missing" if head["label"] is None else None
        return head

    def fields(self, *names: str) -> Iterator[tuple[str, int, str, str]]:
        for section, lines in self.sections:
            if section in names:
                for i, line in enumerate(lines):
                    m = _FIELD.fullmatch(line)
                    if m:
                        yield section, i, m[1], m[2].strip()

    def line_items(self) -> Iterator[tuple]:
        for section, i, label, value in self.fields(*STATEMENT_SECTIONS):
            amount, prior = _pair(value)
            if amount is not None:
                yield STATEMENT_SECTIONS[section], label, _snake(label), amount, prior, i

    def market_data(self) -> Iterator[tuple]:
        for _, _, label, value in self.fields("MARKET_DATA"):
            amount, prior = _pair(value)
            if amount is not None:
                yield _snake(label), amount, prior

    def guidance(self) -> Iterator[tuple]:
        for section, lines in self.sections:
            if section == "MANAGEMENT_GUIDANCE":
                periods = (re.match(r"\s*GuidancePeriod\s*:(.*)", x) for x in lines)
                period = next((m[1].strip() or None for m in periods if m), None)
                for i, line in enumerate(lines):
                    m = _GUIDANCE.fullmatch(line)
                    if m:
                        yield i, m[1], _number(m[2]), _number(m[3]), _number(m[4]), (m[5] or "").strip() or None, period

    def risks(self) -> Iterator[tuple]:
        for section, lines in self.sections:
            if section == "PRINCIPAL_RISKS":
                for i, block in enumerate(re.split(r"(?m)^\s*\[", "\n".join(lines))[1:], 1):
                    part = lambda label, b=block: next((m[1].strip() for m in [re.search(rf"(?m)^\s*{label}:\s*(.*)$", b)] if m), "")
                    yield i, block.split("]")[0], part("Description"), part("Mitigation")

    def pay_rows(self) -> Iterator[tuple]:
        for section, lines in self.sections:
            if section == "DIRECTOR_REMUNERATION":
                for i, line in enumerate(lines):
                    m = _PAY.fullmatch(line)
                    total = _number(m[2]) if m else None
                    if total is not None:
                        name, comma, role = m[1].rpartition(",")
                        role = role.lower() if comma else ""
                        pairs = (p.split("=") for p in re.split(r",\s*(?=[A-Za-z])", m[3] or ""))
                        parts = {k.strip(): v for k, *rest in pairs if (v := _number(rest[0] if rest else None)) is not None}
                        kind = "executive" if "executive" in role and "non" not in role else "non_executive"
                        yield i, (name if comma else m[1]).strip(), kind, total, parts, "GRAND TOTAL" in m[1].upper()

    def everything(self) -> Iterator[tuple]:
        for kind, label, _, amount, prior, i in self.line_items():
            yield kind, i, label, amount, None if prior is None else f"prior {prior:g}"
        for i, (field, value, _) in enumerate(self.market_data()):
            yield "market", i, field, value, None
        for i, name, _, low, _, note, _ in self.guidance():
            yield "guidance", i, name, low, note
        for i, category, _, mitigation in self.risks():
            yield "risk", i, category, None, mitigation
        for i, name, role, total, _, _ in self.pay_rows():
            yield "pay", i, name, total, role


class CondensedTable:
    """The table function itself."""

    @staticmethod
    def analyze(content: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        if not part.isConstantExpression or part.value not in _SCHEMAS:
            raise ValueError(f"the second argument must be one of the constants {', '.join(sorted(_SCHEMAS))}")
        if content.dataType.typeName() not in ("string", "void"):
            raise ValueError(f"the first argument is the text of a file, not {content.dataType.simpleString()}")
        return AnalyzeResult(schema=_schema(part.value))

    def eval(self, content: str, part: str):
        filing = Filing(content or "")
        head = filing.header()
        if part == "filings":
            yield tuple(head.values())
        elif head["error"]:
            yield (*[None] * (len(_schema(part)) - 1), head["error"])
        else:
            for row in filing.everything() if part == "all" else getattr(filing, part)():
                yield (*row, None)


condensed = F.udtf(CondensedTable)


def register(spark: SparkSession, name: str = "condensed") -> None:
    """Make the function known to SQL: ``SELECT f.file, t.* FROM files f, LATERAL condensed(f.content, 'line_items') t``."""
    spark.udtf.register(name, condensed)


def condensed_rows(files: DataFrame, part: str) -> DataFrame:
    """``file`` and the rows of one table (or ``all``) of every file, by a lateral join: each file is parsed once, where it is read."""
    return files.lateralJoin(condensed(F.col("content").outer(), F.lit(part))).drop("content")
