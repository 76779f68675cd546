"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex strings. Beyond them, long mixed tokens are candidates. A value's hash is counted over
distinct repositories and owners in the whole corpus: a value that more than ``max_owners`` owners or ``max_repositories`` repositories hold is a
widely copied example, one that stays with its owner looks live. Candidate tokens of the second kind are added to the base spans; base
spans always stay and only carry their class.

Values never leave a task, only their hashes do. Counting first drops repeats per (value, owner, repository), then per (value, owner), so a value
that every document holds is combined before each shuffle.

Results for odd rows: null and empty texts have no spans; a null owner counts as one owner, a null repository as one; repeated rows get
equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import pin
from .tokens import slices

KINDS = ("assign", "access", "hex", "token")
PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"
TOKEN_BITS = 3.5
MAX_OWNERS = 2
MAX_REPOSITORIES = 20

_FOUND = "key long, doc_id long, owner string, repository string, spans array<struct<start:int,end:int,kind:int,value:string>>"


def _bits(value: str) -> float:
    """Entropy of the value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random_looking(value: str) -> bool:
    return bool(re.search(r"[0-9]", value)) and bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value)) and _bits(value) >= TOKEN_BITS


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """All spans of a text as (start, end, number of the kind, value), by start and kind; code points, end exclusive."""
    found = []
    for m in re.finditer(PATTERNS["assign"], text, re.ASCII | re.IGNORECASE):
        if len(m.group(2)) >= LEAST["assign"]:
            found.append((m.start(), m.end(), 0, m.group(2)))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= LEAST["access"]:
            found.append((m.start(), m.end(), 1, m.group()))
    # a run of 16 or more found directly is the same as all runs with the short ones dropped
    for m in re.finditer(r"[0-9a-f]{%d,}" % LEAST["hex"], text):
        found.append((m.start(), m.end(), 2, m.group()))
    for m in re.finditer(TOKEN, text):
        if _random_looking(m.group()) and not any(s < m.end() and m.start() < e for s, e, k, _ in found if k < 3):
            found.append((m.start(), m.end(), 3, m.group()))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            spans = [
                [{"start": s, "end": e, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in scan(t)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "owner", "repository")), pa.array(spans, kind)], names=["key", "doc_id", "owner", "repository", "spans"])


def ownership(found: DataFrame) -> DataFrame:
    """``value, owners, repositories`` over ``value, owner, repository``, each pair counted once."""
    places = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(
    docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, spans``, an array of ``start, kind, end, value`` (a hash), ``owners, repositories, live`` by start and kind.

    Base spans are all there, candidate tokens only where they look live.
    """
    rows = docs.select(
        F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repository_col).cast("string").alias("repository"), F.col(text_col).cast("string").alias("text"),
    )
    found = pin(rows.mapInArrow(_scanned, _FOUND).withColumn("row", F.monotonically_increasing_id()), "spans")
    each = found.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s"))
    counts = pin(ownership(each.select(F.col("s.value").alias("value"), "owner", "repository")), "ownership")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    span = F.struct("s.start", "s.kind", "s.end", "s.value", "owners", "repositories", live.alias("live"))
    placed = each.withColumn("value", F.col("s.value")).join(counts, "value").where((F.col("s.kind") < 3) | live)
    spans = placed.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
