"""Merging competing readings, upserts, change sets, repairs and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, similarity
from ..session import cut
from .matching import same_person_join

# Who wins a field. A lower tier beats a higher one; automatic readers compete by confidence.
TIER = {"human": 0, "rules": 1, "auto": 2, "fallback": 3}
CONFLICT_TOLERANCE = 0.005


def tier_of(reader) -> Column:
    table = F.create_map(*[F.lit(x) for p in TIER.items() for x in p])
    return F.coalesce(F.try_element_at(table, F.col(reader) if isinstance(reader, str) else reader), F.lit(9))


def precedence_merge(readings: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key: human, then rules, then the most confident automatic reading, then the fallback.

    A map-side-combined ``min`` of an ordered struct, so a field with millions of readings shuffles one row per task.
    """
    rank = F.struct(tier_of("reader").alias("tier"), (-F.coalesce("confidence", F.lit(0.0))).alias("neg"), F.col("reading_id"))
    picked = readings.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(rank.alias("r"), "value", "confidence", "source", "reader")).alias("w"), F.count(F.lit(1)).alias("readings"))
    return picked.select(*keys, "w.value", "w.confidence", "w.source", "w.reader", F.col("w.r.reading_id").alias("reading_id"), "readings")


def differs(a: Column, b: Column, tolerance: float = CONFLICT_TOLERANCE) -> Column:
    return F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.lit(1e-9))


def decision_log(readings: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """What happened to each reading: written, kept_human, kept_existing; and whether it disagrees with the winner."""
    win = merged.select(*keys, F.col("value").alias("__v"), F.col("reader").alias("__r"), F.col("reading_id").alias("__id"))
    joined = readings.where(F.col("value").isNotNull()).join(win, keys)
    return joined.select(
        *keys, "reading_id", "reader", "value",
        F.when(F.col("reading_id") == F.col("__id"), "written").when(F.col("__r") == "human", "kept_human").otherwise("kept_existing").alias("decision"),
        differs(F.col("__v"), F.col("value")).alias("disagrees"))


def detect_conflicts(readings: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """A conflict row per distinct value that is more than 0.5 % away from the winner (compared with the winner only)."""
    log = decision_log(readings, merged, keys).where("disagrees")
    other = log.groupBy(*keys, "value").agg(F.min("reading_id").alias("candidate_b_id"))
    return other.join(merged.select(*keys, F.col("value").alias("candidate_a_value")), keys).withColumnRenamed("value", "candidate_b_value")


def apply_resolution(conflicts: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """The value a reviewer chose: a, b or a typed one; unresolved conflicts keep a."""
    r = resolutions.select(*keys, "choice", F.col("typed").alias("__t"))
    chosen = F.when(F.col("choice") == "b", F.col("candidate_b_value")).when(F.col("choice") == "typed", F.col("__t")).otherwise(F.col("candidate_a_value"))
    return conflicts.join(r, keys, "left").withColumns({"resolved_value": chosen, "is_open": F.col("choice").isNull()}).drop("__t")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "replace", protect: str | None = None) -> DataFrame:
    """Insert or update by key. ``replace``: the update wins, NULL included; ``coalesce``: a NULL update keeps the old
    value; ``fill_only``: the old value wins. ``protect`` names a boolean target column whose rows never change.
    """
    cols = [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"__n_{c}") if c in updates.columns else F.lit(None).alias(f"__n_{c}") for c in cols], F.lit(True).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    guard = F.coalesce(F.col(protect), F.lit(False)) if protect else F.lit(False)

    def pick(c: str) -> Column:
        o, n = F.col(c), F.col(f"__n_{c}")
        if c not in updates.columns:
            return o.alias(c)
        if mode == "replace":
            value = F.when(F.col("__new").isNotNull(), n).otherwise(o)
        elif mode == "coalesce":
            value = F.coalesce(n, o)
        elif mode == "fill_only":
            value = F.coalesce(o, n)
        else:
            raise ValueError(f"unknown mode {mode}")
        return F.when(guard, o).otherwise(value).alias(c)

    return joined.select(*keys, *[pick(c) for c in cols])


def replace_children(target: DataFrame, updates: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the parents named in ``updates`` are replaced; other parents keep theirs."""
    return target.join(updates.select(*parent).distinct(), parent, "left_anti").unionByName(updates, allowMissingColumns=True)


def reupload_replace(old: DataFrame, new: DataFrame, keys: list[str], reviewed: str = "reviewed") -> DataFrame:
    """Fields of an earlier upload absent from the new one are cleared; reviewed fields keep their value."""
    n = new.select(*keys, F.col("value").alias("__n"))
    both = old.join(n, keys, "full_outer")
    keep = F.coalesce(F.col(reviewed), F.lit(False))
    action = (F.when(keep, "kept_reviewed").when(F.col("__n").isNull(), "cleared").when(F.col("value").isNull(), "added")
              .when(F.col("value") == F.col("__n"), "unchanged").otherwise("replaced"))
    return both.select(*keys, F.when(keep, F.col("value")).otherwise(F.col("__n")).alias("new_value"), action.alias("action"))


def change_set(current: DataFrame, form: DataFrame, keys: list[str]) -> DataFrame:
    """Typed diff between stored values and a filled form (``value``, ``ok`` tick): add, update, confirm, unchanged.

    Nothing is removed by an empty box. ``warn`` marks a value stored after the form was made (``prefill`` differs).
    """
    f = form.select(*keys, F.col("value").alias("new_value"), "ok", "prefill")
    both = current.select(*keys, F.col("value").alias("current")).join(f, keys, "right")
    cur, new = F.col("current"), F.col("new_value")
    same = F.abs(cur - new) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(cur))
    op = (F.when(F.col("ok") & cur.isNotNull() & (new.isNull() | same), "confirm").when(new.isNull(), "unchanged").when(cur.isNull(), "add")
          .when(same, "unchanged").otherwise("update"))
    return both.select(*keys, "current", "new_value", op.alias("op"), (cur.isNotNull() & F.col("prefill").isNull() & (op == "update")).alias("warn"))


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored values after the approved adds and updates, with a result per change."""
    c = changes.select(*keys, F.col("new_value").alias("__n"), "op", "approved")
    act = F.coalesce(F.col("approved") & F.col("op").isin("add", "update"), F.lit(False))
    result = F.when(F.col("op").isNull(), "untouched").when(act, "applied").when(F.col("op") == "confirm", "confirmed").otherwise("skipped")
    return current.join(c, keys, "full_outer").select(*keys, F.when(act, F.col("__n")).otherwise(F.col("value")).alias("value"), result.alias("result"))


def keep_best(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """The best row per key (largest ``order`` struct), whole, as a map-side-combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("copies")).select(*keys, *[f"b.{c}" for c in rest], "copies")


def most_complete(flat: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keep the row with most non-zero fields per key, then the newest."""
    filled = reduce(lambda a, b: a + b, [F.coalesce(F.col(f) != 0, F.lit(False)).cast("int") for f in fields])
    return keep_best(flat, keys, [filled, F.col("updated_at"), F.col("id")], "id")


def exact_copies(items: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Mapping of every dropped copy to the kept (oldest) row."""
    kept = items.groupBy(*keys).agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    cond = reduce(lambda a, b: a & b, [items[k].eqNullSafe(kept[k]) for k in keys])
    return items.join(kept, cond).where(F.col(id_col) != F.col("kept_id")).select(F.col(id_col).alias("dropped_id"), "kept_id")


def newest_documents(docs: DataFrame) -> DataFrame:
    """Newest document per (company, content hash or url, period label), with how many copies it replaces."""
    key = F.coalesce("content_hash", "url")
    return docs.where(key.isNotNull()).groupBy("company_id", key.alias("doc_key"), "period_label").agg(
        F.max("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))


def filed_under_several_years(docs: DataFrame) -> DataFrame:
    """Files of a company that are on record under more than one label."""
    return docs.groupBy("company_id", "filename").agg(
        F.count_distinct("period_label").alias("labels"), F.count(F.lit(1)).alias("rows")).where("labels > 1")


def repoint(children: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Foreign keys of dropped rows point to the kept row."""
    m = mapping.select(F.col("dropped_id").alias("__d"), F.col("kept_id").alias("__k"))
    return children.join(m, F.col(column) == F.col("__d"), "left").withColumn(column, F.coalesce("__k", column)).drop("__d", "__k")


def purge_plan(tables: dict[str, DataFrame], targets: DataFrame, key: str) -> DataFrame:
    """Rows per table that a delete of the target keys removes."""
    counts = [t.join(targets.select(key).distinct(), key, "left_semi").agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
              for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def empty_parents(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def missing_company_years(company: DataFrame, years: list[str], survey: DataFrame) -> DataFrame:
    """Company-years with no survey row; the years are an exploded literal, not a cross join."""
    want = company.select("company_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    return want.join(survey.select("company_id", "fiscal_year"), ["company_id", "fiscal_year"], "left_anti")


def backfill_dimension(company: DataFrame, roster: DataFrame, column: str = "sector") -> DataFrame:
    """A blank attribute filled from the roster by ticker, never overwritten."""
    r = roster.select(F.lower("ticker").alias("__t"), F.col(column).alias("__v")).groupBy("__t").agg(F.min("__v").alias("__v"))
    blank = F.when(F.trim(column) != "", F.col(column))
    return company.join(r, F.lower("ticker") == F.col("__t"), "left").withColumn(column, F.coalesce(blank, "__v")).drop("__t", "__v")


def headline_backfill(survey: DataFrame, statements: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Survey figures filled from statements, converted to the survey row's unit, when empty; a row of unknown unit is not filled."""
    cols = {f"__{f}": src for f, src in fields.items()}
    st = statements.select("company_id", "fiscal_year", *[F.col(src).alias(a) for a, src in cols.items()])
    joined = survey.join(st, ["company_id", "fiscal_year"], "left")
    given = {f: F.try_divide(F.col(f"__{f}"), F.col("headline_scale")) for f in fields}
    out = joined.withColumns({f"{f}_source": F.when(F.col(f).isNull() & given[f].isNotNull(), "from parsed financial statements") for f in fields})
    return out.withColumns({f: F.coalesce(F.col(f), given[f]) for f in fields}).drop(*cols)


def comparative_fill(primary: DataFrame, comparative: DataFrame, keys: list[str]) -> DataFrame:
    """A later report's prior column: fills gaps, or replaces a smaller statement that is itself comparative.

    Both sides are (keys, line, amount, is_primary).
    """
    have = primary.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"), F.bool_or("is_primary").alias("__primary"))
    offer = comparative.groupBy(*keys).agg(F.count(F.lit(1)).alias("__offer"))
    verdict = offer.join(have, keys, "left").select(*keys, F.when(F.col("__have").isNull(), "fill").when(
        ~F.col("__primary") & (F.col("__have") < F.col("__offer")), "replace").otherwise("keep").alias("verdict"))
    dropped = verdict.where("verdict = 'replace'")
    added = comparative.join(verdict.where("verdict <> 'keep'").select(*keys), keys, "left_semi")
    return primary.join(dropped, keys, "left_anti").unionByName(added)


def reconcile_register(register: DataFrame, pay_people: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Adopt the pay-table people where the register has fewer than ``least`` rows, otherwise fill role and gender."""
    n = register.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    thin = pay_people.join(n, keys, "left").where(F.coalesce("__n", F.lit(0)) < least).drop("__n")
    full = register.join(n.where(F.col("__n") >= least).drop("__n"), keys, "left_semi")
    fill = pay_people.groupBy(*keys, "name_key").agg(F.min("role").alias("__role"), F.min("gender").alias("__gender"))
    filled = full.join(fill, [*keys, "name_key"], "left").withColumns({
        "role": F.coalesce(F.when(F.col("role") != "unknown", F.col("role")), "__role", F.lit("unknown")),
        "gender": F.coalesce("gender", "__gender")}).drop("__role", "__gender")
    cols = register.columns
    return filled.select(*cols, F.lit("register").alias("origin")).unionByName(
        thin.select(*[F.col(c) if c in pay_people.columns else F.lit(None).alias(c) for c in cols], F.lit("pay_table").alias("origin")))


def one_to_one(edges: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """The edges of an assignment in which no left and no right end occurs twice, the best edge (least by ``order``) first.

    A round takes every edge that is the best of both its ends and drops all others at those ends; rounds go on until no edge is left. That is
    what going through all edges in order would take, and no group is gathered. Edges that repeat count once; ends of edges with equal order are told
    apart by their own columns.
    """
    keys = list(dict.fromkeys([*left, *right]))
    rank = F.struct(*order, *[c for c in keys if c not in order])
    rest, taken = cut(edges.dropDuplicates(keys)), None
    while True:
        best_left = rest.groupBy(*left).agg(F.min(rank).alias("__l"))
        best_right = rest.groupBy(*right).agg(F.min(rank).alias("__r"))
        chosen = cut(rest.join(best_left, left).join(best_right, right).where((F.col("__l") == F.col("__r")) & (rank == F.col("__l"))).select(*edges.columns))
        taken = chosen if taken is None else taken.unionByName(chosen)
        rest = cut(rest.join(chosen.select(*left), left, "left_anti").join(chosen.select(*right), right, "left_anti"))
        if rest.isEmpty():
            return taken


def reconcile_people(register: DataFrame, pay_people: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The register made to agree with the pay tables, person by person; ``origin`` says where a row comes from.

    ``register`` and ``pay_people`` have the keys, director_name, role and gender. People of the two are paired one to one by their names, spelling and
    middle names aside: equal names first, then the most words in common, then the fewest letters apart. A listed director without role or gender
    takes them from the pay row of the same person. A register of fewer than ``least`` people beside a pay table of at least as many takes
    in the pay-table people that are nobody on it.
    """
    pairs = cut(same_person_join(register, pay_people, keys))  # read more than once
    a, b = similarity.name_words("name_a"), similarity.name_words("name_b")
    pairs = pairs.withColumns({
        "__unlike": (names.person_key("name_a") != names.person_key("name_b")).cast("int"), "__words": -F.size(F.array_intersect(a, b)),
        "__letters": F.levenshtein(names.person_key("name_a"), names.person_key("name_b"))})
    same = one_to_one(pairs, [*keys, "name_a"], [*keys, "name_b"], ["__unlike", "__words", "__letters"]).select(*keys, "name_a", "name_b")
    told = pay_people.groupBy(*keys, F.col("director_name").alias("name_b")).agg(F.min("role").alias("__role"), F.min("gender").alias("__gender"))
    facts = same.join(told, [*keys, "name_b"]).withColumnRenamed("name_a", "director_name").drop("name_b")
    listed = register.join(facts, [*keys, "director_name"], "left").withColumns({
        "role": F.coalesce(F.when(F.col("role") != "unknown", F.col("role")), "__role", F.lit("unknown")),
        "gender": F.coalesce(F.when(F.col("gender") != "", F.col("gender")), "__gender")})
    counted = lambda df, n: df.groupBy(*keys).agg(F.count_distinct("director_name").alias(n))
    thin = counted(pay_people, "__p").join(counted(register, "__r"), keys, "left").where((F.coalesce("__r", F.lit(0)) < least) & (F.col("__p") >= least)).select(*keys)
    known = pairs.select(*keys, F.col("name_b").alias("director_name")).distinct()
    added = pay_people.join(thin, keys, "left_semi").join(known, [*keys, "director_name"], "left_anti").groupBy(*keys, "director_name").agg(
        F.coalesce(F.min("role"), F.lit("unknown")).alias("role"), F.min("gender").alias("gender"))
    columns = [*keys, "director_name", "role", "gender"]
    return listed.select(*columns, F.lit("register").alias("origin")).unionByName(added.select(*columns, F.lit("pay_table").alias("origin")))


def align_directors(rows: DataFrame) -> DataFrame:
    """Identity candidates: a normalised full name that is unique in each year it appears and appears in two or more."""
    per_year = rows.groupBy("company_id", "name_key", "table_kind", "fiscal_year").agg(F.count(F.lit(1)).alias("k"))
    return per_year.groupBy("company_id", "name_key", "table_kind").agg(
        F.count(F.lit(1)).alias("years"), F.max("k").alias("__m"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year")
    ).where((F.col("years") >= 2) & (F.col("__m") == 1) & (F.size(F.split("name_key", " ")) >= 2)).drop("__m")


def items_with_statement(items: DataFrame, statements: DataFrame, doc_id: int | None = None) -> DataFrame:
    """Line items with their statement's type and document, for one document when given."""
    s = statements.select(F.col("id").alias("statement_id"), "statement_type", "source_document_id")
    s = s.where(F.col("source_document_id") == doc_id) if doc_id is not None else s
    return items.join(s, "statement_id")
