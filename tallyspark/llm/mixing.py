"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents are each wanted ``target / size of the source`` times. The whole part of that is given to every document; the rest is a
probability, rounded so that the source's words come out near the target: two fractional documents trade probability, weighed by their
words so that the expected words of the pair stay the same, until one of the two is 0 or 1; the other trades on with the next. That
happens inside blocks of about ``BLOCK`` documents; each block leaves at most one fractional document, and those form the blocks of the next
level, until a source has one left, which is rounded by its own probability. A source of any size is thus split over many tasks, and its words
miss the target by at most one document's.

Draws are hashes of the ids, so reruns agree whatever the partitions.

Results for odd rows: null or empty texts have size 0 and are taken 0 words; a null source is a source of its own, last in order; rows that
repeat an id are documents of their own, told apart by their text hash (rows equal in both trade as one document and get equal results);
sources without words have target 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import pin

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources by code point, null last. Targets share ``share`` times all words by weight; none exceeds ``limit`` times its
    source, and what is over is shared again among the rest by weight. Only totals reach the driver, however many sources there are.
    """
    # places over any number of sources: ranges in order, then numbers inside each range after the ranges before it
    ranged = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("range", F.spark_partition_id())
    ranged = pin(ranged, "sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    weighed = pin(ranged.join(before.select("range", "before"), "range").select("source", "source_size", weight.alias("weight")), "weights")
    limited = F.col("source_size") * limit
    total, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, rate, full = share * (total or 0), 0.0, -1
    if total:
        rate = wanted / all_weight
        while True:
            over = limited <= F.col("weight") * rate
            n, taken, rest = weighed.agg(F.count_if(over), F.sum(F.when(over, limited)), F.sum(F.when(~over, F.col("weight")))).first()
            if n == full or not rest:
                break
            full, rate = n, (wanted - (taken or 0.0)) / rest
    return weighed.select("source", "source_size", F.least(limited, F.col("weight") * rate).alias("target"))


def _traded(carry: Column, x: Column) -> Column:
    """One step of a block's fold: the carried document trades with the next one.

    The two keep ``size * p`` together. Either the carried one rises as far as it can or it falls; the odds make the expected change 0.
    """
    a = carry["open"]
    up = F.least(1 - a["p"], x["p"] * x["size"] / a["size"])
    down = F.least(a["p"], (1 - x["p"]) * x["size"] / a["size"])
    rise = draw(a["draw"], x["draw"]) * (up + down) < down
    p_a = F.when(rise, a["p"] + up).otherwise(a["p"] - down)
    p_x = F.when(rise, x["p"] - up * a["size"] / x["size"]).otherwise(x["p"] + down * a["size"] / x["size"])
    return F.struct(p_a.alias("a"), p_x.alias("x"))


def draw(*seeds: Column) -> Column:
    """A number from 0 up to but not including 1."""
    return F.pmod(F.xxhash64(*seeds), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _state(open_: Column, done: Column) -> Column:
    return F.struct(open_.alias("open"), done.alias("done"))


def _block(members: Column) -> Column:
    """Folds a block's documents; all but at most one end up with a probability of 0 or 1."""
    kind = "struct<k1:bigint,k2:bigint,size:bigint,p:double,draw:bigint>"
    nothing = F.lit(None).cast(kind)

    def with_p(d: Column, p: Column) -> Column:
        whole = F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)
        return F.struct(d["k1"].alias("k1"), d["k2"].alias("k2"), d["size"].alias("size"), whole.alias("p"), d["draw"].alias("draw"))

    def open_(d: Column) -> Column:
        return (d["p"] > 0) & (d["p"] < 1)

    def step(state: Column, x: Column) -> Column:
        pair = F.transform(F.array(_traded(state, x)), lambda t: F.struct(with_p(state["open"], t["a"]).alias("a"), with_p(x, t["x"]).alias("x")))
        moved = F.transform(pair, lambda t: _state(
            F.when(open_(t["a"]), t["a"]).when(open_(t["x"]), t["x"]).otherwise(nothing),
            F.concat(state["done"], F.filter(F.array(t["a"], t["x"]), lambda d: ~open_(d))),
        ))
        return F.when(state["open"].isNull(), _state(x, state["done"])).otherwise(F.element_at(moved, 1))

    start = _state(nothing, F.array().cast(f"array<{kind}>"))
    return F.aggregate(members, start, step)


def _levels(open_: DataFrame, block: int, seed: int) -> DataFrame:
    """``source, k1, k2, up``: what every fractional document is rounded to, level after level."""
    settled = None
    level = 0
    while True:
        counts = open_.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        if largest <= 1:
            last = open_.select("source", "k1", "k2", (draw(F.col("draw"), F.lit(seed)) < F.col("p")).cast("int").alias("up"))
            return last if settled is None else settled.unionByName(last)
        blocks = F.ceil(F.col("n") / block)
        placed = open_.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("draw", F.lit(seed), F.lit(level)), blocks))
        # large documents trade first, so that what is left of a block, and in the end of a source, is small
        member = F.struct((-F.col("size")).alias("order"), "draw", "k1", "k2", "size", "p")
        folded = (
            placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(member)).alias("members"))
            .select("source", _block(F.transform("members", lambda m: F.struct(m["k1"].alias("k1"), m["k2"].alias("k2"), m["size"].alias("size"), m["p"].alias("p"), m["draw"].alias("draw")))).alias("b"))
        )
        folded = pin(folded.select("source", "b.open", "b.done"), f"level{level}")
        done = folded.select("source", F.explode("done").alias("d")).select("source", "d.k1", "d.k2", F.col("d.p").cast("int").alias("up"))
        settled = done if settled is None else settled.unionByName(done)
        open_ = folded.where(F.col("open").isNotNull()).select("source", "open.*")
        level += 1


def mixed(
    docs: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, source, size, source_size, target, copies, taken``."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    rows = pin(rows, "sizes")
    targets = pin(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit, weights), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.floor(wanted + _EPS).cast("int").alias("whole"), F.greatest(wanted - F.floor(wanted + _EPS), F.lit(0.0)).alias("p"),
    )
    documents = rows.join(rated, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = (
        documents.where((F.col("size") > 0) & (F.col("p") > _EPS))
        .groupBy("source", F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), "p").agg(F.sum("size").alias("size"))
        .select("source", "k1", "k2", "size", "p", F.xxhash64("k1", "k2", F.lit(seed)).alias("draw"))
    )
    up = _levels(pin(open_, "open"), block, seed)
    found = documents.join(
        up.withColumnRenamed("source", "s"),
        F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2")) & F.col("source").eqNullSafe(F.col("s")), "left",
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0))
    return found.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
