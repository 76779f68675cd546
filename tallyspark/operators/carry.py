"""Carry the last seen value forward without putting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, block: Column | None) -> DataFrame:
    """``name`` = last non-null ``value`` up to each row in ``order``.

    ``block`` is a coarse, order-preserving bucket of the order columns (for pages: page div 50). Rows are ordered inside
    (key, block); what enters a block is carried over the block summaries, which are smaller by the block size. Without a block a key is small, as
    the lines of a page are: nothing enters it, so its rows are read once. Rows without a key are left out either way.
    """
    if block is None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.dropna(subset=list(keys)).withColumn(name, F.last(value, ignorenulls=True).over(whole))
    b = df.withColumn("__b", block)
    inner = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*[F.col(o) for o in order], F.col(value).alias("__val"))))
    ends = b.groupBy(*keys, "__b").agg(last["__val"].alias("__end"))
    outer = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    entering = ends.withColumn("__in", F.last("__end", ignorenulls=True).over(outer)).drop("__end")
    joined = b.join(entering, [*keys, "__b"])
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("__in"))).drop("__b", "__in")


def carried_into_pages(pages: DataFrame, last: Column, name: str, block: Column) -> DataFrame:
    """``doc_id, page, name``: the last non-null ``last`` of the pages before each page of its document. Pages travel without their text."""
    # a page asks for what stands before it, then offers its own last value
    turns = pages.select("doc_id", "page", F.posexplode(F.array(F.lit(None), last)).alias("turn", "__offer"))
    return carry_forward(turns, ["doc_id"], ["page", "turn"], "__offer", name, block).where("turn = 0").select("doc_id", "page", name)


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later steps read many times.

    A one-element explode keeps Spark from copying their expressions into every use, which would otherwise outgrow the
    size limit of generated code.
    """
    kept = [c for c in df.columns if c not in cols]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("__p")
    return df.select(*kept, one).select(*kept, *[F.col(f"__p.{n}").alias(n) for n in cols])
