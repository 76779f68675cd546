"""Near-duplicate documents by MinHash with tensored banding.

A table key is a pair of half-keys, one from each of two collections of ``collections`` half-keys, so ``collections ** 2`` tables cost
only ``2 * collections`` half-keys of minhashes. Two documents meet in some table if and only if they agree on a left and on a right
half-key. At a Jaccard similarity of 0.85 and the defaults (3 minhashes a half-key, 8 + 8 half-keys) that has probability 0.999;
at 0.9 it is above 0.9999. Every candidate is confirmed on the full shingle sets.

Results for odd rows: a null or empty text, or one of white space only, has an empty set, links with nothing and stays its own
component. Rows with equal shingle sets are always linked, repeated rows included. A null ``doc_id`` is larger than any other: it never
names a component that has another id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import pin
from .tokens import odd_constants, shingle_sets, signed, slices, splitmix

WIDTH = 5
SIMILARITY_PERCENT = 85
COLLECTIONS = 8
ROWS = 3
# Words of 64 parities that are compared before two sets are.
WORDS = 8

_SIGNATURE = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, left_keys array<long>, right_keys array<long>"


def half_keys(shingles: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """The left half-keys, then the right ones; each hashes ``rows`` minhashes."""
    factors, offsets = odd_constants(2 * collections * rows, 11), odd_constants(2 * collections * rows, 13)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        block = shingles[at : at + 4096, None] * factors + offsets
        np.minimum(least, block.min(axis=0), out=least)
    parts = splitmix(least).reshape(2 * collections, rows)
    return splitmix((parts * odd_constants(rows, 17)).sum(axis=1, dtype=np.uint64))


def _signatures(width: int, collections: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, h1, h2, keys = [], [], [], []
                for s in shingle_sets(batch.column("text"), width):
                    n.append(len(s))
                    h1.append(int(signed(s.sum(dtype=np.uint64, keepdims=True))[0]) if len(s) else 0)
                    h2.append(int(signed(np.bitwise_xor.reduce(splitmix(s), keepdims=True))[0]) if len(s) else 0)
                    keys.append(signed(half_keys(s, collections, rows)) if len(s) else None)
                sides = [pa.array([None if k is None else k[part] for k in keys], pa.list_(pa.int64())) for part in (slice(None, collections), slice(collections, None))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *sides],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "left_keys", "right_keys"],
                )

    return run


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * WORDS parities of the shingles' hashes. Two sets differ in at least as many shingles as their parities differ in bits."""
    odd = np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([signed(s) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "shingles", "bits"],
                )

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))


def _possible(x: str, y: str, n_x: str, n_y: str, percent: int) -> str:
    """False only for sets that differ in too many shingles to be similar enough."""
    apart = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(WORDS))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({n_x} + {n_y})"


def _similar(percent: int) -> Column:
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    possible = F.expr(_possible("bits_a", "bits_b", "size(shingles_a)", "size(shingles_b)", percent))
    return possible & (100 * shared >= percent * (F.size("shingles_a") + F.size("shingles_b") - shared))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough; sizes alone rule some out before the sets meet."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_similar(percent)).select("a", "b")


def _with_sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles, bits`` of the wanted nodes, from the whole texts."""
    wanted = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"))
    texts = documents.join(wanted, (F.col("doc_id").eqNullSafe(F.col("k1"))) & (F.col("text_hash") == F.col("k2"))).select("node", "text")
    return texts.mapInArrow(_sets(width), "node long, shingles array<long>, bits array<long>").dropDuplicates(["node"])


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(1.03)).cast("int")


def _sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a > b`` of nodes in different components that share one of their rare shingles and may be similar enough.

    With all shingles ordered by the number of nodes that hold them, two sets as similar as asked for share one of the first
    ``n - ceil(percent * n / 100) + 1`` of each, so no such pair is missed. What stands before the shared one is not shared, which bounds the
    overlap and with it the sizes a partner may have; only those are looked up, and pairs whose parities differ too much are never made. Under one shingle the nodes of its commonest component look for
    nobody, since all others look for them.
    """
    each = sets.select("node", "component", "bits", F.explode("shingles").alias("shingle"))
    held = pin(each.groupBy("shingle").agg(F.count("*").alias("holders")), "holders")
    ordered = each.join(held, "shingle").groupBy("node", "component", "bits").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("s"))
    n = F.size("s")
    first = n - F.ceil(n * percent / 100).cast("int") + 1
    rare = ordered.select("node", "component", "bits", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), first)).alias("i", "s"))
    rare = pin(rare.where("s.holders > 1").select("node", "component", "bits", "n", "i", "s.shingle"), "rare")
    common = rare.groupBy("shingle", "component").agg(F.count("*").alias("members")).groupBy("shingle").agg(F.max_by("component", "members").alias("common"), F.count("*").alias("components"))
    common = pin(common.where("components > 1").select("shingle", "common"), "common")
    mixed = pin(rare.join(common, "shingle"), "mixed")

    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("i")) * (100 + percent) / percent) - F.col("n"))
    looking = mixed.where("component <> common").withColumn("least", least).withColumn("most", most).where("least <= most")
    looking = looking.withColumn("class", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    a = looking.select("shingle", "class", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("bits").alias("bx"))
    b = mixed.select("shingle", _size_class(F.col("n")).alias("class"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("bits").alias("by"))
    possible = f"cx <> cy and {100 + percent} * least(nx - ix, ny - iy) >= {percent} * (nx + ny) and {_possible('bx', 'by', 'nx', 'ny', percent)}"
    return a.join(b, ["shingle", "class"]).where(possible).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = SIMILARITY_PERCENT,
    collections: int = COLLECTIONS, rows: int = ROWS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_shingles, component_id, kept, keeper``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, ``kept`` says that the row carries it, ``keeper`` marks exactly one
    row of each component (they differ only where rows repeat an id).

    Rows of equal sets are one node from the start, so thousands of copies cost one comparison. In each table the members of a bucket
    are compared with its first node. Of the nodes whose buckets still hold several components, those that share rare shingles are
    compared too, so that no link is missed there; pairs inside a component are never listed.
    """
    documents = _documents(docs, id_col, text_col)
    signatures = pin(documents.mapInArrow(_signatures(width, collections, rows), _SIGNATURE).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = signatures.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("node"))
    classes = pin(classes, "classes")
    member = signatures.where("n_shingles > 0").select("h1", "h2", "n_shingles", "row", "doc_id").join(classes, ["h1", "h2", "n_shingles"]).select("row", "doc_id", "node")
    nodes = pin(signatures.join(classes.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"), "nodes")

    keys = (
        nodes.select("node", F.posexplode("left_keys").alias("i", "left"), "right_keys")
        .select("node", "i", "left", F.posexplode("right_keys").alias("j", "right"))
        .select("node", F.xxhash64("i", "j", "left", "right").alias("key"))
    )
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    meeting = pin(keys.join(shared, "key"), "meeting")
    star = pin(meeting.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "star")
    met = meeting.select("node").distinct()
    sets = pin(_with_sets(documents, nodes.select("node", "doc_id", "text_hash"), met, width), "sets")
    links = pin(_confirmed(star, sets, percent), "links")
    reached = components(links)

    placed = meeting.join(reached, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = pin(placed.join(split, "key").select("node", "component").distinct(), "apart")
    rest = _sharing_rare(sets.join(apart, "node"), percent).join(star, ["a", "b"], "left_anti")
    more = pin(_confirmed(rest, sets, percent), "more")
    if not more.isEmpty():
        reached = components(links.unionByName(more))

    grouped = pin(member.join(reached, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    first = grouped.join(smallest, "component").where("doc_id <=> component_id").groupBy("component", "component_id").agg(F.min("row").alias("keeper_row"))
    placed = grouped.select("row", "component").join(first, "component").select("row", "component_id", "keeper_row")
    return (
        signatures.select("row", "doc_id", "text_hash", "n_shingles")
        .join(placed, "row", "left")
        .select(
            "doc_id", "text_hash", "n_shingles",
            F.when(F.col("keeper_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.col("keeper_row").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
            F.coalesce(F.col("row") == F.col("keeper_row"), F.lit(True)).alias("keeper"),
        )
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT, collections: int = COLLECTIONS,
) -> DataFrame:
    """The rows of ``docs``, one of each component. Columns stay as they are.

    Rows that repeat both id and text are one: only one of them stays.
    """
    keep = near_duplicates(docs, id_col, text_col, percent=percent, collections=collections).where("keeper").select(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash")).distinct()
    rows = docs.withColumn("__llm_key", F.xxhash64(text_col))
    rows = rows.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_hash")), "left_semi")
    return rows.dropDuplicates([id_col, "__llm_key"]).drop("__llm_key")
