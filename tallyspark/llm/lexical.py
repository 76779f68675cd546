"""Ranked lexical search over a term-document grid held in K2-treaps.

The corpus is dealt into shards of at most ``SHARD_DOCS`` documents or ``SHARD_TEXT`` bytes, wherever they lie, without a shuffle. A shard's grid has a
row for each of its terms, the commonest first, and a column for each document, short ones first; a term in a document is a cell with its
impact ``10^9 tf div (1000 tf + 12 m)``, where ``m`` grows with the document's length. Rows are cut into square bands of as many rows as there
are columns (rounded up to a power of two), and each band is a quadtree whose cells are numbered level by level: a cell keeps a mask of its
non-empty quarters and the largest impact below it, stored as what it lacks to its parent's. Children stand together, so the place of a
child is the number of quarters before it: no pointers are stored.

An item's terms are rows. Its search holds ranges of documents: for each range the cells, one on each row's path, that cover it. The sum of
weight times the cells' largest impacts bounds the score of every document of the range. The best ranges of all items of a shard are halved
together, round by round, all paths going down at once; a range of one document has its exact score. A range goes when its bound is below the
item's ``k``-th best score so far, over all shards that the task has seen; one that equals it stays, so ties are settled by id. No document
is scored unless its bound is that high, and none that could be in the result is left out.

Results for odd rows: null and empty texts have no terms, are not counted in N and are never found. Rows that repeat are documents of their
own, with ranks of their own; equal scores are ordered by id, then text hash, null ids last. An item row that repeats exactly is answered once;
rows with one id and different texts are answered separately. Items without terms, or with none that occurs, have no rows, as has an empty
table. Other columns are ignored. Items are sent to the tasks in blocks of at most about ``MAX_TERMS`` terms, each block against all shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import pin
from .tokens import alphanumeric_words, lower_table, slices, utf8

TOP = 20
SHARD_DOCS = 1 << 12
SHARD_TEXT = 1 << 22
MAX_TERMS = 200_000
# Shards in a file of the index: Spark reads a file's rows together, so its size bounds what a search task decodes at once.
FILE_SHARDS = 2
# Ranges of an item that are halved in a round; and terms of the items that are searched for together, which bounds a task's memory.
BEAM = 24
TERMS_AT_ONCE = 600
# Terms as a pattern of the JVM, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BITS4 = np.array([bin(i).count("1") for i in range(16)], np.int64)
_GRID = "doc_ids array<long>, text_hashes array<long>, terms array<binary>, holders array<int>, masks binary, drops binary"


# Terms


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of every term of the texts: the text it is in and its bytes (A-Z lower-cased)."""
    data, offsets = utf8(column)
    low = lower_table()[data]
    inside = alphanumeric_words()[low]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    bounds = np.append(0, np.cumsum(ends - starts))
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low[inside])])
    return np.searchsorted(offsets, starts, side="right") - 1, packed


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = total = 0
    for whole in batches:
        for batch in slices(whole, "text"):
            of, _ = terms(batch.column("text"))
            documents, total = documents + len(np.unique(of)), total + len(of)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "terms"])


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and terms of all."""
    found = rows.select("text").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


# The grid


def _spread(x: np.ndarray) -> np.ndarray:
    """Bit i of x at place 2 i."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """Quadtrees of the bands of one grid: the mask and largest impact of every cell, and its first child."""

    def __init__(self, masks: np.ndarray, largest: np.ndarray, bits: int, bands: int):
        self.masks, self.largest, self.bits = masks, largest, bits
        quarters = _BITS4[masks]
        self.first = bands + np.cumsum(quarters) - quarters

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, impact: np.ndarray, columns: int) -> Treap:
        bits = max(1, int(columns - 1).bit_length())
        side = np.uint64(bits)
        at = row.astype(np.uint64)
        key = (at >> side) << np.uint64(2 * bits) | _spread(at & np.uint64((1 << bits) - 1)) << np.uint64(1) | _spread(column)
        order = np.argsort(key, kind="stable")
        key, top = key[order], impact[order]
        masks, largest = [], [top]
        for _ in range(bits):
            up = key >> np.uint64(2)
            head = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (key & np.uint64(3)).astype(np.uint8), head))
            top = np.maximum.reduceat(top, head)
            largest.append(top)
            key = up[head]
        return cls(np.concatenate(masks[::-1]), np.concatenate(largest[::-1]), bits, len(top))

    def stored(self) -> tuple[bytes, bytes]:
        parent = np.repeat(np.arange(len(self.masks)), _BITS4[self.masks])
        drops = self.largest.copy()
        drops[len(drops) - len(parent) :] = self.largest[parent] - drops[len(drops) - len(parent) :]
        return self.masks.tobytes(), drops.astype("<u4").tobytes()

    @classmethod
    def read(cls, masks: bytes, drops: bytes, columns: int) -> Treap:
        masks, largest = np.frombuffer(masks, np.uint8), np.frombuffer(drops, "<u4").astype(np.int64)
        bits = max(1, int(columns - 1).bit_length())
        quarters = _BITS4[masks]
        bands = len(largest) - int(quarters.sum())
        begin, end = 0, bands
        for _ in range(bits):  # a level's cells, then their children's
            below = end + int(quarters[begin:end].sum())
            largest[end:below] = np.repeat(largest[begin:end], quarters[begin:end]) - largest[end:below]
            begin, end = end, below
        return cls(masks, largest, bits, bands)


def _impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of ``n`` terms ``m``, and the impact of every ``tf`` with it."""
    m = np.array([75 + 25 * k * documents // total for k in n.tolist()], np.int64)
    return m, lambda of: (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])


def _grid_rows(ids: pa.Array, hashes: pa.Array, text: pa.Array, documents: int, total: int) -> list[pa.RecordBatch]:
    of, word = terms(text)
    if not len(of):
        return []
    word = word.dictionary_encode()
    names = word.dictionary
    found, tf = np.unique(of * np.int64(len(names)) + word.indices.to_numpy(), return_counts=True)
    of_text, code = found // len(names), found % len(names)
    held, n = np.unique(of, return_counts=True)
    m, impact = _impacts(tf, n, documents, total)
    order = np.lexsort((held, m))
    column = np.empty(len(held), np.int64)
    column[order] = np.arange(len(held))
    holders = np.bincount(code, minlength=len(names))
    by_row = np.argsort(-holders, kind="stable")
    row = np.empty(len(names), np.int64)
    row[by_row] = np.arange(len(names))
    place = np.searchsorted(held, of_text)
    masks, drops = Treap.of(row[code], column[place], impact(place), len(held)).stored()
    at = pa.array(held[order])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return [pa.RecordBatch.from_arrays(
        [one(ids.take(at)), one(hashes.take(at)), one(names.take(pa.array(by_row)).cast(pa.binary())), one(pa.array(holders[by_row].astype(np.int32))), pa.array([masks], pa.binary()), pa.array([drops], pa.binary())],
        names=["doc_ids", "text_hashes", "terms", "holders", "masks", "drops"],
    )]


def _grids(documents: int, total: int, shard_docs: int, shard_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0

        def full() -> list[pa.RecordBatch]:
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text_hash", "text")]
            held.clear()
            return _grid_rows(*columns, documents, total)

        for whole in batches:
            for part in slices(whole, "text", shard_text // 8):
                for at in range(0, part.num_rows, shard_docs):
                    piece = part.slice(at, shard_docs)
                    weight = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                    if held and (rows + piece.num_rows > shard_docs or size + weight > shard_text):
                        yield from full()
                        rows = size = 0
                    held.append(piece)
                    rows, size = rows + piece.num_rows, size + weight
        if held:
            yield from full()

    return run


def grids(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_text: int = SHARD_TEXT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index, a row for each shard, written once; and N."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    documents, total = corpus_size(rows)
    index = rows.mapInArrow(_grids(documents, total, shard_docs, shard_text), _GRID)
    return pin(index, "grids", compression="zstd", maxRecordsPerFile=str(FILE_SHARDS)), documents


# Search


def _first_of_each(group: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of ``order``, which lists rows by group, the first ``k`` of each group."""
    g = group[order]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g)))) < k]


class Scores:
    """The ``k`` best scores of every item so far; the last of them (1 where there are fewer) is what others must reach."""

    def __init__(self, items: int, k: int):
        self.k, self.best = k, np.zeros((items, k), np.int64)

    @property
    def least(self) -> np.ndarray:
        return np.maximum(self.best[:, -1], 1)

    def add(self, item: np.ndarray, score: np.ndarray) -> None:
        if len(item):
            every = np.concatenate([item, np.repeat(np.arange(len(self.best)), self.k)])
            value = np.concatenate([score, self.best.ravel()])
            self.best = value[_first_of_each(every, np.lexsort((-value, every)), self.k)].reshape(self.best.shape)


def search(treap: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, scores: Scores, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, columns and exact scores of all documents that may be among the best; ``item, row, weight`` are of the terms, by item."""
    band, inside = row >> treap.bits, row & ((1 << treap.bits) - 1)
    pool_term, pool_cell, used = np.arange(len(row), dtype=np.int32), band.astype(np.int32), len(row)
    value = weight * treap.largest[band]
    head = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    bound = np.add.reduceat(value, head) if len(head) else np.zeros(0, np.int64)
    # ranges: item, level, number within the level, bound, place and number of their cells
    ranges = np.stack([item[head], np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), bound, head, np.diff(np.append(head, len(item)))])
    found: list[np.ndarray] = []
    while ranges.shape[1]:
        ranges = ranges[:, ranges[3] >= scores.least[ranges[0]]]
        if not ranges.shape[1]:
            break
        chosen = np.zeros(ranges.shape[1], bool)
        chosen[_first_of_each(ranges[0], np.lexsort((-ranges[3], ranges[0])), beam)] = True
        now, ranges = ranges[:, chosen], ranges[:, ~chosen]
        count = now[5]
        owner = np.repeat(np.arange(len(count)), count)
        at = np.repeat(now[4] - (np.cumsum(count) - count), count) + np.arange(len(owner))
        term, cell = pool_term[at], pool_cell[at]
        down = (inside[term] >> (treap.bits - 1 - now[1][owner])) & 1
        mask, first = treap.masks[cell], treap.first[cell]
        fresh = []
        for right in (0, 1):
            quarter = (down * 2 + right).astype(np.uint8)
            there = np.flatnonzero(mask >> quarter & 1)
            if not len(there):
                continue
            child = first[there] + _BITS4[mask[there] & ((1 << quarter[there].astype(np.int64)) - 1)]
            whose, t = owner[there], term[there]
            head = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
            bound, of = np.add.reduceat(weight[t] * treap.largest[child], head), whose[head]
            made = np.stack([now[0][of], now[1][of] + 1, now[2][of] * 2 + right, bound, head + used, np.diff(np.append(head, len(whose)))])
            alive = made[3] >= scores.least[made[0]]
            leaf = made[1] == treap.bits
            found.append(made[:, alive & leaf][[0, 2, 3]])
            fresh.append(made[:, alive & ~leaf])
            if used + len(child) > len(pool_cell):
                grow = np.zeros(max(len(pool_cell), len(child)), np.int32)
                pool_term, pool_cell = np.concatenate([pool_term, grow]), np.concatenate([pool_cell, grow])
            pool_term[used : used + len(child)], pool_cell[used : used + len(child)] = t, child
            used += len(child)
            scores.add(found[-1][0], found[-1][2])
        ranges = np.concatenate([ranges, *fresh], axis=1)
    item, column, score = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    last = score >= scores.least[item]
    return item[last], column[last], score[last]


def _order(item: np.ndarray, score: np.ndarray, doc: np.ndarray, unknown: np.ndarray, text: np.ndarray) -> np.ndarray:
    return np.lexsort((text, doc, unknown, -score, item))


def _together(item: np.ndarray, most: int) -> list[slice]:
    """Ranges of the items' terms, whole items each, of about ``most`` terms."""
    heads = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    cuts = heads[np.append(True, heads[1:] // most != heads[:-1] // most)] if len(heads) else heads
    return [slice(int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(item)))]


def _searcher(sent, k: int):
    """``sent``: the distinct terms, and of each item's terms, by item: the item, the place among the distinct terms, the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, name, weight = sent.value
        names = pa.array(names, pa.binary())
        parts = [(p, int(item[p].min()), Scores(int(item[p].max() - item[p].min()) + 1, k)) for p in _together(item, TERMS_AT_ONCE)]
        best = [np.zeros(0, np.int64)] * 5  # item, score, id, unknown id, text hash
        for batch in batches:
            for i in range(batch.num_rows):
                ids, hashes, held = (batch.column(c)[i].values for c in ("doc_ids", "text_hashes", "terms"))
                row = pc.fill_null(pc.index_in(names, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int64)[name]
                treap = Treap.read(batch.column("masks")[i].as_py(), batch.column("drops")[i].as_py(), len(ids))
                found = []
                for p, least, scores in parts:
                    here = row[p] >= 0
                    of, column, score = search(treap, item[p][here] - least, row[p][here], weight[p][here], scores)
                    found.append((of + least, column, score))
                of, column, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[column]
                unknown = np.asarray(ids.is_null())[column].astype(np.int64)
                best = [np.concatenate(x) for x in zip(best, (of, score, doc, unknown, hashes.to_numpy(zero_copy_only=False)[column]))]
                kept = _first_of_each(best[0], _order(best[0], best[1], best[2], best[3], best[4]), k)
                best = [x[kept] for x in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0].astype(np.int32)), pa.array(best[2], mask=best[3] == 1), pa.array(best[4]), pa.array(best[1])], names=["item", "doc_id", "text_hash", "score"]
        )

    return run


def _holders(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.binary())
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = pc.index_in(names, value_set=batch.column("terms")[i].values)
                there = np.asarray(row.is_valid())
                total[there] += batch.column("holders")[i].values.to_numpy()[row.drop_null().to_numpy()]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["name", "holders"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words`` of each different item row that has terms."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    return rows.select("item_id", F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1)).alias("words")).where(F.size("words") > 0)


def _answers(index: DataFrame, documents: int, items: list, k: int) -> DataFrame:
    """``item, doc_id, text_hash, score, rank`` for a block of items, by their places in it."""
    context = index.sparkSession.sparkContext
    names = sorted({w.encode() for r in items for w in r.words})
    place = {w: i for i, w in enumerate(names)}
    found = index.select("terms", "holders").mapInArrow(_holders(context.broadcast(names)), "name int, holders long").groupBy("name").agg(F.sum("holders").alias("df")).collect()
    weight = {r.name: math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in found}
    parts = []
    for i, r in enumerate(items):
        times: dict[int, int] = {}
        for w in r.words:
            times[place[w.encode()]] = times.get(place[w.encode()], 0) + 1
        parts += [(i, w, n * weight[w]) for w, n in times.items() if weight.get(w, 0) > 0]
    item, name, value = np.array(parts, np.int64).reshape(-1, 3).T
    sent = context.broadcast((names, item, name, value))
    best = index.mapInArrow(_searcher(sent, k), "item int, doc_id long, text_hash long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "text_hash"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, max_terms: int = MAX_TERMS, shard_docs: int = SHARD_DOCS, shard_text: int = SHARD_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, among all documents."""
    spark = docs.sparkSession
    index, documents = grids(docs, shard_docs, shard_text, id_col, text_col)
    asked = pin(item_terms(items), "items")
    blocks = max(1, -(-2 * (asked.agg(F.sum(F.size("words"))).first()[0] or 0) // max_terms))
    kind = asked.schema["item_id"].dataType
    out = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {kind.simpleString()}")
        out.append(_answers(index, documents, part, k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
