"""Removal of multi-line chunks that repeat across the corpus.

A text's non-blank lines are cut into content-defined chunks. A rolling hash over the hashes of a line and the next says whether a chunk begins
there, one over a line and the line before whether a chunk ends there; a chunk runs from a beginning to the first end after it. So both ends
depend on the chunk's own lines only, and a passage is cut the same way whatever surrounds it. One such pair of hashes marks all but one in
``DIVISOR`` lines and misses some passages; ``PAIRS`` independent ones miss few, and their chunks count together (they overlap). Every chunk
has two lines or more, and blank lines inside belong to it.

A chunk that occurs again anywhere is removed, except its first occurrence (smallest id, then place). Occurrences are found by hash and
told apart by their bytes: Spark groups the bytes themselves, so equal hashes alone remove nothing. A line goes with any removed chunk over it;
the first occurrence of a line that repeats in such a chunk stays. Single lines that repeat always stay. Of repeated passages, the share of
lines that goes is 0.99 for two lines by the model and more beyond; at least 0.95 is measured on planted passages of 2 to 6 lines (see the tests).

``with_unique_chunks`` can leave near copies whole for a stage that compares whole texts: one that keeps a few edited lines after its other
lines went would be a fragment that resembles nothing. A text is a near copy if the bytes that it would lose to one single text are at
least ``near_copies`` of the bytes of both together. Exact copies go whole in any case.

Results for odd rows: null and empty texts have no lines and stay as they are; rows that repeat an id with another text follow each other
in the order of their text hashes; rows that repeat both are one document and get equal results; a null id comes after all others. An
empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import pin
from .tokens import odd_constants, signed, slices, splitmix, utf8, words

# All but one in so many lines begin (or end) a chunk by one pair of hashes; and how many pairs there are.
DIVISOR = 4
PAIRS = 6
NEAR_COPIES = 0.6


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    inside[10] = False
    return words(data, offsets, inside, fold=False)


class Lines:
    """The non-blank lines of texts, and the chunks they are cut into."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.text, self.start, self.length, self.hash = _lines(data, offsets)
        self.first_line = np.searchsorted(self.text, np.arange(len(offsets)))
        # where the next line begins, or the text ends: blank lines go with the line before them
        self.next = offsets[self.text + 1] if len(self.text) else np.zeros(0, np.int64)
        follows = np.flatnonzero(self.text[1:] == self.text[:-1])
        self.next[follows] = self.start[follows + 1]

    def chunks(self, divisor: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last line of every chunk, each once."""
        n, h = len(self.text), self.hash
        if n < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = self.text[1:] == self.text[:-1]
        found = []
        for low, high in odd_constants(2 * pairs, 23).reshape(pairs, 2):
            rolled = h[:-1] * low + h[1:] * high
            begin = np.flatnonzero(joined & (splitmix(rolled) % np.uint64(divisor) != 0))
            end = np.flatnonzero(joined & (splitmix(rolled ^ high) % np.uint64(divisor) != 0)) + 1
            at = np.searchsorted(end, begin, side="right")
            begin, at = begin[at < len(end)], at[at < len(end)]
            last = end[at]
            inside = self.text[last] == self.text[begin]
            found.append(begin[inside] * np.int64(n) + last[inside])
        key = np.unique(np.concatenate(found))
        return key // n, key % n

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A polynomial over the line hashes of each chunk, by differences of running sums."""
        odd = int(odd_constants(1, 19)[0])
        inverse = np.uint64(pow(odd, -1, 1 << 64))
        power, back = np.full(len(self.text), odd, np.uint64), np.full(len(self.text), inverse, np.uint64)
        power[:1], back[:1] = 1, 1
        total = np.append(np.uint64(0), np.cumsum(self.hash * np.cumprod(power)))
        return splitmix((total[last + 1] - total[first]) * np.cumprod(back)[first] + (last - first).astype(np.uint64))

    def numbers(self, line: np.ndarray) -> pa.Array:
        """Lines counted within their text."""
        return pa.array((line - self.first_line[self.text[line]]).astype(np.int32))


def _listed(divisor: int, pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                held = Lines(*utf8(batch.column("text")))
                first, last = held.chunks(divisor, pairs)
                at = pa.array(held.text[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("text_hash").take(at), held.numbers(first), held.numbers(last), pa.array(signed(held.hashes(first, last)))],
                    names=["doc_id", "text_hash", "first", "last", "chunk_hash"],
                )

    return run


def _ranges(held: Lines, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """Of lists of structs with ``first`` and ``last``, one list a text: text, first and last line of each, and the structs."""
    part = lists.flatten()
    count = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    of = np.repeat(np.arange(len(count)), count)
    line = lambda name: held.first_line[of] + part.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
    return of, line("first"), line("last"), part


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            held = Lines(*utf8(batch.column("text")))
            of, first, last, part = _ranges(held, batch.column("wanted"))
            begin, end = held.start[first], held.start[last] + held.length[last]
            content = [held.data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            at, size = pa.array(of), np.bincount(held.text, held.length, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), part.field("first"), part.field("last"), part.field("chunk_hash"), pa.array(size[of]), pa.array(content, pa.binary())],
                names=["doc_id", "text_hash", "first", "last", "chunk_hash", "size", "content"],
            )


def _near_copies(held: Lines, of: np.ndarray, first: np.ndarray, last: np.ndarray, part: pa.StructArray, share: float) -> np.ndarray:
    """The texts that lose at least ``share`` of the bytes of both to one single text, but not all they have."""
    out = np.zeros(len(held.offsets) - 1, bool)
    if not len(of):
        return out
    number = lambda name: part.field(name).to_numpy(zero_copy_only=False)
    other = np.stack([np.asarray(part.field("unknown")).astype(np.int64), np.nan_to_num(number("doc_id")).astype(np.int64), number("other_hash")])
    order = np.lexsort((first, *other, of))
    of, first, last, other, size = of[order], first[order], last[order], other[:, order], number("size")[order]
    fresh = np.append(True, (of[1:] != of[:-1]) | (other[:, 1:] != other[:, :-1]).any(axis=0))
    group = np.cumsum(fresh) - 1
    # lines of a group that no earlier chunk of it covers: running maxima, with the groups lifted above each other
    lift = group * np.int64(len(held.text) + 1)
    reach = np.maximum.accumulate(last + lift) - lift
    begin = np.where(fresh, first, np.maximum(first, np.append(0, reach[:-1]) + 1))
    total = np.append(0, np.cumsum(held.length))
    gained = np.where(last >= begin, total[last + 1] - total[np.minimum(begin, last + 1)], 0)
    covered = np.bincount(group, gained)
    text, own = of[fresh], np.diff(total[held.first_line])
    out[text[covered >= share * (own[text] + size[fresh] - covered)]] = True
    return out


def _applied(divisor: int, pairs: int, carried: list[str], near_copies: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__llm_text"):
                held, n = Lines(*utf8(batch.column("__llm_text"))), batch.num_rows
                of, first, last, part = _ranges(held, batch.column("__llm_gone"))
                change = np.zeros(len(held.text) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, last + 1, -1)
                line_gone = np.cumsum(change[:-1]) > 0
                lines = np.bincount(held.text, minlength=n)
                if near_copies is not None:
                    near = _near_copies(held, of, first, last, part, near_copies) & (np.bincount(held.text[line_gone], minlength=n) < lines)
                    line_gone &= ~near[held.text]
                    of = of[~near[of]]
                edge = np.zeros(len(held.data) + 1, np.int64)
                np.add.at(edge, held.start[line_gone], 1)
                np.add.at(edge, held.next[line_gone], -1)
                keep = np.cumsum(edge[:-1]) == 0
                valid, ends = np.asarray(batch.column("__llm_text").is_valid()), held.offsets
                kept = [held.data[a:b][keep[a:b]].tobytes().decode() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]
                cut = held.chunks(divisor, pairs)[0]
                count = lambda of: pa.array(np.bincount(of, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in carried), pa.array(kept, pa.string()), pa.array(lines.astype(np.int64)), count(held.text[cut]), count(held.text[line_gone]), count(of)],
                    names=[*carried, "__llm_kept", "__llm_lines", "__llm_chunks", "__llm_gone_lines", "__llm_gone_chunks"],
                )

    return run


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, first, last, origin``: the chunks to remove (lines counted from 0) and the place of the first occurrence, whose bytes
    are the same."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    listed = pin(rows.mapInArrow(_listed(divisor, pairs), "doc_id long, text_hash long, first int, last int, chunk_hash long"), "chunks")
    several = pin(listed.groupBy("chunk_hash").agg(F.count("*").alias("n")).where("n > 1").select("chunk_hash"), "several")
    again = listed.join(several, "chunk_hash")
    wanted = again.groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).agg(F.collect_set(F.struct("first", "last", "chunk_hash")).alias("wanted"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2"))).select("doc_id", "text_hash", "text", "wanted")
    held = texts.mapInArrow(_bytes, "doc_id long, text_hash long, first int, last int, chunk_hash long, size long, content binary")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "first", "size")
    held = pin(held.withColumn("second_hash", F.xxhash64(F.lit(1), "content")).withColumn("place", place), "contents")
    # Equal bytes are one row each after this: bytes travel once for each task that holds them. Two hashes tell them apart from then on, unless
    # different bytes share both; those are joined by their bytes.
    keys = ["chunk_hash", "second_hash"]
    first = pin(held.groupBy(*keys, "content").agg(F.min("place").alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    told = first.groupBy(*keys).agg(F.min("origin").alias("origin"), F.count("*").alias("variants"))
    gone = held.drop("content").join(told.where("variants = 1").drop("variants"), keys)
    shared = told.where("variants > 1")
    if not shared.isEmpty():
        gone = gone.unionByName(held.join(first.join(shared.select(*keys), keys, "left_semi"), [*keys, "content"]).drop("content"))
    return gone.where("place > origin").select("doc_id", "text_hash", "first", "last", "origin").distinct()


def without_repeated_chunks(
    docs: DataFrame, carried: list[str], divisor: int = DIVISOR, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text", near_copies: float | None = None,
) -> DataFrame:
    """The carried columns of every row, and ``__llm_kept`` (the text left), ``__llm_lines``, ``__llm_chunks``, ``__llm_gone_lines``,
    ``__llm_gone_chunks`` (counts over non-blank lines)."""
    gone = repeated_chunks(docs, divisor, pairs, id_col, text_col)
    span = F.struct("first", "last", "origin.unknown", "origin.doc_id", F.col("origin.text_hash").alias("other_hash"), "origin.size")
    gone = gone.groupBy(F.col("doc_id").alias("__llm_k1"), F.col("text_hash").alias("__llm_k2")).agg(F.collect_list(span).alias("__llm_gone"))
    rows = docs.withColumn("__llm_text", F.col(text_col).cast("string")).withColumn("__llm_hash", F.xxhash64(text_col))
    rows = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__llm_k1")) & (F.col("__llm_hash") == F.col("__llm_k2")), "left")
    rows = rows.withColumn("__llm_gone", F.coalesce("__llm_gone", F.array().cast(gone.schema["__llm_gone"].dataType)))
    schema = T.StructType([docs.schema[c] for c in carried]).add("__llm_kept", T.StringType())
    for name in ("__llm_lines", "__llm_chunks", "__llm_gone_lines", "__llm_gone_chunks"):
        schema = schema.add(name, T.LongType())
    return rows.select(*carried, "__llm_text", "__llm_gone").mapInArrow(_applied(divisor, pairs, carried, near_copies), schema)


def with_unique_chunks(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", near_copies: float | None = NEAR_COPIES) -> DataFrame:
    """The rows of ``docs`` with repeated chunks cut out of their texts, and their lengths set anew where they have that column.

    A text of which nothing but white space is left was only repeats: its row goes. Rows without any text before stay, and near copies stay
    whole (``None`` cuts them too).
    """
    out = without_repeated_chunks(docs, docs.columns, text_col=text_col, near_copies=near_copies)
    out = out.where((F.col("__llm_gone_lines") == 0) | F.col("__llm_kept").rlike(r"\S")).withColumn(text_col, F.when(F.col("__llm_gone_lines") > 0, F.col("__llm_kept")).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("__llm_gone_lines") > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
