"""Benchmark decontamination: windows of normalised benchmark words are looked up in every document.

The benchmark's windows are a hash set that goes to every task. Its size is checked first: at most ``MAX_WINDOWS`` windows are sent at
once, and a larger benchmark is worked off in blocks of whole items, each block against all documents, with the same result. Every hash
hit is verified on the words themselves.

Results for odd rows: null and empty texts have no words and no hits; items without words have no windows; equal items all count; a
repeated document row gets the same result as its twin; rows with a null ``doc_id`` are treated like any other; an empty benchmark hits
nothing. Items with a null id hit words but cannot be listed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import pin
from .tokens import alphanumeric_words, lower_table, slices, utf8, window_hashes, words

WIDTH = 10
MAX_WINDOWS = 200_000
# Words as a pattern of the JVM: lower-case letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_RESULT = [
    ("__llm_n_words", T.LongType()), ("__llm_hit_words", T.ArrayType(T.IntegerType())), ("__llm_items", T.ArrayType(T.StringType())),
]


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words, size``: every run of ``width`` words of an item, or all its words where it has fewer."""
    w = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w")).select(
        "item_id", F.array_join("w", " ").alias("words"), F.size("w").alias("size")
    )


def hash_set(rows: list[tuple[str, str, int]]) -> tuple[dict[bytes, list[str]], dict[int, np.ndarray]]:
    """Of the windows of one block: the items of each text, and by size the sorted hashes."""
    items: dict[str, set[str]] = {}
    by_size: dict[int, set[str]] = {}
    for item, text, size in rows:
        held = items.setdefault(text, set())
        if item is not None:
            held.add(item)
        by_size.setdefault(size, set()).add(text)
    hashes = {}
    for size, texts in by_size.items():
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        found = [window_hashes(words(r, np.array([0, len(r)]), alphanumeric_words())[3], size)[0] for r in raw]
        hashes[size] = np.unique(np.array(found, np.uint64))
    return {t.encode(): sorted(i) for t, i in items.items()}, hashes


def _scan(windows, carried: list[str]):
    """Adds the results of one block to the carried columns; the texts are in ``__llm_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_items, by_size = windows.value
        member, low = alphanumeric_words(), lower_table()
        maybe = {}
        for size, hashes in by_size.items():
            maybe[size] = np.zeros(1 << 16, bool)
            maybe[size][hashes >> np.uint64(48)] = True
        for whole in batches:
            for batch in slices(whole, "__llm_text"):
                data, offsets = utf8(batch.column("__llm_text"))
                text, starts, lengths, hashed = words(data, offsets, member)
                first_word = np.searchsorted(text, np.arange(len(offsets)))
                items: list[set] = [set() for _ in range(batch.num_rows)]
                hit = np.zeros(len(text), bool)
                for size, hashes in by_size.items():
                    runs = window_hashes(hashed, size)
                    at = np.flatnonzero(maybe[size][runs >> np.uint64(48)])
                    place = np.minimum(np.searchsorted(hashes, runs[at]), len(hashes) - 1)
                    for i in at[(hashes[place] == runs[at]) & (text[at] == text[at + size - 1])].tolist():
                        run_words = b" ".join(low[data[starts[j] : starts[j] + lengths[j]]].tobytes() for j in range(i, i + size))
                        known = known_items.get(run_words)
                        if known is not None:
                            hit[i : i + size] = True
                            items[text[i]].update(known)
                hit_words = [np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(first_word[:-1], first_word[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in carried), pa.array(np.diff(first_word), pa.int64()),
                        pa.array(hit_words, pa.list_(pa.int32())), pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    ],
                    names=[*carried, *(name for name, _ in _RESULT)],
                )

    return run


def _blocks(benchmark: DataFrame, width: int, max_windows: int) -> Iterator:
    """Broadcasts of at most about ``max_windows`` windows each, which together hold all of them."""
    spark = benchmark.sparkSession
    found = benchmark_windows(benchmark, width).distinct()
    n = found.count()
    if n <= max_windows:
        yield spark.sparkContext.broadcast(hash_set([tuple(r) for r in found.limit(max_windows).collect()])), True
        return
    found = pin(found, "windows")
    blocks = -(-2 * n // max_windows)
    for b in range(blocks):
        part = found.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(hash_set([tuple(r) for r in part.collect()])), False


def _scanned(rows: DataFrame, windows, carried: list[str]) -> DataFrame:
    schema = T.StructType([rows.schema[c] for c in carried])
    for name, kind in _RESULT:
        schema = schema.add(name, kind)
    return rows.mapInArrow(_scan(windows, carried), schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, hit_words, items``: the places of hit words (from 0, ascending) and the ids of the items
    with a window in the text, sorted as strings."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__llm_text")).withColumn("text_hash", F.xxhash64("__llm_text"))
    names = [F.col(name).alias(name.removeprefix("__llm_")) for name, _ in _RESULT]
    found = []
    for windows, alone in _blocks(benchmark, width, max_windows):
        out = _scanned(rows, windows, ["doc_id", "text_hash"]).select("doc_id", "text_hash", *names)
        if alone:
            return out.drop("text_hash")
        found.append(out)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part.where(F.size("hit_words") > 0))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731 - of one document's own words
    merged = every.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), flat("hit_words"), flat("items"))
    keys = rows.select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"))
    return keys.join(merged, F.col("k1").eqNullSafe(F.col("doc_id")) & (F.col("k2") == F.col("text_hash"))).drop("k1", "k2", "text_hash")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; their columns stay as they are."""
    carried, kept = docs.columns, docs
    for windows, alone in _blocks(benchmark, width, max_windows):
        kept = _scanned(kept.withColumn("__llm_text", F.col(text_col).cast("string")), windows, carried)
        kept = kept.where(F.size("__llm_hit_words") == 0).select(*carried)
        if not alone:
            kept = pin(kept, "clean")
    return kept
