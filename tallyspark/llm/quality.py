"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled texts are a sample of all documents. Nothing else is learnt from: labels
of bad documents are not used. The share of good texts among the unlabelled (the class prior) is estimated from the scores of a first
classifier, and a linear model over text statistics then minimises the non-negative unbiased risk

    prior * E_p[loss(+)]  +  max(0, E_u[loss(-)] - prior * E_p[loss(-)])

Both samples are bounded by documented parameters (``POSITIVES``, ``UNLABELLED`` rows, those with the smallest hash of the id); only their
statistics, 40 numbers a text, reach the driver. Every text is scored whole, in one pass without a shuffle.

Results for odd rows: null and empty texts are scored as texts without words; labels that are null, or of unknown documents, are
ignored; repeated rows get equal scores; a null id is scored, not held out, and not learnt from. Without any trusted positive nothing
speaks against a text and every score is 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split import held_out, learnable
from .tokens import slices, utf8, whitespace_words, words

POSITIVES = 6_000
UNLABELLED = 12_000
KEEP_AT = 0.7
# Words at which a text's own statistics and the mean count the same.
SHORT = 4

# Kinds of bytes that are counted, by their characters.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "|", "#", "$", "%", "&", "*", "<>", "{}[]()", "\"'", "/\\", ":;", "?=+~^_@`-"]


def _kinds() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    for i, chars in enumerate(KINDS):
        table[np.frombuffer(chars.encode(), np.uint8)] = i
    table[128:] = len(KINDS) + 1
    return table


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of shares and means for each text."""
    n, width = len(offsets) - 1, len(KINDS) + 2
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    shares = np.bincount(doc * width + _kinds()[data], minlength=n * width).reshape(n, width) / np.maximum(sizes, 1)[:, None]

    text, starts, lengths, hashed = words(data, offsets, whitespace_words())
    count = np.bincount(text, minlength=n)
    safe = np.maximum(count, 1)
    mean = np.bincount(text, weights=lengths, minlength=n) / safe
    spread = np.sqrt(np.maximum(np.bincount(text, weights=lengths.astype(float) ** 2, minlength=n) / safe - mean**2, 0))
    again = np.append(False, (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1]))[: len(text)]
    runs = np.bincount(text, weights=again, minlength=n) / safe
    order = np.lexsort((hashed, text))
    new = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
    distinct = np.bincount(text[order][new], minlength=n) / safe
    tally = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(n)
    if len(tally):
        np.maximum.at(top, text[order][new], tally)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    capital = np.bincount(text, weights=(first >= 65) & (first <= 90), minlength=n) / safe
    long_words = np.bincount(text, weights=lengths > 20, minlength=n) / safe

    newline = np.zeros(256, bool)
    newline[:] = True
    newline[10] = False
    line_of, _, line_size, line_hash = words(data, offsets, newline)
    lines = np.bincount(line_of, minlength=n)
    some = np.maximum(lines, 1)
    order = np.lexsort((line_hash, line_of))
    fresh = np.append(True, (line_hash[order][1:] != line_hash[order][:-1]) | (line_of[order][1:] != line_of[order][:-1]))[: len(order)]
    other = np.bincount(line_of[order][fresh], minlength=n) / some
    short = np.bincount(line_of, weights=line_size < 20, minlength=n) / some
    line_mean = np.bincount(line_of, weights=line_size, minlength=n) / some
    mixed = np.stack(
        [np.log1p(count), mean, spread, runs, distinct, np.log1p(count) * (1 - distinct), top / safe, capital, long_words, other, short, np.log1p(line_mean), np.log1p(lines), (count == 0).astype(float)], axis=1
    )
    return np.concatenate([shares, mixed], axis=1)


def _expanded(x: np.ndarray, model: dict) -> np.ndarray:
    """Standardised, clipped statistics with their absolute and squared deviations: both too much and too little can be bad.

    Shares over few words vary by themselves, so short texts are drawn towards the mean.
    """
    count = np.expm1(x[:, len(KINDS) + 2 : len(KINDS) + 3])
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) * (count / (count + SHORT))
    return np.concatenate([z, np.abs(z), z * z / 8, np.ones((len(z), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, width: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam from zero, with decaying steps."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of both on texts the scorer has not seen.

    Above any cut the unlabelled hold at least ``prior`` times the positives' share; the cut with the smallest upper bound is taken.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = (positive[None, :] >= cuts[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= cuts[:, None]).mean(axis=1)
    slack = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> dict:
    """The model: standardisation, weights and the estimated prior."""
    both = np.concatenate([positive, unlabelled])
    model = {"mean": positive.mean(axis=0), "scale": np.maximum(positive.std(axis=0), 0.05 * np.maximum(both.std(axis=0), 1e-3)) + 1e-6}
    p, u = _expanded(positive, model), _expanded(unlabelled, model)

    def contrast(p: np.ndarray, u: np.ndarray):
        return lambda w: (p.T @ (_sigmoid(p @ w) - 1)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + decay * w

    first = _descend(contrast(p[::2], u[::2]), p.shape[1], 300)
    prior = class_prior(p[1::2] @ first, u[1::2] @ first) if min(len(p), len(u)) > 3 else 0.5

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        rest = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        if negative < 0:  # the unbiased estimate has gone below what a risk can be: step back from it
            return -rest + decay * w
        return prior * (p.T @ (sp - 1)) / len(p) + rest + decay * w

    return model | {"prior": prior, "weights": _descend(risk, p.shape[1])}


def _sampled_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = statistics(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(list(rows), pa.list_(pa.float64()))], names=["positive", "statistics"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, or None without a trusted positive."""
    # what is drawn are different texts of different ids, so rows that repeat are one and the sample is as large as its parameters say
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    ids = rows.where(learnable()).select("doc_id", "text_hash").distinct()
    good = labels.where((F.col("quality") == 1) & learnable()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    p = ids.join(good, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(positives).withColumn("positive", F.lit(True))
    u = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_hash").limit(unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.unionByName(u))  # at most positives + unlabelled rows
    texts = rows.join(chosen, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "positive").agg(F.first("text").alias("text"))
    rows = texts.mapInArrow(_sampled_statistics, "positive boolean, statistics array<double>").toArrow()
    flag = np.asarray(rows.column("positive").to_pylist(), bool)
    x = np.array(rows.column("statistics").to_pylist(), float)
    if not flag.any() or flag.all():
        return None
    order = np.lexsort(x.T[::-1])  # rows arrive in any order; the model must not depend on it
    return fit_positive_unlabelled(x[order][flag[order]], x[order][~flag[order]])


def _scores(model: dict | None, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__llm_text"):
                if model is None:
                    score = np.ones(batch.num_rows)
                else:
                    score = _sigmoid(_expanded(statistics(*utf8(batch.column("__llm_text"))), model) @ model["weights"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(score, pa.float64())], names=[*carried, "__llm_score"])

    return run


def with_score(docs: DataFrame, model: dict | None, carried: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns of every row and its ``__llm_score``."""
    rows = docs.withColumn("__llm_text", F.col(text_col).cast("string"))
    return rows.select(*carried, "__llm_text").mapInArrow(_scores(model, carried), T.StructType([docs.schema[c] for c in carried]).add("__llm_score", T.DoubleType()))


def scored(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **sample: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels, **sample), ["doc_id"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("__llm_score").alias("score"), (F.col("__llm_score") >= keep_at).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **sample: int) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_at``; their columns stay as they are."""
    carried = docs.columns
    return with_score(docs, train(docs, labels, **sample), carried).where(F.col("__llm_score") >= keep_at).select(*carried)
