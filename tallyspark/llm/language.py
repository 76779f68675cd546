"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1; for each place of the code a binary classifier over hashed byte 1- to 3-grams predicts the bit.
Decoding compares the margins with all codewords by a loss in which each bit counts, for each language, as much as it was right about
that language in training. The nearest codeword wins; where the next one is almost as near, the text is flagged as ambiguous.

Training takes at most ``PER_LANGUAGE`` texts of a language and ``SAMPLE`` in all, those with the smallest hashes of their ids; their counts (``BUCKETS``
numbers a text) reach the driver. Prediction counts whole texts in one pass without a shuffle.

Results for odd rows: a null text, or one without a letter, is ``und`` with score 0; null languages and rows with a null id are not learnt from;
without any learnable row every text is ``und``; with one language every text with letters is that language; repeated rows get equal
results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .split import held_out, learnable
from .tokens import lower_table, odd_constants, slices, utf8

PER_LANGUAGE = 600
SAMPLE = 4_000
BUCKETS = 2_048
AMBIGUOUS_BELOW = 0.2
UNKNOWN = "und"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def gram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Per text the normalised logarithms of its hashed 1- to 3-gram counts; grams never cross texts."""
    n = len(offsets) - 1
    table = lower_table()
    other = np.ones(256, bool)
    other[np.frombuffer(_LETTERS.encode(), np.uint8)] = False
    other[128:] = False
    table[other[table]] = 32
    low = table[data].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    total = np.zeros(n * buckets)
    factors = odd_constants(3, 41)
    key = np.zeros(len(low), np.uint64)
    for size in range(1, 4):
        m = len(low) - size + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(257) + low[size - 1 :] + np.uint64(1)
        inside = doc[:m] == doc[size - 1 :]
        bucket = ((key * factors[size - 1]) >> np.uint64(40)).astype(np.int64) % buckets
        total += np.bincount(doc[:m][inside] * buckets + bucket[inside], minlength=n * buckets)
    x = np.log1p(total.reshape(n, buckets))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1: all different splits up to 5 classes, the best of several random codes beyond."""
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 5:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(classes - 1)] for c in range(2 ** (classes - 1) - 1)]
        return np.array(columns, float).T
    rng, best, apart = np.random.default_rng(classes), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, int(np.ceil(10 * np.log2(classes)))))
        near = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(classes) * code.shape[1]
        if near.min() > apart and (np.abs(code.sum(axis=0)) < classes).all():
            best, apart = code, near.min()
    return best if best is not None else np.where(np.eye(classes) > 0, 1.0, -1.0)


def _fit_bits(x: np.ndarray, bits: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic classifiers for all bits together, by Adam; classes weigh the same on both sides of a bit."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = (bits > 0).mean(axis=0).clip(1e-6, 1 - 1e-6)
    weight = np.where(bits > 0, 0.5 / share, 0.5 / (1 - share)) / len(x)
    w = np.zeros((x.shape[1], bits.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (-bits * weight / (1 + np.exp(np.clip(bits * (x @ w), -30, 30)))).astype(np.float32) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_codes(x: np.ndarray, languages: list[str]) -> dict:
    names = sorted(set(languages))
    label = np.searchsorted(np.array(names, object), np.array(languages, object))
    code = codewords(len(names))
    w = _fit_bits(x, code[label])
    right = (x @ w[:-1] + w[-1]) * code[label] > 0
    accuracy = np.stack([right[label == i].mean(axis=0) for i in range(len(names))]) + 1e-6
    return {"names": names, "code": code, "weights": w, "trust": accuracy / accuracy.sum(axis=1, keepdims=True)}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword, its share of the closeness to all codewords, and its lead over the next."""
    margin = x @ model["weights"][:-1] + model["weights"][-1]
    loss = np.logaddexp(0, -margin[:, None, :] * model["code"][None, :, :])
    near = -(loss * model["trust"][None, :, :]).sum(axis=2) * model["code"].shape[1]
    share = np.exp(near - near.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    best = np.argmax(share, axis=1)
    score = share[np.arange(len(best)), best]
    next_ = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
    return best, score, score - next_


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = gram_counts(*utf8(batch.column("text")), buckets)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(rows), pa.list_(pa.float32()))], names=["lang", "counts"])

    return run


def _predictions(model: dict, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                best, score, lead = [], [], []
                data, offsets = utf8(batch.column("text"))
                for a in range(0, batch.num_rows, 1024):
                    part = offsets[a : a + 1025]
                    b, s, gap = decode(gram_counts(data[part[0] : part[-1]], part - part[0], buckets), model)
                    best.append(b), score.append(s), lead.append(gap)
                names = np.array(model["names"], object)[np.concatenate(best)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("has_letter"), pa.array(names, pa.string()), pa.array(np.concatenate(score), pa.float64()), pa.array(np.concatenate(lead), pa.float64())],
                    names=["doc_id", "has_letter", "lang_pred", "score", "lead"],
                )

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, buckets: int = BUCKETS) -> dict | None:
    """The model from the learnable rows of ``docs(doc_id, text, lang)``, or None without any."""
    texts = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = texts.select("doc_id", "lang", "text_hash").distinct()  # rows that repeat are one
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(per_language, sample // languages))
    # only about 4 * each rows of a language pass the cut on the hash, so the ranking never gathers a large one; the counts have one row for each
    # language, and the model holds all of those anyway
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(counts), "lang").withColumn("drawn", drawn).where(F.col("drawn") * F.col("n") < 4 * each + 20).select("doc_id", "lang", "text_hash", "drawn")
    order = Window.partitionBy("lang").orderBy("drawn", "doc_id", "text_hash")
    ids = F.broadcast(few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("doc_id", "lang", "text_hash"))  # at most languages * each
    drawn_texts = texts.join(ids, ["doc_id", "lang", "text_hash"]).groupBy("doc_id", "lang", "text_hash").agg(F.first("text").alias("text"))
    found = drawn_texts.select("lang", "text").mapInArrow(_counted(buckets), "lang string, counts array<float>").toArrow()
    x = np.stack(found.column("counts").to_numpy()).astype(np.float32)
    lang = found.column("lang").to_pylist()
    order = sorted(range(len(lang)), key=lambda i: (lang[i], x[i, :64].tobytes()))  # rows arrive in any order
    return fit_codes(x[order], [lang[i] for i in order])


def identified(docs: DataFrame, buckets: int = BUCKETS, ambiguous_below: float = AMBIGUOUS_BELOW, **sample: int) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: ``doc_id, held_out, lang_pred, score, ambiguous``."""
    model = train(docs, buckets=buckets, **sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        found = rows.select("doc_id", F.lit(False).alias("has_letter"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lead"))
    else:
        found = rows.mapInArrow(_predictions(model, buckets), "doc_id long, has_letter boolean, lang_pred string, score double, lead double")
    known = F.col("has_letter")
    return found.select(
        "doc_id", held_out().alias("held_out"), F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"), (~known | (F.col("lead") < ambiguous_below)).alias("ambiguous"),
    )
