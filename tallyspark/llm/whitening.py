"""Whitening of embeddings along their leading principal components, found by Chebyshev-filtered subspace iteration.

A vector's entries ``c`` become whole numbers ``x = floor(256 * c)``. The fit list is each distinct ``x`` vector once: ``n`` of them, sums
``S``. Its covariance ``V`` (divisor ``n``) is never built: a pass over the fit list gives ``V Q`` for a thin block ``Q``, each task centring its
vectors before it multiplies, and the tasks' blocks are summed by Spark. A cycle is

1. a Chebyshev recurrence of ``degree`` such passes, which damps the part of the spectrum below the block's smallest Ritz value and lets
   the part above grow as fast as a polynomial of that degree can;
2. QR of the filtered block and Rayleigh-Ritz (one more pass) for new Ritz pairs.

Cycles end when every wanted pair is certified: ``|V u - e u|`` at most ``TOLERANCE`` times the largest eigenvalue, or no longer falling at
rounding level. What does not get there in ``CYCLES`` cycles is an error, not a result. What the driver holds is of size dimensions x block.
Each pass reads the whole fit list, about 60 to 90 times where the spectrum is nearly flat; a wider ``block`` needs fewer passes.

Results for odd rows: rows whose vector is null, or holds null or non-finite entries, are dropped, as are those with an entry beyond 64 bits.
The dimension is the commonest length (the longer of equally common ones); vectors of other lengths are dropped. Repeated rows each get
their result and count once in the fit list. A null id stays null. Fewer than four dimensions give fewer components. A component without
variance (a single vector, fewer distinct vectors than components) has ``whitened`` null, ``explained`` 0, and no part in the error.
``deviation`` beyond 64 bits is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import pin

COMPONENTS = 4
SCALE = 256
BLOCK = 32
DEGREE = 12
CYCLES = 60
TOLERANCE = 2e-14

_OUT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
])


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the rows that stay."""
    scaled = F.transform(F.col(vector_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("y"))
    rows = rows.where(F.size("y") > 0).where(F.forall("y", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 63))))
    sizes = rows.groupBy(F.size("y").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("y") == (sizes["size"] if sizes else 0)).select("vec_id", F.transform("y", lambda c: F.floor(c)).alias("x"))


def _long_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension: the count and the exact sum, in a high and a low half so that no batch overflows."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _long_matrix(batch.column("x"))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """``n`` and ``S`` of the fit list, exact."""
    parts = fit.mapInArrow(_sums, "i int, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect())
    return (rows[0].n if rows else 0), [int(r.high) * (1 << 32) + int(r.low) for r in rows]


def _product(block, mean):
    """Per task the rows of ``sum of xc (xc Q)``, and in the last place of each the dimension's sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, m = block.value, mean.value
        total = np.zeros((len(m), q.shape[1] + 1))
        for batch in batches:
            x = _long_matrix(batch.column("x")) - m if batch.num_rows else np.zeros((0, len(m)))
            total[:, :-1] += x.T @ (x @ q)
            total[:, -1] += np.einsum("ij,ij->j", x, x)
        offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], names=["i", "v"])

    return run


def covariance_product(fit: DataFrame, n: int, mean: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """The function that takes ``Q`` to ``V Q`` and the trace of ``V`` by one pass over the fit list."""
    context = fit.sparkSession.sparkContext
    sent_mean = context.broadcast(mean)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        sent = context.broadcast(q)
        parts = fit.mapInArrow(_product(sent, sent_mean), "i int, v array<double>")
        rows = parts.groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(q.shape[1] + 1))).alias("v")).orderBy("i").collect()
        sent.unpersist()
        found = np.array([r.v for r in rows]) / n
        return found[:, :-1], float(found[:, -1].sum())

    return product


def filtered(product: Callable, q: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """``p(V) Q`` for the Chebyshev polynomial that is small on ``[0, cut]``, scaled to stay near 1 at ``top``."""
    half = cut / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    y = (product(q)[0] - half * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (tau - sigma)
        q, y = y, (product(y)[0] - half * y) * (2 * following / half) - q * (sigma * following)
        sigma = following
    return y


def leading_pairs(product: Callable, dimension: int, wanted: int, block: int = BLOCK, degree: int = DEGREE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, unit eigenvectors (columns) and the trace, certified by their residuals."""
    wanted = min(wanted, dimension)
    width = min(dimension, max(block, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))[0]
    best = np.inf
    for _ in range(CYCLES):
        vq, trace = product(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(wanted), q[:, :wanted], trace
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        if residual <= TOLERANCE or residual < 1e-12 and residual > best / 2:
            vectors = q[:, :wanted]
            return np.where(values[:wanted] > 1e-13 * top, values[:wanted], 0.0), vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)]), trace
        best = min(best, residual)
        cut = min(max(values[-1], 1e-9 * top), 0.999 * top)
        q = np.linalg.qr(filtered(product, q, degree, cut, top))[0]
    raise RuntimeError(f"eigenpairs not certified after {CYCLES} cycles: residual {residual:.1e}")


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact ``sum of (n * x - S)^2`` of each row; beyond 64 bits null."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums)
        return np.einsum("ij,ij->i", y, y).tolist()
    found = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def _projected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, values, vectors, explained, error = model.value
        k = len(values)
        live = values > 0
        per_unit = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _long_matrix(batch.column("x")), batch.num_rows
            each = pa.array(np.repeat(np.arange(rows), k))
            white = ((x - mean) @ np.where(live, per_unit, 0.0)).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    pa.array(_squares(x, n, sums), pa.int64()).take(each), pa.array(white, mask=np.tile(~live, rows)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                names=_OUT.names,
            )

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per remaining row and component ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col)
    fit = pin(rows.select("x").distinct(), "fit")
    n, sums = totals(fit)
    if not n:
        return spark.createDataFrame([], _OUT)
    mean = np.array([s / n for s in sums])
    product = covariance_product(fit, n, mean)
    values, found, trace = leading_pairs(product, len(sums), components, block, degree)
    live, error = values > 0, 0.0
    if live.any():
        unit = found[:, live] / np.sqrt(values[live])
        error = float(np.abs(unit.T @ product(unit)[0] - np.eye(live.sum())).max())
    model = spark.sparkContext.broadcast((n, sums, mean, values, found, values / trace if trace else values, error))
    return rows.mapInArrow(_projected(model), _OUT)
