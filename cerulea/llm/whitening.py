"""Whitening of embeddings by exact second moments: digit-slice products.

Whole numbers are split into small signed limbs, so that float64 matrix products of limbs are exact; the products are put together as big integers, merged over all
tasks digit by digit, and only then turned into a covariance, which is decomposed into eigenvectors. Nothing is rounded before the division by n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, stored

SCALE = 256
COMPONENTS = 4
#: Bits of a limb and rows of a product: limbs are at most 2**19, so sums of 2**13 products stay below 2**52.
LIMB, ROWS = 20, 1 << 13
#: Bits and number of the digits in which sums are merged: products of two 64-bit numbers over 2**50 rows, and sums of 2**31 digits, fit.
DIGIT, DIGITS = 32, 6


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry c, as long; beyond its range the nearest long. Null vectors, and those with a null or non-finite entry, are dropped."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~bad)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(scale * c.cast("double"))).alias("x"))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of ``LIMB`` bits, lowest first, as doubles: x is the sum of limb k times 2**(LIMB * k)."""
    out, half, mask = [], 1 << (LIMB - 1), (1 << LIMB) - 1
    while x.any():
        low = ((x & mask) ^ half) - half
        out.append(low.astype(np.float64))
        x = (x >> LIMB) + (low < 0)
    return out


def moments(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``x`` and a column of ones, as Python integers."""
    d, total = x.shape[1] + 1, None
    for low in range(0, len(x), ROWS):
        part = limbs(np.column_stack([x[low : low + ROWS], np.ones(len(x[low : low + ROWS]), np.int64)]))
        for i, a in enumerate(part):
            for j, b in enumerate(part):
                product = (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
                total = product if total is None else total + product
    return np.zeros((d, d), object) if total is None else total


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length but 0, and their entries as a matrix."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(at)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


_DIGITS = [f"d{k}" for k in range(DIGITS)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of a task's vectors, of each length by itself, in digits."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in by_length(batch.column("x")):
            d, part = x.shape[1], moments(x)
            total[d] = total[d] + part if d in total else part
    for d, sums in total.items():
        i, j = np.triu_indices(d + 1)
        left, columns = sums[i, j], []
        for k in range(DIGITS):
            columns.append(left if k == DIGITS - 1 else left & ((1 << DIGIT) - 1))
            left = left >> DIGIT
        names = ["dim", "i", "j", *_DIGITS]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip([np.full(len(i), d), i, j, *columns], ["i4"] * 3 + ["i8"] * DIGITS, strict=True)], names=names)


def _decomposed(components: int):
    fields = [("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64()))]
    schema = pa.schema(fields)

    def model(sums: pa.Table) -> pa.Table:
        """n, the sums, and the first eigenvalues and unit eigenvectors of the covariance (n * G - S S') / n**2, of which only the quotient is rounded."""
        d = sums["dim"][0].as_py()
        g = np.zeros((d + 1, d + 1), object)
        i, j = sums["i"].to_numpy(), sums["j"].to_numpy()
        g[i, j] = g[j, i] = sum(sums[c].to_numpy().astype(object) * (1 << (DIGIT * k)) for k, c in enumerate(_DIGITS))
        n, s = g[d, d], g[d, :d]
        v = ((n * g[:d, :d] - np.outer(s, s)) / n**2).astype(np.float64)
        e, u = np.linalg.eigh(v)
        e, u, trace = e[::-1][:components], u[:, ::-1][:, :components], float(np.trace(v))
        e = np.where(e > d * np.finfo(float).eps * max(e[0], 0.0), e, 0.0)
        share = e / trace if trace > 0 else np.zeros(len(e))
        return pa.table([pa.array([x], t) for x, (_, t) in zip((d, n, [str(x) for x in s], e.tolist(), u.T.ravel().tolist(), share.tolist()), fields, strict=True)], schema=schema)

    return model


class Model:
    """What whitens the vectors of one length."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, explained: np.ndarray):
        self.n, self.sums, self.values, self.vectors, self.explained = n, sums, values, vectors, explained

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S as doubles, rounded once at most, and the exact sum of its squares for each row; None beyond the range of long."""
        most = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        exact = x.shape[1] * most * most < 1 << 63
        off = x * np.int64(self.n) - np.array(self.sums, np.int64) if exact else x.astype(object) * self.n - np.array(self.sums, object)
        squares = (off * off).sum(1).tolist()
        return off.astype(np.float64), [q if q < 1 << 63 else None for q in squares]

    def whitened(self, off: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (off / self.n) @ self.vectors.T / root


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the distinct vectors ``fit`` (x): what comes to the driver is a few eigenvectors for each length."""
    digits = fit.mapInArrow(_products, "dim int, i int, j int, " + ", ".join(f"{c} long" for c in _DIGITS))
    merged = digits.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in _DIGITS])
    rows = merged.groupBy("dim").applyInArrow(_decomposed(components), "dim int, n long, sums array<string>, values array<double>, vectors array<double>, explained array<double>")
    return {r.dim: Model(r.n, [int(s) for s in r.sums], np.array(r["values"]), np.array(r.vectors).reshape(-1, r.dim), np.array(r.explained)) for r in rows.collect()}


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length the largest absolute entry of the covariance, over ``fit``, of the whitened vectors minus the identity, of components that vary; centred sums, merged by Spark."""
    held = fit.sparkSession.sparkContext.broadcast(models)
    most = max((len(m.values) for m in models.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column("x")):
                m = held.value[x.shape[1]]
                w = np.full((len(rows), most), np.nan)
                w[:, : len(m.values)] = m.whitened(m.apart(x)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), *[pa.array(w[:, k], from_pandas=True) for k in range(most)]], names=["dim", *[f"w{k}" for k in range(most)]])

    if not most:
        return {}
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    seen = fit.mapInArrow(run, "dim int, " + ", ".join(f"w{k} double" for k in range(most))).groupBy("dim").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return {r.dim: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=None) for r in seen.collect()}


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of ``vectors`` (vec_id, embedding) and each of the first components.

    The model is fitted on the distinct vectors, once each, so copies weigh nothing, however many there are; all rows are whitened, repeated and null ids included.
    Vectors of different lengths are whitened by themselves; an empty vector has no components. A component without variance (up to rounding, one vector alone
    included) has null for whitened, and explains 0; identity_error is over the others, null if there are none. deviation is null beyond the range of long. No usable
    row gives no rows.
    """
    rows = stored(whole_numbers(vectors, scale), "whole-numbers")
    fit = stored(rows.select("x").distinct(), "distinct-vectors")
    models = fitted(fit, components)
    errors = identity_errors(fit, models)
    held = rows.sparkSession.sparkContext.broadcast((models, errors))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = held.value
        for batch in batches:
            for at, x in by_length(batch.column("x")):
                m = models[x.shape[1]]
                k, n = len(m.values), len(at)
                off, squares = m.apart(x)
                error = errors.get(x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)),
                        pa.array([q for q in squares for _ in range(k)], pa.int64()), pa.array(m.whitened(off).ravel(), from_pandas=True), pa.array(np.tile(m.explained, n)),
                        pa.array(np.full(n * k, np.nan if error is None else error), from_pandas=True),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_digit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
