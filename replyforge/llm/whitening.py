"""Whitening of embeddings along their leading principal components.

Vectors become integers x = floor(256 * c), so counts, sums and deviations are
exact.  The fit uses each distinct x once.  Every task centres its rows and
reduces them, block by block, to one triangular factor (QR); factors are
reduced again in a bounded number of tasks, and the last one, d x d numbers, is
solved on the driver (``bidiagonal``).  Memory is d x d and one block of rows
per task whatever the number of vectors; a vector that a third of all rows
share is one row of the fit, collapsed before the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from replyforge.llm.bidiagonal import leading
from replyforge.sources.stages import cut

COMPONENTS = 4
GRID = 256.0
BLOCK = 2048  # rows of one QR step
GATHER = 32  # tasks, and so factors, before the driver

_OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector is there, without null or non-finite entries."""

    def broken(c):
        value = c.cast("double")
        return c.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("v"))
    return given.where(F.col("v").isNotNull()).where(~F.exists("v", broken)).select(
        "vec_id", F.transform("v", lambda c: F.floor(F.lit(GRID) * c.cast("double"))).alias("x")
    )


def _blocks(batches, d: int, column: str = "x"):
    """int64 matrices of up to BLOCK rows."""
    for batch in batches:
        lists = batch.column(column)
        for at in range(0, len(lists), BLOCK):
            part = lists.slice(at, BLOCK)
            yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S) exactly: halves of 32 bits are summed apart, so no task overflows."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, d):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(d), pa.int32()), "n": [n] * d, "high": high, "low": low}
            )

    parts = fit.mapInArrow(run, "i int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), *wide).orderBy("i").collect()
    return (found[0].n if found else 0), [(int(r.high) << 32) + int(r.low) for r in found]


def _wrapped(numbers) -> np.ndarray:
    """Whole numbers modulo 2**64, as int64."""
    return np.array([x % (1 << 64) for x in numbers], dtype=np.uint64).view(np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int], wrapped: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact n * x - S where a long holds it."""
    rough = x.astype(float) * n - np.array(sums, dtype=float)
    with np.errstate(over="ignore"):
        exact = x * np.int64(n) - wrapped
    return np.where(np.abs(rough) < 2.0**62, exact.astype(float), rough) / n


def _factor(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if held is None else np.vstack([held, rows]), mode="r")


def triangular(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The d x d factor R of the centred rows: R'R is n times their covariance."""
    wrapped = _wrapped(sums)

    def record(r):
        return pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary()),
        })

    def reduce(batches):
        held = None
        for _, x in _blocks(batches, d):
            held = _factor(held, _centred(x, n, sums, wrapped))
        if held is not None:
            yield record(held)

    def gather(batches):
        held = None
        for batch in batches:
            for r in batch.column("r").to_pylist():
                held = _factor(held, np.frombuffer(r).reshape(-1, d))
        if held is not None:
            yield record(held)

    schema = "part int, r binary"
    parts = fit.mapInArrow(reduce, schema).repartition(GATHER, "part").mapInArrow(gather, schema)
    held = None
    for row in sorted(parts.collect()):  # GATHER rows at most; one order, one result
        held = _factor(held, np.frombuffer(row.r).reshape(-1, d))
    full = np.zeros((d, d))
    full[: len(held)] = held
    return full


def _identity_error(fit: DataFrame, whiten, d: int, k: int) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""

    def run(batches):
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, d):
            w = whiten(x)
            n += len(w)
            first += w.sum(axis=0)
            second += w.T @ w
        if n:
            sums = [float(n), *first, *second.ravel()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "s": sums})

    parts = fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    sums = np.array([r.s for r in parts.orderBy("i").collect()])
    mean = sums[1:1 + k] / sums[0]
    covariance = sums[1 + k:].reshape(k, k) / sums[0] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row along up to ``components`` components.

    (vec_id, component, n, deviation, whitened, explained, identity_error), one
    row per row and component.  Rows whose vector is NULL or holds NULL or
    non-finite entries are dropped, as are rows whose vector is not of the
    commonest length (of equally common ones the longest) or is empty; an empty
    table gives no rows.  Equal vectors count once in the fit; repeated rows and
    NULL ids are returned as often as they come.  A component without variance
    has NULL ``whitened``; without any, ``explained`` and ``identity_error`` are
    NULL.  A deviation beyond a long is NULL, and entries beyond a long are the
    nearest long.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, column), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().where("d > 0")
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], _OUT)
    d = common.d
    rows = rows.where(F.size("x") == d)
    fit = cut(rows.select("x").distinct(), "fit-list")
    n, sums = _sums(fit, d)
    wrapped = _wrapped(sums)
    r = triangular(fit, d, n, sums)
    values, directions = leading(r, components)
    total = float((r * r).sum())
    k = len(values)
    spread = values > 0
    scaled = directions[:, spread] / np.sqrt(values[spread] / n)

    def whiten_rows(x):
        return _centred(x, n, sums, wrapped) @ scaled

    error = _identity_error(fit, whiten_rows, d, int(spread.sum())) if spread.any() else None
    explained = [float(v) / total if total else None for v in values]

    def deviations(x):
        with np.errstate(over="ignore"):
            apart = x * np.int64(n) - wrapped
            exact = (apart * apart).sum(axis=1)
        rough = ((x.astype(float) * n - np.array(sums, dtype=float)) ** 2).sum(axis=1)
        found = exact.tolist()
        for at in np.flatnonzero(rough > 2.0**62).tolist():
            whole = sum((n * int(c) - s) ** 2 for c, s in zip(x[at].tolist(), sums))
            found[at] = whole if whole < 1 << 63 else None
        return found

    def run(batches):
        for batch in batches:
            for at, x in _blocks([batch], d):
                whitened = np.full((len(x), k), np.nan)
                whitened[:, spread] = whiten_rows(x)
                flat = whitened.ravel()
                rows = len(x)
                deviation = pa.array(deviations(x), pa.int64())
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").slice(at, rows).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    deviation.take(pa.array(each)),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ], names=[f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
