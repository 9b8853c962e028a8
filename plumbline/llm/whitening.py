"""Embedding whitening by a polarisation covariance.

Entries become integers on a grid, so that every sum is exact. With n distinct
vectors of sums S, z = n * x - S is a centred vector, still of integers. The
exact squares of z are summed for each dimension, and those of z_d + z_e for
each pair of dimensions; half of what the pair's sum of squares has over those
of its two dimensions is the sum of z_d * z_e. These sums, over n ** 3, are the
covariance, rounded once; its eigenvectors whiten every row.

A task adds its rows to D * (D + 1) / 2 integers; sums leave it in limbs of 60
bits, which Spark adds as decimals, so nothing overflows at any size. The
driver sees those sums only, a number fixed by the dimension. Equal vectors
meet in a pre-aggregated distinct, so a vector that a third of all rows share
is one row a task there; everything else is row by row.

Defined cases: a vector that is null, is empty, or has a null or non-finite
entry is dropped, as is one with an entry beyond 2 ** 62 on the grid; where
lengths differ, the commonest length stays (of equals the longest), as others
have no place in its space; components without variance are left out, so fewer
than two distinct vectors give no rows; rows may repeat and ids may be null;
a deviation that no long can hold is null; other columns are not looked at.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import drop, staged, table

SCALE, COMPONENTS = 256, 4
#: Bits of a limb, and how many hold a sum.
LIMB, LIMBS = 60, 4
#: Largest grid value, and largest integer that int64 arithmetic is trusted with.
GRID_TOP, INT_TOP = 2.0**62, 1 << 62
#: Rows squared at once, and the bits of the two halves they are split into where squares are large.
ROWS, HALF = 1024, 26


@dataclasses.dataclass(frozen=True)
class Model:
    """n distinct vectors, their sums, and the components by falling eigenvalue (columns of ``vectors``)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def gridded(rows: DataFrame, vec_col: str, scale: int, *keep: str) -> DataFrame:
    """Rows whose vector is whole, with ``x``: its entries on the grid as longs."""
    entry = lambda c: F.floor(c.cast("double") * scale)
    # A comparison with a null or NaN entry, or an infinite one, is not true.
    whole = F.forall(rows[vec_col], lambda c: F.coalesce(F.abs(c.cast("double") * scale) < GRID_TOP, F.lit(False)))
    return rows.where(rows[vec_col].isNotNull() & (F.size(rows[vec_col]) > 0) & whole).select(*[rows[c].alias("id") for c in keep], F.transform(rows[vec_col], lambda c: entry(c).cast("long")).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.int64).reshape(batch.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: in int64 where it and sums of two fit, else in Python's integers."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if 2 * top < INT_TOP:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(s: np.ndarray) -> list[int]:
    """Exact sums of squares by column."""
    if s.dtype == object:
        return (s * s).sum(0).tolist()
    top = int(np.abs(s).max(initial=0))
    if top * top * len(s) < INT_TOP:
        return np.einsum("ij,ij->j", s, s).tolist()
    if top >= 1 << 2 * HALF or len(s) > ROWS:
        return square_sums(s.astype(object))
    high, low = s >> HALF, s & ((1 << HALF) - 1)
    parts = (np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
    return [(a << 2 * HALF) + (b << HALF + 1) + c for a, b, c in zip(*parts)]


def polarised(z: np.ndarray) -> list[int]:
    """Sums of squares of every dimension, then of z_d + z_e for every d < e, in order."""
    return square_sums(z) + [t for d in range(z.shape[1] - 1) for t in square_sums(z[:, d + 1 :] + z[:, d : d + 1])]


def exact_sums(rows: DataFrame, terms: Callable[[np.ndarray], list[int]], width: int) -> list[int]:
    """Totals over all rows of ``width`` exact integers that ``terms`` gives for the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch)
            for at in range(0, len(x), ROWS):
                more = terms(x[at : at + ROWS])
                total = more if total is None else [a + b for a, b in zip(total, more)]
        if total is not None:
            limbs = [[(t >> LIMB * k) & ((1 << LIMB) - 1) if k < LIMBS - 1 else t >> LIMB * k for t in total] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["place", *names])

    names = [f"limb{k}" for k in range(LIMBS)]
    parts = rows.mapInArrow(run, "place int, " + ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("place").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names]).collect()
    out = [0] * width
    for r in found:
        out[r.place] = sum(int(r[n]) << LIMB * k for k, n in enumerate(names))
    return out


def covariance(n: int, dims: int, squares: list[int]) -> tuple[np.ndarray, float]:
    """The covariance matrix and its trace, each entry rounded once from the exact sums."""
    cube, v, at = n**3, np.zeros((dims, dims)), dims
    for d in range(dims):
        v[d, d] = squares[d] / cube
        for e in range(d + 1, dims):
            v[d, e] = v[e, d] = (squares[at] - squares[d] - squares[e]) / (2 * cube)
            at += 1
    return v, sum(squares[:dims]) / cube


def fit(distinct: DataFrame, dims: int, components: int | None = None) -> Model:
    """Components of the distinct grid vectors in column ``x``."""
    n, *sums = exact_sums(distinct, lambda x: [len(x), *(x.sum(0).tolist() if np.abs(x).max() < INT_TOP // ROWS else x.astype(object).sum(0).tolist())], 1 + dims)
    sums = tuple(sums)
    if n < 2:
        return Model(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)))
    squares = exact_sums(distinct, lambda x: polarised(centred(x, n, sums)), dims * (dims + 1) // 2)
    v, trace = covariance(n, dims, squares)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = int((values > trace * dims * np.finfo(float).eps).sum())
    values, vectors = values[: min(there, components or dims)], vectors[:, : min(there, components or dims)]
    if len(values):  # either sign would do: the largest entry is positive
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])
    return Model(n, sums, trace, values, vectors)


def projected(z: np.ndarray, model: Model) -> np.ndarray:
    return (z.astype(np.float64) / model.n) @ model.vectors / np.sqrt(model.values)


def identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + size, size))
        for batch in batches:
            w = projected(centred(matrix(batch), model.n, model.sums), model)
            total[0] += w.sum(0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "total"])

    total = np.zeros((1 + size) * size)
    for r in distinct.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        total[r.place] = r.total
    mean, products = total[:size] / model.n, total[size:].reshape(size, size) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def whitened(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """A row per row of ``rows`` (id, x) and component of the model."""
    kind = rows.schema["id"].dataType
    size, share = len(model.values), model.values / model.trace if len(model.values) else model.values
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            z = centred(matrix(batch), model.n, model.sums)
            far = [t if t < 1 << 63 else None for t in square_sums(z.T)]
            columns = [
                batch.column("id").take(pa.array(np.repeat(np.arange(m), size))),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                pa.array(np.full(m * size, model.n, np.int64)),
                pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), size))),
                pa.array(projected(z, model).ravel()),
                pa.array(np.tile(share, m)),
                pa.array(np.full(m * size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = [kind, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    return rows.where(F.lit(size > 0)).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Each whole vector's leading whitened components: id, component, n, deviation, whitened, explained, identity_error."""
    grid = gridded(rows, vec_col, scale, id_col)
    lengths = grid.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return whitened(grid, Model(0, (), 0.0, np.zeros(0), np.zeros((0, 0))), 0.0).withColumnRenamed("id", id_col)
    grid = grid.where(F.size("x") == lengths.dims)
    distinct = staged(grid.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, lengths.dims, components)
    error = identity_error(distinct, model)
    drop(distinct)
    return whitened(grid, model, error).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
