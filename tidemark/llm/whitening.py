"""PCA whitening of vectors, fitted in one pass by merging partial covariances.

Each partition computes count, local mean and centred scatter of its vectors; two such states merge by the pairwise
formula of Chan, Golub and LeVeque (1979): the scatter of both is the sum of theirs and the outer product of
the difference of the means, times n_a n_b / n. Merging runs as a treeReduce, so the driver gets one state of
d + d*d numbers, decomposes it, and sends out d times ``components`` numbers. A second pass whitens every vector and merges the
covariance of the results the same way, which says how far it is from the identity.

Vectors of whole numbers are summed exactly (sums as Python integers, differences of means as exact quotients, centring
about a vector of the partition), so a large common offset costs no digits; the deviations from a mean are rounded once.

A vector is used if it isn't null and all entries are finite (:func:`usable`; entries beyond 2**53 after scaling are the
caller's to leave out). Repeated vectors count as often as they occur. Vectors of another length than
most have (of equally many, the shorter) can't be projected: ``transform`` gives them a null, ``fit`` leaves them out. No
vectors: a model without components, and no rows. Components without variance (fewer distinct vectors than
dimensions) are null in every result, with 0 explained, and are left out of the identity error; so are all of a single vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass
class State:
    """Count, sums or mean, and centred scatter of vectors of one length. ``sums`` (exact) only of whole numbers."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: State) -> State:
        n = self.n + other.n
        if self.sums is not None and other.sums is not None:
            sums = [a + b for a, b in zip(self.sums, other.sums)]
            delta = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
            mean = np.array([s / n for s in sums])
        else:
            sums, delta = None, other.mean - self.mean
            mean = self.mean + delta * (other.n / n)
        return State(n, sums, mean, self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n)))


def state_of(rows: np.ndarray) -> State:
    """The state of the rows of a matrix, whole numbers or doubles."""
    shift = rows[0]
    off = (rows - shift).astype(np.float64)  # exact for whole numbers
    if rows.dtype.kind == "i":
        total = (rows - shift).sum(0)
        sums = [int(t) + len(rows) * int(s) for t, s in zip(total, shift)]
        inner, mean = np.array([int(t) / len(rows) for t in total]), np.array([s / len(rows) for s in sums])
    else:
        sums, inner = None, off.mean(0)
        mean = shift + inner
    off -= inner
    if sums is None:  # the mean of rounded numbers is rounded too: what is left of it goes into the mean
        rest = off.mean(0)
        off, mean = off - rest, mean + rest
    return State(len(rows), sums, mean, off.T @ off)


def matrices(column: pa.Array, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length; null lists and empty ones are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, values.astype(np.int64 if whole else np.float64).reshape(-1, d)


def _is_whole(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.elementType.typeName() in ("byte", "short", "integer", "long")


def merged(df: DataFrame, column: str) -> dict[int, State]:
    """States of the vectors in ``column`` by their length."""
    whole = _is_whole(df, column)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, State] = {}
        for batch in batches:
            for _, rows in matrices(batch.column(0), whole):
                own, d = state_of(rows), rows.shape[1]
                found[d] = found[d].merge(own) if d in found else own
        packed = [common.pack(mean=s.mean, scatter=s.scatter.ravel()) for s in found.values()]
        sums = [None if s.sums is None else [str(x) for x in s.sums] for s in found.values()]
        yield pa.record_batch([pa.array([s.n for s in found.values()], pa.int64()), pa.array(sums, pa.list_(pa.string())), pa.array(packed, pa.binary())], names=["n", "sums", "packed"])

    def unpacked(row) -> dict[int, State]:
        got = common.unpack(bytes(row.packed))
        d = len(got["mean"])
        return {d: State(row.n, None if row.sums is None else [int(x) for x in row.sums], got["mean"].copy(), got["scatter"].reshape(d, d).copy())}

    def both(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
        return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}

    states = df.select(F.col(f"`{column}`").alias("v")).mapInArrow(common.lean(partial), "n long, sums array<string>, packed binary").rdd.map(unpacked)
    if not states.getNumPartitions():
        return {}
    # a partition without vectors adds an empty state, so there is always something to reduce
    return states.mapPartitions(lambda rows: [_fold(both, rows)]).treeReduce(both)


def _fold(both, rows) -> dict[int, State]:
    out: dict[int, State] = {}
    for row in rows:
        out = both(out, row)
    return out


@dataclass
class Model:
    """n, sums (of whole numbers) and mean of the fitted vectors; eigenvalues, falling, and the directions to project
    on (rows, over the root of their eigenvalue; zero where there is no variance); share of variance explained."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    eigenvalues: np.ndarray
    directions: np.ndarray
    explained: list[float]
    identity_error: float | None = None


def decompose(state: State | None, components: int) -> Model:
    if state is None:
        return Model(0, None, np.zeros(0), np.zeros(0), np.zeros((0, 0)), [])
    covariance = state.scatter / state.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    trace = float(np.trace(covariance))
    floor = trace * len(values) * np.finfo(float).eps
    k = min(components, len(values))
    held = values[:k] > floor
    directions = np.where(held[:, None], vectors[:k] / np.sqrt(np.where(held, values[:k], 1))[:, None], 0.0)
    return Model(state.n, state.sums, state.mean, values[:k], directions, [float(v / trace) if h else 0.0 for v, h in zip(values, held)])


def project(model: Model, rows: np.ndarray) -> np.ndarray:
    """Whitened rows. Deviations of whole numbers are n*x - S, exact, over n."""
    if rows.dtype.kind == "i" and model.sums is not None:
        base = np.array([s // model.n for s in model.sums], np.int64)
        rest = np.array([float(Fraction(s, model.n) - int(b)) for s, b in zip(model.sums, base)])
        off = (rows - base).astype(np.float64) - rest
    else:
        off = rows - model.mean
    return off @ model.directions.T


def transform(df: DataFrame, model: Model, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """(id, whitened array<double>) and the columns in ``keep``; null where a vector is null or has another length."""
    whole, held, d = _is_whole(df, vector_col), np.any(model.directions != 0, axis=1), len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[float | None] | None] = [None] * batch.num_rows
            for at, rows in matrices(batch.column("v?"), whole):
                if rows.shape[1] == d:
                    for i, row in zip(at.tolist(), project(model, rows)):
                        out[i] = row.tolist() if held.all() else [x if h else None for x, h in zip(row.tolist(), held)]
            names = ["id", *keep]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "whitened"])

    kinds = [("id", df.schema[id_col].dataType.simpleString()), *((c, df.schema[c].dataType.simpleString()) for c in keep), ("whitened", "array<double>")]
    source = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{vector_col}`").alias("v?"))
    return source.mapInArrow(common.lean(run), ", ".join(f"`{n}` {kind}" for n, kind in kinds))


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 32) -> Model:
    """The whitening of the vectors in ``vector_col`` (all usable, see the module), by two passes over them."""
    states = merged(df, vector_col)
    model = decompose(max(states.values(), key=lambda s: (s.n, -len(s.mean)), default=None), components)
    if not model.n:
        return model
    held = np.flatnonzero(np.any(model.directions != 0, axis=1))
    white = transform(df.select(F.lit(0).alias("id"), F.col(f"`{vector_col}`").alias("v")), model, id_col="id", vector_col="v")
    inner = F.filter("whitened", lambda x: x.isNotNull())
    again = merged(white.select(inner.alias("w")).where(F.size("w") > 0), "w").get(len(held))
    model.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(held))).max()) if again else 0.0
    return model


def usable(vector_col: str) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite numbers."""
    fine = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine & (F.size(vector_col) > 0), F.lit(False))


def constants(values: Sequence[float] | None, kind: str) -> Column:
    """An array literal, as long as a vector."""
    return F.array(*[F.lit(v) for v in values or ()]).cast(f"array<{kind}>")
