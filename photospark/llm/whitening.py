"""Whitening of embeddings by their leading principal components.

The components come from a block Jacobi-Davidson iteration that never forms the
covariance: each product of the centred data with a block of vectors is one
Spark pass, whose partial sums are added up by a shuffle of ``length x block``
rows. A step takes Ritz pairs of the search space, solves the projected
correction equations of the open ones by a few MINRES steps in lockstep (one
pass for all of them), and extends the space by the corrections. Pairs whose
residual has reached double precision are locked and projected out of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.llm.scratch import keep

#: Components that are computed, and levels of one unit of a vector entry.
COMPONENTS = 4
LEVELS = 256
#: Vectors of a stored block; start and largest size of the search space; MINRES steps of a correction.
BLOCK = 4096
START = 8
SPACE = 24
INNER = 4
#: Residual at which a pair is locked, as a share of the largest eigenvalue.
TOLERANCE = 100 * np.finfo(float).eps
_STEPS = 200
#: Entries up to this size are summed in 64-bit integers, larger ones as integers of any size.
_PLAIN = 1 << 20
_LIMB = 30
_SPLIT = 40


class Fit(NamedTuple):
    """Exact moments of the distinct vectors of one length and their leading components."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def taken(vector: Column) -> Column:
    """Whether a vector takes part: not null, every entry there and finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _rows(vectors: DataFrame, levels: int) -> DataFrame:
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(levels))))
    return vectors.filter(taken(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), F.size("embedding").alias("dim"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors as blocks of integers as narrow as they allow; a batch can hold vectors of several lengths."""
    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            matrix = _matrix(batch.column(0).filter(pa.array(dims == dim)), dim)
            for at in range(0, len(matrix), BLOCK):
                part = matrix[at : at + BLOCK]
                kind = np.result_type(np.min_scalar_type(int(part.min())), np.min_scalar_type(int(part.max())), np.int8)
                kind = kind if kind.kind == "i" else np.dtype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], ["dim", "width", "block"])


def _stored(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            yield np.frombuffer(block.as_buffer(), f"<i{width}").reshape(-1, dim).astype(np.int64)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """(vectors, sum of each entry, sum of all squares) in exact integers."""
    def parts(batches):
        for x in _stored(batches, dim):
            wide = x if max(-int(x.min()), int(x.max())) <= _PLAIN else x.astype(object)
            totals = [int(s) for s in wide.sum(axis=0)] + [int((wide * wide).sum()), len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim + 2), pa.int32()), pa.array([Decimal(t >> _SPLIT) for t in totals], pa.decimal128(38, 0)),
                 pa.array([t & ((1 << _SPLIT) - 1) for t in totals], pa.int64())], ["pos", "high", "low"])

    rows = fit.mapInArrow(parts, "pos int, high decimal(38,0), low bigint").groupBy("pos").agg(
        F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    total = {r["pos"]: (int(r["high"]) << _SPLIT) + int(r["low"]) for r in rows}
    return total[dim + 1], [total[p] for p in range(dim)], total[dim]


def _added(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray], dim: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``partial`` over all blocks: summed in tasks, then by a shuffle of as many rows as the result has entries."""
    def parts(batches):
        total = np.zeros(shape)
        for x in _stored(batches, dim):
            total += partial(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["pos", "value"])

    rows = fit.mapInArrow(parts, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(shape)
    for r in rows:
        out.flat[r["pos"]] = r["value"]
    return out


def corrections(product: Callable, held: np.ndarray, theta: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(A - theta)(I - QQ') t = -r, all columns by MINRES in lockstep.

    ``held`` is Q: locked and current Ritz vectors. One product per step serves every column.
    """
    def project(m):
        return m - held @ (held.T @ m)

    def safe(x):
        return np.where(x > 0, x, 1.0)

    rest = project(-residuals)
    size = np.linalg.norm(rest, axis=0)
    before, now = np.zeros_like(rest), rest / safe(size)
    way_before, way = np.zeros_like(rest), np.zeros_like(rest)
    out = np.zeros_like(rest)
    cos_before, sin_before = np.ones_like(size), np.zeros_like(size)
    cos, sin, left, beta = np.ones_like(size), np.zeros_like(size), size, np.zeros_like(size)
    for _ in range(steps):
        image = project(product(now) - theta * now)
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * before
        after = np.linalg.norm(image, axis=0)
        turned = cos * alpha - cos_before * sin * beta
        pivot = safe(np.hypot(turned, after))
        step = (now - (sin * alpha + cos_before * cos * beta) * way - sin_before * beta * way_before) / pivot
        cos_before, sin_before = cos, sin
        cos, sin = turned / pivot, after / pivot
        out = out + cos * left * step
        left = -sin * left
        way_before, way = way, step
        before, now, beta = now, image / safe(after), after
    return project(out)


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors) of the symmetric operator behind ``product``, by block Jacobi-Davidson."""
    wanted = min(wanted, dim)
    space = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, min(START, dim))))[0]
    image = product(space)
    locked, values, top = np.zeros((dim, 0)), [], 0.0
    for _ in range(_STEPS):
        ritz = space.T @ image
        theta, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(top, float(np.abs(theta).max(initial=0.0)))
        m = min(wanted - len(values), space.shape[1])
        gaps = image[:, :m] - space[:, :m] * theta[:m]
        gaps -= locked @ (locked.T @ gaps)
        full = locked.shape[1] + space.shape[1] == dim
        good = (np.linalg.norm(gaps, axis=0) <= tolerance * top) | full
        # in order of size, so that what is locked is never smaller than what comes
        ready = m if good.all() else int(np.argmin(good))
        locked = np.hstack([locked, space[:, :ready]])
        values += theta[:ready].tolist()
        space, image = space[:, ready:], image[:, ready:]
        if len(values) == wanted:
            break
        theta, gaps, m = theta[ready:], gaps[:, ready:], m - ready
        asked = np.flatnonzero(~good[ready:])
        more = corrections(product, np.hstack([locked, space[:, :m]]), theta[asked], gaps[:, asked], INNER)
        if space.shape[1] + more.shape[1] > SPACE:
            space, image = space[:, :START], image[:, :START]
        for _ in range(2):
            held = np.hstack([locked, space])
            more = more - held @ (held.T @ more)
            more, size = np.linalg.qr(more)
            alive = np.abs(np.diag(size)) > 0
            more = more[:, alive]
        more = more[:, : dim - locked.shape[1] - space.shape[1]]
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} components reached double precision")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """Moments and leading components of the stored distinct vectors of length ``dim``."""
    n, sums, squares = _sums(blocks, dim)
    centre = np.array([float(Fraction(s, n)) for s in sums])
    passes = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(x):
            centred = x - centre
            return centred.T @ (centred @ block)

        return _added(blocks, partial, dim, block.shape) / n

    values, vectors = leading(product, dim, components)
    return Fit(n, sums, float(Fraction(n * squares - sum(s * s for s in sums), n * n)), values, vectors, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over entries of (n x - S)^2 per row, exact."""
    constant = sum(s * s for s in sums)
    if x.size and max(-int(x.min()), int(x.max())) > _PLAIN:
        wide = x.astype(object)
        squares, cross = (wide * wide).sum(axis=1), wide @ np.array(sums, object)
    else:
        # sums cut into limbs, so that every product fits 64 bits
        squares, cross = (x * x).sum(axis=1).astype(object), np.zeros(len(x), object)
        for limb in range(max(1, -(-max(map(int.bit_length, sums)) // _LIMB))):
            part = np.array([(abs(s) >> (_LIMB * limb) & ((1 << _LIMB) - 1)) * (1 if s >= 0 else -1) for s in sums], np.int64)
            cross = cross + ((x @ part).astype(object) << (_LIMB * limb))
    return [n * n * int(q) - 2 * n * int(c) + constant for q, c in zip(squares, cross, strict=True)]


SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, deviation_exact decimal(38,0), whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, levels: int = LEVELS) -> DataFrame:
    """Every vector on the leading unit components of the distinct quantised vectors, scaled to variance 1.

    ``vectors`` has ``vec_id`` and ``embedding`` (array of numbers); other
    columns are not looked at. Vectors that are null or hold a null or
    non-finite entry take no part; empty ones have no components. Entry c counts
    as floor(levels c). Each distinct vector counts once in the fit, every row
    is returned, repeated ids and null ids included. Vectors of another length
    are a table of their own, with their own n and components.

    Per row and component (at most ``components`` and the length): n, deviation
    (sum of (n x - S)^2; null beyond 64 bits, ``deviation_exact`` goes on to 38
    digits), whitened (null for a component without variance), explained (its
    share of the variance; null where there is none), identity_error (largest
    absolute entry of the covariance of ``whitened`` less the identity, over
    components with variance). An empty table gives no rows. The passes over the
    data run while the result is built.
    """
    rows = _rows(vectors, levels).filter("dim > 0")
    distinct = rows.groupBy("x").agg(F.first("dim").alias("dim"))
    blocks = keep(distinct.select("x", "dim").mapInArrow(_blocks, "dim int, width int, block binary"), "fit-list")
    dims = [r["dim"] for r in blocks.select("dim").distinct().collect()]
    out = None
    for dim in sorted(dims):
        part = _projected(rows.filter(F.col("dim") == dim), blocks.filter(F.col("dim") == dim), dim, components)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _projected(rows: DataFrame, blocks: DataFrame, dim: int, components: int) -> DataFrame:
    found = fit(blocks, dim, components)
    k = len(found.values)
    centre = np.array([float(Fraction(s, found.n)) for s in found.sums])
    varied = found.values > dim * np.finfo(float).eps * max(found.trace, 0.0)
    scaled = found.vectors / np.sqrt(np.where(varied, found.values, 1.0))

    def moments(x):
        w = np.hstack([(x - centre) @ scaled, np.ones((len(x), 1))])
        return w.T @ w

    total = _added(blocks, moments, dim, (k + 1, k + 1)) / found.n
    gap = total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)
    gap = np.abs(gap[np.ix_(varied, varied)])
    error = float(gap.max()) if gap.size else None
    explained = [float(v / found.trace) if found.trace > 0 else None for v in found.values]

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            whitened = (x - centre) @ scaled
            exact = deviations(x, found.n, found.sums)
            plain = [d if d < 1 << 63 else None for d in exact]
            exact = [Decimal(d) if d < 10 ** 38 else None for d in exact]
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, found.n)), pa.array(plain, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(whitened.ravel(), mask=~np.tile(varied, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, SCHEMA)
