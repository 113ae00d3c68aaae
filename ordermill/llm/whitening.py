"""Whitening of embeddings from exact variances (polarisation).

The covariance of two dimensions follows from variances alone:
``2 cov(a, b) = var(a + b) - var(a) - var(b)``.  So the job aggregates squares of centred values for
every dimension and for the sum of every pair of dimensions, and nothing else:

1. Every vector becomes integers ``x = floor(scale * c)``; the fit list is each distinct integer
   vector once (a distinct over their bytes, combined before the shuffle, so copies cost nothing).
2. One pass sums the list: ``n`` and, per dimension, ``S``.
3. A second pass aggregates exact squares of centred values.  With ``m = floor(S / n)`` and
   ``r = S - n * m`` the centred value is ``(n * (x - m) - r) / n``; a task sums ``x - m`` and its
   squares, per dimension and per pair sum, in integers, and ``n`` and ``r`` enter exactly afterwards: the sum
   of ``(n * x - S) ** 2`` is ``n ** 2`` times the sum of squares less ``n * r ** 2``.
4. The differences of these sums, divided once as integers, fill the matrix for ``eigh`` on the driver
   (its size is the dimension, whatever the number of rows).
5. Every row is projected; a third pass over the list measures the covariance of the result.

Sums leave a task as limbs of ``LIMB`` bits, which Spark adds as decimals, so nothing is rounded at any
size; values too large for 64-bit arithmetic are summed as Python integers.

Defined results: null vectors and vectors with null or non-finite entries (or of 2**400 and more) are dropped; vectors of
different length are fitted apart, each length on its own list, and empty ones give no rows; a component
whose eigenvalue is not above rounding (``d * 2**-52`` of the greatest) cannot be scaled and is not
returned, so a list of one vector gives no rows; a null id is kept, repeated rows are returned each; a
deviation beyond 64 bits is a decimal here and null in the registered query; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

SCALE, COMPONENTS = 256, 4
HUGE = 2.0 ** 400  # an entry from here on counts as not finite: its square would not be
LIMB = 40          # bits of a limb
BLOCK = 1 << 18    # entries of the vectors handled at once


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, equal for equal rows: two or eight bytes an entry, or text."""
    if x.dtype != object and x.size and -(1 << 15) <= x.min() and x.max() < 1 << 15:
        return [b"2" + row.tobytes() for row in x.astype("<i2")]
    out = []
    for row in x:
        big = row.astype(object)
        low, high = min(big), max(big)
        if -(1 << 15) <= low and high < 1 << 15:
            out.append(b"2" + row.astype("<i2").tobytes())
        elif -(1 << 62) <= low and high < 1 << 62:
            out.append(b"8" + row.astype("<i8").tobytes())
        else:
            out.append(b"t" + b",".join(str(int(v)).encode() for v in big))
    return out


def _unpack(rows: list[bytes]) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """{(length, kind): (row numbers, matrix of integers)}."""
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        kind = row[:1].decode()
        groups[(row.count(b",") + 1 if kind == "t" else (len(row) - 1) // int(kind), kind)].append(k)
    out = {}
    for (d, kind), where in groups.items():
        if kind == "t":
            x = np.array([[int(v) for v in rows[k][1:].split(b",")] for k in where], dtype=object)
        else:
            x = np.frombuffer(b"".join(rows[k][1:] for k in where), f"<i{kind}").reshape(-1, d).astype(np.int64)
        out[d, kind] = (np.array(where), x)
    return out


def _blocks(batch: pa.RecordBatch, column: int):
    """(rows of the batch, length, matrix) of bounded size, over the bytes in a column."""
    step = max(1, 8 * BLOCK * batch.num_rows // max(1, batch.column(column).nbytes))
    for lo in range(0, batch.num_rows, step):
        for (d, _), (where, x) in _unpack(batch.column(column).slice(lo, step).to_pylist()).items():
            yield lo + where, d, x


def integer_vectors(table: DataFrame, *, scale: int = SCALE, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """vec_id and ``x``, the bytes of the integer vector, of all rows with a finite vector."""

    def work(batches):
        for batch in batches:
            step = max(1, BLOCK * batch.num_rows // max(1, len(batch.column(1).flatten())))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids, vectors = part.column(0), part.column(1)
                sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = vectors.flatten()
                gap = flat.is_null().to_numpy(zero_copy_only=False)
                values = flat.fill_null(0).to_numpy(zero_copy_only=False)
                good = ~gap & (np.abs(values) < HUGE)  # false for NaN too
                ends = np.cumsum(sizes)
                bad = np.concatenate([[0], np.cumsum(~good)])
                fine = (sizes > 0) & (bad[ends] == bad[ends - sizes])
                for d in np.unique(sizes[fine]):
                    rows = np.flatnonzero(fine & (sizes == d))
                    y = np.floor(scale * values[(ends - sizes)[rows][:, None] + np.arange(d)])
                    if np.abs(y).max() < 2 ** 62:
                        x = y.astype(np.int64)
                    else:
                        x = np.array([[int(v) for v in row] for row in y], dtype=object)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array(_pack(x), pa.binary())], ["vec_id", "x"])

    return table.select(F.col(id_col).cast("bigint").alias("vec_id"),
                        F.col(vector_col).cast("array<double>").alias("embedding")) \
                .where("embedding is not null").mapInArrow(work, "vec_id bigint, x binary")


def _limbs(d: int, sums) -> list[tuple[int, int, int, int]]:
    """(d, number of the sum, number of the limb, limb) of exact integers."""
    out, mask = [], (1 << LIMB) - 1
    for k, value in enumerate(sums):
        limb = 0
        while not -(1 << LIMB) < value < 1 << LIMB:
            out.append((d, k, limb, value & mask))
            value >>= LIMB
            limb += 1
        out.append((d, k, limb, value))
    return out


def _add_up(rows: DataFrame, sums_of) -> dict[int, list[int]]:
    """Exact sums over all rows: ``sums_of(d, matrix)`` gives a block's integers, in a fixed order."""

    def work(batches):
        total = {}
        for batch in batches:
            for _, d, x in _blocks(batch, 0):
                got = sums_of(d, x)
                total[d] = got if d not in total else [a + b for a, b in zip(total[d], got)]
        out = [r for d, sums in total.items() for r in _limbs(d, sums)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["d", "k", "limb", "value"])

    summed = rows.select("x").mapInArrow(work, "d bigint, k bigint, limb bigint, value bigint") \
                 .groupBy("d", "k", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = defaultdict(dict)
    for d, k, limb, value in summed.collect():  # a few numbers per pair of dimensions
        out[d][k] = out[d].get(k, 0) + (int(value) << LIMB * limb)
    return {d: [sums[k] for k in range(len(sums))] for d, sums in out.items()}


def _counts(d: int, x: np.ndarray) -> list[int]:
    if x.dtype != object and len(x) * max(int(np.abs(x).max()), 1) >= 1 << 62:
        x = x.astype(object)
    return [len(x), *(int(v) for v in x.sum(axis=0))]


def _squares(middle: dict[int, list[int]]):
    """Sums of ``y ** 2`` per dimension and of ``(y_i + y_j) ** 2`` per pair i < j, ``y = x - middle``."""

    def sums_of(d, x):
        y = x - np.array(middle[d], dtype=object if x.dtype == object or max(map(abs, middle[d])) >= 1 << 62 else np.int64)
        if y.dtype != object and 4 * len(y) * int(np.abs(y).max()) ** 2 >= 1 << 62:
            y = y.astype(object)
        y = np.ascontiguousarray(y.T)
        out = [int(v) for v in (y * y).sum(axis=1)]
        for i in range(d - 1):
            pair = y[i + 1:] + y[i]
            pair *= pair
            out += [int(v) for v in pair.sum(axis=1)]
        return out
    return sums_of


class Fit:
    """Count, sums, covariance, and the components of one length of vectors."""

    def __init__(self, n: int, sums: list[int], squares: list[int], components: int):
        d = len(sums)
        self.n, self.sums = n, sums
        rest = [s - n * (s // n) for s in sums]
        # n * n times the sums of squares of centred values; a pair's remainder is that of its sum
        var = [n * squares[i] - rest[i] ** 2 for i in range(d)]
        self.covariance = np.zeros((d, d))
        k = d
        for i in range(d):
            self.covariance[i, i] = var[i] / n ** 2
            for j in range(i + 1, d):
                both = n * squares[k] - (rest[i] + rest[j]) ** 2
                self.covariance[i, j] = self.covariance[j, i] = (both - var[i] - var[j]) / (2 * n ** 2)
                k += 1
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        usable = int((values > max(values[0], 0) * d * 2.0 ** -52).sum()) if values[0] > 0 else 0
        keep = min(components, usable)
        self.values, self.vectors = values[:keep], vectors[:, :keep]
        # one sign for all rows: the largest entry of a component is positive
        top = np.abs(self.vectors).argmax(axis=0)
        self.vectors = self.vectors * np.where(self.vectors[top, np.arange(keep)] < 0, -1.0, 1.0)
        self.explained = self.values / np.trace(self.covariance)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on the components, over the roots of their eigenvalues."""
        middle = [s // self.n for s in self.sums]
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, middle)])
        wide = x.dtype == object or max(map(abs, middle)) >= 1 << 62
        y = (x - np.array(middle, dtype=object if wide else np.int64)).astype(np.float64) - rest
        out = np.zeros((len(x), len(self.values)))
        for i in range(len(middle)):  # term by term: a row's result does not depend on its neighbours
            out += y[:, i:i + 1] * self.vectors[i]
        return out / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S) ** 2."""
        most = max(int(np.abs(x).max()) if x.dtype != object else max(abs(int(v)) for v in x.flat), *map(abs, self.sums))
        if x.dtype == object or len(self.sums) * (2 * self.n * max(most, 1)) ** 2 >= 1 << 62:
            y = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        else:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
        return [int(v) for v in (y * y).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Fit], dict[int, float]]:
    """Fits by length of vector, and the largest entry of (covariance of the whitened list - identity)."""
    distinct = stored(vectors.select("x").distinct())
    counts = _add_up(distinct, _counts)
    middle = {d: [s // c[0] for s in c[1:]] for d, c in counts.items()}
    squares = _add_up(distinct, _squares(middle))
    fits = {d: Fit(c[0], c[1:], squares[d], components) for d, c in counts.items()}

    def work(batches):
        total = {}
        for batch in batches:
            for _, d, x in _blocks(batch, 0):
                w = fits[d].whitened(x)
                total[d] = total.get(d, 0) + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        for d, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int64()), pa.array(sums)],
                ["d", "k", "value"])

    seen = defaultdict(dict)
    for d, k, value in distinct.mapInArrow(work, "d bigint, k bigint, value double").groupBy("d", "k") \
                               .agg(F.sum("value")).collect():
        seen[d][k] = value
    errors = {}
    for d, f in fits.items():
        c = len(f.values)
        sums = np.array([seen[d][k] for k in range(len(seen[d]))])
        mean = sums[:c] / f.n
        errors[d] = float(np.abs(sums[c:].reshape(c, c) / f.n - np.outer(mean, mean) - np.eye(c)).max()) if c else 0.0
    return fits, errors


def whiten(table: DataFrame, *, scale: int = SCALE, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """vec_id, dimension, n, deviation (decimal), whitened (array of double, by component),
    explained (the same for all rows of a length), identity_error, per row with a finite vector."""
    vectors = stored(integer_vectors(table, scale=scale, id_col=id_col, vector_col=vector_col))
    fits, errors = fit(vectors, components)

    def work(batches):
        for batch in batches:
            for where, d, x in _blocks(batch, 1):
                f = fits[d]
                w = f.whitened(x)
                m = len(where)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where)), pa.array([d] * m, pa.int64()), pa.array([f.n] * m, pa.int64()),
                     pa.array([str(v) for v in f.deviations(x)]), pa.array(list(w), pa.list_(pa.float64())),
                     pa.array([f.explained.tolist()] * m, pa.list_(pa.float64())), pa.array([errors[d]] * m)],
                    ["vec_id", "dimension", "n", "deviation", "whitened", "explained", "identity_error"])

    out = vectors.mapInArrow(work, "vec_id bigint, dimension bigint, n bigint, deviation string, "
                                   "whitened array<double>, explained array<double>, identity_error double")
    return out.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read_table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "of")
    return out.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n",
        F.expr("try_cast(deviation as bigint)").alias("deviation"), "of.whitened", "of.explained", "identity_error")
