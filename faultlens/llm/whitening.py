"""Whitening by exact integer scatter sums from bit planes.

Components become whole numbers; each dimension, less its least value, is cut into bit planes
and every plane of 64 rows is packed into a word. The cross-product of two dimensions is then
the sum over pairs of planes of 2**(a + b) times the set bits of the planes' AND: whole
numbers all the way, added up by Spark in limbs that can't overflow. The sums are centred as
whole numbers (n * sum(xy) - sum(x) * sum(y)), divided once, and give the eigenvectors.
What reaches the driver is a number for each pair of dimensions, whatever the rows.

Defined results: vectors that are null or hold a null or non-finite component, or one so large
that 64 times it is no exact whole number (2**46 and more), take no part; each length of vector
has a fit of its own, and an empty vector has no components, so no rows; a null id is carried, and
rows that repeat are answered each, while the fit counts equal vectors once; where the fit list
has fewer directions than components, the rest have eigenvalue 0, ``whitened`` 0, and no part
in ``identity_error``, which is null where no component is left; equal eigenvalues may have any
basis of their space; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows whose planes are packed at once.
BLOCK = 4096
#: Bits of a limb: sums of limbs stay within a long for 2**37 rows and more.
LIMB = 20
#: An eigenvalue below this share of the largest one is taken for 0.
LEAST = 1e-12
LARGEST = 2.0**46


def whole_numbers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with dim and x: array<long>."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + OFFSET)
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn("x", x).withColumn("dim", F.size("x"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Runs of rows of one length as a matrix."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims[dims > 0]):
            rows = batch.filter(pa.array(dims == dim))
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                yield int(dim), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim), part


def _ranges(batches):
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
    for dim, x, _ in _rows(batches):
        low, high, n = x.min(axis=0), x.max(axis=0), len(x)
        if dim in found:
            low, high, n = np.minimum(low, found[dim][0]), np.maximum(high, found[dim][1]), n + found[dim][2]
        found[dim] = low, high, n
    for dim, (low, high, n) in found.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "i": pa.array(range(dim), pa.int32()), "low": low, "high": high, "n": pa.array([n] * dim, pa.int64())})


@dataclass
class Fit:
    """Of one length of vectors: least and largest values, sums, eigenvalues and components."""

    dim: int
    low: list[int]
    high: list[int]
    n: int
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    error: float | None = None

    @property
    def bits(self) -> int:
        return max(1, max(b - a for a, b in zip(self.low, self.high, strict=True)).bit_length())

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they suffice."""
        widest = max(max(abs(self.n * v - s) for v in (a, b)) for a, b, s in zip(self.low, self.high, self.sums, strict=True))
        if max(widest, self.n * max(map(abs, [*self.low, *self.high])), *map(abs, self.sums)) < 2**62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)
        return (self.centred(x) / self.n).astype(float) @ self.axes * scale


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """dim x bits x words: bit ``a`` of each dimension, 64 rows a word."""
    rows, dim = x.shape
    padded = np.zeros((-(-rows // 64) * 64, dim), dtype=np.uint64)
    padded[:rows] = x
    out = np.empty((dim, bits, len(padded) // 64), dtype=np.uint64)
    for a in range(bits):
        plane = ((padded >> np.uint64(a)) & np.uint64(1)).astype(np.uint8).T
        out[:, a] = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little")).view("<u8")
    return out


def scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """dim x dim x limbs: cross-products of the dimensions j >= i, as weighted set bits of ANDs of planes."""
    w = planes(x, bits)
    dim = len(w)
    out = np.zeros((dim, dim, _limbs(bits)), dtype=np.int64)
    for i in range(dim):
        weights = np.zeros((dim - i, 2 * bits - 1), dtype=np.int64)
        for a in range(bits):
            weights[:, a : a + bits] += np.bitwise_count(w[i, a] & w[i:]).sum(axis=2, dtype=np.int64)
        out[i, i:] = in_limbs(weights, _limbs(bits))
    return out


def in_limbs(weights: np.ndarray, limbs: int) -> np.ndarray:
    """Counts by weight 2**k, as limbs of LIMB bits (a limb may hold more than LIMB bits)."""
    padded = np.zeros((len(weights), limbs * LIMB), dtype=np.int64)
    padded[:, : weights.shape[1]] = weights
    return (padded.reshape(len(weights), limbs, LIMB) << np.arange(LIMB)).sum(axis=2)


def _limbs(bits: int) -> int:
    return -(-(2 * bits - 1) // LIMB)


def _scatter(fits: dict[int, tuple[np.ndarray, int]], limbs: int):
    """Per task and pair of dimensions: limbs of the cross-product, and of the sum where i = j."""

    def run(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, x, _ in _rows(batches):
            low, bits = fits[dim]
            y = x - low
            ones = np.stack([((y >> a) & 1).sum(axis=0) for a in range(bits)], axis=1)
            old = found.get(dim, (0, 0))
            found[dim] = old[0] + scatter(y, bits), old[1] + in_limbs(ones, _limbs(bits))
        for dim, (products, sums) in found.items():
            i, j = np.triu_indices(dim)
            columns = {"dim": np.full(len(i), dim, dtype=np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32)}
            for name, part in (("p", products[i, j]), ("s", np.where((i == j)[:, None], sums[i], 0))):
                for k in range(limbs):
                    columns[f"{name}{k}"] = part[:, k] if k < part.shape[1] else np.zeros(len(i), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return run


def _solve(one: Fit, i: list[int], j: list[int], products: list[int], sums: list[int], components: int) -> None:
    n, v = one.n, np.empty((one.dim, one.dim))
    shifted = {a: s for a, b, s in zip(i, j, sums, strict=True) if a == b}
    one.sums = [shifted[a] + n * low for a, low in enumerate(one.low)]
    for a, b, p in zip(i, j, products, strict=True):
        # A shift moves no covariance; whole numbers until the one division.
        v[a, b] = v[b, a] = (n * p - shifted[a] * shifted[b]) / (n * n)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    one.trace = float(np.trace(v))
    one.values = np.where(values > LEAST * max(values[0], 0), values, 0)
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    one.axes = axes * np.where(signs == 0, 1, signs)


def _check(fits: dict[int, Fit]):
    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, x, _ in _rows(batches):
            z = fits[dim].whitened(x)
            old = sums.get(dim, (0, 0))
            sums[dim] = old[0] + z.T @ z, old[1] + z.sum(axis=0)
        for dim, (zz, z) in sums.items():
            i, j = np.triu_indices(len(z))
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(i), dim, dtype=np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "zz": zz[i, j], "z": np.where(i == j, z[i], 0.0)})

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """rows: as whole_numbers() gives them -> the fit of each length of vector, over the distinct vectors."""
    listed = Stored(rows.select("dim", "x").where("dim > 0").distinct(), "fit-list")
    got = listed.df.mapInArrow(_ranges, "dim int, i int, low long, high long, n long").groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    fits: dict[int, Fit] = {}
    for r in got.orderBy("dim", "i").collect():  # a row for each dimension
        one = fits.setdefault(r["dim"], Fit(r["dim"], [], [], r["n"]))
        one.low.append(r["low"])
        one.high.append(r["high"])
    if not fits:
        listed.drop()
        return {}
    limbs = max(_limbs(f.bits) for f in fits.values())
    needs = {d: (np.array(f.low, dtype=np.int64), f.bits) for d, f in fits.items()}
    names = [f"{name}{k}" for name in "ps" for k in range(limbs)]
    parts = listed.df.mapInArrow(_scatter(needs, limbs), "dim int, i int, j int, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # a row for each pair of dimensions
    for d, one in fits.items():
        own = {c: v.tolist() for c, v in ((c, got.column(c).to_numpy()[got.column("dim").to_numpy() == d]) for c in ["i", "j", *names])}
        whole = {name: [sum(v << (LIMB * k) for k, v in enumerate(row)) for row in zip(*[own[f"{name}{k}"] for k in range(limbs)], strict=True)] for name in "ps"}
        _solve(one, own["i"], own["j"], whole["p"], whole["s"], components)
    seen = listed.df.mapInArrow(_check(fits), "dim int, i int, j int, zz double, z double").groupBy("dim", "i", "j").agg(F.sum("zz").alias("zz"), F.sum("z").alias("z")).collect()  # components squared
    for d, one in fits.items():
        k = len(one.values)
        zz, z = np.zeros((k, k)), np.zeros(k)
        for r in seen:
            if r["dim"] == d:
                zz[r["i"], r["j"]] = zz[r["j"], r["i"]] = r["zz"]
                if r["i"] == r["j"]:
                    z[r["i"]] = r["z"]
        live = one.values > 0
        off = (zz / one.n - np.outer(z, z) / one.n**2 - np.eye(k))[np.ix_(live, live)]
        one.error = float(np.abs(off).max()) if live.any() else None
    listed.drop()
    return fits


def _apply(fits: dict[int, Fit], keep: str):
    def run(batches):
        for dim, x, part in _rows(batches):
            one = fits[dim]
            d = one.centred(x)
            squares = dim * max(max(abs(one.n * v - s) for v in (a, b)) for a, b, s in zip(one.low, one.high, one.sums, strict=True)) ** 2
            deviation = (d * d).sum(axis=1) if d.dtype != object and squares < 2**62 else (d.astype(object) ** 2).sum(axis=1)
            white = one.whitened(x)
            k = white.shape[1]
            ends = np.arange(0, white.size + 1, k, dtype=np.int32)
            explained = np.tile(one.values / one.trace if one.trace else np.zeros(k), len(x))
            columns = [pa.array([one.n] * len(x), pa.int64()), pa.array([str(v) for v in deviation.tolist()], pa.string()), pa.ListArray.from_arrays(ends, white.ravel()), pa.ListArray.from_arrays(ends, explained), pa.array([one.error] * len(x), pa.float64())]
            yield pa.RecordBatch.from_arrays([part.column(keep), *columns], names=[keep, "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and component: id, component, n, deviation decimal(38,0) (null beyond 38 digits), whitened, explained, identity_error."""
    rows = whole_numbers(vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")), "v").select("id", "dim", "x")
    kind = rows.schema["id"].dataType.simpleString()
    each = rows.where("dim > 0").mapInArrow(_apply(fit(rows, components), "id"), f"id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")
    out = each.select("id", "n", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z"))
    return out.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), "n", "deviation", "z.whitened", "z.explained", "identity_error")
