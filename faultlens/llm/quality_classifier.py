"""Quality by compression: which of two dictionaries, of good and of bad text, helps more.

Two zstandard dictionaries are built from the whole texts of a bounded sample of labelled
rows. A text is cut into pieces of a fixed size, so that the dictionary and not the text's
own past decides, and each piece is compressed with either. The difference of the compressed
sizes over their sum, of the whole text and of its worst piece, goes through a logistic curve
that rises with both, fitted on another bounded sample of labelled rows.

Defined results: a null or empty text has no difference and gets the share of good texts in
the sample; with labels of one class only, or none, every score is that share (0.5 for none);
repeated rows get equal scores; of contradicting labels of an id the smaller counts, and of
labelled rows that repeat an id the smallest text; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_hash import slices

#: Labelled documents of each class that the dictionaries and, apart from these, the curve are fitted on.
DICTIONARY_DOCS = 1500
CURVE_DOCS = 2500
#: The dictionaries are made of texts of so many bytes each, and together for each class, at most; longer ones are left out whole.
DICTIONARY_TEXT, DICTIONARY_READ = 1 << 20, 64 << 20
PIECE = 512
DICTIONARY_BYTES = 110 << 10
LEVEL = 3


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.each = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def measure(self, raw: bytes) -> list[float]:
        """1, and the differences of the whole and of the worst piece; zeros for an empty text."""
        if not raw:
            return [0.0] * 3
        pieces = cut(raw)
        g, b = (np.array([len(c.compress(p)) for p in pieces], dtype=float) for c in self.each)
        return [1.0, float((b.sum() - g.sum()) / (b.sum() + g.sum())), float(((b - g) / (b + g)).min())]


def cut(raw: bytes) -> list[bytes]:
    """Pieces of PIECE bytes; a last one below a quarter of that stays with the one before."""
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    if len(pieces) > 1 and len(pieces[-1]) < PIECE // 4:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return pieces


#: Differences are small; the curve sees them so much larger.
SCALE = 20.0


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's steps; a difference of falling weight is left out."""
    use = [0, 1, 2]
    while True:
        z = x[:, use] * np.where(np.array(use) > 0, SCALE, 1.0)
        w = np.zeros(len(use))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w)), z.T @ (p - y) + 0.01 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        falling = [k for k, v in zip(use[1:], w[1:], strict=True) if v < 0]
        if not falling:
            out = np.zeros(3)
            out[use] = w
            return out
        use.remove(falling[-1])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text."""
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            pieces = cut((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array([y] * len(pieces), pa.int32())], ["piece", "y"])


def _measured(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_dictionaries = Compressors(good, bad)
        for batch in batches:
            x = [with_dictionaries.measure((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    return run


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\0" * 8


class Model:
    """good, bad: dictionaries; weights of the curve, or only the share of good texts."""

    def __init__(self, share: float, good: bytes = b"", bad: bytes = b"", weights: np.ndarray | None = None):
        self.share, self.good, self.bad, self.weights = share, good, bad, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x * np.array([1.0, SCALE, SCALE]) @ self.weights, -30, 30)))
        return np.where(x[:, 0] > 0, p, self.share)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, y (0 or 1), of the rows to learn from only."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(float(1 in n) if n else 0.5)
    draw = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = []
    for y in (0, 1):  # bounded by the two parameters
        chosen += one.where(F.col("y") == y).orderBy(draw, "doc_id").limit(DICTIONARY_DOCS + CURVE_DOCS).collect()
    cut = {y: min(DICTIONARY_DOCS, n[y] // 2) for y in n}
    seen = {0: 0, 1: 0}
    parts: dict[str, list] = {"dictionary": [], "curve": []}
    for r in chosen:
        parts["dictionary" if seen[r["y"]] < cut[r["y"]] else "curve"].append((r["doc_id"], r["y"]))
        seen[r["y"]] += 1
    spark = docs.sparkSession
    rows = [(d, y, part) for part, found in parts.items() for d, y in found]
    sample = spark.createDataFrame(rows, "doc_id long, y int, part string")
    # Rows that repeat an id would make the sample larger than its parameters say.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "part").agg(F.min("text").alias("text"))
    order = Window.partitionBy("y").orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # DICTIONARY_DOCS rows at most
    read = texts.where((F.col("part") == "dictionary") & (F.octet_length("text") <= DICTIONARY_TEXT)).withColumn("upto", F.sum(F.octet_length("text")).over(order))
    pieces = read.where(F.col("upto") <= DICTIONARY_READ).select("text", "y").mapInArrow(_pieces, "piece binary, y int").collect()
    good, bad = (_dictionary(sorted(bytes(r["piece"]) for r in pieces if r["y"] == y)) for y in (1, 0))
    curve = texts.where("part = 'curve'").select("text", "y").mapInArrow(_measured(good, bad), "x array<double>, y int").collect()
    share = n[1] / (n[0] + n[1])
    x, y = np.array([r["x"] for r in curve], dtype=float).reshape(-1, 3), np.array([r["y"] for r in curve], dtype=float)
    return Model(share, good, bad, fit_curve(x, y)) if 0 < y.sum() < len(y) else Model(share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    if model.weights is None:
        return docs.select("doc_id", F.lit(model.share).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = Compressors(model.good, model.bad)
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.array([each.measure((t or "").encode()) for t in batch.column("text").to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(model.scores(x), 6))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
