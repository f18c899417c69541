"""Exact top-k inner products: a ball tree for each shard, searched best bound first.

Vectors are dealt to shards by a hash of their id; each shard's task builds a ball tree and
searches it for a block of queries. A node's bound is q . centre + |q| * radius; nodes under
a query's k-th score so far are cut, the others visited by falling bound. All shards start
from the k-th score that the first shard gives, which is shared with them.

Components become floor(256 * x), so that scores are integers and exact: in doubles where
these suffice, else in whole numbers of any size. Defined results: vectors that are null,
empty or hold a null or non-finite component take no part, nor do rows with a null id;
vectors of another length than the query's are no candidates; ties go to the smaller id,
and rows that repeat an id are candidates each; an id is one query, that of the smallest of
its vectors, and none of its own rows is its candidate; a score beyond a long is ranked by its
value and given as the nearest long; fewer candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

SCALE = 256
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
LEAF = 128
#: beyond: empty, or of a score beyond a long its sign and a text that sorts as the score.
FOUND = "query_id long, vec_id long, score long, beyond string"


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dim, v: array<double> of the rows that take part, floor(256 * x) as far as doubles below 2**1015 go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(id_column).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False)))
    # From 2**45 on, a double's last place is worth more than 1/256: it is left as it is, and scaled by scaled().
    small = lambda c: F.abs(c) < 2.0**45
    v = F.transform(x, lambda c: F.when(small(c), F.floor(c * SCALE).cast("double") / SCALE).otherwise(c))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.size(vector).alias("dim"), v.alias("v"))


def scaled(values) -> list[int]:
    """The whole numbers of a vector of quantised()."""
    return [int(x) * SCALE if abs(x) >= 2.0**45 else int(x * SCALE) for x in values]


class BallTree:
    """Levels of nodes over points ordered so that each node is a run; leaves hold their points by id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        runs = [(0, len(ids))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parents = np.zeros(1, dtype=np.int64)
        while True:
            centres = np.stack([points[order[a:b]].mean(axis=0) for a, b in runs])
            radii = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(runs, centres, strict=True)])
            self.levels.append((centres, radii, parents))
            if max(b - a for a, b in runs) <= leaf:
                break
            split, parents = [], []
            for k, (a, b) in enumerate(runs):
                part = points[order[a:b]]
                axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
                m = (a + b) // 2
                split += [(a, m), (m, b)] if b - a > 1 else [(a, b)]
                parents += [k, k] if b - a > 1 else [k]
            runs, parents = split, np.array(parents)
        for a, b in runs:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.runs, self.ids, self.points = runs, ids[order], points[order]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores (n x k, id -1 where there is none), best first; ``floor``: a score that k candidates elsewhere reach."""
        n = len(qid)
        ids, scores = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)
        kth = floor.astype(float).copy()
        norm = np.sqrt((q * q).sum(axis=1))
        slack = 1e-9 * (1 + norm * np.sqrt((self.points**2).sum(axis=1).max(initial=0)))
        alive = np.ones((n, 1), dtype=bool)
        bound = np.zeros((n, 1))
        for centres, radii, parents in self.levels:
            bound = q @ centres.T + norm[:, None] * radii + slack[:, None]
            alive = alive[:, parents] & (bound >= kth[:, None])
        bound = np.where(alive, bound, -np.inf)
        turn = np.argsort(-bound, axis=1, kind="stable")
        for r in range(bound.shape[1]):
            best = bound[np.arange(n), turn[:, r]]
            active = np.flatnonzero((best > -np.inf) & (best >= kth))
            if not len(active):
                break
            for leaf in np.unique(turn[active, r]):
                rows = active[turn[active, r] == leaf]
                a, b = self.runs[leaf]
                got = q[rows] @ self.points[a:b].T
                got[qid[rows][:, None] == self.ids[a:b]] = -np.inf
                hit = got.max(axis=1) >= kth[rows]
                if not hit.any():
                    continue
                rows, got = rows[hit], got[hit]
                both = np.concatenate([scores[rows], got], axis=1)
                names = np.concatenate([ids[rows], np.broadcast_to(self.ids[a:b], got.shape)], axis=1)
                by = np.lexsort((names, -both), axis=1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(both, by, 1), np.take_along_axis(names, by, 1)
                kth[rows] = np.maximum(kth[rows], scores[rows][:, -1])
        return np.where(np.isinf(scores), -1, ids), scores


def _as_long(score: int) -> tuple[int, str]:
    """The nearest long, and ``beyond``."""
    if -(2**63) <= score < 2**63:
        return score, ""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    if score > 0:
        return 2**63 - 1, "+" + text
    return -(2**63), "-" + text.translate(str.maketrans("0123456789", "9876543210"))


def _search_pair(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64").assign(beyond="")
        if not len(queries) or not len(shard):
            return none
        q, v = (np.array(x["v"].tolist(), dtype=np.float64) * SCALE for x in (queries, shard))
        qid, ids = queries["vec_id"].to_numpy(np.int64), shard["vec_id"].to_numpy(np.int64)
        floor = queries["floor"].fillna(-np.inf).to_numpy(float)
        if not max(np.abs(q).max(), 1) * max(np.abs(v).max(), 1) * q.shape[1] < 2**53:  # beyond exact doubles: whole numbers, one by one
            out = []
            big = [scaled(row) for row in shard["v"]]
            for i, row in zip(qid, queries["v"], strict=True):
                own = scaled(row)
                ranked = sorted((-sum(a * b for a, b in zip(own, w, strict=True)), int(j)) for j, w in zip(ids, big, strict=True) if i != j)
                out += [(int(i), j, *_as_long(-s)) for s, j in ranked[:k]]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond"])
        found, scores = BallTree(ids, v).search(qid, q, k, floor)
        rows, cols = np.nonzero(found != -1)
        return pd.DataFrame({"query_id": qid[rows], "vec_id": found[rows, cols], "score": scores[rows, cols].astype(np.int64), "beyond": ""})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors, queries: as quantised() gives them -> query_id, rank, vec_id, score."""
    vectors = Stored(vectors, "vectors").df
    queries = Stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v"), "queries").df
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((vectors, shard_rows), (queries, block_rows)))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(blocks)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["dim", "shard", "block"]

    def search(shard_side: DataFrame, query_side: DataFrame) -> DataFrame:
        return query_side.groupBy(*key).cogroup(shard_side.withColumn("block", every(blocks)).groupBy(*key)).applyInPandas(_search_pair(k), FOUND)

    no_floor = asked.withColumn("floor", F.lit(None).cast("double"))
    seed = search(dealt.where("shard = 0"), no_floor.withColumn("shard", F.lit(0)))
    floor = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    asked = Stored(asked.join(floor, asked["vec_id"] == F.col("query_id"), "left").select("vec_id", "dim", "v", "block", "floor"), "asked").df
    found = search(dealt, asked.withColumn("shard", every(shards)))
    tier = F.when(F.startswith("beyond", F.lit("+")), 1).when(F.startswith("beyond", F.lit("-")), -1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(F.desc(tier), F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
