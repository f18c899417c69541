"""Conflict-constrained best-fit packing of documents into bins of tokens.

Documents are dealt to shards of bounded size by a hash of the row and, where rows repeat, of
their number among their equals; each shard packs its own bins, longest piece first. Open bins are ordered by what is left in them and carry two
bitmaps: of sources (one plane for each document that a source may have in a bin) and of
duplicate clusters. The search starts at the tightest bin that has room and goes on to its
successors until one is compatible; if none is, a new bin opens. Copies of a text follow each
other, so what one of them was refused isn't asked again for the next of the same source. A document longer than a
bin is cut into pieces, full bins first; nothing is dropped.

Defined results: a null or empty text has no tokens, one row and no bin; a null source is a
source of its own, a null id is carried; repeated rows are of one cluster and never share a
bin; pieces of equal length are placed by the smallest id of their cluster in the shard (null
last), then by cluster, source and id; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, ascii_lower, words_of

CAPACITY = 2048
PER_SOURCE = 4
#: Expected documents of a shard; also bounds the memory of a task.
SHARD_ROWS = 10_000
#: Equal rows that one task writes out again.
RUN = 10_000
PACKED = "doc_id long, piece int, tokens long, source string, cluster long, bin long, offset long"


class Bins:
    """Open bins of one shard, ordered by residual, then number."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def place(self, tokens: int, source: int, cluster: int, at: int | None = None) -> tuple[int, int, int]:
        """The bin, the offset within it, and where the search for an equal piece goes on.

        source, cluster: numbers of bits; cluster -1: alone in the shard. at: what stands before has refused such a piece.
        """
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(self.open, (tokens, -1)) if at is None else at
        while at < len(self.open):
            left, k = self.open[at]
            if not (self.sources[k][-1] & s or self.clusters[k] & c):
                del self.open[at]
                break
            at += 1
        else:
            left, k = self.capacity, len(self.sources)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        planes = self.sources[k]
        for i, plane in enumerate(planes):
            if not plane & s:
                planes[i] = plane | s
                break
        self.clusters[k] |= c
        if left > tokens:
            insort(self.open, (left - tokens, k))
            at += 1  # it stands before the next bin to ask: it has less room, or is the only one behind
        return k, self.capacity - left, at


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """rows: shard, doc_id (0 where none), no_id, tokens, source, cluster."""
    smallest = rows.assign(at=rows["doc_id"].astype("Int64").where(~rows["no_id"])).groupby("cluster")["at"].transform("min")
    order = rows.assign(no_least=smallest.isna(), least=smallest.fillna(0)).sort_values(
        ["tokens", "no_least", "least", "cluster", "source", "no_id", "doc_id"], ascending=[False, True, True, True, True, True, True], kind="stable"
    )
    ids = [None if no else int(d) for d, no in zip(order["doc_id"], order["no_id"], strict=True)]
    pieces = []
    for d, t, s, c in zip(ids, order["tokens"], order["source"], order["cluster"], strict=True):
        # Every piece of a row but the last fills a bin; only the last can share one.
        whole, rest = divmod(int(t), capacity)
        pieces += [(d, i, capacity, s, c) for i in range(whole)]
        if rest or not whole:
            pieces.append((d, whole, rest, s, c))
    pieces.sort(key=lambda p: -p[2])
    source = {s: i for i, s in enumerate(dict.fromkeys(p[3] for p in pieces))}
    met = rows["cluster"].value_counts()
    cluster = {c: i for i, c in enumerate(met.index[met > 1])}
    base = int(rows["shard"].iloc[0]) << 32
    bins, out, last, at = Bins(capacity, per_source), [], None, None
    for d, i, t, s, c in pieces:
        k = offset = None
        if t:
            # Of a cluster alone, or the full pieces of one row, nothing was refused before.
            again = at if (t, s, c) == last and c in cluster and t < capacity else None
            k, offset, at = bins.place(t, source[s], cluster.get(c, -1), again)
            last = (t, s, c)
        out.append((d, i, t, s, c, None if k is None else base + k, offset))
    names = ["doc_id", "piece", "tokens", "source", "cluster", "bin", "offset"]
    # Nullable integers from the start: large ids would not survive as doubles.
    return pd.DataFrame({n: pd.array(list(v), dtype=object if n == "source" else "Int64") for n, v in zip(names, zip(*out, strict=True), strict=True)})


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, tokens (words) and cluster: a hash of the small-lettered words."""
    w = words_of(F.col(text))
    rows = docs.select("doc_id", "source", w.alias("__w"), F.col(text).alias("__t"))
    words = F.array_join("__w", " ")
    return rows.select("doc_id", "source", F.size("__w").cast("long").alias("tokens"), F.xxhash64(ascii_lower(words)).alias("cluster"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, text: str = "text") -> DataFrame:
    """One row for each piece: PACKED."""
    rows = Stored(described(docs, text), "lengths").df
    shards = max(1, -(-rows.count() // shard_rows))
    # Equal rows are counted before they are dealt; each gets its number among them, so that neither a text nor a row makes a shard large.
    counted = rows.groupBy("doc_id", "source", "tokens", "cluster").agg(F.count("*").alias("copies"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    runs = counted.withColumn("run", F.explode(to(F.ceil(F.col("copies") / RUN).cast("int"))))
    many = runs.where(F.col("copies") > RUN).repartition("doc_id", "cluster", "run")
    each = runs.where(F.col("copies") <= RUN).unionByName(many)
    here = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run").cast("long") * RUN).cast("int")
    rows = each.withColumn("copy", F.explode(to(here)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "run", "copy"), F.lit(shards))).drop("copies", "run", "copy")
    dealt = dealt.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    run = lambda frame: pack_shard(frame, capacity, per_source)
    return dealt.groupBy("shard").applyInPandas(run, PACKED)
