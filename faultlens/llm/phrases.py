"""Phrase collocations by partitioned mining: what is frequent anywhere is frequent in some shard.

The files of a table are dealt to a few shards by a hash of their names. A shard's support is the support times
the shard's share of a language's words, rounded up; a phrase that reaches the support over
all rows reaches a shard's own in at least one. Each shard is mined completely, level by
level (words, pairs, then three and four words): an aggregation of hashed counts that Spark
spreads over all machines, so that a shard may be of any size (rows of one file, or of none, are
one shard). A level looks only at phrases
whose shorter parts are frequent in some shard. The locally frequent hashes of all shards are
united in a bitmap of fixed size, whose false positives cost work and change no result. A last
pass counts, exactly and by their words, all phrases that the bitmaps let through.

Defined results: a null text is empty, a null language is ``und``, a null id changes nothing; an
empty table, or one without frequent phrases, gives no rows; rows that repeat count as often as
they stand there; texts of any length are read whole, in pieces of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, release, small_side
from .text_hash import CHUNK, mix, slices, word_hashes

SHARDS = 3
SUPPORT = 30
LONGEST = 4
TOP = 2000
#: Bits of a bitmap of locally frequent phrases, as a power of two: 8 MB, whatever the input.
BITS = 26
#: Bytes of texts that are counted together.
RUN = 8 * CHUNK
#: A phrase goes where a longer one has at least this percentage of its occurrences.
COVERED = 80
SCALE = 2_000_000
_FOLD = bytearray(range(256))
for _x in range(65, 91):
    _FOLD[_x] += 32
for _x in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_x] = 0xFF
_FOLD[9] = 32
FOLD = bytes(_FOLD)
#: Ends a piece: a byte that no UTF-8 text has.
STOP = b"\xff"


def numbered(text: bytes, limit: int = 2 * CHUNK) -> Iterator[tuple[np.ndarray, list[bytes], int]]:
    """Word numbers of ``text`` with -1 between pieces, the words, and how many numbers at the front were there before."""
    text, at, before = text.translate(FOLD), 0, []
    while at < len(text):
        end = len(text)
        if end - at > limit:
            cut = max(text.rfind(b" ", at, at + limit), text.rfind(STOP, at, at + limit))
            later = [x for x in (text.find(b" ", at + limit), text.find(STOP, at + limit)) if x >= 0]
            end = cut + 1 if cut >= 0 else min(later) + 1 if later else end
        part = b" ".join([*before, text[at:end].replace(STOP, b" \xff ")])
        found = pc.split_pattern(pa.array([part], pa.large_binary()), b" ").flatten().dictionary_encode()
        known, ids = found.dictionary, found.indices.to_numpy()
        # Two spaces have an empty text between them, which is no word.
        none, stop = (pc.index(known, pa.scalar(x, pa.large_binary())).as_py() for x in (b"", STOP))
        plain = np.ones(len(known), dtype=bool)
        plain[[i for i in (none, stop) if i >= 0]] = False
        ids = np.where(plain, np.cumsum(plain) - 1, -1)[ids if none < 0 else ids[ids != none]]
        words = _listed(known.filter(pa.array(plain)))
        yield ids, words, len(before)
        before = [words[i] if i >= 0 else STOP for i in ids[-(LONGEST - 1) :].tolist()]
        at = end


def _listed(words: pa.Array) -> list[bytes]:
    """Words, which hold no space, as a list: one text is made and split, which is faster than a value each."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", words.type))
    return joined[0].as_py().split(b" ") if len(words) else []


def hashed(words: list[bytes], lang: str) -> np.ndarray:
    """Hashes of words, all at once; long words go in by a hash of their own."""
    short = b" ".join([w if len(w) <= 64 else xxhash.xxh64_hexdigest(w).encode() for w in words])
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    return mix(word_hashes(pa.array([short], pa.large_binary()).view(pa.large_string()))[0] ^ salt) if words else np.zeros(1, dtype=np.uint64)


def grown(ids: np.ndarray, own: np.ndarray, maps: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: where phrases of k words begin, their hashes, and which of the places of k - 1 these were.

    Only phrases within a piece whose parts of k - 1 words are there, and that the bitmap of k words lets through, if there is one.
    """
    known = _has(maps[0], own) if maps else np.ones(len(own), dtype=bool)
    at = np.flatnonzero((ids >= 0) & known[ids])
    h = own[ids[at]]
    yield 1, at, h, at
    for k in range(2, longest + 1):
        here = np.zeros(len(ids) + 1, dtype=bool)
        here[at] = True
        kept = np.flatnonzero(here[at + 1])
        h = mix(h[kept] + own[ids[at[kept] + k - 1]], k)
        if k <= len(maps):
            through = _has(maps[k - 1], h)
            kept, h = kept[through], h[through]
        at = at[kept]
        yield k, at, h, kept


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(len(bitmap) * 64 - 1).bit_length())
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, bytes]]:
    """Texts of one shard and language joined, some megabytes at a time: shard, lang, need, text."""
    for batch in batches:
        for part in slices(batch, "text", RUN):
            texts: dict[tuple[int, str, int], list[bytes]] = {}
            columns = part.select(["shard", "lang", "need"]).to_pydict()
            for key, text in zip(zip(*columns.values(), strict=True), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                texts.setdefault(key, []).append(text)
            for (shard, lang, need), found in texts.items():
                yield shard, lang, need, b"\n".join(found)


def _local(levels: list[int], bitmaps):
    """Counts of hashed phrases of the given numbers of words within each shard; a slot is a shard and, in its low 32 bits, what it needs."""

    def run(batches):
        maps = [np.frombuffer(b, dtype=np.uint64) for b in bitmaps.value]
        for shard, lang, need, text in _runs(batches):
            for ids, words, fresh in numbered(text):
                found = [h[at + k > fresh] for k, at, h, _ in grown(ids, hashed(words, lang), maps, max(levels)) if k in levels]
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(np.full(len(h), (shard << 32) + need, dtype=np.int64)), "h": pa.array(h.view(np.int64)), "c": pa.array(c.astype(np.int64))})

    return run


def _words(batches):
    """Counts of hashed words in each shard and language."""
    for shard, lang, _, text in _runs(batches):
        for ids, words, fresh in numbered(text):
            c = np.bincount(ids[fresh:][ids[fresh:] >= 0], minlength=len(words))
            h = hashed(words, lang)[: len(words)][c > 0]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(len(h), shard, dtype=np.int32)), "lang": pa.array([lang] * len(h), pa.string()), "h": pa.array(h.view(np.int64)), "c": pa.array(c[c > 0].astype(np.int64)),
            })


def _exact(bitmaps):
    """Counts of the phrases that the bitmaps let through, by their words: numbers of words are exact within a run."""

    def run(batches):
        maps = [np.frombuffer(b, dtype=np.uint64) for b in bitmaps.value]
        for _, lang, _, text in _runs(batches):
            for ids, words, fresh in numbered(text):
                known, code = pa.array(words, pa.binary()).cast(pa.string()), ids
                for k, at, _, kept in grown(ids, hashed(words, lang), maps, LONGEST):
                    if k == 1:
                        code = ids[at]
                        c = np.bincount(code[at >= fresh], minlength=len(words))
                        phrases = known.filter(pa.array(c > 0))
                    else:
                        # Pairs of a shorter phrase's number and a word's, numbered anew.
                        _, first, code = np.unique(code[kept] * (len(words) + 1) + ids[at + k - 1], return_index=True, return_inverse=True)
                        c = np.bincount(code[at + k > fresh], minlength=len(first))
                        phrases = pc.binary_join_element_wise(*(pc.take(known, pa.array(ids[at[first[c > 0]] + i])) for i in range(k)), " ")
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": phrases, "c": pa.array(c[c > 0].astype(np.int64))})

    return run


def bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """A bitmap over the first ``bits`` bits of ``h``: at most 2**bits / 64 rows reach the driver."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63L AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.tobytes()


def frequent(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, bits: int = BITS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to LONGEST words with ``f >= support``, and (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    rows = rows.select("text", "lang", F.pmod(F.xxhash64(F.input_file_name()), F.lit(shards)).cast("int").alias("shard"))
    counted = rows.withColumn("need", F.lit(0).cast("long")).mapInArrow(_words, "shard int, lang string, h long, c long")
    words = Stored(counted.groupBy("shard", "lang", "h").agg(F.sum("c").alias("c")), "phrase-words")
    each = words.df.groupBy("shard", "lang").agg(F.sum("c").alias("own"))
    total = each.groupBy("lang").agg(F.sum("own").alias("n"))
    # support * own / n, rounded up, in whole numbers
    share = each.join(total, "lang").withColumn("x", F.lit(support).cast("decimal(10,0)") * F.col("own") + F.col("n") - 1)
    shares = Stored(share.select("shard", "lang", "n", F.expr("greatest(1L, x div n)").alias("need")), "phrase-shares")
    needs = small_side(shares.df.select("shard", "lang", "need"), 48)
    maps = [bitmap(words.df.join(needs, ["shard", "lang"]).where("c >= need").select("h"), bits)]
    words.drop()
    del counted
    known = rows.join(needs, ["shard", "lang"]).select("text", "lang", "shard", "need")
    for levels in ([2], [3, 4]):
        release(spark)  # a pass doesn't need what the one before it shuffled
        sent = spark.sparkContext.broadcast(maps)
        local = known.mapInArrow(_local(levels, sent), "slot long, h long, c long")
        often = local.groupBy("slot", "h").agg(F.sum("c").alias("c")).where("c >= (slot & 4294967295L)")
        maps = [*maps, bitmap(often.select("h"), bits)]
        del local, often
    release(spark)
    sent = spark.sparkContext.broadcast([*maps, maps[-1]])
    exact = known.mapInArrow(_exact(sent), "lang string, phrase string, c long")
    found = exact.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= support)
    found = Stored(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f"), "phrases")
    del exact
    release(spark)
    return found.df, shares.df.groupBy("lang").agg(F.max("n").alias("n"))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of each frequent phrase of two words and more, by its lowest-scoring cut."""
    phrases = found.where("k >= 2").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("first"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # Decimals are exact here: counts of up to 20 digits, times SCALE.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    each = both.withColumn("num", wide("a") * F.lit(SCALE)).withColumn("den", wide("l") + wide("r")).withColumn("score", F.expr("num div den"))
    best = each.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame, percent: int = COVERED) -> DataFrame:
    """Candidates (lang, phrase, k, a) without those that a longer one with ``percent`` of their occurrences contains."""
    longer = candidates.where("k >= 3").select("lang", "k", "a", F.split("phrase", " ").alias("w"))
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(F.col("w"), i, n)))), lambda s: s != "")
    top = longer.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(top, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * percent)).drop("most")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    found, totals = frequent(docs, support, shards, bits, text, lang)
    left = uncovered(scored(found)).join(small_side(totals, 48), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
