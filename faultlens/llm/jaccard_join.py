"""N-gram Jaccard join with parity sketches.

A text's set of word shingles is split by hash into blocks, each block keeping the XOR of
its shingles' hashes. Within a size band two sets that link differ in at most ``d``
shingles, and every difference spoils at most one block, so of more than ``d`` blocks they
agree on all others: equal blocks are the candidates. Empty blocks say nothing and are no
keys. A second parity sketch, of two bits a shingle and more, gives, by its Hamming distance, a
lower bound of the symmetric difference that sorts candidates out before the sets decide.

There are a fifth more blocks than ``d`` asks for, so two sets that link share many keys,
at least ``T`` as each of them can tell by itself. So each may leave out its ``T - 1`` most
frequent keys (in one order for all), and they still meet on another: a passage that many
texts share costs nothing. Sets that can't tell so much (tiny ones) also take their smallest
shingles as keys, enough of them that two linked sets share some.

All work is on classes of equal sets, named by a 64-bit fingerprint that a second one
confirms; different sets of one name are named anew. Each bucket of a key is a star around
its smallest class. Star links are verified first. A bucket whose members then still belong
to different components has the pairs between components compared too, by sketches that
grow with the set within the join, so that only near ones leave it; no link between
components is lost.

Defined results: a null or empty text, or one without words, has no shingles and is linked
with nothing; a null id is carried, and is the component only where no other id is;
repeated rows are equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Stored, packed, release, small_side, unpacked
from .components import connected
from .text_hash import mix, shingle_sets, slices

WIDTH = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A sketch has BRIEF words at least, and 2 bits for each shingle; a brief sketch is folded to BRIEF words.
BITS_EACH, BRIEF = 2, 8
BAND = 1.5
#: Smallest keys of a class by which a pair that shares several keys is met but once.
HEAD = 8
#: Bytes of texts within which a class is taken once.
BATCH = 16 << 20
#: A key with this share of a batch's keys, and met twice there, may be common: such keys are counted by partial sums. Any other
#: key has a smaller share of all keys than this, too, so what a task must bring together of one key is a share that bounded.
HOT_SHARE = 1 / 16384
#: A class of so many rows gets its answer by a broadcast, if all such classes fit.
HOT_COPIES = 10_000


def furthest(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=512)
def edge(g: int) -> int:
    """The least size in band g."""
    return 1 if g == 0 else max(edge(g - 1) + 1, int(BAND**g))


@lru_cache(maxsize=512)
def group(g: int, percent: int) -> tuple[int, int, int]:
    """Of band g joined with the sets just above it: its largest size, their largest size, the number of blocks."""
    top = edge(g + 1) - 1
    largest = top * 100 // percent
    d = furthest(top + largest, percent)
    return top, largest, d + 1 + 2 + (d + 1) // 5


def keys_of(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """The join keys of a sorted set of shingle hashes, and how many of the most frequent it can leave out.

    The last two bits of a key tell its kind: band modulo 2, and blocks (0) or shingles (1).
    The second result has a number for each kind.
    """
    n, g, drop = len(s), 0, [0, 0, 0, 0]
    while edge(g + 1) <= n:
        g += 1
    out = []

    def add(keys: np.ndarray, own: int, shingles: int, spare: int) -> None:
        kind = own % 2 + 2 * shingles
        drop[kind] = spare
        out.append((keys & ~np.uint64(3)) | np.uint64(kind))

    for own in (g, g - 1):
        if own < 0:
            continue
        top, largest, blocks = group(own, percent)
        if n > largest:
            continue
        # The most that this set and another of the band that links with it can differ in.
        d = furthest(n + (min(largest, n * 100 // percent) if n <= top else top), percent)
        if not d:
            continue  # only equal sets link
        which = (mix(s, 1000 + own) % np.uint64(blocks)).astype(np.int64)
        sums = np.zeros(blocks, dtype=np.uint64)
        np.bitwise_xor.at(sums, which, s)
        full = np.bincount(which, minlength=blocks) > 0
        named = mix(sums, 2000 + own) + mix(np.arange(blocks, dtype=np.uint64), 3000 + own)
        # Two linked sets agree on blocks - d, of which no more are empty than either set has empty.
        shared = int(full.sum()) - d
        add(mix(named[full]), own, 0, max(shared - 1, 0))
        if shared < 1:
            # Linked sets share ceil(t n) shingles, so ``more`` + 1 of the first n - ceil(t n) + 1 + more in one order for all.
            more = 15 * edge(own) // 100
            add(mix(np.sort(mix(s, 4000))[: n + percent * -n // 100 + 1 + more], 5000 + own), own, 1, more)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64), drop


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a power of two of words, so that a larger one folds to a smaller one's size."""
    size = max(BRIEF, 1 << (BITS_EACH * len(s) // 64).bit_length())
    bits = (mix(s, 6000) & np.uint64(64 * size - 1)).astype(np.int64)
    words = np.zeros(size, dtype=np.uint64)
    np.bitwise_xor.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    return words


def folded_to(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def fingerprint(s: np.ndarray, bits: int = 64) -> tuple[np.uint64, np.uint64]:
    """The name of a set, of ``bits`` bits, and another fingerprint that confirms it; 0, 0 for an empty set."""
    if not len(s):
        return np.uint64(0), np.uint64(0)
    one = np.array([np.bitwise_xor.reduce(mix(s, 7000)), mix(s, 7001).sum(dtype=np.uint64)], dtype=np.uint64)
    name = mix(one[:1] * np.uint64(3) + mix(one[1:], len(s)))[0] >> np.uint64(64 - bits)
    return name, mix(mix(one[:1], 7002) + one[1:] * np.uint64(5), len(s))[0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list for each part; None: null."""
    missing = np.array([p is None for p in parts] + [False])
    sizes = [0 if p is None else len(p) for p in parts]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=missing if missing.any() else None)
    parts = [p for p in parts if p is not None]
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64), pa.int64()))


SIGNATURES = "doc_id long, rid long, mark int, n long, cls long, cls2 long, sketch array<long>, brief array<long>, leave array<long>, hot array<long>"


def _signatures(width: int, percent: int, bits: int):
    """Of each row its set's size and names; of each class in the batch once its sketches and how many keys it can leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH):
                names, out, all_keys, seen = [], ([], [], []), [], set()
                for part in slices(batch, "text"):
                    for s in shingle_sets(part.column("text"), width):
                        name = fingerprint(s, bits)
                        names.append((len(s), *name))
                        own: tuple = (None, None, None)
                        if len(s) and name not in seen:
                            seen.add(name)
                            keys, leave = keys_of(s, percent)
                            all_keys.append(keys)
                            sketch = sketch_of(s)
                            own = (sketch, folded_to(sketch, BRIEF), np.array(leave, dtype=np.uint64))
                        for column, v in zip(out, own, strict=True):
                            column.append(v)
                n, cls, cls2 = (np.array([x[k] for x in names], dtype=np.uint64).view(np.int64) for k in range(3))
                hot = [_common(all_keys)] + [None] * (len(names) - 1)
                columns = [batch.column("doc_id").cast(pa.int64()), batch.column("rid"), batch.column("mark"), pa.array(n), pa.array(cls), pa.array(cls2), *map(_lists, out), _lists(hot)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNATURES.split(", ")])

    return run


def _keys(width: int, percent: int, bits: int):
    """The keys of each class in the batch, once. They are made again from the texts: that takes less than keeping them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, "text", BATCH)):
            seen: set = set()
            for piece in slices(part, "text"):
                names, keys = [], []
                for s in shingle_sets(piece.column("text"), width):
                    name = fingerprint(s, bits)
                    if len(s) and name not in seen:
                        seen.add(name)
                        names.append(name)
                        keys.append(keys_of(s, percent)[0])
                both = np.array(names, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), _lists(keys)], ["cls", "cls2", "keys"])

    return run


def _common(keys: list[np.ndarray]) -> np.ndarray:
    """The keys that many classes of a batch have."""
    flat, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, dtype=np.uint64),) * 2
    return flat[count >= max(2, HOT_SHARE * count.sum())]


def _sets(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sets = list(shingle_sets(part.column("text"), width))
                names = np.array([fingerprint(s, bits) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "cls2", "items"])

    return run


def _decide(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _hamming(x: str, y: str):
    """Hamming distance of two parity sketches, the longer folded to the size of the shorter: a lower bound of the symmetric difference."""
    short = F.least(F.size(x), F.size(y))
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(v: str):
        at = lambda i: F.slice(v, i * short + 1, short)
        parts = F.sequence(F.lit(1), F.floor(F.size(v) / short).cast("int") - 1)
        return F.when(F.size(v) > short, F.aggregate(parts, at(F.lit(0)), lambda a, i: F.zip_with(a, at(i), xor))).otherwise(F.col(v))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0).cast("long"), lambda acc, v: acc + v)


@dataclass
class Texts:
    """docs: rid, text. classes: a row for each class, with the rid of one of its texts. renamed: names that different sets had."""

    docs: DataFrame
    classes: DataFrame
    renamed: DataFrame | None
    width: int
    percent: int
    bits: int

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` (cls, cls2, ...) with the names that tell all sets apart."""
        if self.renamed is None:
            return df
        hit = df.join(small_side(self.renamed.withColumn("hit", F.lit(True)), 32), "cls", "left")
        return hit.withColumn("cls", F.when(F.col("hit"), F.xxhash64("cls", "cls2")).otherwise(F.col("cls"))).drop("hit")


def verified(pairs: DataFrame, of: Texts, name: str) -> DataFrame:
    """Of the class pairs (a, b) those that link: first by sketch, then by the sets, read again from one text of each class."""
    percent = of.percent
    side = lambda c: of.classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    total, least, most = F.col("na") + F.col("nb"), F.least("na", "nb"), F.greatest("na", "nb")
    near = near.where((100 * least >= percent * most) & (_hamming("sa", "sb") * (100 + percent) <= (100 - percent) * total)).select("a", "b")
    near = Stored(near, f"{name}-near")
    involved = near.df.select(F.col("a").alias("cls")).union(near.df.select("b")).distinct()
    wanted = Stored(involved.join(of.classes.select("cls", "rid"), "cls"), f"{name}-wanted")
    rows = wanted.df.count()
    texts = of.docs.join(small_side(wanted.df.select("rid").distinct(), 16, rows), "rid", "left_semi").select("text")
    sets = of.named(texts.mapInArrow(_sets(of.width, of.bits), "cls long, cls2 long, items binary")).select("cls", "items")
    sets = sets.join(small_side(wanted.df.select("cls"), 16, rows), "cls", "left_semi").dropDuplicates(["cls"])
    sets = Stored(sets, f"{name}-sets")
    have = lambda c, v: sets.df.select(F.col("cls").alias(c), F.col("items").alias(v))
    found = near.df.join(have("a", "x"), "a").join(have("b", "y"), "b").mapInArrow(_decide(percent), "a long, b long")
    links = Stored(found, f"{name}-links")
    for s in (near, wanted, sets):
        s.drop()
    return links.df


def _shared_keys(of: Texts, hot: DataFrame) -> DataFrame:
    """(key, cls, freq) of the keys that several classes have. Common keys (``hot``) are counted by partial sums, the others where they meet."""
    made = of.named(of.docs.select("text").mapInArrow(_keys(of.width, of.percent, of.bits), "cls long, cls2 long, keys array<long>"))
    each = made.select("cls", F.explode("keys").alias("key"))
    n_hot = hot.count()
    own = Window.partitionBy("key")
    several = lambda df: df.where("low < high").select("key", "cls", "freq")
    cold = each if not n_hot else each.join(small_side(hot, 16, n_hot), "key", "left_anti")
    shared = several(cold.select("key", "cls", F.min("cls").over(own).alias("low"), F.max("cls").over(own).alias("high"), F.count("*").over(own).alias("freq")))
    if not n_hot:
        return shared
    common = Stored(each.join(small_side(hot, 16, n_hot), "key", "left_semi"), "common").df
    counted = Stored(common.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("freq")), "hot-counts").df
    return shared.union(several(common.join(small_side(counted, 48, n_hot), "key")))


def _needed_keys(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cls): each class without the most frequent keys that it can leave out, and each key of several classes."""
    kind = F.col("key").bitwiseAND(F.lit(3).cast("long")).cast("int")
    each = shared.distinct().join(classes.select("cls", "leave"), "cls").withColumn("kind", kind)
    order = Window.partitionBy("cls", "kind").orderBy(F.desc("freq"), "key")
    return each.withColumn("i", F.row_number().over(order)).where(F.col("i") > F.get("leave", F.col("kind"))).select("key", "cls")


def _stars(needed: DataFrame) -> DataFrame:
    """(key, cls, hub): every class of a bucket other than its smallest, with the smallest."""
    hubs = needed.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where("hub < last").select("key", "hub")
    return needed.join(hubs, "key").where("cls <> hub").select("key", "cls", "hub")


def _left_over(stars: DataFrame, pairs: DataFrame, first: DataFrame, of: Texts) -> DataFrame:
    """Pairs (a, b) of near classes of one bucket that the star links left in different components."""
    comp = lambda c, out: first.select(F.col("node").alias(c), F.col("component").alias(out))
    apart = pairs.join(comp("a", "ca"), "a", "left").join(comp("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    apart = Stored(apart.select(F.col("a").alias("cls"), F.col("b").alias("hub")), "apart")
    open_keys = stars.join(small_side(apart.df, 24), ["cls", "hub"], "left_semi").select("key").distinct()
    rows = stars.join(open_keys, "key", "left_semi")
    rows = rows.select("key", "cls").union(rows.select("key", "hub")).distinct()
    rows = rows.join(comp("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = Stored(rows, "open")
    # A row carries its class's size, sketch and smallest keys, so that the join itself sorts pairs out.
    heads = rows.df.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEAD).alias("head"))
    known = of.classes.select("cls", "n", "sketch", *[F.element_at("brief", i + 1).alias(f"s{i}") for i in range(BRIEF)])
    full = rows.df.join(heads, "cls").join(known, "cls")
    own, other = (full.select(*[F.col(c).alias(f"{c}_{side}") for c in full.columns]) for side in "xy")
    total, least, most = F.col("n_x") + F.col("n_y"), F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    hamming = F.lit(0)
    for i in range(BRIEF):
        hamming = hamming + F.bit_count(F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y")))
    below = lambda c: F.filter(c, lambda k: k < F.col("key_x"))
    may = lambda h: h * (100 + of.percent) <= (100 - of.percent) * total
    near = (100 * least >= of.percent * most) & may(hamming) & may(_hamming("sketch_x", "sketch_y"))
    # Where both heads show a smaller common key the pair is met there.
    first_meeting = ~F.arrays_overlap(below("head_x"), below("head_y"))
    met = own.join(other, (F.col("key_x") == F.col("key_y")) & (F.col("comp_x") < F.col("comp_y")) & near & first_meeting)
    return met.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()


def _classes(signed: DataFrame) -> DataFrame:
    own = [F.min(c).alias(c) for c in ("doc_id", "rid")] + [F.first(c, ignorenulls=True).alias(c) for c in ("n", "sketch", "brief", "leave")]
    return signed.groupBy("cls").agg(*own, F.count("*").alias("copies"), F.min("cls2").alias("low2"), F.max("cls2").alias("high2"))


def _members(docs: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, rid, mark, n, component, component_id."""
    if not 70 <= percent <= 99:
        raise ValueError("percent must be 70 to 99: linked sets lie in one size band or two")
    docs = docs.select("doc_id", rid_of(docs), mark_of(docs), "text")
    signed = Stored(docs.mapInArrow(_signatures(width, percent, bits), SIGNATURES), "signatures")
    of = Texts(docs.select("rid", "text"), signed.df, None, width, percent, bits)
    of.classes = Stored(_classes(signed.df.where("n > 0")), "classes").df
    clash = of.classes.where("low2 <> high2").select("cls")
    if not clash.isEmpty():
        of.renamed = Stored(clash, "renamed").df
        of.classes = Stored(_classes(of.named(signed.df).where("n > 0")), "classes").df
    named = of.named(signed.df)
    rows = Stored(named.select("doc_id", "rid", "mark", "n", "cls"), "ids").df
    hot = Stored(signed.df.select(F.explode("hot").alias("key")).distinct(), "hot").df
    signed.drop()
    del named
    release(docs.sparkSession)
    shared = Stored(_shared_keys(of, hot), "shared")
    needed = Stored(_needed_keys(shared.df, of.classes), "needed")
    shared.drop()
    stars = Stored(_stars(needed.df), "stars").df
    needed.drop()
    pairs = Stored(stars.select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct(), "pairs").df
    links = verified(pairs, of, "star")
    first = connected(links)
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = Stored(_left_over(stars, pairs, first, of).join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.df.isEmpty():
        links = links.union(verified(rest.df, of, "rest"))
        first = connected(links)
    member = of.classes.select("cls", "doc_id").join(first.withColumnRenamed("node", "cls"), "cls")
    smallest = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = member.select("cls", "component").join(smallest, "component").select("cls", "component", "component_id")
    own = of.classes.select("cls", F.col("doc_id").alias("own"), "copies")
    answer = own.join(linked, "cls", "left").select("cls", "copies", F.coalesce("component", "cls").alias("component"), F.coalesce("component_id", "own").alias("component_id"))
    answer = Stored(answer, "answer").df
    # Classes of very many rows are few; they are not brought together.
    hot = answer.where(F.col("copies") >= HOT_COPIES).drop("copies")
    n_hot = hot.count()
    filled = rows.where("n > 0")
    cold = filled.join(small_side(hot.select("cls"), 16, n_hot), "cls", "left_anti") if n_hot else filled
    out = cold.join(answer.drop("copies"), "cls")
    if n_hot:
        out = out.unionByName(filled.join(small_side(hot, 48, n_hot), "cls"))
    empty = rows.where("n = 0").select("cls", "doc_id", "rid", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "rid", "mark", "n", "component", "component_id"]
    return out.select(*columns).union(empty.select(*columns))


def rid_of(docs: DataFrame):
    """A row's own number: equal for equal ids with equal texts."""
    return F.xxhash64(F.coalesce(docs["doc_id"], F.lit(-1)), docs["doc_id"].isNull(), docs["text"]).alias("rid")


def mark_of(docs: DataFrame):
    """Of a row's text; beside its number, so that no row goes because of another of the same number."""
    return F.hash(docs["text"]).alias("mark")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """docs (doc_id, text, ...) -> one row for each row: doc_id, n_shingles, component_id."""
    return _members(docs, width, percent, bits).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the row of its smallest id (a null id is the largest).

    Of several texts of that id in the component, and of rows that repeat, one stays. Rows without a word all stay.
    """
    members = Stored(_members(docs, width, percent, 64), "members").df.where("n > 0")
    own = ["rid", "mark"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *own)
    chosen = members.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("rows"))
    chosen = Stored(chosen.where("rows > 1").select("best", "component"), "chosen").df
    # Rows of the components of several rows, but for the chosen ones, go.
    grouped = members.join(small_side(chosen.select("component"), 16), "component", "left_semi")
    gone = Stored(grouped.join(chosen, "component").where("rid <> best.rid OR mark <> best.mark").select(*own).distinct(), "gone").df
    repeated = members.groupBy(*own).count().where("count > 1").select(*own)
    twice = Stored(repeated.join(gone, own, "left_anti"), "twice").df
    whole = packed(docs, "doc_id", "text")
    rest = whole.select(ROW, rid_of(whole), mark_of(whole)).join(small_side(gone, 24), own, "left_anti")
    n_twice = twice.count()
    if not n_twice:
        return unpacked(rest)
    once = rest.join(small_side(twice, 24, n_twice), own, "left_anti")
    return unpacked(once.unionByName(rest.join(small_side(twice, 24, n_twice), own, "left_semi").dropDuplicates(own)))
