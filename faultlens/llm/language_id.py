"""Language identification with interpolated Kneser-Ney character models.

Each language has one model of character n-grams, kept in sorted hash arrays: for each
order the discounted share of every n-gram and the weight that its context leaves to the
next shorter one. A text goes to the language of the lowest cross-entropy per character.
The score is the posterior of that language with a temperature calibrated on held-back
sample texts; texts whose cross-entropy lies beyond what these show are marked rejected.

Characters are letters and their marks in small form, runs of anything else count as one
space. The models are fitted on a bounded sample of whole texts: at most DOCS rows of a
language, and no further row once CHARS characters are reached. Of rows that repeat an id
with the same language the smallest text counts.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text if nothing was learned; of equal languages the first by name wins; repeated rows get
equal results; other columns take no part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_hash import mix, slices

ORDER = 4
DOCS = 600
CHARS = 500_000
DISCOUNT = 0.75
#: Share of the sample held back for the temperature and the rejection.
HELD_BACK = 5
SPACE, EDGE = 32, 0
#: Characters of a text that are folded and scored at once.
PIECE = 1 << 20
#: N-grams of which a worker remembers the values.
CACHE = 1 << 20


def _fold(c: int) -> tuple[int, bool]:
    """A code point's small letter or mark, else a space; and whether it is a letter."""
    kind = unicodedata.category(chr(c))[0]
    if kind not in "LM":
        return SPACE, False
    low = chr(c).lower()
    return ord(low) if len(low) == 1 else c, kind == "L"


#: The basic plane's folded code points and letters, filled on first use.
_table: list[np.ndarray] = []


def _folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and which are letters."""
    if not _table:
        each = [_fold(c) for c in range(1 << 16)]
        _table.extend([np.array([x for x, _ in each], dtype=np.uint32), np.array([x for _, x in each], dtype=bool)])
    low = np.minimum(raw, 0xFFFF)
    code, letter = _table[0][low], _table[1][low]
    beyond = np.flatnonzero(raw > 0xFFFF)
    if len(beyond):
        kinds, where = np.unique(raw[beyond], return_inverse=True)
        each = [_fold(int(c)) for c in kinds]
        code[beyond] = np.array([x for x, _ in each], dtype=np.uint32)[where]
        letter[beyond] = np.array([x for _, x in each], dtype=bool)[where]
    return code, letter


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each after ORDER - 1 edges; where each text begins; letters of each."""
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(texts) if texts else ""
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(t) + len(pad) for t in texts)])[: len(texts)]
    code, letter = _folded(raw)
    edge = np.zeros(len(raw), dtype=bool)
    for k in range(len(pad)):
        edge[starts + k] = True
    code[edge] = EDGE
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != SPACE) | ((code[:-1] != SPACE) & (code[:-1] != EDGE))
    place = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(letter & ~edge)])
    ends = np.concatenate([starts[1:], [len(code)]]).astype(np.int64)
    return code[keep], place[starts], letters[ends] - letters[starts]


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """At i the hash of the n characters that end there (for i >= ORDER - 1)."""
    out = np.zeros(max(0, len(code) - ORDER + 1), dtype=np.uint64)
    for k in range(n):
        a = ORDER - n + k
        out = (out + code[a : a + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out, n)


def scored_places(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries of grams() stand for a character and not for an edge."""
    return code[ORDER - 1 :] != EDGE if len(code) >= ORDER else np.zeros(0, dtype=bool)


class Table:
    """Sorted hashes and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


def context(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n - 1 characters before each entry of grams()."""
    shifted = np.concatenate([[EDGE], code[:-1]]).astype(code.dtype)
    return grams(shifted, n - 1) if n > 1 else np.zeros(max(0, len(code) - ORDER + 1), dtype=np.uint64)


class Language:
    """share[n]: discounted share of an n-gram after its context; left[n]: what the context leaves to order n - 1."""

    def __init__(self, code: np.ndarray):
        use = scored_places(code, np.zeros(0))
        self.share, self.left = [], []
        full = [grams(code, n)[use] for n in range(1, ORDER + 1)]
        before = [context(code, n)[use] for n in range(1, ORDER + 1)]
        for n in range(1, ORDER + 1):
            gram, ctx = full[n - 1], before[n - 1]
            if n < ORDER:  # how many different characters stand before the n-gram
                _, first = np.unique(full[n], return_index=True)
                gram, ctx = gram[first], ctx[first]
            keys, first, count = np.unique(gram, return_index=True, return_counts=True)
            own = ctx[first]
            contexts, where = np.unique(own, return_inverse=True)
            total = np.bincount(where, weights=count, minlength=len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            self.share.append(Table(keys, (count - DISCOUNT) / total[where]))
            self.left.append(Table(contexts, DISCOUNT * kinds / total))

    def log2(self, full: list[np.ndarray], before: list[np.ndarray], letters: int) -> np.ndarray:
        p = np.full(len(full[0]), 1.0 / letters)
        for n in range(ORDER):
            p = self.share[n].get(full[n], 0.0) + self.left[n].get(before[n], 1.0) * p
        return np.log2(p)


class Models:
    """names: languages in order; temperature and limit: calibrated."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(k for k, v in samples.items() if any(characters([t])[2][0] for t in v))
        self.temperature, self.limit = 1.0, float("inf")
        self.languages, held = [], []
        for name in self.names:
            texts = samples[name]
            back = texts[::HELD_BACK] if len(texts) >= 2 * HELD_BACK else []
            used = [t for i, t in enumerate(texts) if not back or i % HELD_BACK]
            self.languages.append(Language(characters(used)[0]))
            held += [(t, len(self.languages) - 1) for t in back]
        self.letters = max(64, max((len(x.share[0].keys) for x in self.languages), default=0) + 1)
        if held and len(self.names) > 1:
            entropy, _, _ = self.entropies([t for t, _ in held])
            truth = np.array([k for _, k in held])
            fits = []
            for t in 2.0 ** np.arange(-2, 9):
                z = -t * (entropy - entropy.min(axis=1, keepdims=True))
                fits.append((-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean() + 1e-4 * np.log2(t) ** 2, t))
            self.temperature = min(fits)[1]
            best = entropy.min(axis=1)
            self.limit = float(np.median(best) + 8 * max(1.4826 * np.median(np.abs(best - np.median(best))), 0.05))

    def entropies(self, texts: list[str], cache: "Cache | None" = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, characters, letters."""
        cache = cache or Cache(self)
        long = [i for i, t in enumerate(texts) if len(t) > PIECE]
        if long:
            out = self.entropies(["" if len(t) > PIECE else t for t in texts], cache)
            for i in long:
                for column, v in zip(out, self.entropy_of_long(texts[i], cache), strict=True):
                    column[i] = v
            return out
        code, starts, letters = characters(texts)
        use = scored_places(code, starts)
        values = cache.values(code, use)
        ends = np.concatenate([starts[1:], [len(code)]])
        # starts count characters; entry i of grams() ends at character i + ORDER - 1
        sums = np.zeros((len(texts), len(self.names)))
        counts = np.maximum(ends - starts - (ORDER - 1), 0)
        full = np.flatnonzero(counts)
        if len(full):
            # Between two texts lie entries of edges only, which are worth 0.
            sums[full] = np.add.reduceat(values, starts[full], axis=0)
        return -sums / np.maximum(counts, 1)[:, None], counts, letters

    def entropy_of_long(self, text: str, cache: "Cache") -> tuple[np.ndarray, int, int]:
        """What entropies() gives for one text, a piece at a time: each begins with the characters before it."""
        before = np.full(ORDER - 1, EDGE, dtype=np.uint32)
        total, count, letters = np.zeros(len(self.names)), 0, 0
        for at in range(0, len(text), PIECE):
            code, letter = _folded(np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            code = np.concatenate([before, code])
            keep = np.ones(len(code), dtype=bool)
            keep[1:] = (code[1:] != SPACE) | ((code[:-1] != SPACE) & (code[:-1] != EDGE))
            keep[: ORDER - 1] = True
            code = code[keep]
            new = len(code) - ORDER + 1
            if new:
                total += cache.values(code, np.ones(new, dtype=bool)).sum(axis=0, dtype=np.float64)
            count, letters, before = count + new, letters + int(letter.sum()), code[len(code) - ORDER + 1 :]
        return -total / max(count, 1), count, letters


class Cache:
    """Values of n-grams by hash, in slots; what a slot has for another n-gram is computed again."""

    def __init__(self, models: Models, slots: int = CACHE):
        self.models, self.slots = models, slots
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.rows = np.zeros((slots, len(models.names)), dtype=np.float32)

    def values(self, code: np.ndarray, use: np.ndarray) -> np.ndarray:
        key = grams(code, ORDER)
        key[~use] = 0
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != key) & use)
        out = self.rows[slot]
        if len(miss):
            _, first, where = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[first]
            new = self._computed(code, at)
            out[miss] = new[where]
            self.keys[slot[at]], self.rows[slot[at]] = key[at], new
        out[~use] = 0
        return out

    def _computed(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        window = np.stack([code[at + k] for k in range(ORDER)], axis=1)
        full, before = [], []
        for n in range(1, ORDER + 1):
            full.append(grams_of(window[:, ORDER - n :], n))
            before.append(grams_of(window[:, ORDER - n : ORDER - 1], n - 1) if n > 1 else np.zeros(len(at), dtype=np.uint64))
        return np.stack([x.log2(full, before, self.models.letters) for x in self.models.languages], axis=1).astype(np.float32)


def grams_of(window: np.ndarray, n: int) -> np.ndarray:
    """The hash that grams() gives for each row of n characters."""
    out = np.zeros(len(window), dtype=np.uint64)
    for k in range(n):
        out = (out + window[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out, n)


def fit(docs: DataFrame) -> Models:
    """docs: doc_id, text, lang of the rows to learn from only."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 40))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not n:
        return Models({})
    share = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * DOCS / c + 20 / c)))])
    near = rows.select("doc_id", "lang", F.length("text").alias("n")).where((F.col("n") <= CHARS) & (draw < F.element_at(share, F.col("lang")) * (1 << 40)))
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = near.groupBy("doc_id", "lang").agg(F.max("n").alias("n"))
    chosen = each.withColumn("i", F.row_number().over(order)).withColumn("before", before).where((F.col("i") <= DOCS) & (F.col("before") < CHARS)).select("doc_id", "lang")
    got = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], hash_order(r["doc_id"]))):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Models(samples)


def hash_order(doc_id: int) -> int:
    return int(mix(np.array([doc_id], dtype=np.int64).view(np.uint64), 5)[0])


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, entropy (bits a character), rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by CHARS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = Cache(own)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n = len(texts)
                lang, score, bits, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, dtype=bool)
                if own.names:
                    entropy, _, letters = own.entropies(texts, cache)
                    best = entropy.argmin(axis=1)
                    low = entropy[np.arange(n), best]
                    posterior = 1 / np.exp(-own.temperature * (entropy - low[:, None])).sum(axis=1)
                    known = letters > 0
                    rejected = known & (low > own.limit)
                    score = np.where(known, np.where(rejected, np.minimum(posterior, 0.5), posterior), 0.0)
                    bits = np.where(known, low, np.nan)
                    lang = [own.names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                arrays = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(np.round(bits, 6), from_pandas=True), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
