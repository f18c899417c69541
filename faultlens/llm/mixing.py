"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A naive Bayes classifier, fitted on the labelled table, gives each document posteriors over
domains. It sees character shares and, for each domain, the weight of the words and word
beginnings that the labels show to be its own, in whatever language: document counts of
words, case folded, one aggregation over a bounded share of the labelled rows. The other
labelled rows teach the classifier, so that no row is judged by words that it taught itself.
Nonnegative document rates then minimise the squared distance between the expected domain
token totals and their targets, by projected gradient steps scaled with the inverse of the
domains' token overlap in the rows whose rate isn't 0. Every step is one aggregation over a narrow table, of
which the driver sees one number a domain.

Defined results: a null or empty text has zero tokens, its rate stays 1; a row with a
null id counts as unlabelled; of contradicting domains of an id the largest name counts;
repeated rows each have a rate, the same one; an empty table gives an empty result; a domain
without labels has posterior 0; targets of which none is above 0 for a domain that is there are refused; other columns pass through mixed() untouched, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, WORD_GAP, Stored, let, packed, removed, small_side, unpacked

#: domain: target share of all tokens
TARGETS = {"good": 0.93, "bad": 0.04, "toxic": 0.03}
#: The domain whose expected tokens stay as they are; the others' follow from their shares.
ANCHOR = "good"
STEPS = 12
TOLERANCE = 1e-6
#: At most about so many labelled documents of each domain, and at most this share of them, teach the words, chosen by a hash of the id.
LABELLED, TEACHERS = 4000, 0.7
#: Letters of a word's beginning that is weighed beside the whole word.
STEM = 4
#: What parts the words that are weighed, beside white space.
MARKS = ".,;:!?()[]{}\"'`#*$%&|<>+-=_/\\"
#: A word's log ratio counts from LEAST on, and only where the log-likelihood gains EVIDENCE by taking the class apart from the others.
LEAST, EVIDENCE = 1.2, 10.0
#: Stands behind the beginning of a word; no word holds it.
BEGINS = "*"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words of a text between marks and white space, case folded; an empty one may stand first or last."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D" + "".join(f"\\{c}" for c in MARKS) + "]+")


def beginnings(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, STEM))


def drawn(labels: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (doc_id, domain) that teach the words, and those that teach the classifier; both have every id once."""
    own = labelled(labels).where(F.col("domain").isin(classes))
    n = {r["domain"]: r["count"] for r in own.groupBy("domain").count().collect()}  # a row for each domain
    if len(n) < 2:
        return own.limit(0), own
    share = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(min(TEACHERS, LABELLED / c)))])
    teaches = F.pmod(F.xxhash64(F.lit("words"), "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("domain")) * (1 << 30)
    return own.where(teaches), own.where(~teaches)


def learn_words(docs: DataFrame, own: DataFrame, classes: list[str], text: str = "text") -> list[dict[str, float]]:
    """For each class the words (and beginnings, with BEGINS behind) that its documents have more often than the others', and their weights."""
    each = docs.select("doc_id", F.col(text).alias("text")).join(small_side(own, 32), "doc_id")
    words = each.select("domain", F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w != "")).alias("w"))
    both = F.concat("w", F.array_distinct(F.transform(beginnings(F.col("w")), lambda w: F.concat(w, F.lit(BEGINS)))))
    # An empty word stands for the document itself: the class's size comes from the same aggregation.
    rows = words.select("domain", F.explode(F.concat(F.array(F.lit("")), both)).alias("word"))
    counts = rows.groupBy("word").agg(*[F.sum(F.when(F.col("domain") == k, 1).otherwise(0)).cast("double").alias(f"n{i}") for i, k in enumerate(classes)])
    counts = Stored(counts, "words").df
    sizes = counts.where("word = ''").first()
    if sizes is None:
        return [{} for _ in classes]
    found: list[dict[str, float]] = []
    for i in range(len(classes)):
        size = sizes[f"n{i}"]
        rest = sum(sizes[f"n{j}"] for j in range(len(classes)) if j != i)
        mine = F.col(f"n{i}")
        others = sum((F.col(f"n{j}") for j in range(len(classes)) if j != i), F.lit(0.0))
        ratio = F.log((mine + 0.5) / (size + 1)) - F.log((others + 0.5) / (rest + 1))
        gain = lambda n, all_docs: F.when(n > 0, n * F.log(n / ((mine + others) * all_docs / (size + rest)))).otherwise(0.0)
        told = counts.where("word <> ''").where(gain(mine, size) + gain(others, rest) >= EVIDENCE) if size and rest else counts.limit(0)
        got = told.select("word", F.round(ratio, 3).alias("w")).where(F.col("w") >= LEAST)
        found.append({r["word"]: r["w"] for r in got.collect()})  # words of a bounded sample, a few hundred of them
    return found


def weighed(words: Column, tokens: Column, weights: list[dict[str, float]]) -> Column:
    """For each class the root of the summed weights of a text's distinct telling words, over the root of ``tokens``."""
    known = sorted({w for own in weights for w in own})
    whole, begun = [w for w in known if not w.endswith(BEGINS)], [w for w in known if w.endswith(BEGINS)]
    distinct = F.array_distinct(words)
    literal = lambda values: F.split(F.lit("\n".join(values)), "\n")  # noqa: E731 (words hold no white space)
    parts = []
    if whole:
        parts.append(F.array_intersect(distinct, literal(whole)))
    if begun:
        # Cut words are met without BEGINS; it comes back for those that are known.
        met = F.array_intersect(beginnings(distinct), literal([w.removesuffix(BEGINS) for w in begun]))
        parts.append(F.transform(met, lambda w: F.concat(w, F.lit(BEGINS))))
    table = lambda own: F.split(F.lit(",".join(str(own.get(w, 0.0)) for w in known)), ",").cast("array<double>")
    names, tables = literal(known), [table(own) for own in weights]
    places = F.transform(F.concat(*parts), lambda w: F.array_position(names, w).cast("int") - 1)
    add = lambda a, i: F.array(*[F.get(a, F.lit(k)) + F.get(t, i) for k, t in enumerate(tables)])
    total = F.aggregate(places, F.array(*[F.lit(0.0)] * len(weights)), add)
    return F.transform(total, lambda v: F.sqrt(v / F.sqrt(F.greatest(tokens, F.lit(1)))))


def described(text: Column, weights: list[dict[str, float]]) -> Column:
    """struct<tokens, x>: words of a text and its features, all finite, also for an empty one."""
    t = F.coalesce(text, F.lit(""))
    inner = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    counted = F.struct(
        F.when(inner == "", 0).otherwise(F.size(F.split(inner, WORD_GAP))).cast("long").alias("tokens"), F.length(t).alias("n"), F.length(removed(t, SYMBOLS)).alias("bare"),
        F.length(removed(t, "!")).alias("calm"), words_of(t).alias("words"),
    )

    def own(d: Column) -> Column:
        n = F.greatest(d["n"], F.lit(1)).cast("double")
        shares = F.array(F.sqrt((d["n"] - d["bare"]) / n), F.sqrt((d["n"] - d["calm"]) / n))
        return F.struct(d["tokens"].alias("tokens"), (F.concat(shares, weighed(d["words"], d["tokens"], weights)) if any(weights) else shares).alias("x"))

    return let(counted, own)


@dataclass
class Bayes:
    """Per class: log prior, means and variances."""

    classes: list[str]
    prior: list[float]
    mean: list[list[float]]
    var: list[list[float]]

    def posterior(self, x: Column, n: int) -> list[Column]:
        logs = []
        for k in range(len(self.classes)):
            terms = [-0.5 * ((x[j] - self.mean[k][j]) ** 2 / self.var[k][j] + float(np.log(self.var[k][j]))) for j in range(n)]
            total = F.lit(self.prior[k])
            for term in terms:
                total = total + term
            logs.append(total)
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(F.greatest(v - top, F.lit(-60.0))) for v in logs]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole + p
        return [F.round(p / whole, 9) for p in parts]


def labelled(labels: DataFrame) -> DataFrame:
    """labels: doc_id, domain; each id once."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))


def fit_classifier(rows: DataFrame, labels: DataFrame, classes: list[str], n: int) -> Bayes:
    """Means and variances of each domain over the ``n`` features, in one aggregation. labels: as drawn() gives them."""
    got = rows.join(labels, "doc_id").groupBy("domain").agg(
        F.count("*").alias("n"), *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(n)], *[F.var_pop(F.col("x")[j]).alias(f"v{j}") for j in range(n)]
    )
    by = {r["domain"]: r for r in got.collect()}  # a row for each domain
    seen = [k for k in classes if k in by] or classes[:1]
    total = sum(by[k]["n"] for k in seen if k in by) or 1
    value = lambda k, c: float(by[k][c] or 0.0) if k in by else 0.0
    return Bayes(
        seen,
        [float(np.log(max(value(k, "n"), 1) / total)) for k in seen],
        [[value(k, f"m{j}") for j in range(n)] for k in seen],
        [[max(value(k, f"v{j}"), 1e-4) for j in range(n)] for k in seen],
    )


@dataclass
class Mix:
    """What was fitted: word weights, classifier, and the rate as an expression of tokens and the p_ columns."""

    names: list[str]
    weights: list[dict[str, float]]
    model: Bayes
    rate: Column
    residual: np.ndarray

    def posteriors(self) -> list[Column]:
        """p_ columns over a column ``d`` of described()."""
        n = width(self.weights)
        p = dict(zip(self.model.classes, self.model.posterior(F.col("d.x"), n), strict=True))
        return [(p[k] if k in p else F.lit(0.0)).alias(f"p_{k}") for k in self.names]

    def copies(self) -> Column:
        """The rate rounded up or down at random by a hash of doc_id, so that the expected copies equal the rate."""
        draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_000)) / 1e6
        whole = F.floor("rate")
        return (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def width(weights: list[dict[str, float]]) -> int:
    return 2 + (len(weights) if any(weights) else 0)


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", steps: int = STEPS) -> tuple[Mix, DataFrame]:
    """The fitted mix, and doc_id, tokens, p_<domain>... of each row of ``docs``."""
    targets = dict(targets or TARGETS)
    names = list(targets)
    teachers, others = drawn(labels, names)
    weights = learn_words(docs, teachers, names, text)
    rows = Stored(docs.select("doc_id", described(F.col(text), weights).alias("d")), "features").df
    mix = Mix(names, weights, fit_classifier(rows.select("doc_id", F.col("d.x").alias("x")), others, names, width(weights)), F.lit(1.0), np.zeros(len(names)))
    soft = Stored(rows.select("doc_id", "d.tokens", *mix.posteriors()), "posteriors").df
    mix.rate, mix.residual = solve(soft, [f"p_{k}" for k in names], list(targets.values()), steps, names.index(ANCHOR) if ANCHOR in names else None)
    return mix, soft


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", steps: int = STEPS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, tokens, p_<domain>..., rate, copies. The row order is not kept."""
    mix, soft = fit(docs, labels, targets, text, steps)
    return soft.withColumn("rate", mix.rate).withColumn("copies", mix.copies())


def solve(soft: DataFrame, ps: list[str], shares: list[float], steps: int = STEPS, anchor: int | None = None) -> tuple[Column, np.ndarray]:
    """The rate as an expression over ``soft``, and the relative residual it leaves.

    ``rate = max(0, rate - p . g)`` for each step's scaled gradient g. The steps are kept
    as a short list of vectors, so that the rate is computed in one pass from the row.
    """
    k = len(ps)

    def sums(r: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected domain totals, the domains' overlap in the rows whose rate isn't 0, all tokens."""
        cell = lambda i, j: F.sum(F.when(r > 0, F.col("tokens") * F.col(ps[i]) * F.col(ps[j])).otherwise(0.0)).alias(f"a{i}_{j}")
        each = [F.sum(F.col("tokens") * F.col(c) * r).alias(f"s{i}") for i, c in enumerate(ps)]
        got = soft.agg(F.sum("tokens").alias("t"), *each, *[cell(i, j) for i in range(k) for j in range(i, k)]).first()
        value = lambda c: float(got[c] or 0.0)
        return np.array([value(f"s{i}") for i in range(k)]), np.array([[value(f"a{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]), value("t")

    own, overlap, total = sums(F.lit(1.0))
    if not total:
        return F.lit(1.0), np.zeros(k)
    goal = np.array(shares) / sum(shares)
    present = np.diag(overlap) > 0
    goal = np.where(present, goal, 0)
    if not goal.sum():
        raise ValueError("no domain that the documents have has a target above 0")
    goal = goal / goal.sum()
    if anchor is not None and goal[anchor] > 0:
        goal *= own[anchor] / total / goal[anchor]
    moves: list[np.ndarray] = []

    def rate() -> Column:
        if not moves:
            return F.lit(1.0)
        flat = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in moves])
        dot = lambda m: sum((F.col(ps[i]) * m[i] for i in range(k)), F.lit(0.0))
        return F.aggregate(flat, F.lit(1.0), lambda a, m: F.greatest(F.lit(0.0), a - dot(m)))

    best: tuple[float, int] = (float("inf"), 0)
    residual = np.zeros(k)
    for step in range(steps + 1):
        if moves:
            own, overlap, _ = sums(F.when(F.col("tokens") > 0, rate()).otherwise(0.0))
        residual = own / total - goal
        off = float(np.abs(residual).max())
        best = min(best, (off, step))
        if off < TOLERANCE or step == steps:
            break
        moves.append(np.linalg.pinv(overlap / total + 1e-9 * np.eye(k)) @ residual)
    del moves[best[1] :]
    return F.when(F.col("tokens") > 0, rate()).otherwise(1.0), residual


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: toxic, else good or bad."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", steps: int = STEPS) -> DataFrame:
    """Each row of ``docs`` as often as its copies say. The rate is an expression of the row, so no text is shuffled."""
    mix, _ = fit(docs, labels, targets, text, steps)
    # The generator keeps the description from being computed anew for each use.
    rows = packed(docs, "doc_id", text).select(ROW, "doc_id", F.explode(F.array(described(F.col(text), mix.weights))).alias("d"))
    rated = rows.select(ROW, "doc_id", "d.tokens", *mix.posteriors()).withColumn("rate", mix.rate)
    return unpacked(rated.select(ROW, F.explode(F.array_repeat(F.lit(True), mix.copies())).alias("__copy")))
