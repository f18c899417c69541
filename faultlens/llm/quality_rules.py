"""Host-level quality rules, in DataFrame functions only.

Each text is measured within its row: three-word windows are hashed, and only where two
hashes are equal are the windows sorted, by hash, then by their words, so that a clash of
hashes decides nothing and no word leaves its row. Rule failures are summed by domain, each domain's failure rate is
shrunk with a beta prior fitted on all domains, and the verdict on the domain
joins back to its documents.

Defined results: a null or empty text has no words and fails; a null domain is
never rejected as such; repeated rows are each judged; an empty table gives an
empty result; other columns pass through untouched, but for those that have the
name of a result, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, Stored, let, packed, quoted, removed, small_side, unpacked, without, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A further rule that counts towards the domain's failures: symbols per hundred words.
SYMBOL_PERCENT = 30
#: A domain goes when its shrunken failure rate is above this.
HOST_FAILURE_RATE = 0.6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(w: Column, h: Column) -> Column:
        window = lambda x, i: F.struct(x.alias("h"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))
        same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | ((i < last) & same(x, F.get(s, i + 1))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        # A window adds the words that the one before it doesn't reach.
        new = lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)
        return let(let(F.sort_array(F.transform(h, window)), places), new)

    either = lambda w: let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(w, h)).otherwise(0))
    return F.when(F.size(words) > 3, either(words)).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES to every row; no shuffle, no Python."""
    docs = without(docs, MEASURES)
    kept = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__w", words_of(F.col(text)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("__l", lines)
    n = F.size("__w").cast("long")
    out = step.select(
        *quoted(kept),
        n.alias("n_words"),
        F.length(removed(t, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(removed(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).alias("n_repeat_words"),
    )
    short, repeats = F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return out.withColumn("base_failed", short | repeats)


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_FAILURE_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunken), host_ok; one row for each domain that isn't null."""
    failed = F.col("base_failed") | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("host_docs"), F.count_if(failed).alias("host_failed"))
    )
    rate = F.col("host_failed") / F.col("host_docs")
    hosts = Stored(hosts, "hosts").df
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("inv")).first()
    mean = min(max(m["mean"] if m["mean"] is not None else 0.5, 1e-3), 1 - 1e-3)
    # Moments of a beta-binomial: what varies beyond the binomial share belongs to the prior.
    noise = mean * (1 - mean) * (m["inv"] or 1.0)
    between = max((m["var"] or 0.0) - noise, 1e-4)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select("host", "host_docs", "host_failed", F.round(shrunk, 9).alias("host_rate")).withColumn("host_ok", F.col("host_rate") <= limit)


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_FAILURE_RATE, carry: bool = True) -> DataFrame:
    """Every row of ``docs`` (without its text, if ``carry`` is false) with MEASURES, host_rate and kept."""
    measured = measure(without(docs, ["host_rate", "kept"]), text)
    measured = Stored(measured if carry else measured.drop(text), "measured").df
    return _joined(measured, host_verdicts(measured, host, limit), host)


def _joined(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    side = small_side(verdicts, 128).select(F.col("host").alias("__host"), "host_rate", F.col("host_ok").alias("__ok"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("__ok"), F.lit(True))
    return measured.join(side, measured[host] == F.col("__host"), "left").withColumn("kept", kept).drop("__host", "__ok")


def filtered(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they were.

    The texts are measured twice, for the hosts and then for the rows: a second pass over the
    input takes less than a written copy of all texts.
    """
    measured = measure(packed(docs, text, host), text)
    verdicts = host_verdicts(measured, host)
    # A plain filter would be pushed below the measures, and they into it, to be computed anew for each window.
    passed = F.explode(F.when(~F.col("base_failed"), F.array(F.lit(True))))
    rows = measured.select(ROW, host, passed.alias("__passed")).withColumn("base_failed", F.lit(False))
    return unpacked(_joined(rows, verdicts, host).where("kept"))
