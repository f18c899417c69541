"""Secret scans: three fixed patterns, and character Markov models of random strings against identifiers.

The patterns give the base spans. Besides them, every long token is scored by the
log-likelihood ratio of two first-order character models, one of random strings and
one of ordinary identifiers, both trained from labelled samples (made by rule, or a table that
load_samples() reads), part of which is held out to choose the threshold; tokens from it on of which a base span leaves two characters or more are added as kind ``markov``. All of it is
DataFrame functions within a row; there is no shuffle.

Positions are code points, end exclusive. Defined results: a null text is empty and
has no spans; repeated rows are each scanned; other columns pass through untouched, but
scan() replaces those that are named base or spans.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, packed, unpacked, without

#: kind: (regular expression, group whose length counts, least length)
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # a run of 16 and more is what [0-9a-f]+ finds there
}
#: The matches of ``access`` that are long enough.
ACCESS = "AKIA[A-Z0-9]{14,}"
KINDS = [*PATTERNS, "markov"]
#: No two runs of these meet, so a token is a whole run.
LEAST_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Labelled strings that are not learned from but choose the threshold: one in so many, by a hash of the string.
HELD_OUT = 4
#: What an ordinary string taken for a secret costs, in secrets missed.
FALSE_COST = 10
#: Labelled strings that load_samples() takes at most.
SAMPLES = 20_000

#: Ordinary material of the identifier sample.
PLAIN_WORDS = (
    "account action active address amount array attribute author backup batch begin border branch buffer build button cache call card "
    "category channel child class client close cloud code column command comment commit common config connection container content "
    "context control copy count create current customer data database date debug default delete description detail device directory "
    "display document domain download element email enable entry error event example export extension factory feature field file filter "
    "final folder format frame function gateway global group handle handler hash header height history host image import index info "
    "initial input insert instance interface internal invoice item iterator journal kernel label language layout length level library "
    "license limit line link list listener local location lock logger manager mapping master matrix member memory message metadata "
    "method metric minimum model module monitor mutex name network node notification number object offset option order original output "
    "package page parameter parent parser partition path pattern payment permission pipeline pixel platform pointer policy position "
    "prefix process product profile project property protocol provider proxy query queue random range record reference region register "
    "release remote render replace report request resource response result return role route sample schedule schema score screen script "
    "search section segment select sequence server service session setting shape signal size socket source stack start state status "
    "storage store stream string structure style submit suffix summary support switch symbol system table target task template text "
    "thread ticket time title token total tracker transaction transfer transform tree trigger type update upload user utility value "
    "variable vector version video view virtual visible volume warning weight widget width window worker wrapper write zone"
).split()


#: Common words of other languages, for the same.
FOREIGN_WORDS = (
    "adresse anfrage anzeige auftrag ausgabe beispiel benutzer bericht datei eingabe ergebnis fehler fenster gruppe kunde nachricht rechnung schnittstelle speicher verbindung verzeichnis zeitplan "
    "acheteur affichage ajouter bibliotheque chemin commande compte connexion courrier dossier erreur facture fichier horaire langage message nombre parametre reponse utilisateur valeur "
    "archivo busqueda cabecera cliente conexion contrasena cuenta direccion entrega factura grupo idioma mensaje nombre pantalla parametro pedido registro respuesta servidor usuario ventana"
).split()
# How keys of known formats begin, the letters that follow (0 to 61 of ALPHABET, or all 64) and how many.
KEY_FORMATS = [("ghp_", 62, 36), ("sk_live_", 62, 24), ("AIza", 64, 35), ("eyJ", 64, 60), ("glpat-", 62, 20), ("npm_", 62, 36)]


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random): keys of several alphabets and of known formats; identifiers, paths and rules made of words of four languages."""
    rng, out = random.Random(seed), []
    for i in range(n):
        letters = [ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[52:62] + "abcdef"][i % 5]
        if i % 4 == 3:
            front, size, length = KEY_FORMATS[i // 4 % len(KEY_FORMATS)]
            out.append((front + "".join(rng.choices(ALPHABET[:size], k=length)), 1))
        else:
            out.append(("".join(rng.choices(letters, k=rng.randint(20, 64))), 1))
        parts = rng.choices(PLAIN_WORDS if rng.random() < 0.7 else FOREIGN_WORDS, k=rng.randint(2, 6))
        style = i % 8
        if style == 0:
            text = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 5:
            text = "".join(parts)
        elif style == 6:
            text = "/" + "/".join(parts) + rng.choice(["/", "/v2", "-2021", ""])
        elif style == 7:
            text = "-".join(p.title() for p in parts) + rng.choice(["", "=" + parts[0], "_" + str(rng.randint(1, 99))])
        else:
            text = ["_", "-", "/", "_"][style - 1].join(parts)
            text = text.upper() if style == 4 else text
        out.append((text + (str(rng.randint(1, 2030)) if rng.random() < 0.2 else ""), 0))
        if i % 20 == 0:
            out.append((rng.choice("-_=+/") * rng.randint(20, 60), 0))
    return out


def load_samples(spark: SparkSession, path: str, limit: int = SAMPLES) -> list[tuple[str, int]]:
    """Labelled strings of a Parquet table (text, label: 1 for a secret); of more than ``limit`` rows those of the least hashes."""
    rows = spark.read.parquet(path).where("text IS NOT NULL AND label IN (0, 1)").select("text", F.col("label").cast("int").alias("label")).distinct()
    return [(r["text"], r["label"]) for r in rows.orderBy(F.xxhash64("text"), "text", "label").limit(limit).collect()]


def train(samples: list[tuple[str, int]]) -> list[int]:
    """ratio[a * n + b]: thousandths of ln P(b | a, random) / P(b | a, identifier), with add-half smoothing."""
    n = len(ALPHABET)
    index = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for text, label in samples:
        for a, b in zip(text, text[1:], strict=False):
            if a in index and b in index:
                counts[label][index[a]][index[b]] += 1
    out = []
    for a in range(n):
        plain, rand = sum(counts[0][a]), sum(counts[1][a])
        out += [round(1000 * (math.log(counts[1][a][b] / rand) - math.log(counts[0][a][b] / plain))) for b in range(n)]
    return out


@dataclass(frozen=True)
class Model:
    """ratio: as train() gives it. threshold: mean ratio of a character from which a token is a secret. Both error rates are of held-out strings."""

    ratio: tuple[int, ...]
    threshold: int
    false_positives: float
    false_negatives: float


def mean_ratio(text: str, ratio: tuple[int, ...]) -> float:
    at = [ALPHABET.find(c) for c in text]
    return sum(ratio[a * len(ALPHABET) + b] for a, b in zip(at, at[1:], strict=False)) / (len(text) - 1)


def fit(samples: list[tuple[str, int]]) -> Model:
    """Learns from most of the strings and chooses the threshold on the others: that of the least cost, of several the highest."""
    held = [(t, y) for t, y in samples if zlib.crc32(t.encode()) % HELD_OUT == 0 and len(t) >= LEAST_TOKEN and all(c in ALPHABET for c in t)]
    ratio = tuple(train([(t, y) for t, y in samples if zlib.crc32(t.encode()) % HELD_OUT]))
    scores = [sorted(mean_ratio(t, ratio) for t, own in held if own == y) for y in (0, 1)]
    if not all(scores):
        raise ValueError("the labelled strings need both kinds among those held out")
    share = lambda y, t: bisect_left(scores[y], t) / len(scores[y])  # noqa: E731 (scores below t)
    cost = lambda t: FALSE_COST * (1 - share(0, t)) + share(1, t)
    best = min((cost(t), -t) for t in range(0, 3000, 10))
    return Model(ratio, -best[1], 1 - share(0, -best[1]), share(1, -best[1]))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_samples())


def running(values: Column, start: int, join) -> Column:
    """For each element what ``join`` makes of all before it. In blocks of about the root of the size, so that no list of all is copied for each element."""
    zero, none = F.lit(start), F.array().cast("array<int>")

    def before(items: Column, first: Column) -> Column:
        step = lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(items, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def in_blocks(v: Column, block: Column) -> Column:
        part = lambda first: F.slice(v, first, block)
        firsts = F.sequence(F.lit(1), F.size(v), block)
        totals = F.transform(firsts, lambda first: F.aggregate(part(first), zero, join))
        return F.flatten(F.zip_with(firsts, before(totals, zero), lambda first, at: before(part(first), at)))

    block = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    return let(values, lambda v: F.when(F.size(v) > 0, let(block(v), lambda b: in_blocks(v, b))).otherwise(none))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """array<struct<s,e,kind>> of the matches that ``keep(matched text)`` holds for."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<s:int,e:int,kind:string,t:string>>")
    # What lies between matches and the matches themselves add up to the positions.
    parts = F.arrays_zip(found.alias("t"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"))
    parts = F.filter(parts, lambda x: x["t"].isNotNull())  # behind the last match lies a gap only

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: x["gap"] + F.length(x["t"]))
        span = lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + F.length(x["t"])).alias("e"), F.lit(kind).alias("kind"), x["t"].alias("t"))
        return F.filter(F.zip_with(parts, running(sizes, 0, lambda a, v: a + v), span), lambda x: keep(x["t"]))

    return F.when(F.exists(found, keep), let(parts, placed)).otherwise(none)


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of the token's characters, in thousandths."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0).cast("long"),
        lambda a, i: a + F.get(model, at(i) * len(ALPHABET) + at(i + 1)).cast("long"),
    )
    return total / (F.length(token) - 1)


def _at_least(pattern: str, group: int, least: int):
    return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least


def scan(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds ``base`` and ``spans`` (array<struct<s,e,kind,t>>, by start, then kind as listed) to every row."""
    own = model or default_model()
    table = F.from_json(F.lit(json.dumps(own.ratio)), "array<int>")
    t = F.coalesce(F.col(text), F.lit(""))
    found = {}
    for kind, (pattern, group, least) in PATTERNS.items():
        found[kind] = _spans(t, pattern, kind, _at_least(pattern, group, least))
    found["markov"] = _spans(t, TOKEN, "markov", lambda m: ratio(m, table) >= own.threshold)
    order = F.array(*map(F.lit, KINDS))
    rank = lambda x: F.array_position(order, x["kind"])

    def ordered(spans: Column) -> Column:
        keyed = F.transform(spans, lambda x: F.struct(x["s"], rank(x).alias("r"), x["e"], x["kind"], x["t"]))
        return F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"], x["e"], x["kind"], x["t"]))

    out = without(docs, ["base", "spans"]).withColumns({f"__{k}": v for k, v in found.items()}).withColumn("base", ordered(F.concat(*[f"__{k}" for k in PATTERNS])))
    # One character that the base spans of a kind leave is no pair of characters, so the model says nothing of it.
    # Runs of the other two kinds lie within a token or not at all: its own text tells what they leave.
    assigned = lambda x: F.exists("__assign", lambda b: F.least(b["e"], x["e"]) - F.greatest(b["s"], x["s"]) >= x["e"] - x["s"] - 1)
    left = lambda x, pattern: F.length(F.regexp_replace(x["t"], pattern, ""))
    clear = F.filter("__markov", lambda x: (left(x, PATTERNS["hex"][0]) > 1) & (left(x, ACCESS) > 1) & ~assigned(x))
    return out.withColumn("spans", ordered(F.concat("base", clear))).drop(*[f"__{k}" for k in KINDS])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _without_spans(t: Column, spans: Column, mark: str) -> Column:
    """The text with each span, overlapping ones together, replaced by ``mark``.

    The text is cut into blocks once, so that a piece is found without reading the text from its beginning.
    """
    ends = F.transform(spans, lambda x: x["e"])

    def rebuilt(of: Column) -> Column:
        blocks, size = of["blocks"], of["size"]

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
            return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a - first * size + 1, b - a)

        # A span that begins within what an earlier one covers belongs to that one's mark.
        new = F.zip_with(spans, running(ends, 0, lambda a, v: F.greatest(a, v)), lambda x, at: F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(new, ""), piece(F.array_max(ends), of["n"]))

    cut = lambda of: F.transform(F.sequence(F.lit(0), of["n"], of["size"]), lambda k: F.substring(t, k + 1, of["size"]))
    sized = let(F.length(t), lambda n: F.struct(n.alias("n"), F.greatest(F.lit(1024), F.ceil(F.sqrt(n)).cast("int")).alias("size")))
    return let(let(sized, lambda of: F.struct(of["n"].alias("n"), of["size"].alias("size"), cut(of).alias("blocks"))), rebuilt)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", count: str | None = None) -> DataFrame:
    """``docs`` with each span (overlapping ones together) replaced by ``mark``; texts without spans stay as they are.

    count: a column of ``docs`` that holds the text's length, to be set anew where the text changed.
    """
    columns = docs.columns
    scanned = scan(packed(docs, text), text)
    t = F.col(text)
    clean = F.when(F.size("spans") > 0, _without_spans(t, F.col("spans"), mark)).otherwise(t)
    row, changed = F.col("__row"), scanned.withColumn("__clean", clean)
    row = row.withField(f"`{text}`", F.col("__clean"))
    if count in columns:
        row = row.withField(f"`{count}`", F.when(F.size("spans") > 0, F.length("__clean").cast(docs.schema[count].dataType)).otherwise(F.col("__row")[count]))
    return unpacked(changed.withColumn("__row", row))
