"""Plain versions of the fitted operators, and the cases at the edge of each operator's numbers."""

import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from faultlens.llm import language_id, licenses, mixing, packing, quality_classifier, quality_rules, queries, secrets, topk, url_filters

from .test_operators import ODD, WORDS, documents, plain_spans, sentence, tongue

# Quality classifier


def test_score_is_the_calibrated_difference_of_sizes(spark):
    rng = random.Random(31)
    texts = [sentence(rng, rng.randint(5, 400), WORDS[:20] if k % 2 else WORDS[15:]) for k in range(120)] + ODD
    docs = documents(spark, texts)
    model = quality_classifier.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(0, 120) if k % 3], "doc_id long, y int"))
    each = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert (model.weights[1:] >= 0).all() and model.weights[1:].sum() > 0
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        parts = [raw[i : i + 512] for i in range(0, len(raw), 512)]
        if len(parts) > 1 and len(parts[-1]) < 128:
            parts[-2:] = [b"".join(parts[-2:])]
        sizes = [[len(c.compress(p)) for c in each] for p in parts]
        want = model.share
        if raw:
            good, bad = (sum(s[i] for s in sizes) for i in (0, 1))
            z = model.weights @ [1, 20 * (bad - good) / (bad + good), 20 * min((b - g) / (b + g) for g, b in sizes)]
            want = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        assert got[k] == pytest.approx(want, abs=1e-5), t


def test_repeated_labelled_rows_count_once(spark):
    rng = random.Random(32)
    texts = [sentence(rng, 60, WORDS[:20] if k % 2 else WORDS[15:]) for k in range(40)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, y int")
    once, often = (quality_classifier.fit(d, labels) for d in (docs, docs.union(docs.where("doc_id < 3")).union(docs)))
    assert once.good == often.good and once.bad == often.bad and np.allclose(once.weights, often.weights)


# Top-k


def test_top_k_at_the_edges(spark):
    rng = np.random.default_rng(33)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(50, [9.0, 9.0, 9.0, 9.0]), (7, rows[7][1]), (7, [5.0] * 4)]  # ids that repeat
    rows += [(400, [1.0, 2.0]), (401, [3.0, 1.0]), (450, [1.0, 1.0])]  # another length
    rows += [(500, [float("inf"), 0.0, 0.0, 0.0]), (501, [0.0, -float("inf"), 0.0, 0.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5, 64, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if all(map(math.isfinite, e))]
    asked = {}
    for i, e in whole:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, e), e)
    want = {}
    for i, q in asked.items():
        want[i] = [(j, -s) for s, j in sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in whole if j != i and len(e) == len(q))[:5]]
    assert dict(got) == want and len(want) == 8


def test_top_k_of_huge_components(spark):
    rows = [(0, [2.0**41, 1.0]), (1, [2.0**41, 3.0]), (2, [2.0**41 + 1 / 256, 1.0]), (50, [1e300, -1e300]), (3, [-1e200, 1.0]), (4, [-1e200, -1e200])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 9).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    from fractions import Fraction

    whole = {i: [math.floor(256 * Fraction(x)) for x in e] for i, e in rows}
    for i in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[i], e, strict=True)), j) for j, e in whole.items() if j != i)
        assert got[i] == [(j, min(max(-s, -(2**63)), 2**63 - 1)) for s, j in scored]


# Mixing


def plain_mixing(texts, domains, teachers, classes, targets):
    """Posteriors and rates of single loops over lists; teachers: ids whose labels teach the words, the others teach the classifier."""
    words = [(t or "").split() for t in texts]
    keys = [{x for w in re.findall(r"[^\s" + re.escape(mixing.MARKS) + "]+", (t or "").lower()) for x in (w, w[:4] + "*")} for t in texts]
    feats = []
    for k in classes:
        mine, rest = ([i for i, d in domains.items() if i in teachers and (d == k) == same] for same in (True, False))
        a, b = (Counter(x for i in own for x in keys[i]) for own in (mine, rest))
        weight = {}
        for x in a:
            ratio = round(math.log((a[x] + 0.5) / (len(mine) + 1)) - math.log((b[x] + 0.5) / (len(rest) + 1)), 3)
            share = (a[x] + b[x]) / len(teachers)
            gain = sum(n * math.log(n / (share * len(own))) for n, own in ((a[x], mine), (b[x], rest)) if n)
            if ratio >= mixing.LEAST and gain >= mixing.EVIDENCE:
                weight[x] = ratio
        feats.append([math.sqrt(sum(weight.get(x, 0) for x in s) / math.sqrt(max(len(w), 1))) for s, w in zip(keys, words, strict=True)])
    share = lambda t, chars: math.sqrt(sum(map((t or "").count, chars)) / max(len(t or ""), 1))
    x = np.array([[share(t, mixing.SYMBOLS), share(t, "!")] for t in texts])
    x = np.hstack([x, np.array(feats).T])
    logs = []
    for k in classes:
        own = x[[i for i, d in domains.items() if d == k and i not in teachers]]
        var = np.maximum(own.var(axis=0), 1e-4)
        logs.append(-0.5 * ((x - own.mean(axis=0)) ** 2 / var + np.log(var)).sum(axis=1) + math.log(len(own) / (len(domains) - len(teachers))))
    p = np.exp(np.maximum(np.array(logs).T - np.max(logs, axis=0)[:, None], -60))
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.array([len(w) for w in words], dtype=float)
    goal = np.array(targets) / sum(targets) * tokens.sum()
    rate = np.ones(len(texts))
    scale = np.linalg.pinv((p * tokens[:, None]).T @ p)
    for _ in range(200):
        rate = np.maximum(0, rate - p @ (scale @ ((tokens * rate) @ p - goal)))
    return tokens, p, rate


def test_mixing_against_a_plain_version(spark):
    rng = random.Random(34)
    own = {"a": WORDS[:14] + ["Alpha", "alphas"], "b": WORDS[8:24] + ["beta!", "(BETA)"], "c": WORDS[18:] + ["gamma"]}
    which = [rng.choice("aabc") for _ in range(150)]
    texts = [sentence(rng, rng.randint(20, 60), own[d]) for d in which]
    domains = {i: d for i, d in enumerate(which) if i % 3}
    labels = spark.createDataFrame(list(domains.items()), "doc_id long, domain string")
    clash = ["rate", "copies", "tokens", "d", "__copy", "__row"]
    docs = spark.createDataFrame([(i, t, *clash) for i, t in enumerate(texts)], "doc_id long, text string, rate string, copies string, tokens string, d string, __copy string, __row string")
    got = {r["doc_id"]: r for r in mixing.rates(docs, labels, {"a": 0.5, "b": 0.2, "c": 0.3}).collect()}
    words, others = ({r["doc_id"] for r in x.collect()} for x in mixing.drawn(labels, ["a", "b", "c"]))
    assert words | others == set(domains) and not words & others and 50 < len(words) < 90
    tokens, p, rate = plain_mixing(texts, domains, words, ["a", "b", "c"], [0.5, 0.2, 0.3])
    for i in range(len(texts)):
        assert got[i]["tokens"] == tokens[i]
        assert [got[i][f"p_{k}"] for k in "abc"] == pytest.approx(list(p[i]), abs=1e-6)
        assert got[i]["rate"] == pytest.approx(rate[i], abs=1e-3)
    total = {k: sum(r["tokens"] * r["rate"] * r[f"p_{k}"] for r in got.values()) for k in "abc"}
    assert [total[k] / sum(total.values()) for k in "abc"] == pytest.approx([0.5, 0.2, 0.3], abs=1e-4)
    mixed = mixing.mixed(docs, labels, {"a": 0.5, "b": 0.2, "c": 0.3})
    assert mixed.columns == docs.columns and mixed.select(*clash).distinct().count() == 1
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})


def test_words_that_no_label_has_tell_nothing(spark):
    rng = random.Random(35)
    texts = [sentence(rng, 60, WORDS[:14] + (["vile", "#awful"] if k % 3 == 0 else ["fine"])) for k in range(300)]
    rare = [" ".join("".join(rng.choice("bcdeghijklmnopqrstuwxyz") for _ in range(rng.randint(3, 12))) for _ in range(n)) for n in [500, 2000, 20_000] * 5]
    labels = spark.createDataFrame([(k, "toxic" if k % 3 == 0 else "good") for k in range(300)], "doc_id long, domain string")
    docs = documents(spark, texts + rare)
    weights = mixing.learn_words(docs, mixing.drawn(labels, ["good", "toxic"])[0], ["good", "toxic"])
    assert set(weights[1]) == {"vile", "vile*", "awful", "awfu*"} and set(weights[0]) == {"fine", "fine*"}
    own = docs.where("doc_id >= 300").select(mixing.described(mixing.F.col("text"), weights).alias("d")).collect()
    assert all(r["d"]["x"][2:] == [0, 0] for r in own)
    with pytest.raises(ValueError, match="target"):
        mixing.rates(docs, labels, {"good": 0.0, "toxic": 0.0, "other": 1.0}).collect()


# Packing


def test_packing_against_plain_best_fit(spark):
    rng = random.Random(35)
    texts = [sentence(rng, rng.randint(1, 70)) for _ in range(120)] + ["twice the same"] * 6 + [sentence(rng, 130)] * 2
    sources = [rng.choice(["hot", "hot", "x", "y", None]) for _ in texts]
    got = packing.pack(documents(spark, texts, sources=sources), 60, 2, 10_000).collect()
    cluster = {r["doc_id"]: r["cluster"] for r in got}
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    # Longest document first, its full pieces first; ties by the smallest id of the text, its copies by source (null last) and id. Then longest piece first.
    least = {c: min(i for i in size if cluster[i] == c) for c in cluster.values()}
    order = sorted(size, key=lambda i: (-size[i], least[cluster[i]], sources[i] is None, sources[i] or "", i))
    pieces = [(i, k, min(60, size[i] - 60 * k)) for i in order for k in range(-(-size[i] // 60))]
    bins = []
    where = {}
    for i, k, n in sorted(pieces, key=lambda x: -x[2]):
        fits = [
            (60 - sum(x[2] for x in b), at) for at, b in enumerate(bins)
            if sum(x[2] for x in b) + n <= 60 and sum(sources[x[0]] == sources[i] for x in b) < 2 and all(cluster[x[0]] != cluster[i] for x in b)
        ]
        at = min(fits)[1] if fits else len(bins)
        bins += [[]] if not fits else []
        where[i, k] = at, sum(x[2] for x in bins[at])
        bins[at].append((i, k, n))
    assert {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in got} == where


# Secrets


def test_markov_ratio_against_a_plain_version(spark):
    rng = random.Random(36)
    tokens = ["".join(rng.choices(secrets.ALPHABET[:64], k=rng.randint(20, 40))) for _ in range(25)] + ["_".join(rng.choices(secrets.PLAIN_WORDS, k=4)) for _ in range(25)]
    model = secrets.default_model()
    table = model.ratio
    assert model.false_positives < 0.01 and model.false_negatives < 0.05
    at = {c: i for i, c in enumerate(secrets.ALPHABET)}
    docs = documents(spark, [f"({t}) {t[:19]}" for t in tokens])
    rows = {r["doc_id"]: r["s"] for r in secrets.scan(docs).select("doc_id", F.filter("spans", lambda x: x["kind"] == "markov").alias("s")).collect()}
    for i, t in enumerate(tokens):
        mean = sum(table[at[a] * len(at) + at[b]] for a, b in zip(t, t[1:], strict=False)) / (len(t) - 1)
        assert [(x["s"], x["e"]) for x in rows[i]] == ([(1, 1 + len(t))] if mean >= model.threshold else []), t
    assert 20 < sum(map(bool, rows.values())) < 30


def test_markov_spans_of_the_query(spark, tmp_path):
    rng = random.Random(37)
    key = lambda n: "".join(rng.choices(secrets.ALPHABET[:62], k=n))
    texts = [f"see {key(32)} there" for _ in range(40)] + [f"see {'_'.join(rng.choices(secrets.PLAIN_WORDS, k=5))} there" for _ in range(40)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op4_secret_scans(spark, str(tmp_path)).collect()}
    assert all(r["n_assign"] + r["n_access"] + r["n_hex"] == 0 for r in rows.values())
    assert sum(rows[i]["spans"] == "markov:4:36" for i in range(40)) >= 39 and all(rows[i]["spans"] == "" for i in range(40, 80))
    # Own labelled strings: letters only are keys here, digits are not.
    samples = [("".join(rng.choices(c, k=30)), y) for _ in range(300) for c, y in (("abcdefghij", 1), ("0123456789", 0))]
    spark.createDataFrame([*samples, (None, 1), ("x", None)], "text string, label int").write.parquet(str(tmp_path / "labels"))
    own = secrets.fit(secrets.load_samples(spark, str(tmp_path / "labels")))
    assert len(secrets.load_samples(spark, str(tmp_path / "labels"), 50)) == 50 and own.false_positives == own.false_negatives == 0
    found = secrets.scan(documents(spark, ["jihgfedcbajihgfedcbaji 98765432109876543210987"]), model=own).first()
    assert secrets.written(F.col("spans")) is not None and [(x["s"], x["e"]) for x in found["spans"] if x["kind"] == "markov"] == [(0, 22)]
    with pytest.raises(ValueError, match="both kinds"):
        secrets.fit([("a" * 30, 1)])


def test_very_many_secrets_in_one_text(spark):
    n = 60_000
    text = "é " + " ".join(f"{i:016x}" for i in range(n))
    docs = documents(spark, [text])
    got = secrets.scan(docs).select(F.size("base"), secrets.written(F.col("base"))).first()
    assert got[0] == n and got[1] == plain_spans(text)
    assert secrets.redact(docs).first()["text"] == "é " + " ".join(["[SECRET]"] * n)


# Language ID


def test_no_letter_is_und(spark):
    rng = random.Random(37)
    texts = [tongue(rng, n, 30) for n in ("xx", "yy") for _ in range(20)]
    odd = ["\U0001f600\U0001f601", "\U0001d7d8\U0001d7d9", "́́", "12 ١", "\U00020000", "\U00010400x", "Ⅷ"]
    docs = documents(spark, texts + odd, langs=["xx"] * 20 + ["yy"] * 20 + [None] * len(odd))
    rows = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert [rows[40 + k]["lang_pred"] == "und" for k in range(len(odd))] == [True, True, True, True, False, False, True]
    assert all(rows[40 + k]["score"] == 0 for k in range(4))


def test_kneser_ney_against_a_plain_version():
    rng = random.Random(38)
    text, asked = tongue(rng, "yy", 200), tongue(rng, "yy", 6) + " qka"
    models = language_id.Models({"yy": [text]})
    pad = "\0" * 3
    seen = [(pad + text)[i : i + 4] for i in range(len(text))]
    counts = {4: Counter(seen)}
    for n in (3, 2, 1):  # in how many different contexts
        counts[n] = Counter(x[1:] for x in set(counts[n + 1]) if len(x) == n + 1)

    def p(gram):
        if not gram:
            return 1 / models.letters
        own = counts[len(gram)]
        same = {x: c for x, c in own.items() if x[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - 0.75, 0) / total + 0.75 * len(same) / total * p(gram[1:])

    padded = pad + asked
    want = -sum(math.log2(p(padded[i : i + 4])) for i in range(len(asked))) / len(asked)
    assert models.entropies([asked])[0][0, 0] == pytest.approx(want, abs=1e-4)


# Quality rules, licences and URLs


def test_host_verdicts_against_plain_numbers(spark):
    rng = random.Random(39)
    rows = [(f"h{k}", 20 + 9 * k, rng.randint(0, 20 + 9 * k)) for k in range(12)] + [("all", 300, 300), ("one", 1, 1)]
    measured = spark.createDataFrame([(h, i < bad, 0, 60) for h, n, bad in rows for i in range(n)], "source string, base_failed boolean, n_symbols long, n_words long")
    rate = np.array([bad / n for _, n, bad in rows])
    mean = rate.mean()
    between = max(rate.var(ddof=1) - mean * (1 - mean) * np.mean([1 / n for _, n, _ in rows]), 1e-4)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    want = {h: (bad + mean * strength) / (n + strength) for h, n, bad in rows}
    got = {r["host"]: r for r in quality_rules.host_verdicts(measured).collect()}
    assert {h: r["host_rate"] for h, r in got.items()} == pytest.approx(want, abs=1e-8)
    assert {h for h, r in got.items() if not r["host_ok"]} == {h for h, x in want.items() if x > quality_rules.HOST_FAILURE_RATE} >= {"all"}


def test_clashing_names(spark):
    clash = [*quality_rules.MEASURES, "kept", "host_rate", "digest", "license", "known", "host", "path", "rule", "verdict", "__w", "__l"]
    rows = spark.createDataFrame([(1, "a b c", "s", "http://x.net/", *["old"] * len(clash))], "doc_id long, text string, source string, url string, " + ", ".join(f"{c} string" for c in clash))
    one = quality_rules.judge(rows).first()
    assert (one["n_words"], one["kept"], one["digest"]) == (3, False, "old")
    one = licenses.scan(rows).first()
    assert one["license"] is None and len(one["digest"]) == 64 and one["kept"] == "old"
    one = url_filters.judge(rows, url_filters.rule_table(spark, url_filters.RULES)).first()
    assert (one["host"], one["rule"], one["verdict"], one["n_words"]) == ("x.net", "net/", "block", "old")


def test_a_host_of_very_many_labels(spark):
    host = "a." * 100_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/de/x"), (2, f"http://{host}/en/"), (3, "http://net/"), (4, "http://.net/"), (5, "http://xnet/")], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filters.judge(pages, url_filters.rule_table(spark, [*url_filters.RULES, ("block", "/")])).collect()}
    assert got == {1: "example.com/de/", 2: None, 3: "net/", 4: "net/", 5: None}


def test_queries_decide_something(spark, tmp_path):
    """Through the registered queries: licences are found, a host is rejected, its good documents with it."""
    rng = random.Random(40)
    fine = [" ".join(rng.sample(WORDS, 30) + [f"w{rng.random()}" for _ in range(60)]) for _ in range(44)]
    mpl = "Redistribution\n" + licenses.KNOWN["BSD-3-Clause"][len("Redistribution") :].upper()
    texts = fine[:40] + ["bad"] * 37 + fine[40:43] + ["Copyright 2001 X\n" + mpl, licenses.MIT, licenses.ISC + " x"]
    sources = ["fine"] * 40 + ["farm"] * 40 + ["third"] * 3
    documents(spark, texts, sources=sources).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["license"] for r in queries.op8_license_scans(spark, str(tmp_path)).collect()}
    assert {i: k for i, k in found.items() if k} == {80: "BSD-3-Clause", 81: "MIT"}
    rows = queries.op9_quality_rules(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows if not r["base_failed"] and not r["kept"]} == {77, 78, 79}
    assert {r["doc_id"] for r in rows if r["kept"]} >= set(range(40))


def test_licenses_at_every_width_with_titles_and_notices(spark):
    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))

    titles = {"MIT": "MIT License", "ISC": "The ISC License", "Zlib": "zlib License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
    notices = ["Copyright (c) 2020 Jane Doe", "(C) 1999 X\nAll rights reserved.", "Copyright 2010, 2011 A\nCopyright © 2012 B\nCopyright (c) npm, Inc. and Contributors", "Copyright The Example Authors"]
    cases = [(k, wrapped(licenses.KNOWN[k], w)) for k in titles for w in range(40, 101)]
    for k, t in titles.items():
        for i, n in enumerate(notices):
            whole = f"{t}\n\n{n}\n\n{wrapped(licenses.KNOWN[k], 50 + 12 * i)}"
            cases += [(k, whole), (k, "\n".join(f" * {line}" for line in whole.split("\n"))), (None, whole + "\nand more"), (None, "Something else.\n" + whole)]
    cases += [(None, "Copyright notice and this permission notice"), (None, "(c) 2020"), (None, "MIT License")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["digest"], r["license"]) for r in licenses.scan(df).collect()}
    assert [got[i][1] for i in range(len(cases))] == [k for k, _ in cases]
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(cases)])
    assert {r[0]: r[1:] for r in base.execute(queries.oracle_sql()["op8_license_scans"]).fetchall()} == got
