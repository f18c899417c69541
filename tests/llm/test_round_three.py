"""Whitening, the conversation tree and phrase mining against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultlens.llm import chat_tree, phrases, whitening

# Whitening


def plain_whitening(vectors, k):
    """Whole numbers of any size; eigenvectors by NumPy."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = [[n * c - t for c, t in zip(row, s, strict=True)] for row in fit]
    v = np.array([[sum(row[a] * row[b] for row in d) / n**3 for b in range(len(s))] for a in range(len(s))])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    own = {i: [n * c - t for c, t in zip(row, s, strict=True)] for i, row in x.items()}
    return n, {i: sum(c * c for c in row) for i, row in own.items()}, {i: np.array(row, dtype=float) / n @ axes / np.sqrt(values) for i, row in own.items()}, values / np.trace(v)


def check_whitening(spark, vectors, odd=(), k=3):
    df = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>").repartition(3)
    rows = whitening.whiten(df, k).collect()
    n, deviation, white, explained = plain_whitening(vectors, k)
    assert len(rows) == len(vectors) * k
    signs = {}
    for r in rows:
        z = white[r["vec_id"]][r["component"] - 1]
        if abs(z) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(z * r["whitened"]))
        assert (r["n"], int(r["deviation"])) == (n, deviation[r["vec_id"]])
        assert abs(r["whitened"]) == pytest.approx(abs(z), abs=1e-7) and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_against_whole_numbers(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 1 + np.arange(6)).tolist()) for i in range(90)]
    vectors += [(200 + i, vectors[0][1]) for i in range(40)]  # equal vectors count once in the fit
    odd = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [1e30] * 6)]
    check_whitening(spark, vectors, odd)


def test_whitening_of_wide_ranges(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, (rng.normal(0, 1, 5) * [1e9, 1e6, 1e9, 1e3, 1]).tolist()) for i in range(70)])


def test_planes_give_exact_products():
    rng = np.random.default_rng(5)
    for rows, dim, bits in ((1, 1, 1), (63, 3, 7), (65, 4, 20), (130, 5, 52)):
        x = rng.integers(0, 1 << bits, (rows, dim))
        limbs = whitening.scatter(x, bits)
        for i in range(dim):
            for j in range(i, dim):
                assert sum(int(v) << (whitening.LIMB * k) for k, v in enumerate(limbs[i, j])) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True))


def test_whitening_at_its_edges(spark):
    kinds = "vec_id long, embedding array<double>, component string, n string"
    assert whitening.whiten(spark.createDataFrame([], kinds)).collect() == []
    flat = spark.createDataFrame([(None, [1.0, 2.0], "x", "y"), (7, [1.0, 2.0], "x", "y"), (7, [1.0, 3.0], "x", "y"), (8, [5.0], "x", "y")], kinds)
    rows = whitening.whiten(flat).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], int(r["deviation"]), abs(round(r["whitened"], 9))) for r in rows) == [
        (0, 1, 2, 64**2, 1.0), (0, 2, 2, 64**2, 0.0), (7, 1, 2, 64**2, 1.0), (7, 1, 2, 64**2, 1.0), (7, 2, 2, 64**2, 0.0), (7, 2, 2, 64**2, 0.0), (8, 1, 1, 0, 0.0),
    ]
    assert {r["identity_error"] for r in rows if r["vec_id"] == 8} == {None}


# Conversations

TURNS = "conv_id long, turn long, role string, text string"


def plain_digests(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def some_conversations(rng):
    odd = ["", None, "\\", "a\\[INST]", "[INST", "<", "<<", "</s>[INST] ok [/INST]", "<s></s>", "<<SYS>><</SYS>>", "[ROLE]x[SEP]y[/ROLE]", "\U0001f600 é\n\t", "[\\INST]"]
    rows, firsts = [], [[("system", "be brief"), ("user", "hello")], [("user", "hello")], [("user", "<s>hi")]]
    for c in range(60):
        turns = list(rng.choice(firsts)) + [(rng.choice(["user", "assistant", "assistant", "tool", "[SEP]", None]), rng.choice(odd)) for _ in range(rng.randint(0, 4))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(100 + c, t, r, x) for c in range(20) for _, t, r, x in rows[:3]]  # whole copies
    rows += [(300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "user", "a"), (300, None, "user", "c"), (None, 0, "user", "no id"), (None, 1, "assistant", "x")]
    return rows


@pytest.mark.parametrize("tokenizer", [None, chat_tree.TOKENIZER])
def test_conversations_read_back(spark, tokenizer):
    rows = some_conversations(random.Random(11))
    tree = chat_tree.build(spark.createDataFrame(rows, TURNS).repartition(5), tokenizer)
    got = {r[0]: tuple(r)[1:] for r in chat_tree.read_back(tree, tokenizer).collect()}
    want = plain_digests(rows)
    assert {c: v[:4] for c, v in got.items()} == want
    nodes = tree.stream.orderBy("start").collect()
    prefixes = {tuple(own[: k + 1]) for own in _sorted_turns(rows).values() for k in range(len(own))}
    assert len(nodes) == len(prefixes)  # a shared turn stands once
    assert [n["start"] for n in nodes] == list(np.cumsum([0] + [len(n["tokens"]) for n in nodes])[:-1])
    ends = {n["start"] + len(n["tokens"]): k for k, n in enumerate(nodes)}
    starts = {n["start"]: k for k, n in enumerate(nodes)}
    parent = {}
    for k, n in enumerate(nodes):
        # Attention: whole nodes, as many tokens as the position says, each a beginning of the next.
        seen = []
        for s in n["attends"]:
            j = starts[s["start"]]
            while nodes[j]["start"] < s["end"]:
                seen.append(j)
                j += 1
            assert s["end"] in ends
        assert sum(len(nodes[j]["tokens"]) for j in seen) == n["position"]
        parent[k] = seen[-1] if seen else None
        assert seen == ([*_chain(parent, seen[-1]), seen[-1]] if seen else [])
        # Depth first: what stands between a node and its parent hangs on the parent, too.
        assert parent[k] is None or all(parent[k] in _chain(parent, j) for j in range(parent[k] + 1, k))


def _chain(parent, k):
    out = []
    while parent[k] is not None:
        k = parent[k]
        out.append(k)
    return out[::-1]


def _sorted_turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(own)] for c, own in by.items()}


def test_control_strings_never_stand_in_texts():
    rng = random.Random(12)
    for _ in range(2000):
        text = "".join(rng.choice([*chat_tree.CONTROLS, "\\", "<", "[", "INST", "s>", "/", "]", "é"]) for _ in range(rng.randint(0, 6)))
        safe = chat_tree.escaped(text)
        assert chat_tree.unescaped(safe) == text and not any(c in safe for c in chat_tree.CONTROLS)
        for role in ("user", "assistant", "system", "tool", text, ""):
            code = chat_tree.coder(None)
            tokens, a, b = code.turn(role, text, rng.random() < 0.5)
            assert chat_tree.parsed(code.decode(tokens)) == (role, text)
            assert chat_tree.unescaped(code.decode(tokens[a:b])) == (text if role == "assistant" else "")


def test_conversations_at_their_edges(spark):
    empty = chat_tree.build(spark.createDataFrame([], TURNS))
    assert empty.stream.collect() == [] and chat_tree.read_back(empty).collect() == []
    long = [(1, i, "assistant" if i % 2 else "user", "word " * 40_000 + "x" * 200_000) for i in range(3)]
    tree = chat_tree.build(spark.createDataFrame([(*r, "a", "b") for r in long], TURNS + ", key string, tokens string"))
    assert {r[0]: tuple(r)[1:5] for r in chat_tree.read_back(tree).collect()} == plain_digests(long)


# Phrases


def plain_collocations(rows, support, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        covered = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * found[p[i : i + k]]}
        rank = []
        for p, a in found.items():
            if p not in covered:
                score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def some_texts(rng):
    words = ["The", "a", "of", "naïve", "ΑΒΓ", "x-ray", "in", "spite", "New", "York", "#1", "\x00odd"]
    phrase = [["in", "spite", "of"], ["New", "York"], ["of", "the", "a", "x-ray"], ["a", "a", "a"]]
    rows = []
    for k in range(160):
        text = []
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(phrase) if rng.random() < 0.3 else [rng.choice(words)]
            text.append(rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " "]))
            text.insert(-1, " ")
        rows.append((k, "".join(t if t.isspace() or t in ".," else t + " " for t in text), rng.choice(["en", "en", "fr", None, ""])))
    rows += [(k, "In spite of all, New York", "en") for k in range(40)]
    return rows + [(None, None, "en"), (None, "", None), (3, " . ", "xx"), (3, "one", "yy")]


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_against_single_loops(spark, tmp_path, shards):
    rows = some_texts(random.Random(13))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, phrase string")
    df.repartition(7).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = plain_collocations([r[1:] for r in rows], 12, 25)
    assert len(want) > 40
    assert sorted(map(tuple, phrases.collocations(docs, 12, 25, shards).collect())) == want
    assert sorted(map(tuple, phrases.collocations(docs, 12, 25, shards, bits=6).collect())) == want  # bitmaps that let all through


@pytest.mark.parametrize("limit", [1, 2, 5, 17, 60, 1 << 20])
def test_texts_are_cut_without_loss(limit):
    for text, _ in [r[1:] for r in some_texts(random.Random(14))[:60] if r[1]]:
        got, want = Counter(), Counter()
        for ids, words, fresh in phrases.numbered(text.encode(), limit):
            for k, at, _, _ in phrases.grown(ids, phrases.hashed(words, "en"), [], phrases.LONGEST):
                got.update(b" ".join(words[i] for i in ids[a : a + k]).decode() for a in at[at + k > fresh])
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        assert got == want


def test_words_are_numbered_and_hashed_at_once():
    """Each pass does this to every text: a step of Python for each word was most of what op13 took. Tells it by the time of such steps."""
    rng = random.Random(15)
    own = ["w%x" % rng.getrandbits(24) for _ in range(40_000)]
    text = " ".join(own[min(int(rng.expovariate(1 / 6000)), 39_999)] + rng.choice(["", "", "", "."]) for _ in range(300_000)).encode()

    def plain():
        numbers = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in text.translate(phrases.FOLD).replace(phrases.STOP, b" \xff ").split()]
        return np.array(ids), np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    both = [(took(lambda: [phrases.hashed(words, "en") for _, words, _ in phrases.numbered(text)]), took(plain)) for _ in range(7)]
    assert min(b[0] for b in both) < 0.7 * min(b[1] for b in both)


def test_long_words_have_hashes_of_their_own():
    words = [b"x" * n for n in (1, 63, 64, 65, 66, 3 << 20)] + [b"x" * 65 + b"y", b"y" + b"x" * 65, "ΑΒΓ".encode()]
    apart = np.concatenate([phrases.hashed([w], "en") for w in words])
    assert phrases.hashed(words, "en").tolist() == apart.tolist()
    assert len(set(apart.tolist()) | set(phrases.hashed(words, "fr").tolist())) == 2 * len(words)
    assert [(ids.tolist(), found, fresh) for ids, found, fresh in phrases.numbered(b"  A\t" + words[5] + b" ,a .", 1 << 30)] == [([0, 1, -1, 0, -1], [b"a", words[5]], 0)]


def test_collocations_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b " * 20, "en")], docs.schema)).select("phrase", "a", "l", "r", "n", "score").collect() == []
    hot = spark.createDataFrame([(1, "a b, " * 40_000, "en")], docs.schema)
    assert [tuple(r) for r in phrases.collocations(hot).collect()] == [("en", 1, "a b", 40_000, 40_000, 40_000, 80_000, 1_000_000)]


def test_scores_are_exact_beyond_longs(spark):
    a = 9_000_000_000_000
    found = spark.createDataFrame([("en", "x", 1, a + 1), ("en", "y", 1, a + 2), ("en", "x y", 2, a)], "lang string, phrase string, k int, f long")
    assert phrases.scored(found).select("score").first()[0] == 2_000_000 * a // (2 * a + 3)
    assert phrases.uncovered(phrases.scored(found)).select(F.col("a")).first()[0] == a
