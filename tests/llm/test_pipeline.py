import os
import random

import numpy as np
import pytest

import corpus_pipeline
from faultlens.llm import quality_rules, queries

from .test_operators import WORDS, plain_join, plain_measures, plain_spans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_columns(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    words = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    texts = [words, words.replace("word79", "last"), "short", other + " token = abcdef0123456789abcdef", other.upper() + " idiot " * 2, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, other[::-1], None, None, None)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOCS)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {0, 1, 3, 4, None}
        elif name == "ngram_jaccard_join":
            assert set(after) == {0, 3, None}
        elif name == "secret_scans":
            assert after[3].endswith(" [SECRET]") and after[0] == before[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, packed.collect())) != []


def test_stages_against_plain_versions(spark, tmp_path):
    """The first three stages, each on what the one before kept, with a good and a bad source, groups of copies and secrets."""
    rng = random.Random(41)
    texts, sources = [], []
    for k in range(60):
        base = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randint(45, 160))]
        if k % 5 == 0:
            base[10:10] = ["password:", f"{rng.getrandbits(64):016x}", "key", "AKIA" + "ABCD0123" * 2]
        for c in range(1 + (k % 4 == 0) * rng.randint(1, 4)):
            text = list(base)
            if c:
                text[rng.randrange(len(text))] = "changed"
            texts.append(" ".join(text) if k % 7 else " ".join(text[:12] * 9))
            sources.append("farm" if k % 6 == 0 else f"s{k % 3}")
    for k in range(30):
        texts.append("spam " * 60)
        sources.append("farm")
    texts += [None, ""]
    sources += [None, "s1"]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)
    failed = [plain_measures(t)[-1] for t in texts]
    each = {s: [f for f, own in zip(failed, sources, strict=True) if own == s] for s in set(sources) - {None}}
    rates = np.array([np.mean(v) for v in each.values()])
    mean = min(max(rates.mean(), 1e-3), 1 - 1e-3)
    between = max(rates.var(ddof=1) - mean * (1 - mean) * np.mean([1 / len(v) for v in each.values()]), 1e-4)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    gone = {s for s, v in each.items() if (sum(v) + mean * strength) / (len(v) + strength) > quality_rules.HOST_FAILURE_RATE}
    assert gone == {"farm"}
    want = {i for i, (f, s) in enumerate(zip(failed, sources, strict=True)) if not f and s not in gone}
    docs = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == want and len(want) > 30
    linked, near = plain_join([(i, texts[i]) for i in sorted(want)], 5, 80)
    docs = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = {c for _, c in linked.values()}
    assert {r["doc_id"] for r in docs.collect()} == want and near > 5
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.redaction(spark, docs, str(tmp_path)).collect()}
    for i in want:
        text = texts[i]
        for kind, start, end in reversed([x.split(":") for x in plain_spans(text).split(",") if x]):
            if kind != "hex" or "assign" not in plain_spans(text):
                text = text[: int(start)] + "[SECRET]" + text[int(end) :]
        assert after[i] == text


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_input(spark, tmp_path, k):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], DOCS)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.collect() == [] and (k == 4 or out.columns == docs.columns)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    r = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    rows = sorted(str([v[c] for c in columns]) for v in got.collect())
    assert rows == sorted(str([v[names.index(c)] for c in columns]) for v in r.fetchall())
