"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from . import chat_tree, jaccard_join, language_id, licenses, mixing, packing, phrases, quality_classifier, quality_rules, secrets, topk, url_filters, whitening
from .common import crc_mod, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).where(crc_mod(F.col("doc_id"), 4) != 2)
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in secrets.PATTERNS], F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_mod(F.col("doc_id"), 5) == 0
    models = language_id.fit(docs.select("doc_id", "text", "lang").where(~out))
    return language_id.predict(docs, models).withColumn("held_out", F.coalesce(out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), carry=False)
    return judged.select("doc_id", *quality_rules.MEASURES, "kept")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(spark, url_filters.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_tree.read_back(chat_tree.build(rows.union(chat_tree.template_case(spark, rows))))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_classifier, op2_exact_topk, op3_mixing, op4_secret_scans, op5_jaccard_join,
        op6_best_fit_packing, op7_language_id, op8_license_scans, op9_quality_rules, op10_url_filters,
        op11_embedding_whitening, op12_chat_formatting, op13_phrase_collocations,
    ]
    return {f.__name__: f for f in own}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, source, t, w, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END AS g FROM w
), e AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM e),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) o(k) WHERE n >= 2 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM g),
m AS (
  SELECT g.doc_id, g.source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM g JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 30 * n_words) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT least(greatest(avg(k / n), 0.001), 0.999) AS mean, coalesce(var_samp(k / n), 0) AS var, avg(1.0 / n) AS inv FROM h),
b AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 0.0001) - 1, 2), 10000) AS strength FROM s),
v AS (SELECT source, round((k + mean * strength) / (n + strength), 9) <= 0.6 AS ok FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, TRUE) AS kept
FROM f LEFT JOIN v USING (source)
"""

URL_SQL = """
WITH rules(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM a
), n AS (SELECT *, row_number() OVER () AS row FROM p),
m AS (
  SELECT n.page_id, n.host, n.path, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY n.row ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.action DESC) AS i
  FROM n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE i = 1
"""


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) own(conv_id, turn, role, text)
), e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + length(regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[SEP\]|\[/ROLE\])', '\1+', 'g')) - length(text) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 15 ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
e AS (SELECT lang, id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM w),
m AS (SELECT lang, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c, lead(a, 3) OVER s AS d FROM e WINDOW s AS (PARTITION BY id ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, a AS phrase FROM m UNION ALL SELECT lang, 2, a || ' ' || b FROM m WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM m WHERE c IS NOT NULL UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM m WHERE d IS NOT NULL
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
u AS (
  SELECT c.*, cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN (VALUES (1), (2), (3)) s(cut) ON cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut+1:c.k], ' ')
), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, array_to_string(w[i:i+j-1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (2), (3)) s(j), (VALUES (1), (2), (3)) h(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL
), k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN t USING (lang) QUALIFY rank <= 2000
"""


def _license_sql() -> str:
    def lower(text: str) -> str:
        return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    kind = (
        f"CASE WHEN regexp_matches(x, '{licenses.BLANK}') THEN 'b' WHEN regexp_matches(x, '{licenses.NOTICE}') THEN 'n' "
        f"WHEN regexp_matches(x, '{licenses.NAMED}') AND NOT regexp_matches(x, '{licenses.CLAUSE}') THEN 'c' ELSE 't' END"
    )

    def canonical(text: str) -> str:
        t = f"' ' || regexp_replace({text}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' '"
        for a, b in licenses.SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"regexp_replace(trim(regexp_replace({t}, ' +', ' ', 'g')), '{licenses.TITLE}', '')"

    def digests(source: str, key: str, text: str) -> str:
        return (
            f"SELECT {key}, sha256({canonical('body')}) AS digest FROM (SELECT {key}, array_to_string(list_filter(l, lambda x, i: substr(k, i, 1) <> 'n'), chr(10)) AS body FROM ("
            f"SELECT {key}, l, array_to_string(list_transform(string_split(array_to_string(list_transform(l, lambda x: {kind}), ''), 'b'), lambda p: CASE WHEN contains(p, 't') THEN p ELSE replace(p, 'c', 'n') END), 'b') AS k "
            f"FROM (SELECT {key}, string_split({lower(text)}, chr(10)) AS l FROM {source})))"
        )

    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())
    made = ", ".join(f"('{k}', '{v}')" for k, v in licenses.DIGESTS.items())
    return (
        f"WITH k(license, body) AS (VALUES {known}), m(license, digest) AS (VALUES {made}), "
        f"a AS ({digests('k', 'license', 'body')} UNION ALL SELECT license, digest FROM m), d AS (SELECT digest, min(license) AS license FROM a GROUP BY 1), "
        f"t AS ({digests('documents', 'doc_id', 'text')}) SELECT doc_id, digest, license FROM t LEFT JOIN d USING (digest)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": TOPK_SQL, "op8_license_scans": _license_sql(), "op9_quality_rules": RULES_SQL, "op10_url_filters": URL_SQL, "op12_chat_formatting": CHAT_SQL, "op13_phrase_collocations": PHRASES_SQL}
