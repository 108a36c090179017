"""The queries ``op1_`` to ``op10_``: each operator over its whole table, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, labelled, minhash, mixing, neighbours, pii, quality, records, rules, toxicity
from kinfold.llm._shared import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base checks, and the verdict of a learned list of rules."""
    found, _ = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data in every text, all spans, and a digest of the base kinds' spans."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = pii.KINDS[:4]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*base))), 256)
    return found.select("doc_id", *map(number, base), digest.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every vector and its class of near duplicates."""
    found = neighbours.classes(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_quality_machine(spark: SparkSession, sf_dir: str, folds: int = 5, held: int = 0, limit: float = 0.3, sample: int = quality.SAMPLE) -> DataFrame:
    """Every document's quality, learned from at most ``sample`` labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = labelled.fold(F.col("doc_id"), folds)
    machine = quality.learn(labelled.teaching(docs, table(spark, sf_dir, "labels"), "quality", fold != held, sample))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op5_token_records(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write every text's identifiers to record files and describe what is read back."""
    folder = shared_dir(spark)
    records.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, path or public_tokenizers.path(WORD_BPE))
    return records.read(spark, folder).select(
        F.col("id").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op7_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the identifiers of every text and of the text decoded from them."""
    path = path or public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.encode_and_decode(docs, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, and whether it is over ``limit`` tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = bpe.count(docs, path or public_tokenizers.path(BYTE_BPE))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str, folds: int = 3, held: int = 1, limit: float = 0.7) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    teaches = labelled.fold(F.col("doc_id"), folds) != held
    rows = labelled.teaching(docs, labels, "toxic", teaches)
    marks = labels.filter(teaches & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.score(docs, rows, marks).select(
        "doc_id",
        (labelled.fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's set of shingles and its class of near duplicates."""
    found = minhash.classes(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


# --- parts of operators that SQL can say ------------------------------------------------------


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 1 counts of every text, and its base checks."""
    return op1_quality_rules(spark, sf_dir).drop("kept", "rejected_by")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind operator 2 finds in every text."""
    return op2_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of operator 6."""
    return op6_source_mix(spark, sf_dir).drop("taken")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_pii_spans,
        op3_nn_descent,
        op4_quality_machine,
        op5_token_records,
        op6_source_mix,
        op7_bpe_codec,
        op8_token_counts,
        op9_toxicity,
        op10_minhash_dedup,
        text_counts,
        pii_counts,
        mix_targets,
    )
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_REACH = "reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN ties e ON r.other = e.a), least_ AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT)
  ELSE 2 * CAST(substr(reverse(d), i, 1) AS INT) - CASE WHEN CAST(substr(reverse(d), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END))"""
_DIGITS = "list_transform(regexp_extract_all(coalesce(text, ''), '{0}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "op3_nn_descent": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
        embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound FROM embeddings),
      ties AS (SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.id <> q.id AND p.sound AND q.sound AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.95), {_REACH}
      SELECT id AS vec_id, (SELECT count(*) FROM ties WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM least_""",
    "op10_minhash_dedup": f"""WITH RECURSIVE cut AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM cut),
      one AS (SELECT id, len(s) AS n, unnest(s) AS s FROM nodes),
      met AS (SELECT p.id AS a, q.id AS b, p.n AS n, q.n AS m, count(*) AS both_ FROM one p JOIN one q ON p.s = q.s AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n),
      ties AS (SELECT a, b FROM met WHERE 100 * both_ >= 80 * (n + m - both_)), {_REACH}
      SELECT l.id AS doc_id, len(s) AS n_shingles, component AS component_id, l.id = component AS kept FROM least_ l JOIN nodes USING (id)""",
    "text_counts": f"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
      lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM cut),
      wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS k FROM cut),
      again AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
      covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY doc_id),
      n AS (SELECT c.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM cut c JOIN lines USING (doc_id) LEFT JOIN covered v USING (doc_id))
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n""",
    "pii_counts": f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')) AS n_email,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 0) > 255)) = 0)) AS n_ip,
      len(list_filter({_DIGITS.format('[0-9]([ -]?[0-9])+')}, lambda d: length(d) BETWEEN 13 AND 19 AND {_LUHN} % 10 = 0)) AS n_card,
      len(list_filter({_DIGITS.format('[+][0-9][ ().0-9-]+[0-9]')}, lambda d: length(d) BETWEEN 9 AND 15)) AS n_phone FROM documents""",
    "mix_targets": f"""WITH sized AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
      w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * CAST(source_size AS DOUBLE) AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM s),
      o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM w),
      r AS (SELECT o.*, (whole - coalesce((SELECT sum(cap) FROM o p WHERE p.k < o.k), 0)) / (SELECT sum(w) FROM o p WHERE p.k >= o.k) AS each FROM o),
      l AS (SELECT (SELECT each FROM r WHERE cap > each * w ORDER BY k LIMIT 1) AS level)
      SELECT doc_id, size, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source, l""",
}
