"""Operators 1, 2, 4, 6 and 9, and the pipeline."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import labelled, mixing, pii, quality, queries, rules

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_spans_match_patterns():
    rng = random.Random(3)
    pieces = [*"a1 9@.+-()%_é0\n", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", "@@", "..", "255."]
    for _ in range(8000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert [s for s in pii.find(text) if s[0] in BASE] == base_spans(text), text


def test_other_spans_and_redaction():
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" https://bob:pw1@x.org/a IBAN DE89 3704 0044 0532 0130 00 Account no. 12345678 by the accountant'
    assert pii.redacted(text, pii.find(text)) == 'token = "[SECRET]" https://[ADDRESS]/a IBAN [ACCOUNT] Account no. [ACCOUNT] by the accountant'
    assert pii.find("an ordinary account of 3 tokens: nothing secret.") == []


def test_long_numbers():
    assert pii.find("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]
    assert pii.find("1" * 5000 + ".1.2.3") == [] and pii.find("256.1.2.3") == []


def test_pii_edges(edge_docs):
    assert pii.redact(edge_docs).filter("text IS NULL").count() == 1
    assert pii.spans(edge_docs).columns == edge_docs.columns
    assert pii.spans(edge_docs.limit(0)).count() == 0


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, edge_docs):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "#", "|", "é", "\t", "a b c d e ", "x y\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    got = rules.statistics(rows.withColumn("again", F.col("text"))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.again or "")


@pytest.fixture(scope="module")
def graded(spark):
    """Clean, symbol-ridden and insulting texts, some with labels."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        junk, rude = i % 5 == 0, i % 7 == 0
        if junk:
            w = [x + rng.choice(("***", "&&&", "$$$")) for x in w]
        if rude:
            w[rng.randrange(len(w))] = rng.choice(("blorp", "snarg"))
            w[rng.randrange(len(w))] = "snarg"
        docs.append((i, " ".join(w) + ".", "en", f"src{i % 4}", 0))
        labels.append((i, int(not junk), int(rude)))
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return made


def test_rules(graded):
    docs, labels = graded
    found, learned = rules.judged(docs, labels)
    assert learned and {str(c).split()[0] for r in learned for c in r} <= set(rules.SHARES)
    rejected = {r.doc_id for r in found.filter("rejected_by IS NOT NULL").collect()}
    assert rejected == {i for i in range(400) if i % 5 == 0}
    assert rules.judged(docs, labels.limit(0))[1] == []
    assert rules.judged(docs.limit(0), labels)[0].count() == 0


def held_out(spark, query, graded, edge_docs, tmp_path, column):
    docs, labels = graded
    docs.unionByName(edge_docs.select(docs.columns).filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 5000)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    truth = [(got[r.doc_id], r[column]) for r in labels.collect()]
    tested = [(r, y) for r, y in truth if r.held_out]
    assert len(tested) > 50 and all(0 <= r.score <= 1 for r in got.values())
    return sum(r.predicted == y for r, y in tested) / len(tested), got


def test_quality(spark, graded, edge_docs, tmp_path):
    accuracy, got = held_out(spark, queries.op4_quality_machine, graded, edge_docs, tmp_path, "quality")
    assert accuracy > 0.95 and len(got) == 412


def test_machine_in_linear_time():
    import numpy as np

    m = quality.Machine()
    m.linear += 0.1
    n, x = np.array([3, 50, 9000]), np.array([0.5, -1.0, 2.0])
    pairs = sum(float(m.factors[n[i]] @ m.factors[n[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(n, x) == pytest.approx(m.bias + 0.1 * x.sum() + pairs)


def test_words_without_a_letter_are_counted_in_the_whole_text():
    def bare(words):
        return quality.features(" ".join(words).encode(), quality.Buckets())[1][-2]

    assert all(bare(["word", "|"] * k) == pytest.approx(1.0) for k in (10, 300, 400, 599, 5000))
    assert bare(["word"] * 1601 + ["|"] * 3 + ["word"] * 396) == pytest.approx(2 * 3 / 2000)
    found, _ = quality.features(b"one 12 | two", quality.Buckets())
    assert (found < quality.BUCKETS).sum() == 4 and len(found) == 4 + quality.STATISTICS


def test_toxicity(spark, graded, edge_docs, tmp_path):
    accuracy, got = held_out(spark, queries.op9_toxicity, graded, edge_docs, tmp_path, "toxic")
    assert accuracy > 0.95 and got[5001].score < 0.5 and len(got) == 412


def test_platt_and_folds(spark):
    a, b = labelled.platt([(0.0, 0.0, 90.0), (1.0, 10.0, 0.0)])
    assert a > 0 and 1 / (1 + 2.718281828 ** -(a + b)) > 0.8
    assert labelled.platt([]) == (0.0, 0.0)
    got = spark.createDataFrame([(7,), (None,)], "doc_id long").select(labelled.fold(F.col("doc_id"), 5)).collect()
    import zlib

    assert [r[0] for r in got] == [zlib.crc32(b"7") % 5, 0]


#: Names that operators use or return.
CLASHES = ("size", "target", "base", "threshold", "copies", "taken", "mark", "of", "row", "hash", "copy", "mix", "found")


def test_mix(spark, edge_docs):
    rng = random.Random(6)
    sizes = {"a": 900, "b": 60, "c": 300, None: 200}
    rows = [(i, " ".join(["w"] * rng.randint(0, 12)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("mine"))
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c not in ("text", "mix")] + ["mix"]
    assert mixed.filter(" OR ".join(f"{c} <> 'mine'" for c in CLASHES if c != "mix")).isEmpty()
    got = mixed.select("doc_id", "source", "mix.*").collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.mix.taken) for r in mixing.mix(docs.repartition(5)).collect())
    total = Counter()
    for r in got:
        total[r.source] += r.size
    weights, capped = {"a": 5, "b": 2, "c": 1, None: 5}, set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in weights if s not in capped and weights[s] * level > 2 * total[s]}
        if not more:
            break
        capped |= more
    for s in weights:
        mine = [r for r in got if r.source == s]
        target = 2 * total[s] if s in capped else weights[s] * level
        assert mine[0].target == pytest.approx(target) and mine[0].source_size == total[s]
        assert abs(sum(r.taken for r in mine) - target) <= 12 and all(r.taken <= 2 * r.size for r in mine)
    taken = mixing.repeated(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert taken.filter(" OR ".join(f"{c} <> 'mine'" for c in CLASHES)).isEmpty()
    assert Counter(r.doc_id for r in taken.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(edge_docs).count() == edge_docs.count() and mixing.mix(edge_docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, edge_docs, tmp_path, name):
    """On the smallest tables, and on them with edge texts whose ids are made unique."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    edge = edge_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 100000).alias("doc_id"), "text", "source")
    docs.unionByName(edge).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for table in ("embeddings", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(tuple(row[columns.index(c)] for c in sorted(columns)) for row in result.fetchall())
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in sorted(columns)) for r in found.collect()) == want


def test_pipeline(spark, graded, tmp_path):
    docs, labels = graded
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i in range(400) if i % 5}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= kept and out.count() > 0


def test_pipeline_takes_five_words(spark):
    """Three words of 130 differ: alike by four words (115 of 139), not by five (111 of 141)."""
    words = [f"w{i}" for i in range(130)]
    other = [f"x{i}" if i in (30, 60, 90) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words))], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_leaving_out_the_pipeline(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "op1_quality_rules" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.setitem(sys.modules, "kinfold.llm", None)
    names = entry.queries()
    assert "clean_people" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
