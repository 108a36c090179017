"""Operator 9 against the same models worked out by plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import queries, toxicity
from kinfold.llm.labelled import WordIds

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def texts():
    """Ordinary texts, and toxic ones with two telling words and one telling expression of common words."""
    rng = random.Random(11)
    out = []
    for i in range(500):
        w = [rng.choice(WORDS) for _ in range(rng.randint(15, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(("Blorp,", "snarg!"))
            at = rng.randrange(len(w))
            w[at:at] = ["w1", "w2", "w1"]
        out.append((" ".join(w), int(toxic)))
    return out


def brute(pairs):
    """Probability of a word after another in class 1 or 0, by the rules of the docstring, and what tells."""
    D, words, of, after = toxicity.DISCOUNT, defaultdict(lambda: [0, 0]), [0, 0], defaultdict(lambda: [0.0, 0.0])
    for (u, w), n in pairs.items():
        for c in (0, 1):
            words[w][c] += n[c] > 0
            of[c] += n[c] > 0
            after[u][c] += n[c]
    weight = toxicity.SHARED * min(of)
    shared = {w: sum(n) / sum(of) for w, n in words.items()}
    own = {w: [(max(n[c] - D, 0) + shared[w] * weight) / (of[c] + weight) for c in (0, 1)] for w, n in words.items()}

    def tells(n, share, p):
        both = sum(n)
        return abs(n[1] - both * share) >= toxicity.SURE * math.sqrt(both * share + 0.25) and abs(math.log(p[1] / p[0])) >= toxicity.STRONG

    telling = {w for w, n in words.items() if tells(n, of[1] / sum(of), own[w])}
    rest = [(1 - sum(own[w][c] for w in telling)) / (1 - sum(shared[w] for w in telling)) for c in (0, 1)]

    def lower(c, w):
        return own[w][c] if w in telling else rest[c] * shared[w]

    total = [sum(n[c] for n in pairs.values()) for c in (0, 1)]
    share = total[1] / sum(total)
    higher = {}
    for (u, w), n in pairs.items():
        k = 1 + toxicity.SHARED * min(share, 1 - share) * sum(after[u])
        p = [(max(n[c] - D, 0) + k * (sum(n) - D) / sum(after[u])) / (after[u][c] + k) for c in (0, 1)]
        if tells(n, (after[u][1] + 10 * share) / (sum(after[u]) + 10), p):
            higher[u, w] = p
    left = {u: [(1 - sum(p[c] for (x, _), p in higher.items() if x == u)) / (1 - sum(lower(c, w) for x, w in higher if x == u)) for c in (0, 1)] for u, _ in higher}

    def probability(c, u, w):
        return higher[u, w][c] if (u, w) in higher else left.get(u, [1, 1])[c] * lower(c, w)

    return probability, telling, higher, set(words)


def test_models_are_those_of_plain_python(spark, texts, monkeypatch):
    memory = WordIds()
    rows = spark.createDataFrame(texts, "text string, label int")
    counted = toxicity.contexts(rows)
    pairs = {(r.u, r.w): (r.ordinary, r.toxic) for r in counted.collect()}
    probability, telling, higher, vocabulary = brute(pairs)
    assert {memory[w] for w in ("blorp", "snarg")} <= telling and (memory["w1"], memory["w2"]) in higher
    for u in [toxicity.START, *(memory[w] for w in ("w0", "w1", "w2", "blorp", "snarg"))]:
        for c in (0, 1):
            assert sum(probability(c, u, w) for w in vocabulary) == pytest.approx(1.0)
    model = toxicity.learned(rows)
    docs = rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit("mine").alias("row"), F.lit("mine").alias("u"))
    want = {}
    for r in docs.collect():
        ids = toxicity._ids(r.text.encode(), memory).tolist()
        each = [math.log(probability(1, u, w) / probability(0, u, w)) for u, w in zip([toxicity.START, *ids[:-1]], ids, strict=True)]
        want[r.doc_id] = sum(each) / max(len(ids), toxicity.SHORTEST)
    got = toxicity.evidence(docs, model)
    assert got.columns == ["doc_id", "row", "u", "evidence"]
    assert {r.doc_id: r.evidence for r in got.collect()} == pytest.approx(want)
    monkeypatch.setattr(toxicity, "BROADCAST_ENTRIES", 1)
    got = toxicity.evidence(docs, model)
    assert got.columns == ["doc_id", "row", "u", "evidence"] and got.filter("row <> 'mine'").isEmpty()
    assert {r.doc_id: r.evidence for r in got.collect()} == pytest.approx(want)


def test_counts_of_pairs(spark):
    """A pair counts once a text and once a surrounding, copies and loops not at all."""
    rng = random.Random(3)

    def around(middle):
        return " ".join([*rng.sample(WORDS, 4), middle, *rng.sample(WORDS, 4)])

    copies = [(around("one copy"), 1)] * 30
    near = [(copies[0][0] + f" end{i}", 1) for i in range(30)]
    loop = [("again once " * 50, 1)]
    fixed = [(around("such a fixed form"), 1) for _ in range(12)] + [(around("such a fixed form"), 0) for _ in range(100)]
    rows = spark.createDataFrame(copies + near + loop + fixed, "text string, label int").repartition(7)
    memory = WordIds()
    got = {(r.u, r.w): (r.toxic, r.ordinary) for r in toxicity.contexts(rows).collect()}

    def count(u, w):
        return got[memory[u], memory[w]]

    assert count("one", "copy") == (1, 0) and count("again", "once")[0] <= 1
    assert 8 <= count("a", "fixed")[0] <= 12 and count("a", "fixed")[1] == 100


def test_copies_of_a_toxic_text_blame_no_other(spark, texts):
    """A text with thousands of copies makes its own rare words toxic in no other text."""
    copied = "rare1 rare2 rare3 rare4 " + " ".join(WORDS[:20])
    rows = spark.createDataFrame(texts + [(copied + f" c{i % 3}", 1) for i in range(1000)], "text string, label int")
    model = toxicity.learned(rows)
    other = spark.createDataFrame([(1, "w9 rare1 rare2 rare3 rare4 w8 " * 5), (2, "blorp snarg w3 " * 8)], "doc_id long, text string")
    clean, toxic = (r.evidence for r in toxicity.evidence(other, model).orderBy("doc_id").collect())
    assert clean < 0.1 < toxic


def test_no_labels_and_edges(spark, texts, edge_docs):
    one = spark.createDataFrame([("a b c", 0)], "text string, label int")
    for rows in (one, one.limit(0), spark.createDataFrame([(None, 1), ("", 0)], "text string, label int")):
        model = toxicity.learned(rows)
        assert model.entries is None
        assert {r.evidence for r in toxicity.evidence(edge_docs, model).collect()} == {0.0}
    model = toxicity.learned(spark.createDataFrame(texts, "text string, label int"))
    got = toxicity.evidence(edge_docs, model)
    assert got.count() == edge_docs.count() and got.columns == [c for c in edge_docs.columns if c != "text"] + ["evidence"]
    assert all(r.evidence == 0 for r in got.collect() if r.doc_id in (0, 1, 2, 3))
    assert toxicity.evidence(edge_docs.limit(0), model).count() == 0


def test_query_without_labels(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (queries.op9_toxicity, queries.op4_quality_machine):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == edge_docs.count() and len({r.score for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
