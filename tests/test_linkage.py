"""The whole run on labelled leads, and what must hold whatever the input."""

import json
import random

import pytest
from leads import COLUMNS, ROWS, frame

from kinfold.config import Config
from kinfold.operators import metrics
from kinfold.operators.clustering import components, replay
from kinfold.plans.clean import clean, content_hash, latest_decisions
from kinfold.sources import rows as R
from kinfold.sources import sinks


@pytest.fixture(scope="module")
def run(spark):
    return clean(frame(spark))


def members(result):
    return {r.id: r.member_ids for r in result.clusters.collect()}


def test_merges_and_keeps_apart(run):
    found = members(run)
    assert found["c-a01"] == ["a01", "a02", "a03"] and found["c-b01"] == ["b01", "b02"] and found["c-i01"] == ["i01", "i02"]
    assert all(len(v) == 1 for k, v in found.items() if k not in ("c-a01", "c-b01", "c-i01"))
    assert {(r.a, r.b) for r in run.refused.collect()} == {("c01", "c02"), ("f01", "f02")}
    assert {r.id for r in run.quarantined.collect()} == {"h01", "h02", "h03", "h04"}


def test_review_queue(run):
    queue = {(r.a, r.b): r.score for r in run.review.collect()}
    assert queue[("g01", "g03")] == pytest.approx(0.9)
    for r in run.review.collect():
        assert sum(x.weight or 0 for x in r.reasons) == pytest.approx(r.score)


def test_survivors(run):
    amos = next(r for r in run.clusters.collect() if r.id == "c-i01")
    assert (amos.title, amos.phone) == ("Owner", "+15550103301")
    assert amos.provenance.title.rule.startswith("the most trusted source")
    assert [(c.id, c.value) for c in amos.provenance.title.conflicts] == [("i01", "Founder")]


def test_metrics_and_accounting(run):
    m = run.metrics
    assert m["groundTruth"]["autoPrecision"] == 1.0 and m["groundTruth"]["truePairs"] == 8
    assert sum(map(len, members(run).values())) + m["quarantined"] == m["rowsIn"] == len(ROWS)
    assert m["comparisonRatio"] < 0.2 and "22 rows" in run.summary()


def test_order_does_not_matter(spark, run):
    mixed = list(ROWS)
    random.Random(1).shuffle(mixed)
    again = clean(frame(spark, mixed).repartition(3))
    assert sinks.audit(again) == sinks.audit(run)


def test_blocking_loses_nothing(spark, run):
    whole = clean(frame(spark), Config(blocking=False))
    assert members(whole) == members(run)
    assert {(r.a, r.b) for r in whole.review.collect()} == {(r.a, r.b) for r in run.review.collect()}


def test_decisions(spark):
    decide = R.decisions(spark, [
        {"kind": "must-not-link", "a": "a03", "b": "a01"}, {"kind": "link", "a": "g03", "b": "g01"}, {"kind": "link", "a": "e01", "b": "d01"},
        {"kind": "link", "a": "c01", "b": "c02"}, {"kind": "link", "a": "nobody", "b": "a01"},
    ])
    run = clean(frame(spark), constraints=decide)
    found = {r.id: (r.member_ids, r.strength) for r in run.clusters.collect()}
    assert found["c-a01"][0] == ["a01", "a02"] and found["c-a03"][0] == ["a03"]
    assert found["c-g01"] == (["g01", "g03"], "human-linked") and found["c-d01"] == (["d01", "e01"], "human-linked")
    assert found["c-c01"][0] == ["c01"]  # a rule's refusal of a proposed pair beats a link


def test_replay_honours_decisions():
    root, refused = replay([("a", "b", 1.0), ("b", "c", 0.9)], [("a", "c")])
    assert root == {"a": "a", "b": "a", "c": "c"} and refused == [("b", "c", "a and c")]


def test_long_chain(spark):
    names = [f"n{i:05d}" for i in range(400)]
    shuffled = list(names)
    random.Random(2).shuffle(shuffled)
    chain = spark.createDataFrame(list(zip(shuffled, shuffled[1:], strict=False)), "a string, b string")
    assert {r.component for r in components(chain).collect()} == {names[0]}


def test_empty_and_bad_input(spark):
    run = clean(frame(spark, []) if False else frame(spark).limit(0))
    assert run.metrics["dedupRate"] == 0 and run.metrics["comparisonRatio"] == 1 and "groundTruth" not in run.metrics
    with pytest.raises(ValueError, match="unique"):
        clean(frame(spark, [ROWS[0], ROWS[0]]))
    with pytest.raises(ValueError, match="review_threshold"):
        Config(review_threshold=1.5)
    with pytest.raises(ValueError, match="no such setting"):
        Config().with_changes({"nonsense": 1})


def test_block_cap(spark):
    many = [(f"x{i}", "Same Name", None, None, "One Firm", None, None, None, None) for i in range(6)]
    run = clean(frame(spark, many), Config(max_block_size=3))
    assert run.metrics["comparisons"] == 0 and {b["size"] for b in run.metrics["skippedBlocks"]} == {6}


def test_sinks(spark, run, tmp_path):
    text = sinks.csv_text(sinks.cleaned(run))
    assert text.count("\r\n") == 1 + 14 + 4 and text.startswith("person_id,status,")
    review = sinks.review(run)
    assert review.columns == list(sinks.REVIEW) and review.first().score == "0.900"
    audit = json.loads(sinks.audit(run))
    assert audit["runHash"] == run.run_hash and len(audit["clusters"]) == 14
    filled = review.replace({"": "link"}, subset=["decision"])
    assert sinks.decided(spark, filled).count() == review.count()
    sinks.write_csv(review, str(tmp_path / "review"))
    assert spark.read.option("header", True).csv(str(tmp_path / "review")).count() == review.count()


def test_response(spark):
    rows, config, decisions = R.request(spark, {"csv": "Name,Email\nNora Whitfield,nora@mailbox.example\nN. Whitfield,Nora+x@mailbox.example\n", "config": {"review_threshold": 0.9}})
    said = sinks.response(clean(rows, config, decisions))
    assert json.loads(json.dumps(said)) == said and said["config"]["reviewThreshold"] == 0.9
    assert [c["member_ids"] for c in said["clusters"]] == [["r1", "r2"]] and said["metrics"]["decisions"] == {"link": 0, "must-not-link": 0}
    assert said["files"]["cleaned.csv"].count("\r\n") == 2 and said["files"]["review.csv"].count("\r\n") == 1


def test_merged_only(run):
    assert {r.id for r in run.merged.collect()} == {"c-a01", "c-b01", "c-i01"}


def test_hash_and_upserts(spark):
    assert content_hash("") == content_hash("") != content_hash([])
    assert content_hash({"b": 1, "a": 2.0}) == content_hash({"a": 2, "b": 1})
    said = spark.createDataFrame([("link", "a", "b", 1), ("must-not-link", "b", "a", 2), (None, "c", "d", 4), ("link", "c", "d", 3)], "kind string, a string, b string, at int")
    assert [(r.kind, r.a) for r in latest_decisions(said, "at").collect()] == [("must-not-link", "b")]


def test_ratios_without_pairs(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert metrics.precision_recall(none, none) == (1.0, 1.0)
    assert len(COLUMNS) == 9
