"""CSV files, requests and streams."""

import pytest
from leads import frame

from kinfold.operators import records
from kinfold.config import Config
from kinfold.sources import csv, rows, sinks
from kinfold.streaming import ingest

TEXT = '﻿First Name,Last Name,E-mail Address,Direct Dial,Email Opt Out,Notes\r\nAnn,"Lee, Jr",ann@x.example,555-010-0000,yes,"two\nlines"\r\n,,,,,\r\nBob,"O""Neil",bob@x.example\r\n'


def test_parse():
    assert csv.parse('a,b\r\n"x ""y""",ab"c"d\n\n , \r"open, to the end') == [["a", "b"], ['x "y"', "abcd"], ["open, to the end"]]
    assert csv.parse("") == []
    table = [["a,b", 'q"', "line\nbreak"], ["", "x", "y"]]
    assert csv.parse("".join(",".join(map(sinks.csv_cell, r)) + "\r\n" for r in table)) == table


def test_mapping():
    found = csv.guess(["Email Opt Out", "Email", "Account Name", "Company Website", "Last Modified", "Lead Source", "Job Title"])
    assert found == {"email": 1, "company": 2, "website": 3, "updated_at": 4, "source": 5, "title": 6}


def test_lead_file(spark, tmp_path):
    file = csv.read_text(spark, TEXT)
    got = {r.id: r for r in file.rows.collect()}
    assert sorted(got) == ["r1", "r2"] and got["r2"].last_name == 'O"Neil' and got["r2"].phone is None
    assert got["r1"].raw["Notes"] == "two\nlines" and file.unmapped == ["Email Opt Out", "Notes"]
    (tmp_path / "leads.csv").write_text(TEXT, newline="")
    assert csv.read_file(spark, str(tmp_path / "leads.csv")).rows.count() == 2
    folder = csv.read_folder(spark, str(tmp_path))
    assert {r.id for r in folder.collect()} == {"leads.csv:r1", "leads.csv:r2"}


def test_requests(spark):
    given, config, decided = rows.request(spark, {"rows": [{"id": "1", "mapped": {"email": "a@b.example"}}], "config": {"max_block_size": 5}, "constraints": [{"kind": "link", "a": "1", "b": "2"}]})
    assert given.count() == 1 and config.max_block_size == 5 and decided.first().by == "human"
    for bad in ({}, {"rows": []}, {"csv": ""}, {"rows": [{"id": ""}]}, {"rows": [{"id": "1"}], "constraints": [{"kind": "maybe", "a": "1", "b": "2"}]}):
        with pytest.raises(ValueError):
            rows.request(spark, bad)


def test_stream_links_batches(spark, tmp_path):
    every = frame(spark)
    for part, ids in (("1", ("a01", "b01")), ("2", ("a02", "b02", "c01"))):
        every.filter(every.id.isin(*ids)).coalesce(1).write.mode("append").json(str(tmp_path / "in" / part))
    stream = spark.readStream.schema(every.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ingest.link_stream(ingest.normalized_stream(stream), str(tmp_path / "store"), str(tmp_path / "edges"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    edges = spark.read.parquet(str(tmp_path / "edges")).filter("route = 'accepted'")
    assert {(r.a, r.b) for r in edges.collect()} == {("a01", "a02"), ("b01", "b02")}


def test_notes(spark):
    found = records.notes(records.normalized(frame(spark), Config())).filter("id = 'a02'").collect()
    assert {(r.field, r.rule) for r in found} >= {("email", "tag dropped: it is the same mailbox")}
