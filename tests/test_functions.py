"""Scalar functions against published values and cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.functions import similarity as S


@pytest.mark.parametrize(
    ("a", "b", "jaro", "winkler"),
    [("martha", "marhta", 0.944, 0.961), ("dixon", "dicksonx", 0.767, 0.813), ("dwayne", "duane", 0.822, 0.840), ("crate", "trace", 0.733, 0.733), ("", "", 1, 1), ("a", "", 0, 0)],
)
def test_jaro_published(a, b, jaro, winkler):
    assert S.jaro(a, b) == pytest.approx(jaro, abs=5e-4)
    assert S.jaro(b, a) == pytest.approx(S.jaro(a, b))
    assert S.jaro_winkler(a, b) == pytest.approx(max(winkler, jaro), abs=5e-2)


def test_token_sets():
    assert S.token_set("acme tool works", "works acme tool")[:2] == (1.0, 1.0)
    assert S.token_set("acme", "acme global holdings")[:2] == (pytest.approx(1 / 3), 1.0)
    assert S.token_set("acme systems", "apex systems")[0] == 0.5
    assert S.token_set("", "acme") == (0.0, 0.0, [])


def values(spark, column, *cells):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, raw string")
    return [r.out for r in frame.select("i", column(F.col("raw")).alias("out")).orderBy("i").collect()]


def test_soundex(spark):
    words = {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555", "Lee": "L000", "Washington": "W252", "李": ""}
    assert values(spark, S.soundex, *words) == list(words.values())


def test_email(spark):
    got = values(spark, N.email, " B.Reyes+list@Gmail.com ", "mailto:info@acme.example", "Ann <ann@acme.example>", "no at sign", "n/a", None, "+@gmail.com", "a@b@c.example", "no-reply@x.example")
    assert [r.canonical for r in got] == ["breyes@gmail.com", "info@acme.example", "ann@acme.example", None, None, None, None, None, "no-reply@x.example"]
    assert [r.kind for r in got] == ["freemail", "role", "personal", "invalid", "missing", "missing", "invalid", "invalid", "role"]
    assert [n.rule for n in got[0].notes][:2] == ["address unwrapped and lower-cased", "tag dropped: it is the same mailbox"]


def test_phone(spark):
    us = values(spark, lambda c: N.phone(c, "US"), "(555) 010-2837", "555.010.2837 x204", "1 555 010 2837", "+44 20 7946 0958", "+44 020 7946 0958", "+358 40 1234567", "12345", "fax: none", None)
    assert [(r.e164, r.extension, r.valid) for r in us] == [
        ("+15550102837", None, True), ("+15550102837", "204", True), ("+15550102837", None, True), ("+442079460958", None, True),
        ("+4402079460958", None, False), ("+358401234567", None, True), (None, None, False), (None, None, False), (None, None, False),
    ]
    assert values(spark, lambda c: N.phone(c, "GB"), "020 7946 0958")[0].e164 == "+442079460958"
    assert values(spark, lambda c: N.phone(c, "XX"), "020 7946 0958")[0].valid is False


def test_company(spark):
    got = values(spark, N.company, "Acme, Inc.", "The ACME Company", "Société Générale S.A.", "Harbor Tool & Die", "Co", "Acme Holdings Ltd Inc", "tbd", "***", "IBM")
    assert [r.key for r in got] == ["acme", "acme", "societe generale", "harbor tool and die", "co", "acme holdings", None, None, "ibm"]
    assert got[-1].normalized == "Ibm"


def test_hosts_and_dates(spark):
    assert values(spark, N.host, "https://www.Acme.example:8080/a?b", "bob@acme.example", "acme.example.", "localhost", None) == ["acme.example", "acme.example", "acme.example", None, None]
    dates = ["2026-02-04T10:00", "4 Feb 2026", "February 4th, 2026", "13/02/2026", "02/13/2026", "03/04/2026", "2026-13-01", "2026-02-31", "31.12.2025", None]
    assert values(spark, N.timestamp, *dates) == ["2026-02-04", "2026-02-04", "2026-02-04", "2026-02-13", "2026-02-13", None, None, "2026-02-31", None, None]


def test_titles_and_sources(spark):
    got = [r.tidied for r in values(spark, N.title, "HEAD OF SALES", "VP, Sales", "none", "CISO AND VP  OF DATA")]
    assert got == ["Head of Sales", "VP, Sales", None, "CISO and VP of Data"]
    assert values(spark, N.source, " CRM_Export ", "N/A", None) == ["crm-export", None, None]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Dr. Anna van der Berg, PhD", ("dr", None, ["Anna"], ["van", "der", "Berg"])),
        ("Reyes, Robert", (None, None, ["Robert"], ["Reyes"])),
        ("Robert Reyes Jr.", (None, "jr", ["Robert"], ["Reyes"])),
        ("Cher", (None, None, [], ["Cher"])),
        ("", (None, None, [], [])),
    ],
)
def test_split_name(text, parts):
    assert N.split_name(text) == parts


def test_names(spark):
    frame = spark.createDataFrame([("BOB o'brien", None, None), ("x", "Dr. Émile", "McDonald III"), ("n/a", None, None)], "a string, b string, c string")
    bob, emile, none = (r[0] for r in frame.select(N.name(F.col("a"), F.col("b"), F.col("c"))).collect())
    assert (bob.first, bob.first_canonical, bob.display) == ("bob", "robert", "Bob O'Brien")
    assert (emile.display, emile.honorific, emile.suffix) == ("Emile McDonald III", "dr", "iii")
    assert none.last is None and none.notes[0].rule.startswith("placeholder")


def test_the_whole_table_of_short_names():
    from kinfold.functions import normalize, vocabulary

    table = normalize.formal_names(vocabulary.NICKNAMES)
    assert len(vocabulary.NICKNAMES) == 277 and len({formal for _, formal in vocabulary.NICKNAMES}) == 116
    assert table["gene"] == ["eugene"] and table["becca"] == ["rebecca"] and table["nora"] == ["eleanor"]
    assert table["bert"] == ["albert", "robert"] and table["sandra"] == ["alexandra", "sandra"]
