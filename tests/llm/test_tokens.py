"""Operators 5, 7 and 8 against the library, on random texts and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import bpe, records
from kinfold.llm._shared import shared_dir

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = [*"ab \n\t'stre0 9!<|>é漢🙂́\xa0 \x85\x1c\x1f՘İ", "<|endoftext|>", "<|startoftext|>", "'ll", "  ", "   ", "\r\n"]


def random_texts(n):
    rng = random.Random(1)
    return ["", "a" * 3000, *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def test_codec_and_counts(spark, edge_docs):
    library = Tokenizer.from_file(BYTE)
    texts = random_texts(400)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    got = bpe.count(bpe.decode(bpe.encode(rows, BYTE), BYTE, out_col="back"), BYTE).collect()
    assert len(got) == rows.count()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.back == library.decode(ids, skip_special_tokens=False)


def test_names_that_clash(edge_docs):
    assert bpe.count(edge_docs, BYTE).columns == edge_docs.columns
    assert bpe.count(edge_docs.limit(0), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theanrsod ", min_size=1, max_size=30), min_size=1, max_size=8))
def test_both_ways_to_merge_agree(pieces):
    vocab = bpe.vocabulary(open(BYTE, "rb").read())
    ids, counts = bpe.merged_by_index(pieces, vocab)
    assert counts.tolist() == [bpe.merged_count(vocab.symbols(p), vocab.ranks) for p in pieces]
    assert b"".join(vocab.bytes_of[i] for i in ids.tolist()).decode() == "".join(pieces)


def test_crc32c():
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(0)
    table = records._bytewise()

    def plain(message):
        r = 0xFFFFFFFF
        for b in message:
            r = int(table[(r ^ b) & 255]) ^ (r >> 8)
        return r ^ 0xFFFFFFFF

    messages = [rng.bytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 128, 1000, 64 * 33 + 1)]
    assert records.crc32c(messages).tolist() == [plain(m) for m in messages]


def test_records(spark, edge_docs):
    library = Tokenizer.from_file(WORD)
    texts = random_texts(150)
    rows = spark.createDataFrame([(10_000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    folder = shared_dir(spark)
    manifest = records.write(rows, folder, WORD)
    got = sorted(records.read(spark, folder).collect(), key=lambda r: r.start)
    keys = [(-1 if r.id is None else r.id) for r in got]
    assert keys == sorted(keys) and len(got) == rows.count() == manifest.agg({"n_records": "sum"}).first()[0]
    at = 0
    by_text = sorted(zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows.collect())
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == by_text
    file = manifest.orderBy("part").first()
    one_id, one = records.record(folder, file.name, file.n_records - 1)
    assert one.tobytes() == bytes(got[file.n_records - 1].ids) and one_id == got[file.n_records - 1].id


def test_damaged_records():
    data = bytearray(b"".join(records.frames([b"first", b"second"])))
    offsets = np.array([0, 21, 43])
    assert records.payloads(bytes(data), offsets) == [b"first", b"second"]
    data[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.payloads(bytes(data), offsets)


def test_no_rows(spark):
    folder = shared_dir(spark)
    records.write(spark.createDataFrame([], "doc_id long, text string"), folder, WORD)
    assert records.read(spark, folder).count() == 0
