"""Token sequences as length-delimited binary records (operator 5).

A record file is a row of frames. A frame is the payload's length (unsigned 64-bit), the
masked CRC-32C of those eight bytes, the payload, and the masked CRC-32C of the payload,
all little-endian: the TFRecord layout. A payload is a flag byte (1: the document has an id),
the width of its identifiers in bytes (2 if all are below 65,536, else 4), the id (signed
64-bit), then the token identifiers (unsigned, of that width). Beside each file
``part-*.tfrecord`` lies ``part-*.idx``, the unsigned 64-bit offsets of its frames and its
length, so that a shuffled reader can seek to any record.

Documents are dealt to files by ranges of their id, so files in their order, and records in
theirs, ascend by id (nulls first; equal ids by hash of the text, then text). A file counts
only once its task's row stands in the manifest, a Parquet table that Spark commits; what
failed or speculative attempts leave behind is never read.

Null texts count as empty, and an empty text gives a record with just the end identifier.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import Remembered, for_task, parcels, small_batches

#: The reflected Castagnoli polynomial and the mask of the record format.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_HEAD, _HEAD_SIZE = "<BBq", 10
_BLOCK = 64


@lru_cache(maxsize=1)
def _bytewise() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=64)
def _moved(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a register over 4 zero bytes (level 0), or over 64 * 2 ** (level - 1)."""
    if level == 0:
        low, high = np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
        t = _bytewise()
        for _ in range(4):
            low, high = (t[x & 255] ^ (x >> 8) for x in (low, high))
        return low, high
    low, high = _moved(level - 1)
    for _ in range(15 if level == 1 else 1):
        below = _moved(0 if level == 1 else level - 1)
        low, high = _move(low, below), _move(high, below)
    return low, high


def _move(register: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return tables[0][register & 0xFFFF] ^ tables[1][register >> 16]


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message, all worked out together.

    Messages are set flush right in blocks of 64 bytes, as leading zeros don't change a
    register that starts at zero; the blocks' registers are then joined in pairs.
    """
    if not messages:
        return np.zeros(0, np.uint32)
    lengths = np.array([len(m) for m in messages])
    counts = np.maximum(1, -(-lengths // _BLOCK))
    ends = np.cumsum(counts) * _BLOCK
    room = np.zeros(int(ends[-1]), np.uint8)
    room_view = memoryview(room)
    for m, end, n in zip(messages, ends.tolist(), lengths.tolist(), strict=True):
        room_view[end - n : end] = m
        room[end - n : min(end - n + 4, end)] ^= 255  # the register starts at all ones
    words = room.view("<u4").reshape(-1, _BLOCK // 4)
    register = np.zeros(len(words), np.uint32)
    step = _moved(0)
    for j in range(_BLOCK // 4):
        register = _move(register ^ words[:, j], step)
    level = 1
    while counts.max() > 1:
        halves = (counts + 1) // 2
        starts, new = np.cumsum(counts) - counts, np.cumsum(halves) - halves
        paired = np.zeros(2 * int(halves.sum()), np.uint32)
        paired[np.arange(len(register)) + np.repeat(2 * new + (counts & 1) - starts, counts)] = register
        register = _move(paired[0::2], _moved(level)) ^ paired[1::2]
        counts, level = halves, level + 1
    out = register ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths < 4):  # the all-ones register reaches beyond such a message
        r, t = 0xFFFFFFFF, _bytewise()
        for b in messages[i]:
            r = int(t[(r ^ b) & 255]) ^ (r >> 8)
        out[i] = r ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and the two masked checksums."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    of_heads, of_payloads = masked(crc32c(heads)).astype("<u4").tobytes(), masked(crc32c(payloads)).astype("<u4").tobytes()
    return [b"".join((h, of_heads[4 * i : 4 * i + 4], p, of_payloads[4 * i : 4 * i + 4])) for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def payloads(data: bytes | memoryview, offsets: np.ndarray) -> list[bytes]:
    """The payloads of the frames at ``offsets`` (the last is where they end), checked."""
    view = memoryview(data)
    out, heads = [], []
    sums = np.zeros((2, len(offsets) - 1), np.uint32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        n = struct.unpack_from("<Q", view, a)[0]
        if n != b - a - 16:
            raise ValueError(f"frame at {a}: length {n} does not fit its index")
        heads.append(bytes(view[a : a + 8]))
        out.append(bytes(view[a + 12 : b - 4]))
        sums[0, i], sums[1, i] = struct.unpack_from("<I", view, a + 8)[0], struct.unpack_from("<I", view, b - 4)[0]
    if (masked(crc32c(heads)) != sums[0]).any() or (masked(crc32c(out)) != sums[1]).any():
        raise ValueError("a checksum does not match its record")
    return out


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and its identifiers as unsigned 32-bit integers."""
    flag, width, i = struct.unpack_from(_HEAD, payload)
    return (i if flag else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD_SIZE).astype("<u4")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all machines share, and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
    return pafs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))


class WordMemory(Remembered):
    """Identifiers of stretches between white space, as bytes, from the ``tokenizers`` library.

    A vocabulary that drops white space never joins what it parts: no normalisation, special
    string or piece reaches over an ASCII white-space character, so a text's identifiers are
    those of its stretches in a row. As the vocabulary lower-cases, A to Z are asked for in
    lower case, unless the text may hold a special string; marks at the end of letters are a
    piece of their own. New runs of letters go to the library many at a time
    and are told apart by the identifiers that end a word.
    """

    MARKS = b".,!?;:()|*$%&#"
    limit = 192 << 20

    def __init__(self, file: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def stretches(raw: bytes) -> list[bytes]:
        return raw.split() if b"<|" in raw else raw.lower().split()  # bytes lower A to Z alone

    @staticmethod
    def one_piece(word: bytes) -> bool:
        """Whether a word is letters, and stays so in lower case, where some become letter and mark."""
        if word.isascii():
            return word.isalpha()
        text = word.decode()
        return text.isalpha() and text.lower().isalpha()

    def packed(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _learn(self, letters: list[bytes], others: list[bytes]) -> None:
        for a in range(0, len(letters), 1000):
            some = letters[a : a + 1000]
            ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, width = self.packed(ids), self.width
                for w, i, j in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False):
                    self[w] = data[i * width : j * width]
            else:  # lower-casing made more than one piece of a word
                others += some
        for w, got in zip(others, self.library.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            self[w] = self.packed(got.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.stretches(t) for t in texts]
        new = set().union(*cut).difference(self)
        letters, others, marked = set(), set(), {}
        for w in new:
            if self.one_piece(w):
                letters.add(w)
                continue
            core = w.rstrip(self.MARKS)
            if len(core) < len(w) and self.one_piece(core):
                marked[w] = core, w[len(core) :]
                letters.add(core)
                others.add(w[len(core) :])
            else:
                others.add(w)
        added = (letters | others).difference(self)
        self._learn([w for w in letters if w not in self], [w for w in others if w not in self])
        for w, (core, marks) in marked.items():
            self[w] = self[core] + self[marks]
        get = self.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        self.grew(2 * (sum(map(len, added)) + sum(map(len, marked))), len(added) + len(marked))
        self.trim()
        return out


@lru_cache(maxsize=2)
def _word_memory(file: bytes) -> WordMemory:
    return WordMemory(file)


MANIFEST = "part long, name string, n_records long, n_tokens long, n_bytes long"


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encode ``docs`` and write them to ``folder``; returns the manifest of its files.

    ``path`` is a ``tokenizers`` file that drops white space and lower-cases. Other columns
    of ``docs`` are not written.
    """
    spark = docs.sparkSession
    small_batches(docs)
    with open(path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_task(_word_memory(file.value), keep=True) as memory:
            yield from framed(batches, memory, TaskContext.get().partitionId())

    def framed(batches: Iterator[pa.RecordBatch], memory: WordMemory, part: int) -> Iterator[pa.RecordBatch]:
        end, width = memory.packed([end_id]), memory.width
        stem = f"part-{part:07d}-{uuid.uuid4().hex}"
        offsets, tokens, at, out = [], 0, 0, None
        fs, root = open_folder(folder)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in parcels(batch.column(1), 1 << 22):
                rows = [
                    struct.pack(_HEAD, 0 if i is None else 1, width, i or 0) + ids_of + end
                    for i, ids_of in zip(ids[first : first + len(texts)], memory.encode(texts), strict=True)
                ]
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{stem}.tfrecord")
                for frame in frames(rows):
                    out.write(frame)
                    offsets.append(at)
                    at += len(frame)
                tokens += sum(len(r) - _HEAD_SIZE for r in rows) // width
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{stem}.idx") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [stem], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]}, _MANIFEST_ARROW)

    tie = F.xxhash64(text_col)
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tie.alias("tie"))
    # Ranges are chosen before the texts are encoded: choosing them runs what stands below.
    dealt = dealt.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    dealt.mapInArrow(written, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


_MANIFEST_ARROW = pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = "id long, start long, ids binary"
_RECORDS_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of ``folder``: id, identifiers before it in all files, and its own.

    ``ids`` has them as the bytes of little-endian unsigned 32-bit integers, however wide
    they are in the file.

    A file is a task of its own. The window over the manifest has a row for each file.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                with fs.open_input_file(f"{root}/{name}.tfrecord") as f:
                    step = 256
                    for a in range(0, len(offsets) - 1, step):
                        some = offsets[a : a + step + 1]
                        held = payloads(f.read_at(int(some[-1] - some[0]), int(some[0])), some - some[0])
                        ids, starts, sequences = [], [], []
                        for p in held:
                            i, tokens = unpacked(p)
                            ids.append(i)
                            starts.append(start)
                            sequences.append(tokens.tobytes())
                            start += len(tokens)
                        yield pa.RecordBatch.from_pydict({"id": ids, "start": starts, "ids": sequences}, _RECORDS_ARROW)

    return files.repartition(max(1, manifest.count())).mapInArrow(records, RECORDS)


def record(folder: str, name: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in a file: what a shuffled reader asks for."""
    fs, root = open_folder(folder)
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        pair = np.frombuffer(f.read_at(16, 8 * number), "<u8")
    with fs.open_input_file(f"{root}/{name}.tfrecord") as f:
        (payload,) = payloads(f.read_at(int(pair[1] - pair[0]), int(pair[0])), pair - pair[0])
    return unpacked(payload)
