"""Byte-level byte-pair encoding of whole texts (operators 7 and 8).

Both operators cut a text at the vocabulary's special strings, then into chunks that
begin at a space, then by the vocabulary's pattern. A chunk is encoded once per worker
and looked up from then on. The two differ in how merges are found:

* ``encode`` keeps a *pair occurrence index*: all new pieces of a parcel of texts lie in
  one symbol array, a table maps each pair to its positions, and active ranks are applied
  in ascending order, which updates the lists of the pairs left and right of a merge.
* ``count`` pops the lowest-rank adjacent pair from a *heap* over a *linked list* of
  symbols; the count is the number of symbols at first less the merges, and no
  identifier is ever made.

Null texts count as empty, empty texts give no tokens, and rows keep their other columns;
a column that has the name of a result is replaced by it. Repeated rows get equal results,
an empty table gives none, and a text of any length is encoded whole: a worker holds one
parcel of texts, or one text if that is longer, and a memory of bounded bytes.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._shared import Remembered, for_task, parcels, ragged, small_batches

#: Fixed value: how byte-level vocabularies of this family cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text whose new pieces are merged together.
PARCEL = 1 << 22

#: Where a cut at each space would cut a run of white space that the pattern keeps whole.
_LONG_GAP = re.compile(r"\s\s(?:\s|\Z)")


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Bytes that print in Latin-1 stand for themselves; the others, in ascending order,
    get the code points from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges, identifiers and special strings of a byte-level ``tokenizers`` file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        to_char = printable_bytes()
        to_byte = {c: b for b, c in to_char.items()}
        self.file = file
        ids: dict[str, int] = model["vocab"]
        self.chars = [to_char[b] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self._library = None
        self.of_byte = np.array([ids[c] for c in self.chars], np.int32)
        parts = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in parts], np.int32)  # left, right and both, by rank
        keys = self.merges[:, 0].astype(np.int64) << 32 | self.merges[:, 1]
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """The rank of each pair of symbols as text."""
        merges = json.loads(self.file)["model"]["merges"]
        return {tuple(m if isinstance(m, list) else m.split(" ", 1)): r for r, m in enumerate(merges)}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of identifiers; -1 if it has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (right >= 0), self._order[at], -1)

    def pieces(self, text: str) -> list[str]:
        """``text`` cut by the pattern, as the library does.

        Characters that this Python's tables don't know may be classed differently by
        newer ones; chunks with such characters are cut by the library itself.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text if c > "՗"):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.file.decode()).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def segments(self, text: str) -> Iterator[tuple[str, str | None]]:
        """The stretches of ``text`` between special strings, each with the one after it."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], None

    def chunks(self, segment: str) -> list[str]:
        """``segment`` in stretches between which the pattern always cuts."""
        if _LONG_GAP.search(segment):
            return self.pieces(segment)
        first, *rest = segment.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def text_of(self, ids: list[int | None]) -> str:
        """The text of identifiers; those that are not in the vocabulary give nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")

    def symbols(self, piece: str) -> list[str]:
        chars = self.chars
        return [chars[b] for b in piece.encode()]


@lru_cache(maxsize=2)
def vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens byte-pair merging leaves of ``symbols``."""
    n = len(symbols)
    heap = [(r, i) for i, p in enumerate(pairwise(symbols)) if (r := ranks.get(p)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    held, left, right, total = list(symbols), [*range(-1, n - 1)], [*range(1, n + 1)], n
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if held[i] is None or j >= n or ranks.get((held[i], held[j])) != rank:
            continue  # one of the two was merged meanwhile
        held[i] += held[j]
        held[j] = None
        right[i] = k = right[j]
        total -= 1
        if k < n:
            left[k] = i
            if (r := ranks.get((held[i], held[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := left[i]) >= 0 and (r := ranks.get((held[h], held[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return total


def merged_by_index(pieces: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The identifiers of all ``pieces`` in a row, and how many each has.

    All symbols stand in one array with links to their neighbours. The index has, for each
    rank, the positions where its pair begins; a rank's positions are merged together.
    """
    raw = [p.encode() for p in pieces]
    sizes = np.array([len(r) for r in raw], np.int64)
    symbol = np.append(vocab.of_byte[np.frombuffer(b"".join(raw), np.uint8)], np.int32(-1))
    n = len(symbol) - 1  # stands for "no neighbour"
    right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = np.cumsum(sizes)
    right[ends[sizes > 0] - 1] = n
    left[(ends - sizes)[sizes > 0]] = n
    right[n] = left[n] = n
    where: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Add the pairs that begin at ``positions`` to the index."""
        ranks = vocab.ranks_of(symbol[positions], symbol[right[positions]])
        known = ranks >= 0
        if not known.all():
            positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
            if rank in where:
                where[rank].append(some)
            else:
                where[rank] = [some]
                heapq.heappush(active, rank)

    enter(np.flatnonzero(right[:n] < n).astype(np.int32))
    while active:
        rank = heapq.heappop(active)
        found = where.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b, joint = vocab.merges[rank].tolist()
        follows = right[at]
        at = at[(symbol[at] == a) & (symbol[follows] == b)]
        if a == b and len(at) > 1:  # in a run of one symbol, a merge uses up the next place
            taken, keep = -1, []
            for i in at.tolist():
                if i != taken:
                    keep.append(i)
                    taken = int(right[i])
            at = np.array(keep, np.int32)
        if not len(at):
            continue
        gone = right[at]
        after = right[gone]
        symbol[at] = joint
        symbol[gone] = -1
        right[at] = after
        left[after] = at
        before = left[at]
        enter(np.unique(np.concatenate([at[after < n], before[before < n]])))
    kept = symbol[:n] >= 0
    upto = np.append(0, np.cumsum(kept))
    return symbol[:n][kept], upto[ends] - upto[ends - sizes]


class CountMemory(Remembered):
    """Token counts of chunks and of the pieces they are cut into, worked out when first asked for."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, chunk: str) -> int:
        total, parts = 0, self.vocab.pieces(chunk)
        for piece in parts:
            n = self.get(piece)
            if n is None:
                n = self[piece] = merged_count(self.vocab.symbols(piece), self.vocab.ranks)
                self.grew(len(piece))
            total += n
        if len(parts) != 1:
            self[chunk] = total
            self.grew(len(chunk))
        return total

    def count(self, text: str) -> int:
        vocab, total = self.vocab, 0
        for segment, special in vocab.segments(text):
            total += sum(map(self.__getitem__, vocab.chunks(segment))) + (special is not None)
        return total


class EncodeMemory(Remembered):
    """Identifiers of chunks and of the pieces they are cut into, as the bytes of 32-bit integers."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.special = {s: np.array([i], np.int32).tobytes() for s, i in vocab.special.items()}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        vocab, new = self.vocab, set()
        for text in texts:
            for segment, _ in vocab.segments(text.decode()):
                new.update(vocab.chunks(segment))
        new.difference_update(self)
        fresh, joint = set(), {}
        for chunk in new:
            parts = vocab.pieces(chunk)
            fresh.update(parts)
            if len(parts) != 1:  # else the chunk is its piece
                joint[chunk] = parts
        fresh.difference_update(self)
        pieces = list(fresh)
        ids, counts = merged_by_index(pieces, vocab)
        data, at = ids.tobytes(), 0
        for piece, n in zip(pieces, counts.tolist(), strict=True):
            self[piece] = data[at : (at := at + 4 * n)]
        for chunk, parts in joint.items():
            self[chunk] = b"".join([self[p] for p in parts])
        self.grew(len(data) + sum(map(len, pieces)) + 5 * sum(map(len, joint)), len(pieces) + len(joint))
        get, out = self.__getitem__, []
        for text in texts:
            parts = []
            for segment, special in vocab.segments(text.decode()):
                parts += map(get, vocab.chunks(segment))
                if special:
                    parts.append(self.special[special])
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def _count_memory(file: bytes) -> CountMemory:
    return CountMemory(vocabulary(file))


@lru_cache(maxsize=2)
def _encode_memory(file: bytes) -> EncodeMemory:
    return EncodeMemory(vocabulary(file))


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file for the workers: 1 to 2 MB, whatever the input."""
    small_batches(spark.range(0))
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def count(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (long)."""
    file = _shipped(docs.sparkSession, path)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(_count_memory(file.value)) as memory:
            for batch in batches:
                totals: list[int] = []
                for _, texts in parcels(batch):
                    totals += [memory.count(t.decode()) for t in texts]
                    memory.trim()
                yield pa.array(totals, pa.int64())

    return docs.withColumn(out_col, counted(F.col(text_col)))


def _encoded(batch: pa.Array, memory: EncodeMemory) -> list[bytes]:
    """The identifiers of each text of ``batch`` as bytes."""
    rows: list[bytes] = []
    for _, texts in parcels(batch, PARCEL):
        rows += memory.encode(texts)
        memory.trim()
    return rows


def _as_lists(rows: list[bytes]) -> pa.Array:
    return ragged(pa.array(np.frombuffer(b"".join(rows), np.int32)), [len(r) // 4 for r in rows])


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token identifiers of each whole text (array of int)."""
    file = _shipped(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(_encode_memory(file.value)) as memory:
            for batch in batches:
                yield _as_lists(_encoded(batch, memory))

    return docs.withColumn(out_col, encoded(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of each list of identifiers, special strings included.

    Bytes that are no UTF-8 become U+FFFD and identifiers outside the vocabulary, nulls
    too, are left out, both as the library does. A null list gives the empty text.
    """
    file = _shipped(rows.sparkSession, path)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text_of = vocabulary(file.value).text_of
        for batch in batches:
            yield pa.array([text_of(ids.values.to_pylist() if ids.is_valid else []) for ids in batch], pa.string())

    return rows.withColumn(out_col, decoded(F.col(ids_col)))


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the identifiers of each text and the text that they alone decode to.

    The same as ``decode`` after ``encode``, but one worker a task does both, so the
    identifiers cross to Python and back once and one vocabulary stands in memory.
    """
    file = _shipped(docs.sparkSession, path)

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(_encode_memory(file.value)) as memory:
            text_of = memory.vocab.text_of
            for batch in batches:
                rows = _encoded(batch, memory)
                texts = pa.array([text_of(np.frombuffer(r, np.int32).tolist()) for r in rows], pa.string())
                yield pa.StructArray.from_arrays([_as_lists(rows), texts], ["ids", "text"])

    made = f"_{ids_col}_{out_col}"
    while made in docs.columns:
        made += "_"
    found = docs.withColumn(made, both(F.col(text_col)))
    return found.withColumns({ids_col: F.col(made)["ids"], out_col: F.col(made)["text"]}).drop(made)
