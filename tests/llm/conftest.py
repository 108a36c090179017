import random

import pytest

#: Texts that every operator must take: null, empty, blank, marks, ties and repeated rows, long.
EDGE = [None, "", "   ", "\n\n", "a", "one two three", "one two three", "Same TEXT here, twice over again.", "same text HERE, twice over again.", "é漢🙂 ́ \x1f x", "w " * 3000, "<|endoftext|> x <|endoftext|>"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts with an id that repeats, one that is null, and columns whose names clash with results."""
    rows = [(i, t, "en", None if i == 3 else f"src{i % 3}", 7, -1, "x") for i, t in enumerate(EDGE)]
    rows += [rows[7], (None, "a row without an id", "en", "src1", 7, -1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, spans string")


@pytest.fixture(scope="session")
def corpus():
    """Documents of made-up words in groups of near copies, as {id: text}."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = {}
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice((1, 2, 6))):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out[len(out) * 3 + g % 2] = " ".join(copy)
    out[1000], out[1001], out[1002] = out[0], out[0].upper(), "too short"
    return out
