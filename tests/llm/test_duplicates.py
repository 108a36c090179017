"""Operators 3 and 10 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import minhash, neighbours


def components(nodes, linked):
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def test_near_copies(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus.items()}
    want = components(sets, lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    got = {r.id: r for r in minhash.classes(docs).collect()}
    assert {i: r.component for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert minhash.dedup(docs).count() == len(set(want.values()))


def test_pairs_that_the_smallest_does_not_link(spark):
    """A chain: each links with the next only, so comparing with the smallest is not enough."""
    words = [f"w{i}" for i in range(400)]
    chain = {k: " ".join(words[k * 8 : k * 8 + 100]) for k in range(20)}
    docs = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in chain.items()}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {r.id: r.component for r in minhash.classes(docs).collect()} == want


def test_files_by_the_size_of_what_is_written(spark, monkeypatch):
    """Links are few bytes, the sets they are confirmed on are many: no file for each task of that join."""
    texts = [" ".join(f"{g}w{i}" for i in range(400)) for g in range(60)]
    docs = spark.createDataFrame([(2 * g + k, t + " end" * k) for g, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    files, kept = [], minhash.settle
    monkeypatch.setattr(minhash, "settle", lambda df: (files.append((df.columns, out := kept(df))), out)[1])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.id: r.component for r in minhash.classes(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i in range(120)}
    assert [len(t.inputFiles()) for columns, t in files if columns == ["a", "b"]] == [1, 1]


def test_edges_of_minhash(edge_docs):
    got = minhash.classes(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = {r.id: r for r in got if r.id is not None}
    assert by_id[6].component == 5 and by_id[8].component == 7 and by_id[0].n_shingles == 0 and by_id[1].component == 1
    assert next(r for r in got if r.id is None).component is None
    assert minhash.classes(edge_docs.limit(0)).count() == 0
    assert minhash.dedup(edge_docs).columns == edge_docs.columns


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 16))
    near = np.repeat(base[:6], 8, axis=0) + rng.normal(size=(48, 16)) * 0.08
    return np.concatenate([base, near, base[10:13] * 2.5, base[10:13]]).astype(np.float32)


def test_links(spark):
    x = vectors()
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, []), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = components(range(len(x)), lambda a, b: near[a, b])
    got = {r.id: r for r in neighbours.classes(df).collect()}
    assert len(got) == len(rows) + len(bad)
    assert {i: got[i].component for i in range(len(x))} == want
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].component == i for i in range(900, 906))
    assert got[907].component == 906
    assert neighbours.classes(df.limit(0)).count() == 0


def rare(n=1500, pairs=4):
    """Vectors that link with nothing, but for ``pairs`` pairs, far apart in the order of ids."""
    x = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    x[n - pairs :] = x[:pairs] * 2 + np.float32(0.2) * x[pairs : 2 * pairs]
    return x


def test_rare_links_outlast_poor_seeds(spark, monkeypatch):
    """Seeds that only know neighbouring ids: no round finds the links, so all pairs must be compared."""
    x = rare()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ring = spark.createDataFrame([(i, (i + 1) % len(x), 0.0) for i in range(len(x))], neighbours.EDGES)
    kept = neighbours.seeds
    monkeypatch.setattr(neighbours, "seeds", lambda *a: (ring, True) if isinstance(kept(*a), tuple) else ring)
    monkeypatch.setattr(neighbours, "ROUNDS", 2)
    got = {r.id: r for r in neighbours.classes(df).collect()}
    assert {i for i, r in got.items() if r.n_links} == {*range(4), *range(len(x) - 4, len(x))}
    assert all(got[len(x) - 4 + i].component == i for i in range(4))


def test_an_audit_without_links_is_unknown(spark, monkeypatch):
    x = rare(600, 0)
    nodes = spark.createDataFrame([(int(i), 64, v.tolist()) for i, v in enumerate(x)], "id long, dim int, vector array<float>")
    none = spark.createDataFrame([], "node long, component long")
    assert neighbours.audit(nodes, none, 0.95) == 1.0  # compared in full
    monkeypatch.setattr(neighbours, "AUDITED", 50)
    monkeypatch.setattr(neighbours, "MOST_AUDITED", 100, raising=False)
    assert neighbours.audit(nodes, none, 0.95) is None


def test_vectors_in_double_precision(spark):
    """What single precision would overflow or round to zero is told apart and linked."""
    rows = [(1, [1e300, 1.0]), (2, [1e300, 1.0]), (3, [1.0, 1e300]), (4, [1e-300, 0.0]), (5, [2e-300, 0.0]), (6, [0.0, 0.0])]
    found = {r.id: (r.n_links, r.component) for r in neighbours.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 4: (3, 1), 5: (3, 1), 3: (0, 3), 6: (0, 6)}
    assert neighbours.classes(spark.createDataFrame([], "vec_id long, embedding array<double>, id int, vector int")).count() == 0


def test_dedup_keeps_other_columns(spark, edge_docs):
    for name in ("id", "gone", "row", "component", "node", "sketch", "bucket"):
        edge_docs = edge_docs.withColumn(name, F.lit("mine"))
    kept = minhash.dedup(edge_docs)
    assert kept.columns == edge_docs.columns and kept.filter("id <> 'mine' OR gone <> 'mine' OR component <> 'mine'").isEmpty()
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 5, 7, 7, 9, 10, 11]
    assert kept.count() == 12 and minhash.dedup(edge_docs.limit(0)).count() == 0
