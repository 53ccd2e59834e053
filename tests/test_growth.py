"""Steps whose data once grew faster than their input, against brute force and with their limits lowered."""

import numpy as np
import pytest

from graphloom.operators import canonical, canonicalization as C, graph as G
from graphloom.operators.canonical import cluster_names


def roots(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def names_one_by_one(rows, least, boost, margin, judge):
    """What merging says if every pair of names is looked at."""
    rows = sorted(rows)
    names, n, vec, named = zip(*rows, strict=True)
    x = np.array(vec)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = x @ x.T
    blocked, asked = set(), []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            both = named[i] and named[j]
            need = least + boost * both
            if both and sims[i, j] < need:
                blocked.add((names[i], names[j]))
            if need - margin <= sims[i, j] < need:
                asked.append((names[i], names[j]))
    forced = {p for p, ok in zip(asked, judge(asked), strict=True) if ok}
    return cluster_names(list(names), np.array(vec), dict(zip(names, n, strict=True)), least, blocked, forced)


@pytest.mark.parametrize("seed", [1, 2])
def test_names_that_share_vectors_merge_as_they_would_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, 6))
    vectors = [(base[k % 4] + rng.normal(size=6) * (0.1 + 0.15 * (k % 3))).tolist() for k in range(24)] + [[0.0] * 6]
    rows = [(f"{'Name' if rng.random() < 0.5 else 'thing'} {k:03d}", int(rng.integers(1, 4)), vectors[int(rng.integers(0, 25))]) for k in range(140)]
    rows = [(a, n, v, a[0] == "N") for a, n, v in rows]
    judge = lambda pairs: [(int(a[-3:]) + int(b[-3:])) % 29 == 0 for a, b in pairs]
    want = names_one_by_one(rows, 0.9, 0.05, 0.07, judge)
    d = spark.createDataFrame(rows, "name string, n long, embedding array<double>, is_named boolean")
    got = {r.name: r.canonical for r in C.merge_entities(d, 0.9, judge, 0.07, 0.05, most_judged=10**6).collect()}
    assert got == want and 4 < len(set(got.values())) < 140


def test_many_names_of_few_vectors_make_no_pairs_of_names(spark):
    d = spark.range(6000).selectExpr("concat('n', id) as name", "id % 7 as n", "array(double(id % 3 = 0), double(id % 3 = 1), double(id % 3 = 2)) as embedding", "false as is_named")
    seen = []
    found = C.merge_candidates
    C.merge_candidates = lambda v, *a: seen.append(v.count()) or found(v, *a)
    try:
        got = C.merge_entities(d, 0.92).collect()
    finally:
        C.merge_candidates = found
    assert seen == [3] and len(got) == 6000 and len({r.canonical for r in got}) == 3


def test_rows_are_copied_to_a_fixed_number_of_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 3))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    placed, _ = canonical._block_pairs(d, "v", None)
    assert placed.count() == canonical.BLOCKS * len(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x[:3000] @ x[:3000].T >= 0.999, 1))
    few = d.filter("id < 3000")
    got = {(r.a, r.b): r.score for r in canonical.similar_pairs(few, "id", 0.999, "v").collect()}
    assert set(got) == set(zip(a.tolist(), b.tolist(), strict=True)) and all(abs(s - x[i] @ x[j]) < 1e-12 for (i, j), s in got.items())
    links = [(r.a, r.b) for r in canonical.similar_links(few, "id", 0.999, "v").collect()]
    assert roots(links) == roots(got) and len(links) < min(len(got), 2 * 6 * 3000)


def test_components_of_more_links_than_a_task_takes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (260, 2))] + [(f"p{k}", f"p{k + 1}") for k in range(60)] + [("x", "x")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for few in (10**6, 150, 5):
        monkeypatch.setattr(G, "SMALL_LINKS", few)
        assert {r.node: r.component for r in G.components(d, "a", "b").collect()} == roots(pairs)
    assert G.components(d.limit(0), "a", "b").count() == 0


def test_a_graph_with_hubs_is_contracted_in_few_rounds(spark, monkeypatch):
    """Hundreds of nodes that choose the same few: pairs that choose each other alone would take a round for each."""
    rng = np.random.default_rng(6)
    rows = sorted({(f"a{rng.integers(0, 6)}", f"b{k:03d}") for k in range(240) for _ in range(3)})
    d = spark.createDataFrame([(u, v, 1.0) for u, v in rows], "u_id string, v_id string, w double")
    rounds = []
    monkeypatch.setattr(G, "materialize", lambda x, name="table": rounds.append(name) or x.localCheckpoint())
    top, few = G.contract(d, 0.8, 2.0 * len(rows), 15)
    tops = {r.node_id: r.top for r in top.collect()}
    assert len(tops) == len({x for r in rows for x in r}) and few.count() <= 15 and rounds.count("merges") <= 4
    names = sorted(tops)
    at = {n: i for i, n in enumerate(names)}
    u, v = (np.array([at[r[k]] for r in rows]) for k in (0, 1))
    label = np.unique([tops[n] for n in names], return_inverse=True)[1]
    assert G.modularity(u, v, np.ones(len(rows)), label, 0.8) > G.modularity(u, v, np.ones(len(rows)), np.arange(len(names)), 0.8)
    assert sum(r.w for r in few.collect()) == pytest.approx(len(rows))


def test_conceptness_ships_stored_floats_and_never_sorts_them(spark):
    rng = np.random.default_rng(7)
    edges = sorted({(f"s{a}", f"o{b}") for a, b in rng.integers(0, 9, (40, 2))})
    vec = {n: rng.normal(size=4).astype(np.float32) for n in sorted({x for r in edges for x in r})[1:]}
    vec["s1"] = np.zeros(4, np.float32)
    e = spark.createDataFrame([(s, o, 1 + k % 3) for k, (s, o) in enumerate(edges)], "s string, o string, weight long")
    m = spark.createDataFrame([(n, 2) for n in vec], "entity string, mentions long")
    v = spark.createDataFrame([(n, x.tolist()) for n, x in vec.items()], "entity string, embedding array<float>")
    c = G.conceptness(e, m, v, top=3)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2
    near = {}
    for k, (s, o) in enumerate(edges):
        near.setdefault(s, []).append((-(1 + k % 3), o))
        near.setdefault(o, []).append((-(1 + k % 3), s))
    for r in c.collect():
        own = [n for _, n in sorted(near[r.entity_id])[:3] if n in vec and r.entity_id in vec]
        cos = [float(a @ b) / d if (d := np.linalg.norm(a) * np.linalg.norm(b)) else 0.0 for n in own for a, b in [(vec[r.entity_id].astype(float), vec[n].astype(float))]]
        assert r.neighbor_count == len(own) and r.cohesion == pytest.approx(np.mean(cos) if cos else 0.0, abs=1e-6)


def test_search_of_many_questions_keeps_each_ones_nearest(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.operators.relational import cosine
    from graphloom.plans import engine

    monkeypatch.setattr(engine, "BLOCK", 3)
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (90, 3)).astype(float)  # many ties, some without length
    v = spark.createDataFrame([(f"c{k}", r.tolist()) for k, r in enumerate(x)], "chunk_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.integers(-2, 3, (8, 3)).astype(float))], "query_id long, q array<double>")
    rank = lambda d: {(r.query_id, r.rank, r.chunk_id) for r in engine._first(d, 5, F.desc_nulls_last("score"), "chunk_id").collect()}
    want = v.join(q).select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    got = engine.nearest(v, "chunk_id", q, 5)
    assert rank(got) == rank(want) and len(rank(got)) == 40


def test_results_of_a_batch_of_texts_leave_in_slices(monkeypatch):
    import pandas as pd

    from graphloom.operators import chunking, extraction

    text = "Anna quickly likes Berta. " * 40
    frame = pd.DataFrame({"text_id": range(50), "chunk_id": [str(k) for k in range(50)], "content": [text] * 50})
    for module, run in ((chunking, lambda: chunking.pieces(iter([frame]), chunking.by_meaning)), (extraction, lambda: extraction.extracted(iter([frame]), extraction.OfflineExtractor()))):
        whole = list(run())
        monkeypatch.setattr(module, "SLICE", 5 * len(text))
        parts = list(run())
        assert len(whole) == 1 and len(parts) == 10
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole[0])
