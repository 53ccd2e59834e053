"""Queries over whole tables: cases that lie past a former bound or subset, against brute force."""

import re

import duckdb
import numpy as np

from graphloom.plans import catalog  # noqa: F401
from graphloom.plans.registry import QUERIES

from graphloom.operators import extraction
from graphloom.operators import graph as G


def base_triples(text):
    """A name, one or two words and a name, from left to right in each sentence without overlap."""
    out = []
    word, name = r"[^\W\d_]+", r"[^\W\d_][\w'-]{2,}"
    for s in re.split(r"(?<=[.!?])\s+", text):
        at = 0
        while at < len(s):
            m = re.compile(rf"\b({name})\s+((?:{word}\s+){{1,2}})({name})").match(s, at)
            if m:
                out.append((m[1], m[2].strip(), m[3]))
            at = m.end() if m else at + 1
    return out


def test_extraction_reads_all_sentences_and_all_matches(spark):
    sentences = [f"Anna{'x' * (k % 7)} quickly likes Berta{'y' * (k % 5)} while Carla often meets Dora." for k in range(45)]
    text = " ".join(sentences)
    want = base_triples(text)
    assert len(want) >= 90
    assert extraction.OfflineExtractor().triples(text) == want
    d = spark.createDataFrame([("a", text)], "chunk_id string, content string")
    got = extraction.extract(d).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(want))) and [r.subject for r in got] == [s for s, _, _ in want]


def base_components(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_components_and_merges_over_whole_tables(spark, data):
    lines = duckdb.sql(f"select distinct 'supplier ' || l_suppkey, 'part ' || l_partkey from '{data}/lineitem.parquet'").fetchall()
    assert {r.node: r.component for r in QUERIES["gr7_components"](spark, data).collect()} == base_components(lines)
    ids, vectors = zip(*duckdb.sql(f"select vec_id, embedding from '{data}/embeddings.parquet' order by 1").fetchall(), strict=True)
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.35, 1))
    want = base_components([(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert {r.node: r.component for r in QUERIES["cn5_threshold_components"](spark, data).collect()} == want
    names = {r.name for r in QUERIES["cn3_semantic_merge"](spark, data).collect()}
    assert any(n.startswith("part ") for n in names) and any(n.startswith("supplier ") for n in names)


def test_leiden_holds_components_to_the_whole_graph_at_any_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for c, n in (("a", 60), ("b", 12), ("c", 12)):
        for i in range(n):
            rows += [(f"{c}{i:02d}", f"{c}{j:02d}", 3.0 if i // 6 == j // 6 else 0.2) for j in range(i + 1, n) if i // 6 == j // 6 or rng.random() < 0.05 or j == i + 1]
    e = spark.createDataFrame(rows, "u_id string, v_id string, w double")
    names = sorted({x for r in rows for x in r[:2]})
    u, v = (np.array([names.index(r[k]) for r in rows]) for k in (0, 1))
    w = np.array([r[2] for r in rows])

    def run(gamma):
        got = {r.node_id: r.comm_id for r in G.communities(e, gamma).collect()}
        assert sorted(got) == names
        return got, G.modularity(u, v, w, np.array([got[x] for x in names]), gamma)

    groups = lambda got: {frozenset(x for x in got if got[x] == c) for c in set(got.values())}
    for gamma in (0.2, 1.0):
        whole, best = run(gamma)
        monkeypatch.setattr(G, "SMALL_EDGES", 250)  # a task for each component
        assert max(sum(r[0][0] == c for r in rows) for c in "abc") <= 250 < len(rows)
        assert groups(run(gamma)[0]) == groups(whole)
        monkeypatch.setattr(G, "SMALL_EDGES", 60)  # the largest is contracted first
        assert run(gamma)[1] >= 0.97 * best
        monkeypatch.undo()
