"""Graph construction, components, conceptness, communities and best-first traversal."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules as R
from .relational import ends
from .shared import discard, materialize, spread


def directed_edges(triples: DataFrame) -> DataFrame:
    """s, p, o, label (the commonest predicate text; ties: the smallest), weight and sorted chunk ids; empty ends skipped."""
    t = triples.filter("s is not null and s <> '' and p is not null and p <> '' and o is not null and o <> ''")
    return t.groupBy("s", "p", "o").agg(F.collect_set("chunk_id").alias("c")).select("s", "p", "o", F.col("p").alias("label"), F.size("c").cast("long").alias("weight"), F.array_sort("c").alias("chunks"))


def pair_edges(triples: DataFrame) -> DataFrame:
    """u_id < v_id with the number of distinct chunks of any relation; no loops."""
    t = triples.filter("o is not null and o <> '' and s <> o")
    return t.groupBy(F.least("s", "o").alias("u_id"), F.greatest("s", "o").alias("v_id")).agg(F.count_distinct("chunk_id").alias("weight"))


#: Links up to which one task finds components.
SMALL_LINKS = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node of its component."""
    f = np.arange(n)
    while True:
        a, b = f[u], f[v]
        apart = a != b
        if not apart.any():
            return f
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(f, np.maximum(a, b), np.minimum(a, b))
        while (f != (g := f[f])).any():
            f = g


def _local(links: DataFrame) -> DataFrame:
    """node, component of few links (u, v), in one task."""
    kind = dict(links.dtypes)["u"]

    def run(d: pa.Table) -> pa.Table:
        both = pa.chunked_array([*d.column("u").chunks, *d.column("v").chunks]).combine_chunks()
        code = pc.rank(both, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        n = int(code.max()) + 1
        at = np.zeros(n, np.int64)
        at[code] = np.arange(len(code))
        label = least_labels(code[: d.num_rows], code[d.num_rows :], n)
        return pa.table({"node": both.take(pa.array(at)), "component": both.take(pa.array(at[label]))})

    return links.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda d: run(d), f"node {kind}, component {kind}")


def _stars(links: DataFrame, most_rounds: int) -> DataFrame:
    """node, component by alternating large and small stars; each round is written to the shared folder."""
    e = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
        done, e = e, materialize(large.join(least, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("x")).select("x.*").filter("u <> v").distinct(), "links")
        after = mark(e)
        discard(done)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), "v")).distinct().toDF("node", "component")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node).

    Few links are one task's.  Of more, each node's link to its least neighbour is taken first, so that rounds see a link a
    node; the rest is relabelled once and what still joins two components goes through the same again.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links")
    links = e.filter("u <> v")
    alone = e.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    found = None
    for _ in range(most_rounds):
        if links.count() <= SMALL_LINKS:
            last = _local(links)
            found = last if found is None else _relabelled(found, last)
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialize(both.groupBy("u").agg(F.min("v").alias("v")), "hooks")
        part = materialize(_local(hooks) if hooks.count() <= SMALL_LINKS else _stars(hooks, most_rounds), "parts")
        found = part if found is None else materialize(_relabelled(found, part), "parts")
        side = lambda c: part.toDF(c, f"{c}2")  # noqa: E731, B023
        links = materialize(links.join(side("u"), "u").join(side("v"), "v").filter("u2 <> v2").select(F.greatest("u2", "v2").alias("u"), F.least("u2", "v2").alias("v")).distinct(), "links")
        if links.isEmpty():
            break
    else:
        raise RuntimeError("components didn't settle")
    return found.unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _relabelled(found: DataFrame, more: DataFrame) -> DataFrame:
    """found, with components of its components in their place."""
    return found.join(more.toDF("component", "_c"), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))


def degrees(edges: DataFrame, s: str = "s", o: str = "o", weight: str | None = None) -> DataFrame:
    """node_id, degree, weighted; a loop counts at both of its ends."""
    w = F.col(weight) if weight else F.lit(1)
    return edges.select(F.explode(F.array(s, o)).alias("node_id"), w.alias("w")).groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted"))


def conceptness(edges: DataFrame, mentions: DataFrame, embeddings: DataFrame, top: int = 10) -> DataFrame:
    """Cohesion (mean cosine with the strongest neighbours that have a vector) times support (log mentions and degree).

    edges: s, o, weight; mentions: entity, mentions; embeddings: entity, embedding.  The strongest neighbours are
    chosen before asking for vectors.
    """
    sides = F.explode(F.array(F.struct(F.col("s").alias("e"), F.col("o").alias("n")), F.struct(F.col("o").alias("e"), F.col("s").alias("n"))))
    # one exchange by e serves the sums, the ranks and the degrees
    near = edges.select(sides.alias("x"), "weight").select("x.*", "weight").repartition("e").groupBy("e", "n").agg(F.sum("weight").alias("w"))
    degree = near.groupBy("e").agg(F.sum("w").alias("weighted_degree"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy(F.desc("w"), "n"))).filter(f"r <= {top}")
    # a vector goes along once for each neighbour, as it was stored, past a hash table: such rows are too wide to be sorted
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    vectors = embeddings.toDF("e", "v").select("e", "v", norm.alias("l"))
    a, b = vectors.toDF("e", "ea", "la"), vectors.toDF("n", "eb", "lb")
    both = best.select("e", "n").join(a.hint("shuffle_hash"), "e").join(b.hint("shuffle_hash"), "n")
    cos = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.col("la") * F.col("lb"), F.lit(0.0))
    sims = both.groupBy("e").agg(F.avg(F.coalesce(cos, F.lit(0.0))).alias("cohesion"), F.count("*").alias("neighbor_count"))
    d = degree.join(sims, "e", "left").join(mentions.toDF("e", "mention_count"), "e", "left")
    zero = lambda c, x=0: F.coalesce(c, F.lit(x))
    support = F.log1p(zero("mention_count")) + F.log1p("weighted_degree")
    cohesion = zero("cohesion", 0.0)
    return d.select(F.col("e").alias("entity_id"), cohesion.alias("cohesion"), support.alias("support"), (F.greatest(F.lit(0.0), cohesion) * support).alias("conceptness"), zero("neighbor_count").cast("long").alias("neighbor_count"), "weighted_degree", zero("mention_count").cast("long").alias("mention_count"))


def node_flags(nodes: DataFrame, edges: DataFrame, scores: DataFrame | None = None, hub_pct: float = 0.01, min_degree: int = 1, percentile: float = 0.3, min_support: float = 2.0, milder: float = 0.8) -> DataFrame:
    """node_id, label and whether it may seed a walk or be reached by one.  nodes: node_id, label."""
    deg = degrees(edges)
    n = nodes.agg(F.count("*").alias("n"))
    f = nodes.join(deg, "node_id", "left").join(F.broadcast(n)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    f = f.withColumn("stop", R.is_stop_label(F.col("label"))).withColumn("low", R.is_low_quality_label(F.col("label")))
    f = f.withColumn("hub", F.col("degree") > F.greatest(F.lit(10), F.floor(F.col("n") * hub_pct)))
    strong = mild = F.lit(True)
    if scores is not None:
        scores = materialize(scores.select("entity_id", "conceptness", "support"), "scores")  # read twice
        cutoff = scores.agg(F.percentile("conceptness", percentile).alias("t"))
        f = f.join(scores.select(F.col("entity_id").alias("node_id"), "conceptness", F.col("support").alias("sup")), "node_id", "left").join(F.broadcast(cutoff))
        sure = F.coalesce("sup", F.lit(0.0)) >= min_support
        strong = (F.coalesce("conceptness", F.lit(0.0)) >= F.col("t")) & sure
        mild = (F.coalesce("conceptness", F.lit(0.0)) >= F.col("t") * milder) & sure
    seed = ~F.col("stop") & ~F.col("hub") & (F.col("degree") >= min_degree) & ~F.col("low") & strong
    return f.select("node_id", "label", "degree", "stop", "hub", "low", seed.alias("valid_seed"), (~F.col("stop") & ~F.col("low") & mild).alias("valid_expansion"))


def clustering_edges(pairs: DataFrame, min_weight: int = 1, degree_pct: float = 0.01, log_weight: bool = True) -> DataFrame:
    """u_id, v_id, w: pairs heavy enough, without nodes whose degree is over that share of the nodes."""
    e = pairs.filter(F.col("weight") >= min_weight)
    deg = degrees(e, "u_id", "v_id")
    if degree_pct > 0:
        most = deg.agg(F.greatest(F.lit(1), F.floor(F.count("*") * degree_pct)).alias("most"))
        over = deg.join(F.broadcast(most), F.col("degree") > F.col("most")).select("node_id")
        for c in ("u_id", "v_id"):
            e = e.join(over.withColumnRenamed("node_id", c), c, "left_anti")
    return e.select("u_id", "v_id", (F.log1p("weight") if log_weight else F.col("weight").cast("double")).alias("w"))


def leiden(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, rounds: int = 10, total: float | None = None) -> np.ndarray:
    """Community of each node: local moving, refinement and aggregation for modularity with this resolution.

    Deterministic: nodes are visited in order, ties go to the least community.  total: twice the weight of the whole graph,
    if these edges are only a part of it.
    """
    total = 2.0 * w.sum() if total is None else total
    group = np.arange(n)  # original node -> current super node
    labels = np.arange(n)
    for _ in range(rounds):
        size = int(group.max()) + 1
        adj: list[dict[int, float]] = [defaultdict(float) for _ in range(size)]
        k = np.zeros(size)
        for a, b, x in zip(group[u].tolist(), group[v].tolist(), w.tolist(), strict=True):
            k[a] += x
            k[b] += x
            if a != b:
                adj[a][b] += x
                adj[b][a] += x
        start = np.zeros(size, np.int64)
        start[group] = labels
        comm = np.unique(start, return_inverse=True)[1]
        _move(adj, k, comm, gamma, total, None)
        fine = np.arange(size)
        _move(adj, k, fine, gamma, total, comm)
        labels = comm[group]
        fine = np.unique(fine, return_inverse=True)[1]
        if fine.max() + 1 == size:
            break
        group = fine[group]
    return _renumber(labels)


def _move(adj: list[dict[int, float]], k: np.ndarray, comm: np.ndarray, gamma: float, total: float, inside: np.ndarray | None) -> None:
    """Greedy moves until none gains; inside: moves stay within these communities (refinement)."""
    weight = np.bincount(comm, k, minlength=len(k))
    todo, queued = list(range(len(k))), np.ones(len(k), bool)
    while todo:
        later: list[int] = []
        for i in todo:
            queued[i] = False
            own = comm[i]
            links: dict[int, float] = defaultdict(float)
            for j, x in adj[i].items():
                if inside is None or inside[i] == inside[j]:
                    links[comm[j]] += x
            weight[own] -= k[i]
            best, gain = own, links.get(own, 0.0) - gamma * k[i] * weight[own] / total
            for c in sorted(links):
                g = links[c] - gamma * k[i] * weight[c] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += k[i]
            if best != own:
                comm[i] = best
                for j in adj[i]:
                    if not queued[j] and comm[j] != best:
                        queued[j] = True
                        later.append(j)
        todo = later


def _renumber(labels: np.ndarray) -> np.ndarray:
    """0, 1, ... by falling size, then least node."""
    found, first, back, count = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -count))
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return rank[back]


def modularity(u: np.ndarray, v: np.ndarray, w: np.ndarray, labels: np.ndarray, gamma: float = 1.0) -> float:
    total = 2.0 * w.sum()
    k = np.bincount(u, w, len(labels)) + np.bincount(v, w, len(labels))
    return float(2.0 * w[labels[u] == labels[v]].sum() / total - gamma * (np.bincount(labels, k) ** 2).sum() / total**2)


#: Edges up to which one task runs the sequential algorithm.
SMALL_EDGES = 2_000_000


def contract(edges: DataFrame, gamma: float, total: float, most: int) -> tuple[DataFrame, DataFrame]:
    """node_id, top, and the edges between tops: nodes merge with the neighbour of the best gain in modularity, in distributed
    rounds, until `most` edges are left or no pair gains.

    A neighbour that more nodes choose (ties: by hash) is taken before those that choose it; one that chooses such a neighbour
    itself takes none in this round.  Of the nodes that choose one neighbour those stay apart that wouldn't gain after the
    better ones are in, so every merge gains.
    """
    top = ends(edges, "u_id", "v_id", out="node_id").distinct().withColumn("top", F.col("node_id"))
    e = edges.select("u_id", "v_id", "w")
    while e.count() > most:
        both = F.explode(F.array(F.struct(F.col("u_id").alias("a"), F.col("v_id").alias("b")), F.struct(F.col("v_id").alias("a"), F.col("u_id").alias("b"))))
        k = materialize(e.select(both.alias("x"), "w").groupBy(F.col("x.a").alias("a")).agg(F.sum("w").alias("k")), "strengths")
        near = e.filter("u_id <> v_id").groupBy("u_id", "v_id").agg(F.sum("w").alias("w")).join(k.toDF("u_id", "ku"), "u_id").join(k.toDF("v_id", "kv"), "v_id")
        gain = near.withColumn("gain", F.round(F.col("w") - F.lit(gamma / total) * F.col("ku") * F.col("kv"), 9)).filter("gain > 0")
        best = gain.select(both.alias("x"), "gain", "w").groupBy(F.col("x.a").alias("a")).agg(F.max(F.struct("gain", F.xxhash64(F.least("x.a", "x.b"), F.greatest("x.a", "x.b")).alias("h"), F.col("x.b").alias("b"), "w")).alias("m"))
        best = materialize(best.join(k, "a").select("a", F.col("m.b").alias("b"), F.col("m.gain").alias("gain"), F.col("m.w").alias("w"), "k"), "best")
        chosen = best.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n"))
        rank = best.join(chosen, "a", "left").select("a", "b", "gain", "w", "k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("a").alias("h"), "a").alias("rank"))
        rank = materialize(rank, "ranks")
        seen = rank.join(rank.select(F.col("a").alias("b"), F.col("rank").alias("theirs"), F.col("k").alias("kb")), "b").withColumn("goes", F.col("theirs") > F.col("rank"))
        seen = materialize(seen.drop("rank", "theirs"), "choices")
        goes = seen.filter("goes").join(seen.filter("not goes").select(F.col("a").alias("b")), "b", "left_semi")
        before = F.coalesce(F.sum("k").over(Window.partitionBy("b").orderBy(F.desc("gain"), "a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        pairs = materialize(goes.withColumn("before", before).filter(F.col("w") - F.lit(gamma / total) * F.col("k") * (F.col("kb") + F.col("before")) > 0).select("a", "b"), "merges")
        if pairs.isEmpty():
            break
        low = lambda d, c: d.join(pairs.toDF(c, "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: E731, B023
        e = materialize(low(low(e, "u_id"), "v_id").select(F.least("u_id", "v_id").alias("u_id"), F.greatest("u_id", "v_id").alias("v_id"), "w").groupBy("u_id", "v_id").agg(F.sum("w").alias("w")), "contracted")
        top = materialize(low(top, "top"), "tops")
    return top, e


def parted(edges: DataFrame) -> DataFrame:
    """component, u_id, v_id, w: edges by component where there are more than SMALL_EDGES; component is 'all' otherwise."""
    e = edges.select("u_id", "v_id", "w")
    if e.count() <= SMALL_EDGES:
        return e.withColumn("component", F.lit("all"))
    e = materialize(e, "edges")
    return materialize(e.join(components(e, "u_id", "v_id").withColumnRenamed("node", "u_id"), "u_id"), "parts")


def communities(edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """node_id, comm_id.  Up to SMALL_EDGES edges one task runs Leiden; beyond, each component is a task of its own, and
    components that are larger still are contracted first.  The modularity is that of the whole graph in each case; what
    can't be contracted to SMALL_EDGES has no pair left that gains, and its merged nodes are the communities.

    edges: u_id, v_id, w, or what `parted` says of them.
    """
    e = edges if "component" in edges.columns else parted(edges)
    e = e.select("component", "u_id", "v_id", "w")
    total = 2.0 * float(e.agg(F.sum("w")).first()[0] or 0.0)
    key: Column = F.col("component")
    top, apart = None, None
    sizes = e.groupBy("component").count().filter((F.col("count") > SMALL_EDGES) & (F.col("component") != "all"))
    for r in sizes.select("component").collect():
        mine = e.filter(F.col("component") == r.component)
        t, few = contract(mine, gamma, total, SMALL_EDGES)
        top = t if top is None else top.unionByName(t)
        e = e.filter(F.col("component") != r.component)
        if few.count() > SMALL_EDGES:
            alone = t.select(F.concat(F.lit("alone "), "top").alias("part"), F.col("top").alias("node_id"), F.lit(0).cast("long").alias("local")).distinct()
            apart = alone if apart is None else apart.unionByName(alone)
        else:
            e = e.unionByName(few.select(F.lit(r.component).alias("component"), "u_id", "v_id", "w"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["u_id", "v_id"])
        names, code = np.unique(np.concatenate([d["u_id"].to_numpy(str), d["v_id"].to_numpy(str)]), return_inverse=True)
        labels = leiden(code[: len(d)], code[len(d) :], d["w"].to_numpy(float), len(names), gamma, total=total)
        return pd.DataFrame({"part": d["part"].iloc[0], "node_id": names, "local": labels})

    found = e.select(key.alias("part"), "u_id", "v_id", "w").repartition(spread(e), "part").groupBy("part").applyInPandas(run, "part string, node_id string, local long")
    if apart is not None:
        found = found.unionByName(apart)
    if top is not None:
        found = found.withColumnRenamed("node_id", "top").join(top.withColumnRenamed("node_id", "inner"), "top", "left").select("part", F.coalesce("inner", "top").alias("node_id"), "local")
    found = materialize(found, "found")  # read twice
    sizes = found.groupBy("part", "local").agg(F.count("*").alias("n"), F.min("node_id").alias("low"))
    ranked = sizes.withColumn("comm_id", (F.row_number().over(Window.orderBy(F.desc("n"), "low")) - 1).cast("int"))  # one row a community
    return found.join(ranked, ["part", "local"]).select("node_id", "comm_id")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """query_id, node_id, depth (the least number of out-hops from the query's seeds)."""
    reached = seeds.select("query_id", "node_id").distinct().withColumn("depth", F.lit(0))
    front = reached
    out = edges.select(F.col("s").alias("node_id"), F.col("o").alias("to")).distinct()
    for h in range(1, hops + 1):
        nxt = front.join(out, "node_id").select("query_id", F.col("to").alias("node_id")).distinct()
        front = nxt.join(reached.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(h))
        reached = reached.unionByName(front)
    return reached


def best_out_edges(edges: DataFrame, s: str = "s", o: str = "o") -> DataFrame:
    """For each (s, o) its edge of the greatest weight times predicate weight (ties: least predicate)."""
    e = edges.withColumn("pw", R.predicate_weight(F.col("label")))
    rank = F.row_number().over(Window.partitionBy(s, o).orderBy(F.desc(F.col("weight") * F.col("pw")), "p"))
    return e.withColumn("_r", rank).filter("_r = 1").drop("_r")


def best_first(candidates: pd.DataFrame, seeds: list[str], info: dict[str, tuple[float, bool, int | None]], max_hops: int, max_nodes: int, seed_cap: int, beam: int, max_chunks: int) -> list[tuple]:
    """The walk of one query, in pop order: (step, node, from, label, depth, score, chunks).

    candidates: s, o, label, edge_score, chunks; info: node -> (relevance and affinity, may be reached, community).
    Ties in the heap go to the lesser depth, node and origin.
    """
    out: dict[str, list] = defaultdict(list)
    for row in candidates.itertuples(index=False):
        out[row.s].append(row)
    heap: list[tuple] = []
    for node in [x for x in seeds if x in info][:seed_cap]:
        heapq.heappush(heap, (-info[node][0], 0, node, "", None, ()))
    seen: set[str] = set()
    at_depth: dict[int, int] = defaultdict(int)
    steps: list[tuple] = []
    expansions = collected = 0
    while heap and expansions < max_nodes and collected < max_chunks:
        score, depth, node, origin, label, chunks = heapq.heappop(heap)
        if node in seen:
            continue
        at_depth[depth] += 1
        if depth and (at_depth[depth] > beam or not info[node][1]):
            continue
        seen.add(node)
        expansions += depth > 0
        steps.append((len(steps), node, origin or None, label, depth, -score, list(chunks)))
        collected += len(chunks)
        if depth < max_hops:
            for e in out.get(node, ()):
                if e.o in seen or e.o not in info or not info[e.o][1]:
                    continue
                s = info[e.o][0] + e.edge_score - 0.05 * (depth + 1)
                if e.pw == 0 or s < 0:
                    continue
                heapq.heappush(heap, (-s, depth + 1, e.o, node, e.label, tuple(e.chunks)))
    return steps


STEPS = "query_id long, step int, node_id string, from_node_id string, label string, depth int, score double, chunks array<string>"


def traverse(edges: DataFrame, flags: DataFrame, seeds: DataFrame, members: DataFrame, targets: DataFrame, query_words: DataFrame, max_hops: int = 2, max_nodes: int = 50, seed_cap: int = 20, beam: int = 25, max_chunks: int = 120, scoped_edges: DataFrame | None = None, restrict: bool = False, per_node: int | None = None) -> DataFrame:
    """Best-first walks of many queries, one task a query over its own k-hop candidates.

    seeds: query_id, node_id, rank; targets: query_id, comm_id; query_words: query_id, words; scoped_edges: s, p, o that
    may be walked (either way round).  per_node: out-edges of a node that reach a walk's task; by default as many as it
    could take.
    """
    e = edges
    if scoped_edges is not None:
        both = scoped_edges.select("s", "p", "o").unionByName(scoped_edges.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).distinct()
        e = e.join(both, ["s", "p", "o"], "left_semi")
        inside = ends(scoped_edges, out="node_id").distinct()
        seeds = seeds.join(inside, "node_id", "left_semi")
    reach = materialize(k_hop(e, seeds, max_hops), "reach")
    # edges out of what can be reached are all that a walk may take, so only these are ranked
    near = reach.select(F.col("node_id").alias("s")).distinct()
    best = best_out_edges(e.join(near, "s", "left_semi"))
    same = edges.join(near, "s", "left_semi").groupBy("s", "o", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))
    best = best.drop("chunks").join(same, ["s", "o", "label"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit("[a-z]+"), F.lit(0)))
    n_words = F.greatest(F.size("words"), F.lit(1))
    node = reach.join(flags.select("node_id", "label", "valid_expansion"), "node_id").join(members.select("node_id", "comm_id"), "node_id", "left").join(query_words, "query_id")
    hit = targets.select("query_id", "comm_id", F.lit(True).alias("hit")).distinct()
    node = node.join(hit, ["query_id", "comm_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    own = 0.4 * F.size(F.array_intersect(words, "words")) / n_words + F.when(F.col("hit"), 0.3).otherwise(0.0)
    node = node.select("query_id", "node_id", own.alias("own"), (F.col("valid_expansion") & (F.col("hit") | F.lit(not restrict))).alias("ok"), F.col("comm_id"))
    part = node.select("query_id", F.col("node_id").alias("s")).join(best, "s")
    score = 0.2 * F.least(F.col("weight") / 10.0, F.lit(1.0)) * F.col("pw")
    # Of one node's out-edges only so many can be taken: each better one fills a place of the beam or was visited before.
    # The rest is cut here, so a hub doesn't fill the task of a query that meets it.
    to = node.select("query_id", F.col("node_id").alias("o"), F.col("own").alias("to_own"), F.col("ok").alias("to_ok"))
    part = part.join(to, ["query_id", "o"]).filter("to_ok and pw <> 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "s").orderBy(F.desc(F.col("to_own") + score), "o"))
    part = part.withColumn("r", rank).filter(F.col("r") <= (per_node or beam + seed_cap + max_nodes))
    used = part.select("query_id", F.col("o").alias("node_id")).unionByName(seeds.select("query_id", "node_id")).distinct()
    node = node.join(used, ["query_id", "node_id"], "left_semi")
    rows = part.select("query_id", F.lit(1).alias("kind"), "s", "o", "label", score.alias("x"), "pw", "chunks", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("int").alias("rank"))
    nodes = node.join(seeds.select("query_id", "node_id", "rank"), ["query_id", "node_id"], "left")
    rows = rows.unionByName(nodes.select("query_id", F.lit(0).alias("kind"), F.col("node_id").alias("s"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("label"), F.col("own").alias("x"), F.lit(None).cast("double").alias("pw"), F.lit(None).cast("array<string>").alias("chunks"), "ok", F.col("rank").cast("int")))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = d[d["kind"] == 0]
        info = {r.s: (float(r.x), bool(r.ok), None) for r in n.itertuples(index=False)}
        first = list(n[n["rank"].notna()].sort_values(["rank", "s"])["s"])
        c = d[d["kind"] == 1].rename(columns={"x": "edge_score"}).sort_values(["s", "o"])
        steps = best_first(c, first, info, max_hops, max_nodes, seed_cap, beam, max_chunks)
        return pd.DataFrame([(int(d["query_id"].iloc[0]), *s) for s in steps], columns=["query_id", "step", "node_id", "from_node_id", "label", "depth", "score", "chunks"])

    return rows.groupBy("query_id").applyInPandas(run, STEPS)

