"""Graph building, components, conceptness, communities and walks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as G
from ..operators.relational import ends
from ..operators.shared import materialize
from .registry import query

_EDGES = "edges as (select s, p, o, count(distinct chunk_id) as weight from tg group by 1, 2, 3)"
_PAIRS = "pairs as (select least(s, o) as u, greatest(s, o) as v, count(distinct chunk_id) as weight from tg where s <> o group by 1, 2)"
_COS = "(select sum(a * b) from (select unnest({x}) as a, unnest({y}) as b))"


@query("gr1_nodes_and_edges", f"with {_EDGES} select 'edge' as kind, s || '|' || p || '|' || o as id, weight from edges union all select 'node', node_id, null from nodes")
def _(v):
    e = G.directed_edges(v.tg)
    edges = e.select(F.lit("edge").alias("kind"), F.concat_ws("|", "s", "p", "o").alias("id"), "weight")
    nodes = ends(e, out="id").distinct().select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("weight"))
    return edges.unionByName(nodes)


@query("gr2_cluster_projection", f"with {_PAIRS} select u as u_id, v as v_id, weight from pairs")
def _(v):
    return G.pair_edges(v.tg)


@query("gr3_out_neighbours", "select distinct o as neighbour, p from tg where s = 'supplier 5'")
def _(v):
    return v.tg.filter("s = 'supplier 5'").select(F.col("o").alias("neighbour"), "p").distinct()


@query("gr4_clustering_edges", f"""with {_PAIRS}, deg as (select n, count(*) as d from (select u as n from pairs union all select v from pairs) group by 1),
over_ as (select n from deg where d > (select greatest(1, floor(count(*) * 0.4)) from deg))
select u as u_id, v as v_id, round(ln(1 + weight), 6)::double as w from pairs where u not in (select n from over_) and v not in (select n from over_)""")
def _(v):
    return G.clustering_edges(G.pair_edges(v.tg), degree_pct=0.4).select("u_id", "v_id", F.round("w", 6).alias("w"))


@query("gr7_components")
def _(v):
    """Recursive SQL is too slow for whole tables; tests hold this against union-find."""
    return G.components(v.tg.select("s", "o"), "s", "o")


@query("gr8_induced_subgraph", "with top as (select n from (select n, count(*) as d from (select s as n from tg union all select o from tg) group by 1) order by d desc, n limit 300) select distinct s, p, o from tg where s in (select n from top) and o in (select n from top)")
def _(v):
    top = G.degrees(v.tg).orderBy(F.desc("degree"), "node_id").limit(300).select("node_id")
    return v.tg.join(top.toDF("s"), "s", "left_semi").join(top.toDF("o"), "o", "left_semi").select("s", "p", "o").distinct()


@query("gr11_membership_explode", "select comm_id, unnest(node_ids) as node_id, 1.0::double as weight from comms")
def _(v):
    return v.comms.select("comm_id", F.explode("node_ids").alias("node_id"), F.lit(1.0).alias("weight"))


@query("gr12_nodes_of_communities", "select distinct node_id from mem where comm_id in (0, 3)")
def _(v):
    return v.mem.filter(F.col("comm_id").isin(0, 3)).select("node_id").distinct()


_REPORT = "select comm_id, array_to_string(list(node_id order by d desc, node_id)[1:15], ',') as top_entities, count(*) as size from (select node_id, count(*) as d from (select s as node_id from tg union all select o from tg) group by 1) join mem using (node_id) group by 1"


@query("gr14_report_entities", _REPORT)
def _(v):
    d = G.degrees(v.tg).join(v.mem, "node_id")
    r = F.row_number().over(Window.partitionBy("comm_id").orderBy(F.desc("degree"), "node_id"))
    sizes = d.groupBy("comm_id").agg(F.count("*").alias("size"))
    top = d.withColumn("r", r).filter("r <= 15").groupBy("comm_id").agg(F.array_sort(F.collect_list(F.struct("r", "node_id"))).alias("x"))
    return top.join(sizes, "comm_id").select("comm_id", F.array_join(F.col("x.node_id"), ",").alias("top_entities"), "size")


@query("gr14b_report_citations", "select comm_id, array_to_string(list_sort(list(distinct chunk_id))[1:50], ',') as cited from tg join mem on s = node_id group by 1")
def _(v):
    c = v.tg.join(v.mem.select(F.col("node_id").alias("s"), "comm_id"), "s").select("comm_id", "chunk_id").distinct()
    r = F.row_number().over(Window.partitionBy("comm_id").orderBy("chunk_id"))
    return c.withColumn("r", r).filter("r <= 50").groupBy("comm_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("cited"))


_CONCEPTNESS = f"""with {_EDGES}, m as (select n, count(*) as c from (select s as n from tg union all select o from tg) group by 1),
near as (select e, n, sum(weight) as w from (select s as e, o as n, weight from edges union all select o, s, weight from edges) group by 1, 2),
best as (select e, n from (select *, row_number() over (partition by e order by w desc, n) as r from near) where r <= 10),
sims as (select e, avg(list_cosine_similarity(a.embedding, b.embedding)) as cohesion, count(*) as k from best join ee a on a.entity = e join ee b on b.entity = n group by 1),
deg as (select e, sum(w)::bigint as wd from near group by 1)
select e as entity_id, round(coalesce(cohesion, 0), 6)::double as cohesion, round(ln(1 + coalesce(c, 0)) + ln(1 + wd), 6)::double as support,
       round(greatest(0, coalesce(cohesion, 0)) * (ln(1 + coalesce(c, 0)) + ln(1 + wd)), 6)::double as conceptness, coalesce(k, 0)::bigint as neighbor_count, wd as weighted_degree, coalesce(c, 0)::bigint as mention_count
from deg left join sims using (e) left join m on m.n = e"""


@query("gr16_conceptness", _CONCEPTNESS)
def _(v):
    c = _scores(v)
    return c.select("entity_id", *(F.round(x, 6).alias(x) for x in ("cohesion", "support", "conceptness")), "neighbor_count", "weighted_degree", "mention_count")


def _scores(v):
    # distinct chunks are counted where the edge's rows are: one exchange instead of two
    e = v.tg.select("s", "p", "o", "chunk_id").repartition("s", "p", "o").groupBy("s", "p", "o").agg(F.count_distinct("chunk_id").alias("weight"))
    stored = v.ee.select("entity", F.col("embedding").cast("array<float>").alias("embedding"))  # the table's own floats, half as wide
    return G.conceptness(e, ends(v.tg).groupBy("entity").agg(F.count("*").alias("mentions")), stored)


@query("tk5_lowest_conceptness", _CONCEPTNESS.replace("select e as entity_id, round(coalesce", ", c as (select e as entity_id, round(coalesce") + ") select entity_id, conceptness from c order by conceptness, entity_id limit 20")
def _(v):
    return _scores(v).orderBy(F.round("conceptness", 6), "entity_id").limit(20).select("entity_id", F.round("conceptness", 6).alias("conceptness"))


@query("fi12_hub_and_degree", "with d as (select node_id, count(*) as degree from (select s as node_id from e union all select o from e) group by 1) select node_id, degree > greatest(10, floor((select count(*) from d) * 0.01)) as hub, degree >= 3 as enough from d".replace("from e ", "from (select distinct s, p, o from tg) ").replace("from e)", "from (select distinct s, p, o from tg))"))
def _(v):
    d = G.degrees(v.tg.select("s", "p", "o").distinct())
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    return d.join(n).select("node_id", (F.col("degree") > F.greatest(F.lit(10), F.floor(F.col("n") * 0.01))).alias("hub"), (F.col("degree") >= 3).alias("enough"))


def _flags(v):
    e = v.tg.select("s", "p", "o").distinct()
    return G.node_flags(v.nodes.select("node_id", F.col("node_id").alias("label")), e, _scores(v))


@query("fi14_node_flags")
def _(v):
    return _flags(v)


@query("tk9_graph_view", """with d as (select n, count(*) as d from (select s as n from tg union all select o from tg) group by 1 order by d desc, n limit 250)
select distinct s, o from tg where s in (select n from d) and o in (select n from d)""")
def _(v):
    top = G.degrees(v.tg).orderBy(F.desc("degree"), "node_id").limit(250).select("node_id")
    return v.tg.join(top.toDF("s"), "s", "left_semi").join(top.toDF("o"), "o", "left_semi").select("s", "o").distinct()


@query("gr5_best_first_walks")
def _(v):
    e = materialize(G.directed_edges(v.tg), "edges")
    # the query set: a walk from each supplier whose number is divisible by 20
    q = v.nodes.filter("node_id like 'supplier %' and k % 20 = 0").select(F.col("k").alias("query_id"), "node_id", F.lit(0).alias("rank"), F.array(F.lit("part"), F.lit("one")).alias("words"))
    t = q.select("query_id", (F.col("query_id") % 10).cast("int").alias("comm_id"))
    steps = G.traverse(e, _flags(v), q.select("query_id", "node_id", "rank"), v.mem, t, q.select("query_id", "words"))
    return steps.withColumn("chunks", F.array_join("chunks", ",")).withColumn("score", F.round("score", 6))


@query("gr6_leiden")
def _(v):
    return G.communities(materialize(G.clustering_edges(G.pair_edges(v.tg), degree_pct=0.4), "edges"), 0.8)


@query("gr9_resolution_sweep")
def _(v):
    e = G.parted(materialize(G.clustering_edges(G.pair_edges(v.tg), degree_pct=0.4)))
    out = None
    for g in (0.4, 0.8, 1.2):
        sizes = G.communities(e, g).groupBy("comm_id").agg(F.count("*").alias("n"))
        s = sizes.agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.count_if(F.col("n") > 10).alias("over10")).withColumn("gamma", F.lit(g))
        out = s if out is None else out.unionByName(s)
    return out


@query("cn5_threshold_components")
def _(v):
    """Recursive SQL is too slow for whole tables; tests hold this against union-find."""
    from ..operators.canonical import similar_links

    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return G.components(similar_links(e, "vec_id", 0.35), "a", "b")


@query("jo20_similar_pairs", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)::double as score from embeddings a join embeddings b on a.vec_id < b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4")
def _(v):
    from ..operators.canonical import similar_pairs

    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return similar_pairs(e, "vec_id", 0.4).select("a", "b", F.round("score", 6).alias("score"))
