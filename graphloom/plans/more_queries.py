"""Further functions and stages over the engine's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as X
from ..operators import graph as G
from ..operators import scope_text as S
from ..operators.relational import cosine
from .registry import query

_PREDS = ["is caused by", "causes", "causing", "written by", "wrote in", "written in", "acts on", "acts upon", "is moved by", "moves", "depends on", "depend"]
_QUESTIONS = ["What does Aristotle say about ethics in the Physics?", "Compare Plato with Kant on metaphysics", "Is there a Buddhist view of the self?", "a historical question", "Explain the soul"]


def _pairs(v):
    p = v.spark.createDataFrame([(x,) for x in _PREDS], "a string")
    return p.join(p.toDF("b"), F.col("a") < F.col("b"))


@query("ma1_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], q), 6)::double as score from embeddings a, qv")
def _(v):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.join(F.broadcast(v.qv)).select("vec_id", F.round(cosine(F.col("e"), F.col("q")), 6).alias("score"))


@query("jo21_edge_cosines", "select s, o, round(list_cosine_similarity(a.embedding, b.embedding), 6)::double as score from (select distinct s, o from tg) join ee a on a.entity = s join ee b on b.entity = o")
def _(v):
    j = v.tg.select("s", "o").distinct().join(v.ee.toDF("s", "ea"), "s").join(v.ee.toDF("o", "eb"), "o")
    return j.select("s", "o", F.round(cosine(F.col("ea"), F.col("eb")), 6).alias("score"))


@query("st6_citation_numbers", "select conv_id, key, row_number() over (partition by conv_id order by min(turn)) as idx from (select conv_id, turn, 'k' || (turn % 3) as key from conversations where role = 'assistant') group by 1, 2")
def _(v):
    m = v.msgs.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("see [1]. "), "text").alias("content"), F.array(F.concat(F.lit("k"), (F.col("turn") % 3).cast("string"))).alias("cites"))
    m = m.withColumn("content", F.lit("see [1]."))
    return C.indexes(m).withColumn("idx", F.col("idx").cast("long"))


@query("st6b_citation_rewrite")
def _(v):
    m = v.msgs.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("see [1] "), F.left("text", F.lit(30))).alias("content"), F.array(F.concat(F.lit("k"), (F.col("turn") % 3).cast("string"))).alias("cites"))
    return C.renumber(m)


@query("st10_mention_score", "select node_id, round_even((case when node_id like 'part%' then 1.0 else 0.0 end)::double - 0.1 + least(d / 20, 0.3), 3)::double as score from (select node_id, count(*) as d from (select s as node_id from tg union all select o from tg) group by 1)")
def _(v):
    d = G.degrees(v.tg)
    rel = F.when(F.col("node_id").startswith("part"), 1.0).otherwise(0.0)
    return d.select("node_id", X.mention_score(rel, F.col("node_id"), F.col("degree")).alias("score"))


@query("st18_lemmas")
def _(v):
    from ..operators.extraction import lemmatize

    return lemmatize(v.table("part").select("p_name"), "p_name", "lemma")


@query("st21_inverse_predicates")
def _(v):
    return _pairs(v).filter(X.is_inverse_pair(F.col("a"), F.col("b")))


@query("st22_role_conflicts")
def _(v):
    return _pairs(v).filter(X.roles_conflict(F.col("a"), F.col("b")))


@query("st24_scope_of_questions")
def _(v):
    q = v.spark.createDataFrame(list(enumerate(_QUESTIONS)), "id long, q string")
    c = F.col("q")
    return q.select("id", *(F.array_join(f(c), ",").alias(n) for n, f in (("authors", S.authors), ("works", S.works), ("traditions", S.traditions), ("domains", S.domains))))


@query("fi13_conceptness_threshold", """with t as (select percentile_cont(0.3) within group (order by size * 1.0) as cut from comms) select comm_id, coalesce(size, 0) >= cut as passes, coalesce(size, 0) >= cut * 0.8 as milder from comms, t""")
def _(v):
    t = v.comms.agg(F.percentile(F.col("size").cast("double"), 0.3).alias("cut"))
    return v.comms.join(F.broadcast(t)).select("comm_id", (F.col("size") >= F.col("cut")).alias("passes"), (F.col("size") >= F.col("cut") * 0.8).alias("milder"))


@query("fi16_score_defaults", "select node_id, coalesce(k2, 0.0)::double as score from nodes left join (select node_id, k / 10.0 as k2 from nodes where k % 3 = 0) using (node_id)")
def _(v):
    some = v.nodes.filter("k % 3 = 0").select("node_id", (F.col("k") / 10.0).alias("k2"))
    return v.nodes.select("node_id").join(some, "node_id", "left").select("node_id", F.coalesce("k2", F.lit(0.0)).alias("score"))


@query("fi26_category_labels", "select p_type, regexp_matches(lower(p_type), '(^| )(metal|green|type|brass|steel)( |$)') and length(p_type) >= 4 as label from (select distinct p_type from part)")
def _(v):
    return v.table("part").select("p_type").distinct().select("p_type", X.is_category_label(F.col("p_type"), ("metal", "green", "type", "brass", "steel")).alias("label"))


@query("ag23_rejections_by_reason", "select event_type as reason, count(*) as n from events group by 1")
def _(v):
    return v.table("events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("ag25_flag_or", "select comm_id, max(case when node_id like '%7' then 1 else 0 end) = 1 as flag from mem group by 1")
def _(v):
    return v.mem.groupBy("comm_id").agg(F.bool_or(F.col("node_id").like("%7")).alias("flag"))


@query("tk7_fused_top", "select chunk_id, round(1 / (1 + 0.1 * position) * 0.4, 6)::double as score from chunks order by round(1 / (1 + 0.1 * position) * 0.4, 6) desc, chunk_id limit 12")
def _(v):
    return v.chunks.select("chunk_id", F.round(0.4 * (1 / (1 + F.col("position") * 0.1)), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(12)


@query("sk1_graphml_rows", "select s, o, p as label, count(distinct chunk_id) as weight, array_to_string(list_sort(list(distinct chunk_id)), ',') as chunks from tg group by 1, 2, 3")
def _(v):
    from ..sources.sinks import graphml_rows

    return graphml_rows(G.directed_edges(v.tg))


@query("gr10_stored_communities", "select comm_id, len(node_ids)::int as size, case when len(node_ids) >= 100 then array_to_string(node_ids[1:15], ',') end as terms from comms")
def _(v):
    return v.comms.select("comm_id", "size", F.when(F.col("size") >= 100, F.array_join(F.slice("node_ids", 1, 15), ",")).alias("terms"))


@query("gr13_community_summaries", "select comm_id, 'Community ' || comm_id || ' of ' || size || ': ' || array_to_string(top_terms[1:5], ', ') as summary from comms")
def _(v):
    return v.comms.select("comm_id", F.concat(F.lit("Community "), "comm_id", F.lit(" of "), "size", F.lit(": "), F.array_join(F.slice("top_terms", 1, 5), ", ")).alias("summary"))


@query("gr15_community_detail", "select comm_id, size, array_to_string(top_terms, ',') as terms from comms where comm_id = 4")
def _(v):
    return v.comms.filter("comm_id = 4").select("comm_id", "size", F.array_join("top_terms", ",").alias("terms"))


@query("rt13_expand_node", "select o as neighbour, p, count(*) as n from tg where s = 'supplier 9' group by 1, 2 order by n desc, 1, 2 limit 15")
def _(v):
    from .agent import expand_node

    return expand_node(v.tg, "supplier 9")


@query("cl1_cleaning_profile", "select 'subject' as kind, subject_norm as name, count(*) as n from tt group by 2 having count(*) > 900 union all select 'predicate', predicate_norm, count(*) from tt group by 2")
def _(v):
    s = v.tt.groupBy(F.col("subject_norm").alias("name")).agg(F.count("*").alias("n")).filter("n > 900").select(F.lit("subject").alias("kind"), "name", "n")
    return s.unionByName(v.tt.groupBy(F.col("predicate_norm").alias("name")).agg(F.count("*").alias("n")).select(F.lit("predicate").alias("kind"), "name", "n"))


@query("au1_corpus_audit", "select source, count(*) as texts, min(n_chars) as low, max(n_chars) as high, floor(avg(n_chars))::bigint as mean from documents group by 1")
def _(v):
    return v.table("documents").groupBy("source").agg(F.count("*").alias("texts"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.floor(F.avg("n_chars")).alias("mean"))


@query("ch3_chunk_pending", "select text_id, char_count from raw where text_id not in (select doc_id from chunks where doc_id % 4 = 1)")
def _(v):
    return v.raw.join(v.chunks.filter("doc_id % 4 = 1").select(F.col("doc_id").alias("text_id")), "text_id", "left_anti").select("text_id", "char_count")


@query("cn2_predicate_canon_map")
def _(v):
    from ..operators.canonicalization import canonical_predicates

    p = v.tt.groupBy(F.col("predicate_norm").alias("predicate")).agg(F.count("*").alias("n"))
    return canonical_predicates(p)


@query("cn9_canonical_histogram")
def _(v):
    """Names, predicates and pairs through all steps, and how many pairs have how many edges in the end."""
    from ..operators.canonicalization import canonicalize_all

    t, _names, _preds = canonicalize_all(v.tg)
    pairs = t.groupBy("s", "o").agg(F.count("*").alias("edges"))
    return pairs.groupBy("edges").agg(F.count("*").alias("pairs"))


@query("cn4_pair_keys", "select distinct least(s, o) as a, greatest(s, o) as b from tg")
def _(v):
    return v.tg.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


@query("em2_entities_pending", "select node_id from nodes where node_id not in (select entity from ee)")
def _(v):
    return v.nodes.select("node_id").join(v.ee.select(F.col("entity").alias("node_id")), "node_id", "left_anti")


@query("rt3_query_vector", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 5)::double as norm from embeddings where vec_id = 0")
def _(v):
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return v.table("embeddings").filter("vec_id = 0").select("vec_id", F.round(sq, 5).alias("norm"))


@query("ap7_trace_steps", "select conv_id, array_to_string(list(turn || ':' || role order by turn), ' ') as trace from conversations group by 1")
def _(v):
    from .agent import traces

    return traces(v.msgs, "conv_id", "turn", "role")


@query("ap13_last_session", "select conv_id, max(turn) as last_turn from conversations group by 1")
def _(v):
    return v.msgs.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
