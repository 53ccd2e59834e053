"""Search, scope, seeds, fusion, context, citations, and the state of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import retrieval as T
from ..operators.relational import ends, global_rank
from .registry import query

SCOPE = T.Scope(authors=("src0", "src3"))
_SCORED = "scored as (select chunk_id, list_cosine_similarity(embedding, q) as score from ec, qv)"
_INSIDE = "inside as (select chunk_id from chunks join files using (text_id) where author_source in ('src0', 'src3'))"
_R = "select chunk_id, round(score, 6)::double as score from"


def _r(df):
    return df.withColumn("score", F.round("score", 6))


@query("tk1_chunk_top_k", f"with {_SCORED} {_R} scored order by score desc, chunk_id limit 25")
def _(v):
    return _r(T.vector_top_k(v.ec, v.qv, 25))


@query("tk2_summary_top_k", "select comm_id, round(list_cosine_similarity(summary_embedding, q), 6)::double as score from comms, qv where summary_embedding is not null order by score desc, comm_id limit 5")
def _(v):
    return _r(T.vector_top_k(v.comms.filter("summary_embedding is not null"), v.qv, 5, "comm_id", "summary_embedding"))


@query("tk3_report_top_k", "select comm_id, round(list_cosine_similarity(report_embedding, q), 6)::double as score, array_to_string(cited_chunk_ids, ',') as cited from reports, qv order by score desc, comm_id limit 5")
def _(v):
    return _r(T.report_top_k(v.reports, v.qv, 5)).withColumn("cited", F.array_join("cited", ","))


@query("jo12_scoped_report_top_k", f"""with {_INSIDE}, top as (select comm_id, list_cosine_similarity(report_embedding, q) as score, cited_chunk_ids from reports, qv order by score desc, comm_id limit 8),
e as (select comm_id, score, unnest(case when len(cited_chunk_ids) = 0 then [null] else cited_chunk_ids end) as chunk_id from top)
select comm_id, round(score, 6)::double as score, coalesce(string_agg(chunk_id, ',' order by chunk_id), '') as cited from e where chunk_id is null or chunk_id in (select chunk_id from inside) group by 1, 2""")
def _(v):
    return _r(T.report_top_k(v.reports, v.qv, 8, SCOPE.chunks(v.files, v.chunks))).withColumn("cited", F.array_join("cited", ","))


@query("jo7_scoped_top_k", f"with {_INSIDE}, {_SCORED} {_R} scored where chunk_id in (select chunk_id from inside) order by score desc, chunk_id limit 15")
def _(v):
    return _r(T.scoped_vector_top_k(v.ec, SCOPE.chunks(v.files, v.chunks), v.qv, 15))


@query("tk4_grounded_top_k", f"with {_SCORED}, near as (select * from scored order by score desc, chunk_id limit 50) {_R} near where chunk_id in (select chunk_id from tg) order by score desc, chunk_id limit 10")
def _(v):
    return _r(T.grounded_top_k(v.ec, v.tg, v.qv, 10))


@query("tk15_grounded_reports", "with top as (select comm_id, cited_chunk_ids from reports, qv order by list_cosine_similarity(report_embedding, q) desc, comm_id limit 5) select comm_id, chunk_id from (select comm_id, unnest(cited_chunk_ids) as chunk_id from top) where chunk_id in (select chunk_id from tg)")
def _(v):
    top = T.report_top_k(v.reports, v.qv, 5).select("comm_id", F.explode("cited").alias("chunk_id"))
    return top.join(v.tg.select("chunk_id").distinct(), "chunk_id", "left_semi").select("comm_id", "chunk_id")


@query("fi18_scope_texts", "select text_id from files where author_source in ('src0', 'src3', 'src7') and (domains like '%en%' or domains like '%fr%')")
def _(v):
    return T.Scope(authors=("src0", "src3", "src7"), domains=("en", "fr")).texts(v.files)


@query("fi19_scope_filter_ranked", f"with {_INSIDE} select chunk_id, doc_id as rank from chunks where chunk_id in (select chunk_id from inside)")
def _(v):
    ranked = v.chunks.select("chunk_id", F.col("doc_id").alias("rank"))
    return ranked.join(SCOPE.chunks(v.files, v.chunks), "chunk_id", "left_semi")


@query("fi20_scope_chunk_count", f"with {_INSIDE} select count(*) as n from inside")
def _(v):
    return SCOPE.chunks(v.files, v.chunks).agg(F.count("*").alias("n"))


@query("q10_empty_scope", "select chunk_id, 0.0::double as score from ec where 1 = 0")
def _(v):
    return _r(T.scoped_vector_top_k(v.ec, T.Scope(authors=("nobody",)).chunks(v.files, v.chunks), v.qv, 5))


@query("rt1_hybrid_search", f"with {_SCORED}, a as ({_R} scored order by score desc, chunk_id limit 10), b as (select comm_id, list_cosine_similarity(summary_embedding, q) as s from comms, qv order by s desc, comm_id limit 5) select 'chunk' as kind, chunk_id as id, score from a union all select 'community', comm_id::varchar, round(s, 6)::double from b".replace(f"{_R} scored", "select chunk_id, round(score, 6)::double as score from scored"))
def _(v):
    a = _r(T.vector_top_k(v.ec, v.qv, 10)).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "score")
    b = _r(T.vector_top_k(v.comms.filter("summary_embedding is not null"), v.qv, 5, "comm_id", "summary_embedding"))
    return a.unionByName(b.select(F.lit("community").alias("kind"), F.col("comm_id").cast("string").alias("id"), "score"))


@query("rt2_report_citations", "with top as (select comm_id, cited_chunk_ids from reports, qv order by list_cosine_similarity(report_embedding, q) desc, comm_id limit 5) select distinct unnest(cited_chunk_ids) as chunk_id from top")
def _(v):
    return T.report_top_k(v.reports, v.qv, 5).select(F.explode("cited").alias("chunk_id")).distinct()


@query("rt4_seed_scores", """with c as (select distinct node_id from (select s as node_id from tg where chunk_id in ('1', '2', '3', '4', '5', '6', '7') union all select o from tg where chunk_id in ('1', '2', '3', '4', '5', '6', '7')))
select node_id, round(case when node_id like 'part%' then 1.0 else 0.0 end + case when comm_id in (1, 2) then 0.3 else 0.0 end, 6)::double as score from c join mem using (node_id)
where node_id like 'part%' or comm_id in (1, 2) order by score desc, node_id limit 20""")
def _(v):
    c = ends(v.tg.filter(F.col("chunk_id").isin(*"1234567")), out="node_id").distinct()
    flags = v.nodes.select("node_id", F.col("node_id").alias("label"), F.lit(True).alias("valid_seed"))
    return _r(T.seeds(c, flags, v.mem, F.array(F.lit("part")), [1, 2])).select("node_id", "score")


_FUSED = f"""with {_SCORED}, vec as (select chunk_id, score from scored order by score desc, chunk_id limit 15), g as (select chunk_id, position as step from chunks)
select chunk_id, round(coalesce(vec.score * 0.6, 0) + coalesce(0.4 / (1 + step * 0.1), 0), 6)::double as score, case when vec.score is null then 'graph' when step is null then 'vector' else 'both' end as source
from vec full join g using (chunk_id) order by 2 desc, 1 limit 30"""


@query("rt5_fusion", _FUSED)
def _(v):
    g = v.chunks.select("chunk_id", F.col("position").alias("step"))
    return _r(T.fuse(T.vector_top_k(v.ec, v.qv, 15), g))


@query("rt6_context_selection", f"""with {_SCORED}, vec as (select chunk_id, (row_number() over (order by score desc, chunk_id))::double - 1.0 as rank from scored order by score desc, chunk_id limit 15),
near as (select comm_id, list_cosine_similarity(report_embedding, q) as s, cited_chunk_ids as c from reports, qv order by s desc, comm_id limit 5),
cites as (select s, comm_id, unnest(c) as chunk_id, unnest(range(len(c))) as pos from near), rep as (select chunk_id, (row_number() over (order by s desc, comm_id, pos))::double - 1.0 as rank from cites), walk as (select chunk_id, position - 1 as step from chunks),
one as (select chunk_id, 1 as tier, rank as k, 1.0 - rank * 0.05 as score from rep where rank < 8),
w as (select chunk_id, greatest(0.5, 1.0 - step * 0.02) as s from walk where chunk_id not in (select chunk_id from one)), wr as (select *, row_number() over (order by s desc, chunk_id) as r from w),
allc as (select * from one union all select chunk_id, case when r <= 12 then 2 else 4 end, -s, case when r <= 12 then s else s * 0.8 end from wr union all select chunk_id, 3, rank, 0.8 - rank * 0.02 from vec),
best as (select *, row_number() over (partition by chunk_id order by tier, k) as n from allc), placed as (select chunk_id, score, tier, row_number() over (order by tier, k, chunk_id) as place from best where n = 1)
select chunk_id, round(score, 6)::double as score, tier::int as tier, place::int as place from placed where place <= 35""")
def _(v):
    vec = T.vector_top_k(v.ec, v.qv, 15)
    vec = vec.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1)  # fifteen rows
    cites = T.report_top_k(v.reports, v.qv, 5).select("score", "comm_id", F.posexplode("cited").alias("pos", "chunk_id"))
    rep = cites.orderBy(F.desc("score"), "comm_id", "pos").limit(8).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "comm_id", "pos")) - 1)  # eight rows
    walk = v.chunks.select("chunk_id", (F.col("position") - 1).alias("step"))
    return _r(T.select_context(rep, walk, vec.select("chunk_id", "rank")))


@query("rt7_ranked_context", "select doc_id as rank, chunk_id, content from chunks where doc_id in (3, 17, 5, 400)")
def _(v):
    ids = v.spark.createDataFrame([("3", 3), ("17", 17), ("5", 5), ("400", 400)], "chunk_id string, rank long")
    return ids.join(v.chunks.select("chunk_id", "content"), "chunk_id").select("rank", "chunk_id", "content")


@query("rt8_citations", """with e as (select distinct chunk_id, n from (select chunk_id, s as n from tg union all select chunk_id, o from tg)), m as (select e.chunk_id, string_agg(e.n, ',' order by e.n) as entities, arg_min(comm_id, e.n) filter (comm_id is not null) as comm_id from e left join mem on e.n = node_id group by 1)
select doc_id as rank, chunk_id, case when length(content) > 300 then left(content, 300) || '...' else content end as preview, title, author_source, coalesce(entities, '') as entities, comm_id from chunks left join files using (text_id) left join m using (chunk_id)""")
def _(v):
    ids = v.chunks.select("chunk_id", F.col("doc_id").alias("rank"))
    return T.citations(ids, v.chunks, v.files, v.tg, v.mem).withColumn("entities", F.array_join("entities", ","))


@query("rt9_scope_activation", f"with {_INSIDE} select count(distinct (s, p, o)) as edges, (select count(*) from (select s as n from tg where chunk_id in (select chunk_id from inside) union select o from tg where chunk_id in (select chunk_id from inside))) as nodes from tg where chunk_id in (select chunk_id from inside)")
def _(v):
    scoped = v.tg.join(SCOPE.chunks(v.files, v.chunks), "chunk_id", "left_semi")
    return scoped.agg(F.count_distinct("s", "p", "o").alias("edges")).join(F.broadcast(ends(scoped).distinct().agg(F.count("*").alias("nodes"))))


@query("rt10_scope_check", f"with {_INSIDE}, {_SCORED} select chunk_id from scored where chunk_id in (select chunk_id from inside) order by score desc, chunk_id limit 15")
def _(v):
    inside = SCOPE.chunks(v.files, v.chunks)
    return T.check_scope(T.scoped_vector_top_k(v.ec, inside, v.qv, 15).select("chunk_id"), inside, "vector search")


@query("rt11_multi_hop_answers")
def _(v):
    from .engine import KnowledgeEngine

    # the query set: first user turns of conversations whose id is divisible by 20
    n = F.broadcast(v.table("embeddings").agg(F.count("*").alias("n")))
    first = v.msgs.filter("role = 'user' and conv_id % 20 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    q = first.join(n).select(F.col("conv_id").alias("query_id"), "question", (F.col("conv_id") % F.col("n")).alias("vec_id"))
    return KnowledgeEngine(v).answer(q)


@query("rt12_simple_query", f"with {_SCORED}, t as (select chunk_id, score from scored order by score desc, chunk_id limit 10) select chunk_id, round(score, 6)::double as score, left(content, 50) as head from t join chunks using (chunk_id)")
def _(v):
    return _r(T.vector_top_k(v.ec, v.qv, 10)).join(v.chunks.select("chunk_id", F.left("content", F.lit(50)).alias("head")), "chunk_id")


@query("tk11_neighbour_ranking", f"with {_INSIDE}, e as (select s, o, count(*) as w, max(case when chunk_id in (select chunk_id from inside) then 1 else 0 end) = 1 as in_scope from tg where s = 'supplier 3' group by 1, 2) select o, w, in_scope from e order by in_scope desc, w desc, o limit 20")
def _(v):
    t = v.tg.filter("s = 'supplier 3'").join(SCOPE.chunks(v.files, v.chunks).withColumn("i", F.lit(True)), "chunk_id", "left")
    e = t.groupBy("o").agg(F.count("*").alias("w"), F.coalesce(F.bool_or("i"), F.lit(False)).alias("in_scope"))
    return e.orderBy(F.desc("in_scope"), F.desc("w"), "o").limit(20)


# --- sessions and limits on the events table --------------------------------------------------------------------------
@query("sr1_rate_limit", """with recursive r as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
w as (select event_id, user_id, ts, i, ts as start, 1 as n from r where i = 1 union all
  select r.event_id, r.user_id, r.ts, r.i, case when r.ts >= w.start + interval 3600 second then r.ts else w.start end, case when r.ts >= w.start + interval 3600 second then 1 else w.n + 1 end from w join r on r.user_id = w.user_id and r.i = w.i + 1)
select event_id, n <= 2 as allowed from w""".replace("with recursive ", "with "), recursive=True)
def _(v):
    from ..streaming.state import fixed_window_limit

    return fixed_window_limit(v.table("events"), "user_id", "ts", "event_id", 2, 3600)


@query("sr2_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g) select user_id, count(*) as n, count(distinct sid) as sessions from s group by 1""")
def _(v):
    s = v.table("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))


@query("sr2b_least_recently_used", "select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_used from events group by 1 order by max(ts) desc, 1 limit 200")
def _(v):
    return v.table("events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_used")).orderBy(F.desc("last_used"), "user_id").limit(200).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("sr3_incremental_pending", "select chunk_id from chunks where chunk_id not in (select chunk_id from ec)")
def _(v):
    return v.chunks.select("chunk_id").join(v.ec.select("chunk_id"), "chunk_id", "left_anti")


@query("sr5_sequence", "select event_id, row_number() over (order by ts, event_id) as seq from events")
def _(v):
    return global_rank(v.table("events").select("event_id", "ts"), ["ts", "event_id"], "seq").select("event_id", "seq")


# --- control plane ----------------------------------------------------------------------------------------------------
@query("ap1_phase_audit", """with m as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev from conversations), t(a, b) as (values ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
select conv_id, turn, prev is null or exists (select 1 from t where a = prev and b = role) as valid from m""")
def _(v):
    from .control import audit

    allowed = v.spark.createDataFrame([("system", "user"), ("user", "assistant"), ("assistant", "user")], "prev string, role string")
    return audit(v.msgs, allowed, "conv_id", "turn", "role")


@query("ap4_synthesis_gate", """with a as (select conv_id, turn from conversations where role = 'assistant'), r as (select conv_id, turn from conversations where turn <= 6), b as (select conv_id, min(turn) as turn from a group by 1)
select a.conv_id as query_id, bool_and(r.turn is not null) and bool_or(b.turn is null) as passes from a left join r using (conv_id, turn) left join b using (conv_id, turn) group by 1""")
def _(v):
    from .control import gate

    # turns stand for chunks: an answer's own are cited, the first seven were read, its first was cited before
    at = lambda d: d.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"))
    cited = v.msgs.filter("role = 'assistant'")
    before = cited.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return gate(at(cited), at(v.msgs.filter("turn <= 6")), at(before))


@query("ap5_path_edges", "select conv_id, turn, role as from_node, lead(role) over (partition by conv_id order by turn) as to_node from conversations qualify to_node is not null")
def _(v):
    from .agent import path_edges

    return path_edges(v.msgs, "conv_id", "turn", "role")


@query("sk8_transcript", "select conv_id, string_agg(upper(role) || ': ' || text, chr(10) order by turn) as transcript from conversations group by 1")
def _(v):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.upper(x["role"]), F.lit(": "), x["text"]))
    return v.msgs.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("transcript"))


# --- chunking, extraction, embedding ----------------------------------------------------------------------------------
@query("ch1_paragraph_chunks")
def _(v):
    from ..operators.chunking import paragraph_chunks

    return paragraph_chunks(v.raw.select("text_id", "content"))


@query("ch2_semantic_chunks")
def _(v):
    from ..operators.chunking import semantic_chunks

    return semantic_chunks(v.raw.select("text_id", "content"))


@query("ex1_extraction")
def _(v):
    from ..operators.extraction import extract

    return extract(v.chunks.select("chunk_id", "content"))


@query("em1_embed_pending", "select chunk_id, 64::int as dims from chunks where chunk_id not in (select chunk_id from ec)")
def _(v):
    from ..operators.extraction import embed

    pending = v.chunks.join(v.ec.select("chunk_id"), "chunk_id", "left_anti")
    return embed(pending.select("chunk_id", "content"), "chunk_id", "content").select("chunk_id", F.size("embedding").alias("dims"))


@query("cn1_entity_canon_map")
def _(v):
    from ..operators.extraction import lemmatize

    names = v.tt.select(F.col("subject_norm").alias("entity_orig")).distinct()
    return lemmatize(names, "entity_orig", "entity_canon")


@query("cn3_semantic_merge")
def _(v):
    from ..operators.canonicalization import is_name, merge_entities

    n = ends(v.tg).groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 2")
    return merge_entities(v.ee.join(n, "entity").select(F.col("entity").alias("name"), "n", "embedding", is_name(F.col("entity")).alias("is_named")), 0.92)
