"""Rules and text functions over the engine's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rules as R
from ..operators import words as W
from ..operators.relational import by_ids
from .registry import query

_in = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_likes = lambda col, words: [f"lower({col}) like '%{w}%'" for w in words]


def _legacy_sql(s: str = "subject_norm", p: str = "predicate_norm", o: str = "object_norm") -> str:
    terms = _likes(s, R.EITHER) + _likes(o, R.EITHER) + _likes(s, R.SUBJECT) + _likes(p, R.PREDICATE) + _likes(o, R.OBJECT)
    near = [t for k, c in (("s", s), ("o", o), ("p", p)) for t in _likes(c, R._FOUNDATION[k])] + [f"lower({s}) = 'foundation'", f"lower({o}) = 'foundation'"]
    terms += [
        f"((lower({s}) like '%foundation%' or lower({o}) like '%foundation%') and ({' or '.join(near)}))",
        f"(lower({s}) = 'user' and lower({p}) like '%agree%')",
        f"(lower({p}) like '%links to%' and {o} like '/%')",
        f"(lower({s}) like '%icon%' and lower({p}) like '%depicts%')",
        f"{s} like '[%]'", f"{o} like '[%]'", f"{s} like '1.e.%'", f"{s} like '1.f.%'",
        f"(lower({s}) like '%contributions%' and lower({o}) like '%u.s.%')",
        f"(lower({s}) like '%web page%' and lower({p}) like '%used as%')",
        f"regexp_full_match({s}, '[0-9]+,[0-9]+')", f"regexp_full_match({s}, '[0-9]+-[0-9]+')",
        f"(lower({s}) like '%dog bark%' and lower({p}) not like '%symbol%')", f"(lower({s}) like '%sheep bleat%' and lower({p}) not like '%symbol%')",
    ]
    return "(" + " or ".join(terms) + ")"


@query("fi1_in_list", "select triple_id, chunk_id from tg where chunk_id in ('1', '2', '3', '100', '5000')")
def _(v):
    return by_ids(v.tg, "chunk_id", ["1", "2", "3", "100", "5000"]).select("triple_id", "chunk_id")


@query("fi2_dynamic_noise", "select triple_id from tt where lower(subject_norm) like '%green%' or lower(object_norm) like '%green%' or lower(predicate_norm) like '%part of%' or lower(subject_norm) = 'household' or lower(object_norm) = 'household' or (object_type = 'Concept' and lower(object_norm) like '%mach%') or (subject_type = 'Concept' and lower(subject_norm) like '%mach%')")
def _(v):
    return v.tt.filter(R.noise(["%green%"], ["%part of%"], ["household"], {"Concept": ["%mach%"]})).select("triple_id")


@query("fi3_legacy_noise", f"select doc_id from (select doc_id, text as subject_norm, source as predicate_norm, lang as object_norm from documents) where {_legacy_sql()}")
def _(v):
    d = v.table("documents").select("doc_id", F.col("text").alias("subject_norm"), F.col("source").alias("predicate_norm"), F.col("lang").alias("object_norm"))
    return d.filter(R.legacy_noise()).select("doc_id")


_ALPHA = "(regexp_full_match(subject_norm, '[A-Za-z][A-Za-z \\-]*') and regexp_full_match(predicate_norm, '[A-Za-z][A-Za-z \\-]*') and (object_norm is null or object_norm = '' or regexp_full_match(object_norm, '[A-Za-z][A-Za-z \\-]*')) and length(trim(subject_norm)) > 1 and (object_norm is null or object_norm = '' or length(trim(object_norm)) > 1))"


@query("fi4_alpha_filter", f"select triple_id from tt where {_ALPHA}")
def _(v):
    return v.tt.filter(R.alpha()).select("triple_id")


@query("fi5_noise_statistics", f"select count(*) as total, count(*) filter (lower(subject_norm) like '%green%' or lower(object_norm) like '%green%') as noisy, count(*) filter (not {_ALPHA}) as non_alpha, count(*) filter ({_ALPHA} and not (lower(subject_norm) like '%green%' or lower(object_norm) like '%green%')) as clean from tt")
def _(v):
    return R.count_noise(v.tt, R.noise(["%green%"]), R.alpha())


_PAGES = "(select page_id, regexp_replace(html, '<[^>]+>', chr(10), 'g') as content from pages union all select 1000000 + doc_id, text from documents)"


@query("fi8_chunk_skip_reason", rf"""
with c as (select page_id as id, content, list_filter(list_transform(regexp_split_to_array(content, '\n'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1:80] as ls from {_PAGES}),
m as (select *, greatest(1, len(ls)) as n,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?i)^((chapter|section|book|part|volume|appendix|index)\b|[ivxlcdm]+\.$|\d+([.)]\d+)*$)'))) as heads,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?i)(^|[\s_])(chapter|section|part|book|volume|appendix)[\s_]+([IVXLCDM]+|\d+)\b'))) as refs,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\bsee\s+(also|under)\b|\bcf\.\s'))) as idx,
  len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) as tokens from c)
select id, case when len(ls) = 0 then 'empty_chunk' when {' or '.join(f"lower(content) like '%{w}%'" for w in W.LEGAL_MARKERS)} then 'legal_boilerplate_chunk'
  when lower(content) like '%table of contents%' then 'table_of_contents_chunk' when heads >= 8 and heads / n >= 0.5 then 'structural_heading_chunk'
  when refs >= 5 and refs / n >= 0.3 then 'toc_like_chapter_listing' when idx >= 3 and idx / n >= 0.15 then 'index_glossary_chunk'
  when tokens <= 50 and heads / n >= 0.6 then 'short_header_only_chunk' end as reason from m""")
def _(v):
    pages = v.table("pages").select(F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]+>", "\n").alias("content"))
    docs = v.table("documents").select((F.col("doc_id") + 1000000).alias("id"), F.col("text").alias("content"))
    return pages.unionByName(docs).select("id", R.chunk_skip_reason("content").alias("reason"))


def _reject_sql(t: str) -> str:
    out = []
    for name, test in (
        ("pronoun", "lower({x}) in " + _in(W.PRONOUNS)), ("structural", "lower({x}) in " + _in(W.STRUCTURAL)), ("placeholder", "regexp_full_match(lower({x}), '[_\\s]*n[._\\s]*')"),
        ("single_letter", "regexp_full_match({x}, '[A-Za-z]')"), ("very_short_ascii", "regexp_full_match({x}, '[A-Za-z]{{1,2}}')"), ("entity_too_long", "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) > 8"),
    ):
        out += [f"when {test.format(x=c)} then '{name}_{e}'" for c, e in (("s", "subject"), ("o", "object"))]
    legal = " or ".join(f"lower(s || ' ' || p || ' ' || o) like '%{w}%'" for w in W.LEGAL_MARKERS)
    return f"select id, case {' '.join(out)} when {legal} then 'legal_boilerplate_triple' end as reason from {t}"


@query("fi9_triple_rejection", _reject_sql("(select doc_id as id, trim(split_part(text, ' ', 1)) as s, 'p' as p, trim(split_part(text, ' ', 3)) as o from documents union all select 1000000 + event_id, case event_id % 5 when 0 then 'they' when 1 then 'Index' when 2 then '_n_' when 3 then 'a' else 'a b c d e f g h i' end, 'has copyright', event_type from events)"))
def _(v):
    d = v.table("documents")
    w = F.split("text", " ")
    a = d.select(F.col("doc_id").alias("id"), F.coalesce(F.get(w, 0), F.lit("")).alias("s"), F.lit("p").alias("p"), F.coalesce(F.get(w, 2), F.lit("")).alias("o"))
    k = F.col("event_id") % 5
    s = F.when(k == 0, "they").when(k == 1, "Index").when(k == 2, "_n_").when(k == 3, "a").otherwise("a b c d e f g h i")
    b = v.table("events").select((F.col("event_id") + 1000000).alias("id"), s.alias("s"), F.lit("has copyright").alias("p"), F.col("event_type").alias("o"))
    return a.unionByName(b).select("id", R.triple_rejection_reason("s", "p", "o").alias("reason"))


_LABELS = "(select distinct p_name as label from part union select distinct p_type from part union select distinct split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) from documents union select unnest(['man', 'the soul', 'body without form', 'another form', 'cats and dogs', 'of', 'it', 'god', 'x-ray', '', 'five words are too many', 'being of the same']))"


def _labels(v):
    w = F.split("text", " ")
    part = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    d = v.table("documents").select(F.concat(part(0), F.lit(" "), part(1), F.lit(" "), part(2)).alias("label"))
    own = v.spark.createDataFrame([(x,) for x in ("man", "the soul", "body without form", "another form", "cats and dogs", "of", "it", "god", "x-ray", "", "five words are too many", "being of the same")], "label string")
    return v.table("part").select(F.explode(F.array("p_name", "p_type")).alias("label")).unionByName(d).unionByName(own).distinct()


@query("fi10_stop_labels", f"select label, lower(trim(label)) in {_in(W.STOP_LABELS)} or (length(trim(label)) <= 3 and lower(trim(label)) not in ('god', 'man', 'one', 'two')) as stop from {_LABELS}".replace("trim(label)", "trim(label, ' ' || chr(10) || chr(9))"))
def _(v):
    return _labels(v).select("label", R.is_stop_label(F.col("label")).alias("stop"))


@query("fi11_low_quality_labels", f"""
with l as (select label, regexp_extract_all(lower(label), '[a-z]+') as w from {_LABELS})
select label, coalesce(regexp_matches(label, '[-:;"()\\[\\]]') or len(w) = 0 or len(w) > 4 or (len(w) >= 3 and list_contains(w, 'and')) or w[1] in {_in(W.CLAUSE_MARKERS)}
  or (len(w) >= 3 and len(list_intersect(w[2:-2], {_list(W.CLAUSE_MARKERS)})) > 0) or w[1] in {_in(W.DETERMINERS)}
  or (len(w) > 1 and len(list_filter(w, lambda x: x in {_in(W.FUNCTION_WORDS)})) / len(w) > 0.5) or (len(w) > 1 and w[1] in {_in(W.FUNCTION_WORDS)}), false) as low from l""")
def _(v):
    return _labels(v).select("label", R.is_low_quality_label(F.col("label")).alias("low"))


@query("fi15_predicate_weight", f"""
select p, case when p in {_in(W.BLOCKED_PREDICATES)} then 0.0::double when p in {_in(W.GENERIC_PREDICATES)} then 0.2::double when {' or '.join(f"p like '%{w}%'" for w in W.VALUABLE_PREDICATES)} then 1.5::double else 1.0::double end as weight
from (select distinct predicate_norm as p from tt union select unnest(['is', 'and', 'it causes harm', 'means', 'returned from', 'is cause of', 'likes']))""")
def _(v):
    own = v.spark.createDataFrame([(x,) for x in ("is", "and", "it causes harm", "means", "returned from", "is cause of", "likes")], "p string")
    return v.tt.select(F.col("predicate_norm").alias("p")).unionByName(own).distinct().select("p", R.predicate_weight(F.col("p")).alias("weight"))


@query("fi17_grounded_chunks", "select chunk_id from chunks where chunk_id in (select chunk_id from tg where s <> '' or o <> '')")
def _(v):
    return v.chunks.select("chunk_id").join(v.tg.filter("s <> '' or o <> ''").select("chunk_id"), "chunk_id", "left_semi")


@query("fi21_pending_chunks", "select chunk_id from chunks where level in ('local', 'document') and chunk_id not in (select chunk_id from tg) order by doc_id limit 100")
def _(v):
    return v.chunks.filter(F.col("level").isin("local", "document")).join(v.tg.select("chunk_id"), "chunk_id", "left_anti").orderBy("doc_id").limit(100).select("chunk_id")


@query("fi22_eligible_by_size", "select comm_id, size from comms where size >= 50 order by size desc, comm_id limit 5")
def _(v):
    return v.comms.filter("size >= 50").select("comm_id", "size").orderBy(F.desc("size"), "comm_id").limit(5)


@query("fi23_communities_by_term", "select comm_id from comms where len(list_filter(top_terms, lambda t: lower(t) like '%part 10%' or lower(t) like '%supplier 2%')) > 0")
def _(v):
    hit = lambda t: F.lower(t).contains("part 10") | F.lower(t).contains("supplier 2")
    return v.comms.filter(F.exists("top_terms", hit)).select("comm_id")


@query("fi24_column_exclusion", "select * exclude (content, approx_tokens) from chunks")
def _(v):
    return v.chunks.drop("content", "approx_tokens")


@query("fi25_question_guards", "select conv_id, turn, regexp_matches(lower(text), 'hack|malware|phishing') as unsafe from conversations where role = 'user'")
def _(v):
    return v.msgs.filter("role = 'user'").select("conv_id", "turn", X.is_unsafe(F.col("text")).alias("unsafe"))


# --- strings ----------------------------------------------------------------------------------------------------------
@query("st1_collapse_whitespace", r"select page_id, array_to_string(list_filter(list_transform(string_split(replace(html, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from pages")
def _(v):
    return v.table("pages").select("page_id", X.collapse_whitespace(F.col("html")).alias("text"))


@query("st2_strip_tags", "select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as text from pages")
def _(v):
    return v.table("pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("st2b_strip_html")
def _(v):
    return v.table("pages").select("page_id", X.collapse_whitespace(X.strip_html(F.col("html"))).alias("text"))


@query("st3_normalize_entity", r"select doc_id, substring(regexp_replace(replace(trim(trim(split_part(text, chr(10), 1)), '\"''`()[]'), chr(10), ' '), '\s+', ' ', 'g'), 1, 100) as entity from documents".replace('\\"', '"'))
def _(v):
    return v.table("documents").select("doc_id", X.normalize_entity(F.get(F.split("text", "\n"), 0)).alias("entity"))


@query("st4_normalize_predicate", r"select doc_id, trim(lower(regexp_replace(translate(substring(text, 1, 60), '_-', '  '), '\s+', ' ', 'g'))) as p from documents")
def _(v):
    return v.table("documents").select("doc_id", F.trim(X.normalize_predicate(F.substring("text", 1, 60))).alias("p"))


@query("st5_json_block", r"""select event_id, regexp_extract(wrapped, '(?s)(\{.*\})', 1) as js from (select event_id, case when event_id % 2 = 0 then '```json' || chr(10) || props || chr(10) || '```' else 'Sure: ' || props || ' done' end as wrapped from events where props like '{%')""")
def _(v):
    e = v.table("events").filter("props like '{%'")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return e.select("event_id", X.json_block(wrapped).alias("js"))


@query("st7_strip_inventory")
def _(v):
    return v.msgs.select("conv_id", "turn", X.strip_inventory_udf(F.col("text")).alias("text"))


@query("st8_query_tokens", f"select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) > 2 and x not in {_in(W.QUERY_STOPWORDS)}))), ' ') as tokens from conversations")
def _(v):
    return v.msgs.select("conv_id", "turn", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("tokens"))


@query("st9_label_relevance", """
with q as (select ['green', 'blue', 'metal'] as q), l as (select distinct p_name as label, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) as w from part)
select label, round(case when len(list_intersect(w, q)) > 0 then len(list_intersect(w, q)) / least(len(w), 3)
  when len(list_filter(q, lambda x: len(x) >= 4 and len(list_filter(w, lambda y: contains(y, x))) > 0)) > 0 then 0.4
  when len(list_filter(w, lambda x: len(x) >= 4 and len(list_filter(q, lambda y: contains(y, x))) > 0)) > 0 then 0.3 else 0.0 end, 6)::double as score from l, q""")
def _(v):
    q = F.array(F.lit("green"), F.lit("blue"), F.lit("metal"))
    return v.table("part").select(F.col("p_name").alias("label")).distinct().select("label", F.round(X.label_relevance(F.col("label"), q), 6).alias("score"))


@query("st11_neighbour_score", "select s, o, round(0.2 * least(w / 10, 1.0) + 0.3 * least(c / 5, 1.0) + case when o like '%1' then 0.3 else 0.0 end, 6)::double as score from (select s, o, count(*) as w, count(distinct p) as c from tg group by 1, 2)")
def _(v):
    g = v.tg.groupBy("s", "o").agg(F.count("*").alias("w"), F.count_distinct("p").alias("c"))
    return g.select("s", "o", F.round(X.neighbour_score(F.col("w"), F.col("c"), F.col("o").endswith("1")), 6).alias("score"))


@query("st12_traversal_score", "select s, p, o, round(case when o like '%1' then 0.3 else 0.0 end + 0.2 * least(w / 10, 1.0) * case p when 'is' then 0.2 when 'depends on' then 1.5 else 1.0 end - 0.05, 6)::double as score from (select s, p, o, count(distinct chunk_id) as w from tg group by 1, 2, 3)")
def _(v):
    g = v.tg.groupBy("s", "p", "o").agg(F.count_distinct("chunk_id").alias("w"))
    x = X.traversal_score(F.lit(0), F.lit(0), F.col("o").endswith("1"), F.col("w"), R.predicate_weight(F.col("p")), F.lit(1))
    return g.select("s", "p", "o", F.round(x, 6).alias("score"))


@query("st13_clean_text", r"""select text_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\t+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: not regexp_full_match(x, '(?i)(page\s+)?\d+') and not regexp_matches(x, '(?i)licensed under')), chr(10)), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as text from raw""")
def _(v):
    return v.raw.select("text_id", X.clean_text(F.col("content"), ("licensed under",)).alias("text"))


@query("st14_paragraphs", r"select text_id, len(list_filter(list_transform(regexp_split_to_array(content, '\n{2,}'), lambda x: trim(x)), lambda x: x <> ''))::int as n from raw")
def _(v):
    return v.raw.select("text_id", F.size(X.paragraphs(F.col("content"))).alias("n"))


@query("st15_overlapping_windows", "select doc_id, i::int as i, substring(text, i * 1500 + 1, 1800) as w from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1800) / 1500), 0)::int + 1)) as i from documents)".replace("substring(text, i * 1500 + 1, 1800)", "case when length(text) <= 1800 then text else trim(substring(text, i * 1500 + 1, 1800), ' ' || chr(10) || chr(9)) end"))
def _(v):
    return v.table("documents").select("doc_id", F.posexplode(X.overlapping_windows(F.col("text"), 1800, 300)).alias("i", "w"))


@query("st16_approx_tokens", "select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents")
def _(v):
    return v.table("documents").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query("st17_sentences", r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> ''))::int as n from documents")
def _(v):
    return v.table("documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n"))


_CANON = ", ".join(f"('{w}', '{c}')" for c, ws in W.SYNONYMS.items() for w in (c, *ws))


@query("st20_predicate_synonyms", f"with m(w, c) as (values {_CANON}) select p, c as canon from (select distinct predicate_norm as p from tt union select unnest(['is', 'was', 'owns', 'gives', 'foo'])) left join m on p = w")
def _(v):
    own = v.spark.createDataFrame([(x,) for x in ("is", "was", "owns", "gives", "foo")], "p string")
    return v.tt.select(F.col("predicate_norm").alias("p")).unionByName(own).distinct().select("p", X.canonical_predicate(F.col("p")).alias("canon"))


@query("st23_fuzzy_presence")
def _(v):
    d = v.table("documents")
    return d.select("doc_id", F.round(X.fuzzy_presence(F.concat(F.get(F.split("text", " "), 1), F.lit("x")), F.left("text", F.lit(400))), 6).alias("ratio"))


@query("st25_context_format", """with s as (select chunk_id, list_cosine_similarity(embedding, q) as score from ec, qv), t as (select * from s where chunk_id in (select chunk_id from chunks) order by score desc, chunk_id limit 12)
select string_agg('[' || i || '] ' || left(content, 40), chr(10) order by i) as context from (select row_number() over (order by score desc, chunk_id) as i, content from t join chunks using (chunk_id))""")
def _(v):
    from ..operators.retrieval import scoped_vector_top_k

    top = scoped_vector_top_k(v.ec, v.chunks.select("chunk_id"), v.qv, 12)  # a context is a few chunks
    c = top.join(v.chunks.select("chunk_id", "content"), "chunk_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "chunk_id", "content"))).alias("a"))
    return c.select(F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), F.left(x["content"], F.lit(40)))), "\n").alias("context"))


@query("st26_preview", "select doc_id, case when length(text) > 300 then left(text, 300) || '...' else text end as preview from documents")
def _(v):
    return v.table("documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("st27_citation_refs", r"select event_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '\[(\d+)\]', 1), lambda x: x::int), lambda x: x between 1 and 12))), ',') as refs from (select event_id, 'as [' || event_id % 20 || '] and [' || event_id % 7 || ']' as a from events)")
def _(v):
    a = F.concat(F.lit("as ["), F.col("event_id") % 20, F.lit("] and ["), F.col("event_id") % 7, F.lit("]"))
    return v.table("events").select("event_id", F.array_join(F.array_sort(X.citation_refs(a, 12)), ",").alias("refs"))


@query("st28_escape_html", "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as safe from pages")
def _(v):
    return v.table("pages").select("page_id", X.escape_html(F.col("html")).alias("safe"))


@query("st30_scalar_functions", "select doc_id, lower(lang) as a, length(text) as b, coalesce(nullif(lang, 'en'), 'none') as c, least(doc_id, 50) as d, greatest(doc_id, n_chars) as e, case when text like '%the%' then 1 else 0 end as f, array_to_string(string_split(text, ' ')[1:5], '|') as g from documents")
def _(v):
    return v.table("documents").select("doc_id", F.lower("lang").alias("a"), F.length("text").cast("long").alias("b"), F.coalesce(F.nullif("lang", F.lit("en")), F.lit("none")).alias("c"), F.least("doc_id", F.lit(50)).alias("d"), F.greatest("doc_id", "n_chars").alias("e"), F.when(F.col("text").like("%the%"), 1).otherwise(0).alias("f"), F.array_join(F.slice(F.split("text", " "), 1, 5), "|").alias("g"))


@query("ma2_log_clamp", "select node_id, round(ln(1 + k) + greatest(0, k - 50), 6)::double as x from nodes")
def _(v):
    return v.nodes.select("node_id", F.round(F.log1p("k") + F.greatest(F.lit(0), F.col("k") - 50), 6).alias("x"))


@query("ma3_position_decay", "select chunk_id, round(1 / (1 + 0.1 * position), 6)::double as a, round(greatest(0.5, 1 - 0.02 * position), 6)::double as b, round(1 - 0.05 * position, 6)::double as c from chunks")
def _(v):
    p = F.col("position")
    return v.chunks.select("chunk_id", F.round(1 / (1 + 0.1 * p), 6).alias("a"), F.round(F.greatest(F.lit(0.5), 1 - 0.02 * p), 6).alias("b"), F.round(1 - 0.05 * p, 6).alias("c"))


@query("ma4_percentile_of_array", "select label, round(quantile_cont(x, 0.25), 6)::double as p25 from (select label, unnest(embedding)::double as x from embeddings) group by 1")
def _(v):
    e = v.table("embeddings").select("label", F.explode("embedding").alias("x"))
    return e.groupBy("label").agg(F.round(F.percentile(F.col("x").cast("double"), 0.25), 6).alias("p25"))


@query("dt1_date_prefix", "select event_id, left(strftime(ts, '%Y-%m-%d %H:%M:%S'), 10) as day from events")
def _(v):
    return v.table("events").select("event_id", F.left(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(10)).alias("day"))


@query("dt2_duration", "select doc_id, case when n_chars >= 3600 then (n_chars // 3600) || 'h ' || (n_chars % 3600 // 60) || 'm ' || (n_chars % 60) || 's' when n_chars >= 60 then (n_chars // 60) || 'm ' || (n_chars % 60) || 's' else n_chars || 's' end as t from documents")
def _(v):
    return v.table("documents").select("doc_id", X.duration(F.col("n_chars")).alias("t"))
