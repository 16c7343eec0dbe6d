"""World, check and retrieval queries.

Customers and suppliers stand for entities and line items' orders for relationships; documents
for generated versions; benchmark items for questions; conversations for sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import phrases as P
from ..operators import retrieval as R
from ..operators import world as W
from ..session import table
from .registry import query


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("description"), F.when(k % 3 != 0, F.array(F.concat(F.lit("al"), k % 700), F.concat(F.lit("Zz"), k))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(k % 5 == 0, "draft").otherwise("confirmed").alias("status"), F.when(k % 6 == 0, "manual").otherwise("pack").alias("origin"), F.when(k % 7 != 0, F.concat(F.lit("p"), k % 2)).alias("pack"), (k % 9 == 0).alias("in_use")
    )


_ENT = """with ent as (select c_custkey as id, c_name as name, c_mktsegment as entity_type, case when c_custkey % 4 <> 0 then c_mktsegment end as description, case when c_custkey % 3 <> 0 then ['al' || (c_custkey % 700), 'Zz' || c_custkey] else [] end as aliases,
 case when c_custkey % 5 = 0 then 'draft' else 'confirmed' end as status, case when c_custkey % 6 = 0 then 'manual' else 'pack' end as origin, case when c_custkey % 7 <> 0 then 'p' || (c_custkey % 2) end as pack, c_custkey % 9 = 0 as in_use from customer),
 edg as (select o_orderkey as edge_id, o_custkey as source_id, o_custkey * 7 % 150 + 1 as target_id, case when o_orderkey % 2 = 0 then upper(o_orderpriority) else lower(o_orderpriority) || '  Relation' end as label, case when o_orderkey % 3 = 0 then 'hidden' else 'active' end as visibility from orders),
 sgn as (select *, case when trim(regexp_replace(o1, '(?:relationship|relation|关系|関係|관계)$', '')) <> '' then trim(regexp_replace(o1, '(?:relationship|relation|关系|関係|관계)$', '')) else o1 end as canonical from (select *, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) as o1 from edg)),
 sg as (select *, least(source_id, target_id) || '|' || greatest(source_id, target_id) || '|' || canonical as signature from sgn) """


def edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lower("o_orderpriority"), F.lit("  Relation")))
    return table(spark, d, "orders").select(k.alias("edge_id"), F.col("o_custkey").alias("source_id"), (F.col("o_custkey") * 7 % 150 + 1).alias("target_id"), label.alias("label"), F.when(k % 3 == 0, "hidden").otherwise("active").alias("visibility"))


@query(_ENT + "select id, name from ent where (name ilike '%00%' or entity_type ilike '%00%') and status = 'draft'")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return W.search(entities(spark, d), "00", ["name", "entity_type"], {"status": "draft", "origin": ""}).select("id", "name")


@query(_ENT + "select edge_id, source_id as node from edg where source_id in (select id from ent) union select edge_id, target_id from edg where target_id in (select id from ent)")
def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.incident(edges(spark, d), entities(spark, d))


@query(_ENT + ", s as (select *, case when source_id = 7 then target_id else source_id end as peer from edg where source_id = 7 or target_id = 7) select edge_id, peer, count(*) over (partition by peer) as parallel, row_number() over (partition by peer order by edge_id) as nth from s")
def star_graph(spark: SparkSession, d: str) -> DataFrame:
    return W.star(edges(spark, d), F.lit(7)).select("edge_id", "peer", "parallel", F.col("nth").cast("long").alias("nth"))


@query(_ENT + """, near as (select distinct edge_id from edg where source_id in (3, 4) or target_id in (3, 4) order by edge_id limit 60), ends as (select source_id as id from edg join near using (edge_id) union select target_id from edg join near using (edge_id) union select unnest([3, 4]))
 select id, name from ent where id in (select id from ends) order by id limit 80""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    nodes = entities(spark, d)
    return W.neighbourhood(edges(spark, d), nodes, nodes.filter("id in (3, 4)")).select("id", "name")


@query(_ENT + """, k as (select id, lower(name) as k from ent union all select id, lower(unnest(aliases)) from ent), one as (select k, min(id) as id from k group by k having count(distinct id) = 1)
 select n.name, one.id from (select distinct 'AL' || (o_orderkey % 900) as name from orders) n left join one on one.k = lower(n.name)""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "orders").select(F.concat(F.lit("AL"), F.col("o_orderkey") % 900).alias("name")).distinct()
    return W.resolve(names, entities(spark, d))


@query(_ENT + "select alias, count(distinct id) as entities from (select id, lower(unnest(aliases)) as alias from ent) group by alias having count(distinct id) > 1")
def ambiguous_aliases(spark: SparkSession, d: str) -> DataFrame:
    return W.ambiguous(entities(spark, d))


@query(_ENT + "select edge_id, canonical, signature from (select *, row_number() over (partition by source_id, target_id, canonical order by edge_id) as r from sg where source_id <> target_id) where r = 1")
def unique_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.unique_edges(edges(spark, d)).select("edge_id", "canonical", "signature")


@query(_ENT + "select min(edge_id) as edge_id, signature from sg where source_id <> target_id and edge_id % 10 >= 7 and signature not in (select signature from sg where edge_id % 10 < 7) group by signature")
def new_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d)
    return W.new_edges(rows.filter("edge_id % 10 >= 7"), rows.filter("edge_id % 10 < 7")).select("edge_id", "signature")


@query(_ENT + """, g as (select name, entity_type as t, case when id % 8 = 0 then 'changed' else description end as description from ent where id % 5 <> 1 union all select 'new' || id, entity_type, 'x' from ent where id % 50 = 0),
 s as (select * from ent where id % 10 <> 3)
 select coalesce(s.name, g.name) as name, case when s.name is null then 'create' when g.name is null and s.pack is null then 'keep' when g.name is null and (s.origin = 'manual' or s.in_use) then 'keep' when g.name is null then 'delete'
 when s.pack is null then 'link_existing' when s.origin = 'manual' then 'preserve' when s.entity_type = g.t and s.description is not distinct from g.description then 'noop' else 'update' end as action from s full join g on s.name = g.name""")
def pack_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    given = rows.filter("id % 5 <> 1").select("name", "entity_type", F.when(F.col("id") % 8 == 0, "changed").otherwise(F.col("description")).alias("description"))
    extra = rows.filter("id % 50 = 0").select(F.concat(F.lit("new"), "id").alias("name"), "entity_type", F.lit("x").alias("description"))
    return W.reconcile(rows.filter("id % 10 <> 3"), given.union(extra), "name", ["entity_type", "description"])


@query("""with r as (select l_orderkey % 40 as chunk, l_orderkey * 100 + l_linenumber * 10000000 + l_partkey as position, 'n' || (l_suppkey % 60) as name, case when l_linenumber % 3 = 0 then 'other' else l_returnflag end as entity_type, repeat('d', cast(l_quantity as integer)) || l_partkey as description, ['a' || (l_partkey % 5)] as aliases from lineitem)
 select name, coalesce(arg_min(entity_type, (chunk, position)) filter (entity_type <> 'other'), arg_min(entity_type, (chunk, position))) as entity_type, arg_max(description, (length(description), -chunk, -position)) as description, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') as aliases, count(*) as mentions from r group by name""")
def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    position = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    rows = li.select((F.col("l_orderkey") % 40).alias("chunk"), position.alias("position"), F.concat(F.lit("n"), F.col("l_suppkey") % 60).alias("name"), F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise(F.col("l_returnflag")).alias("entity_type"), F.concat(F.repeat(F.lit("d"), F.col("l_quantity").cast("int")), F.col("l_partkey")).alias("description"), F.array(F.concat(F.lit("a"), F.col("l_partkey") % 5)).alias("aliases"))
    return W.merge_chunks(rows).withColumn("aliases", F.array_join("aliases", ","))


@query("""with r as (select distinct n_name as by_, c_name as v from customer join nation on n_nationkey = c_nationkey), k as (select *, row_number() over (partition by by_ order by v) as r, count(*) over (partition by by_) as n from r)
 select by_ as nation, n, string_agg(v, ', ' order by r) filter (r <= 6) || case when n > 6 then ' (+' || (n - 6) || ' more)' else '' end as sample from k group by by_, n""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "c_name")
    return W.sample(rows, "nation", "c_name")


@query(_ENT + "select 'entities' as kind, count(*) as drafts from ent where status = 'draft' union all select 'orders', count(*) from orders where o_orderstatus = 'P'")
def draft_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "draft").alias("status"))
    return W.draft_counts(("entities", entities(spark, d)), ("orders", orders))


@query(_ENT + """, a as (select distinct o_custkey as id from orders), m as (select ent.id, list_filter([case when coalesce(trim(description), '') = '' then 'description' end, case when len(aliases) = 0 then 'aliases' end, case when a.id is null then 'attributes' end], lambda x: x is not null) as missing from ent left join a on a.id = ent.id where status = 'draft')
 select id, array_to_string(missing, ',') as missing from m where len(missing) > 0""")
def draft_audit(spark: SparkSession, d: str) -> DataFrame:
    attributes = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"))
    return W.audit(entities(spark, d), attributes).withColumn("missing", F.array_join("missing", ","))


def _context(spark: SparkSession, d: str, writer: bool) -> DataFrame:
    attributes = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 5).alias("sort_order"), F.concat(F.lit("k"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("surface"), F.when(F.col("o_orderkey") % 4 == 0, "hidden").otherwise("active").alias("visibility"))
    nodes = entities(spark, d)
    out = W.context(nodes, attributes, edges(spark, d), nodes.filter("id % 3 <> 0"), writer)
    return out.select("id", "name", F.array_join("attributes", ";").alias("attributes"), F.array_join("edges", ";").alias("edges"))


_CTX = _ENT + """, ch as (select id, name from ent where status = 'confirmed' and id % 3 <> 0), atr as (select o_custkey as id, string_agg('k' || o_orderkey || '=' || o_orderstatus, ';' order by o_orderkey % 5, 'k' || o_orderkey, o_orderstatus) as attributes from orders where {a} group by 1),
 ed as (select source_id as id, string_agg(label || '>' || target_id, ';' order by target_id, label) as edges from edg where {e} and source_id in (select id from ch) and target_id in (select id from ch) group by 1) select ch.id, name, attributes, edges from ch left join atr using (id) left join ed using (id)"""


@query(_CTX.replace("{a}", "o_orderkey % 4 <> 0").replace("{e}", "visibility <> 'hidden'"))
def writer_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, True)


@query(_CTX.replace("{a}", "true").replace("{e}", "true"))
def checker_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, False)


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"


@query(f"""with w as (select doc_id as version, {_WORDS} as w from documents), g as (select version, array_to_string(w[k:(k + n - 1)], ' ') as gram, k as at from w, range(3, 6) s(n), unnest(range(1, len(w) - n + 2)) t(k)),
 c as (select version, gram, count(*) as count, min(at) as first from g group by all having count(*) >= 3) select version, gram, count from (select *, row_number() over (partition by version order by count desc, length(gram) desc, first, gram) as r from c) where r = 1""".replace(" as at ", " as at_ ").replace("min(at)", "min(at_)"))
def repeated_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_phrases(docs(spark, d), "doc_id", "text", F.lit("whitespace")).drop("family")


@query(r"""with p as (select doc_id as version, generate_subscripts(a, 1) - 1 as paragraph, unnest(a) as p from (select doc_id, regexp_split_to_array(text, '\n[ \t]*\n') as a from documents)) select version, paragraph, len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) as words from p where words > 250""")
def long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return K.long_paragraphs(docs(spark, d), "doc_id", "text").withColumn("paragraph", F.col("paragraph").cast("long"))


@query(r"""with s as (select doc_id as version, generate_subscripts(a, 1) - 1 as sentence, unnest(a) as s from (select doc_id, regexp_extract_all(text, '[^.!?。！？…]+[.!?。！？…]*') as a from documents)) select version, sentence, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as words from s where words > 30""")
def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    return K.long_sentences(docs(spark, d), "doc_id", "text", 30).withColumn("sentence", F.col("sentence").cast("long"))


@query("select doc_id as version, phrase, instr(lower(text), phrase) as at_ from documents, (values ('license'), ('the and'), ('was of')) p(phrase) where instr(lower(text), phrase) > 0".replace(" as at_", " as \"at\""))
def summary_tone(spark: SparkSession, d: str) -> DataFrame:
    return K.phrase_hits(docs(spark, d), "doc_id", "text", ["license", "the and", "was of"])


@query(r"""with known as (select distinct lower(unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}'))) as k from benchmark union select lower(n_name) from nation),
 t as (select distinct doc_id as version, substring(text, 1, 200) as recent, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}')) as term from documents) select distinct version, term from t where not contains(recent, term) and lower(term) not in (select k from known)""")
def term_drift(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "benchmark").select(F.explode(K.named_terms(F.col("text"))).alias("term")).union(table(spark, d, "nation").select("n_name"))
    rows = docs(spark, d).withColumn("recent", F.substring("text", 1, 200))
    return K.drift(rows, K.named_terms(F.col("text")), known, "doc_id", "recent")


_FIND = r"""with q as (select item_id as query_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 12)) as term from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+'), lambda x: length(x) >= 2) as l from benchmark)),
 w as (select doc_id as id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+')) as term from documents), ix as (select id, term, count(*) as n from w where length(term) >= 2 group by all),
 h as (select query_id, id, count(*) as terms, sum(n) as hits from q join ix using (term) group by all) """


@query(_FIND + "select query_id, term from q")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.terms_of(table(spark, d, "benchmark"), "item_id", "text")


@query(_FIND + "select query_id, rank, id, terms, cast(hits as bigint) as hits from (select *, row_number() over (partition by query_id order by terms desc, hits desc, id) as rank from h) where rank <= 12")
def find_texts(spark: SparkSession, d: str) -> DataFrame:
    out = R.find(R.terms_of(table(spark, d, "benchmark"), "item_id", "text"), R.postings(docs(spark, d), "doc_id", "text"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("""with p as (select l_suppkey as query_id, 'pk' || (l_partkey % 30) as pack_id, l_linenumber as support, 'v' || l_partkey as preview from lineitem), o as (select query_id, pack_id, arg_max(preview, (support, preview)) as preview, max(support) as support from p group by all)
 select query_id, pack_id, preview, support, rank from (select *, row_number() over (partition by query_id order by support desc, pack_id) as rank from o) where rank <= 12""")
def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("pk"), F.col("l_partkey") % 30).alias("pack_id"), F.col("l_linenumber").alias("support"), F.concat(F.lit("v"), "l_partkey").alias("preview"))
    return R.dedupe_packs(rows).withColumn("rank", F.col("rank").cast("long"))


@query("""with a as (select c_nationkey as query_id, c_custkey as id from customer), b as (select s_nationkey as query_id, s_suppkey as id from supplier) select * from a union all select * from b where query_id not in (select query_id from a group by 1 having count(*) >= 3)""")
def evidence_fallback(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"))
    return R.first_enough(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id")))


@query("""select conv_id, row_number() over (partition by conv_id order by turn) as nth, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations where trim(text) <> '') where back <= 4""")
def follow_up_turns(spark: SparkSession, d: str) -> DataFrame:
    return R.follow_up(table(spark, d, "conversations")).withColumn("nth", F.col("nth").cast("long"))


@query("""with r as (select o_custkey as session_id, o_orderkey as id, case o_orderstatus when 'O' then 'running' when 'P' then 'queued' else 'done' end as status, o_orderdate as created_at from orders) select session_id, arg_max(id, (created_at, id)) as id, arg_max(status, (created_at, id)) as status, count(*) filter (status in ('queued', 'running')) as active from r group by session_id""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    return R.latest_run(table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at")))


@query("""with m as (select o_custkey as user_id, count(*) as mine from orders where o_orderstatus = 'P' group by 1), t as (select count(*) as total from orders where o_orderstatus = 'P') select c_custkey as user_id, not (total >= 1000000 or coalesce(mine, 0) >= 2) as admitted, case when total >= 1000000 then 'busy' when coalesce(mine, 0) >= 2 then 'user_limit' end as reason from customer left join m on user_id = c_custkey, t""")
def run_admission(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return R.admission(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), active, 2, 1_000_000)
