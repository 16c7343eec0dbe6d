"""Candidate, dictionary, state and context queries.

The documents have no names of people, so frequent capitalised tokens stand for them; the
claims are line items: the customer is the target, the priority the slot, the flag the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import match as M
from ..operators import state as S
from ..session import settled, table
from .registry import query

COMMON = ["the", "of", "and", "la", "de", "le", "que", "der", "die", "und", "el", "en"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def common(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in COMMON], "word string")


_TOK = r"""with raw as (select doc_id as id, generate_subscripts(p, 1) - 1 as n, unnest(p) as raw from (select doc_id, regexp_split_to_array(text, '[ \t\n\r]') as p from documents)),
 placed as (select *, coalesce(sum(length(raw) + 1) over (partition by id order by n rows between unbounded preceding and 1 preceding), 0) as off_, trim(raw, '"''.,;:!?()[]{}<>*#-_ ') as token from raw),
 tok as (select id, n, cast(off_ + instr(raw, token) - 1 as bigint) as start, token from placed where token <> ''),
 cnt as (select token as name, count(*) as count from tok where length(token) >= 2 and lower(token) not in ('the', 'of', 'and', 'la', 'de', 'le', 'que', 'der', 'die', 'und', 'el', 'en') group by token),
 short as (select * from cnt order by count desc, length(name) desc, name limit 40) """


def _short(spark: SparkSession, d: str, n: int = 40) -> DataFrame:
    return C.shortlist(C.counts(docs(spark, d), "text", common(spark)), n)


@query(_TOK + "select name, count from cnt where count >= 5")
def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.counts(docs(spark, d), "text", common(spark)).filter("count >= 5")


@query(_TOK + "select name, count from short")
def candidate_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return _short(spark, d)


_PRES = _TOK + """, lens as (select doc_id as id, greatest(0, length(text) - 500) as last from documents),
 w as (select id, unnest(list_distinct(list_concat(range(0, last + 1, 250), [last]))) as w0 from lens),
 pres as (select distinct t.token as name, t.id, w.w0 from tok t join short on short.name = t.token join w on w.id = t.id and t.start >= w.w0 and t.start + length(t.token) <= w.w0 + 500),
 imp as (select name, count(*) as importance from pres group by name),
 prs as (select a.name as "left", b.name as "right", count(*) as count from pres a join pres b on a.id = b.id and a.w0 = b.w0 and a.name < b.name join imp i on i.name = a.name and i.importance >= 8 join imp j on j.name = b.name and j.importance >= 8 group by all) """


def _present(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the shortlist's names, which are found where the texts lie."""
    rows, names = docs(spark, d), settled(_short(spark, d))
    found = M.matches_in(rows, names.select(F.col("name").alias("alias"), F.lit(0).alias("target_id")), "doc_id", "text", 1)
    return settled(C.presence(found.select("id", "start", F.col("alias").alias("token")), rows, names, "doc_id", "text"))


@query(_PRES + "select name, importance from imp")
def window_importance(spark: SparkSession, d: str) -> DataFrame:
    return C.importance(_present(spark, d))


@query(_PRES + 'select "left", "right", count from prs')
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    present = _present(spark, d)
    return C.cooccurrence(present, C.importance(present), 8)


@query(_PRES + """, e as (select "left" as name, "right" as other, count from prs union all select "right", "left", count from prs),
 b as (select e.name, max(e.count / sqrt(i.importance * j.importance)) as association from e join imp i on i.name = e.name join imp j on j.name = e.other group by e.name)
 select name, importance, round(coalesce(association, 0), 6) as association, round(18 * ln(1 + importance) + 14 * coalesce(association, 0), 6) as score from imp left join b using (name)""")
def shortlist_scores(spark: SparkSession, d: str) -> DataFrame:
    present = _present(spark, d)
    ranked = C.importance(present)
    out = C.scores(ranked, C.cooccurrence(present, ranked, 8))
    return out.select("name", "importance", F.round("association", 6).alias("association"), F.round("score", 6).alias("score"))


@query(_TOK + """, s as (select token, coalesce(lower(substring(lag(token) over o, 1, 1)), '^') as b, coalesce(lower(substring(lead(token) over o, 1, 1)), '$') as a from tok window o as (partition by id order by n)),
 e as (select token as name, 'left' as side, b as c, count(*) as n from s join short on name = token group by all union all select token, 'right', a, count(*) from s join short on name = token group by all),
 t as (select name, side, log2(sum(n)) - sum(n * log2(n)) / sum(n) as bits from e group by name, side)
 select name, round(max(bits) filter (side = 'left'), 6) as "left", round(max(bits) filter (side = 'right'), 6) as "right" from t group by name""")
def boundary_entropy(spark: SparkSession, d: str) -> DataFrame:
    out = C.boundary_entropy(C.tokens(docs(spark, d), "doc_id", "text"), _short(spark, d))
    return out.select("name", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query(_TOK + """, f as (select c.count, c.name, case when r.name is not null then r.name else c.name end as into_ from cnt c left join cnt r on r.name = regexp_replace(c.name, '(?:ing|ed|s)$', '') and r.name <> c.name) select into_ as name, cast(sum(count) as bigint) as count from f group by into_ having sum(count) >= 5""")
def shadow_fold(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_shadows(C.counts(docs(spark, d), "text", common(spark)), F.lit("(?:ing|ed|s)$")).filter("count >= 5")


_ALIAS = _TOK + """, g as (select id, n, start, start + length(token) as e, token as gram from tok union all
 select id, n, start, l + length(t2), token || ' ' || t2 from (select *, lead(token) over o as t2, lead(start) over o as l from tok window o as (partition by id order by n)) where t2 is not null),
 al as (select alias, (min(struct_pack(rank := rank, pos := pos, target_id := target_id))).target_id as target_id from (
   select doc_id as target_id, doc_id as rank, pos, alias from (select doc_id, 0 as pos, trim(split_part(text, ' ', 1), '"''.,;:!?()[]{}<>*#-_ ') as alias from documents union all
   select doc_id, 1, trim(split_part(text, ' ', 1), '"''.,;:!?()[]{}<>*#-_ ') || ' ' || trim(split_part(text, ' ', 2), '"''.,;:!?()[]{}<>*#-_ ') from documents)) where trim(alias) <> '' group by alias),
 found as (select g.id, g.start, g.e, al.alias, al.target_id from g join al on al.alias = g.gram),
 kept as (select * from (select *, max(e) over (partition by id order by start, e desc, target_id rows between unbounded preceding and 1 preceding) as reach from found) where reach is null or e > reach) """


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The first one and two words of every document name targets."""
    word = lambda k: F.btrim(F.split_part("text", F.lit(" "), F.lit(k)), F.lit("\"'.,;:!?()[]{}<>*#-_ "))
    return docs(spark, d).select(F.col("doc_id").alias("target_id"), F.col("doc_id").alias("rank"), F.array(word(1), F.concat_ws(" ", word(1), word(2))).alias("names"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return M.matches_in(docs(spark, d), settled(M.alias_table(_targets(spark, d))), "doc_id", "text", 2)


@query(_ALIAS + "select alias, target_id from al")
def alias_owners(spark: SparkSession, d: str) -> DataFrame:
    return M.alias_table(_targets(spark, d))


@query(_ALIAS + 'select id, start, e as "end", alias, target_id from kept')
def longest_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.longest(_found(spark, d))


@query(_ALIAS + "select id, target_id, count(*) as n, array_to_string(list_sort(list_distinct(list(alias))), '|') as terms from kept group by all")
def relevant_targets(spark: SparkSession, d: str) -> DataFrame:
    return M.relevant(M.longest(_found(spark, d))).withColumn("terms", F.array_join("terms", "|"))


_SEG = _ALIAS + """, seg as (select doc_id as id, doc_id * 10000000 + k as segment_id, k * 500 as start_pos, least((k + 1) * 500, length(text)) as end_pos, cast(least(7, floor((row_number() over (partition by source order by doc_id, k) - 1) * 8 / count(*) over (partition by source))) as integer) as bucket
   from documents, unnest(range(0, (length(text) + 499) // 500)) t(k)),
 post as (select segment_id, target_id, count(*) as n, round(count(*) / max(end_pos - start_pos), 6) as density, round(count(*) + least(2.0, 120 * count(*) / max(end_pos - start_pos)), 4) as score, min(start - start_pos) as "offset" from found join seg using (id) where start >= start_pos and e <= end_pos group by all) """


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Plain segments of 500 characters, with their place in the source."""
    rows = docs(spark, d).filter("length(text) > 0").select("source", F.col("doc_id").alias("id"), F.length("text").alias("len"), F.ceil(F.length("text") / 500).alias("n"))
    # A text's number of segments stands for them in the window; they are made after it.
    book = Window.partitionBy("source")
    before = F.sum("n").over(book.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(book)}).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return rows.select("id", (F.col("id") * 10_000_000 + F.col("k")).alias("segment_id"), (F.col("k") * 500).alias("start_pos"), F.least((F.col("k") + 1) * 500, F.col("len")).alias("end_pos"), M.progress_bucket(F.col("before") + F.col("k"), F.col("total")).alias("bucket"))


@query(_SEG + 'select segment_id, target_id, n, density, score, cast("offset" as bigint) as "offset" from post')
def mention_postings(spark: SparkSession, d: str) -> DataFrame:
    return M.mention_postings(_found(spark, d), _segments(spark, d))


@query(_SEG + "select target_id, bucket, segment_id, score from (select *, row_number() over (partition by target_id, bucket order by score desc, segment_id) as r from post join (select segment_id, bucket from seg) using (segment_id)) where r = 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    segments = _segments(spark, d)
    return M.coverage(M.mention_postings(_found(spark, d), segments), segments)


_REFS = _SEG + ", refs as (select target_id as name, segment_id as window_id, n as entity_count from post) "


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return M.mention_postings(_found(spark, d), _segments(spark, d)).select(F.col("target_id").alias("name"), F.col("segment_id").alias("window_id"), F.col("n").alias("entity_count"))


@query(_REFS + "select name, window_id, entity_count, r from (select *, row_number() over (partition by name order by entity_count desc, window_id) as r from refs) where r <= 5")
def entity_passages(spark: SparkSession, d: str) -> DataFrame:
    return M.passages(_refs(spark, d), 5).withColumn("r", F.col("r").cast("long"))


@query(_REFS + "select name, window_id, entity_count from refs where name = (select min(name) from refs) and window_id in (select window_id from refs where name = (select max(name) from refs)) order by entity_count desc, window_id limit 20")
def entity_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    refs = settled(_refs(spark, d))
    ends = refs.agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return M.cooccurring(refs, ends.select("a").scalar(), ends.select("b").scalar())


@query(_SEG + ', o as (select id as item, source as k, id as ord, length(source) + id % 400 as cost from (select doc_id as id, source from documents)), c as (select *, sum(cost) over (partition by k order by ord) as total from o) select k, item, cast(total as bigint) as total from c where total <= 2000')
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    return M.prefix_budget(_costs(spark, d), "k", ["ord"], 2000).select("k", "item", "total")


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("source").alias("k"), F.col("doc_id").alias("item"), F.col("doc_id").alias("ord"), (F.length("source") + F.col("doc_id") % 400).cast("long").alias("cost"))


@query("""with recursive o as (select source as k, doc_id as item, length(source) + doc_id % 400 as cost, row_number() over (partition by source order by doc_id) as r from documents),
 f as (select k, r, case when cost <= 2000 then cost else 0 end as used, case when cost <= 2000 then cast(item as varchar) else '' end as items from o where r = 1 union all
 select o.k, o.r, case when f.used + o.cost <= 2000 then f.used + o.cost else f.used end, case when f.used + o.cost <= 2000 then f.items || ',' || o.item else f.items end from f join o on o.k = f.k and o.r = f.r + 1)
 select k, cast(arg_max(used, r) as bigint) as used, ltrim(arg_max(items, r), ',') as items from f group by k""")
def greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    return M.within_budget(_costs(spark, d), "k", ["ord"], 2000).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


_CLAIMS = """with claims as (select o_custkey as target, o_orderpriority as slot, l_returnflag as value, cast(floor(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) / 200) as bigint) as chapter,
 cast(l_shipdate as date) - date '1992-01-01' as segment, l_orderkey * 10 + l_linenumber as claim_id, cast(l_quantity / 50 as double) as confidence, cast(case l_linenumber % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end as integer) as cues from lineitem join orders on l_orderkey = o_orderkey),
 w as (select *, confidence * case when cues = 2 then 0.5::double when cues = 4 then 0.35::double when cues = 8 then 0.2::double else 1.0::double end as w from claims),
 f as (select *, case when lag(value) over o is null or lag(value) over o <> value or chapter - lag(chapter) over o > 1 or (chapter = lag(chapter) over o and segment - lag(segment) over o > 4) then 1 else 0 end as new from w window o as (partition by target, slot order by chapter, segment, claim_id, value, w)),
 i as (select *, cast(sum(new) over (partition by target, slot order by chapter, segment, claim_id, value, w rows unbounded preceding) as bigint) as island from f),
 isl as (select target, slot, island, value, count(*) as claims, sum(w) as total, min(chapter) as start_chapter, max(chapter) as end_chapter, max(segment) as end_segment, max(claim_id) as claim_hi, bit_or(cues) as cues, list_sum(list_slice(list(w order by chapter, segment, claim_id, w), -2, -1)) as tail2 from i group by all),
 r as (select *, least(2.5, total) as support, least(1.5, tail2) as tail, least(2.0, coalesce(sum(total) over (partition by target, slot order by island rows between 1 following and unbounded following), 0) - coalesce(sum(total) over (partition by target, slot, value order by island rows between 1 following and unbounded following), 0)) as conflict,
  case when island = count(*) over (partition by target, slot) then 1.0 when island = count(*) over (partition by target, slot) - 1 and max(end_chapter) over (partition by target, slot) - end_chapter <= 1 then 0.4 else 0.0 end as recency from isl),
 reg as (select *, round(0.55 * tail + 0.30 * recency + 0.15 * support - 0.60 * conflict, 4) as currentness from r) """


def _islands(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    epoch = F.lit("1992-01-01").cast("date")
    cues = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), F.col("l_linenumber") % 4 + 1)
    claims = joined.select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("slot"), F.col("l_returnflag").alias("value"), F.floor(F.date_diff(F.col("o_orderdate").cast("date"), epoch) / 200).alias("chapter"), F.date_diff(F.col("l_shipdate").cast("date"), epoch).cast("long").alias("segment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_quantity") / 50).alias("confidence"), cues.alias("cues"))
    return S.regimes(claims)


@query(_CLAIMS + "select target, slot, island, value, claims, start_chapter, end_chapter, round(support, 4) as support, case when abs(conflict) < 1e-9 then 0.0::double else round(conflict, 4) end as conflict, case when abs(currentness) < 0.00005 then 0.0::double else currentness end as currentness from reg")
def state_regimes(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d).select("target", "slot", "island", "value", "claims", "start_chapter", "end_chapter", F.round("support", 4).alias("support"), (F.round("conflict", 4) + 0.0).alias("conflict"), F.when(F.abs("currentness") < 0.00005, 0.0).otherwise(F.col("currentness")).alias("currentness"))


@query(_CLAIMS + """, k as (select *, row_number() over o as rank, currentness - lead(currentness) over o as margin from reg window o as (partition by target, slot order by currentness desc, end_segment desc, claim_hi desc))
 select target, slot, rank, value, case when rank = 1 and margin < 0.25 then 'low_margin' when conflict >= 0.6 then 'conflict' when tail < 0.45 then 'weak_tail' when cues & 1 = 0 then 'not_asserted' end as hint from k where rank <= 2""")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    return S.current_state(_islands(spark, d)).select("target", "slot", F.col("rank").cast("long").alias("rank"), "value", "hint")


@query(_CLAIMS + ", k as (select *, row_number() over (partition by target, slot order by currentness desc, end_segment desc, claim_hi desc) as rank from reg) select target, slot, rank, value, start_chapter, end_chapter from k where rank <= 4")
def slot_trace(spark: SparkSession, d: str) -> DataFrame:
    return S.trace(_islands(spark, d)).withColumn("rank", F.col("rank").cast("long")).drop("currentness")


@query(_CLAIMS + """select a.target, a.slot, a.island, a.value, arg_min(b.start_chapter, b.island) as next_chapter, arg_min(b.value, b.island) as next_value from isl a left join isl b on a.target = b.target and a.slot = b.slot and b.island > a.island and b.value <> a.value group by all""")
def conflict_handles(spark: SparkSession, d: str) -> DataFrame:
    return S.next_conflict(_islands(spark, d))


@query("""with s as (select source as novel_id, doc_id as chapter_id, md5(text) as signature from documents where doc_id % 11 <> 3 or doc_id > 500), g as (select source as novel_id, doc_id as chapter_id, case when doc_id % 17 = 5 then 'x' else md5(text) end as signature from documents where doc_id % 19 <> 4),
 b as (select coalesce(s.novel_id, g.novel_id) as novel_id, coalesce(s.chapter_id, g.chapter_id) as c, s.signature as old, g.signature as new from s full join g on s.novel_id = g.novel_id and s.chapter_id = g.chapter_id)
 select novel_id, case when count(old) = 0 or count(*) filter (new is null) > 0 or coalesce(min(c) filter (old is null) < max(c) filter (old is not null), false) then 'full' when count(*) filter (new is not null and old is distinct from new) > 0 then 'incremental' else 'reuse' end as mode,
 count(*) filter (new is not null and old is distinct from new) as dirty from b group by novel_id""")
def index_update_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(F.col("source").alias("novel_id"), F.col("doc_id").alias("chapter_id"), F.md5("text").alias("signature"))
    given = rows.filter("chapter_id % 19 <> 4").withColumn("signature", F.when(F.col("chapter_id") % 17 == 5, "x").otherwise(F.col("signature")))
    return S.plan_update(rows.filter("chapter_id % 11 <> 3 or chapter_id > 500"), given)
