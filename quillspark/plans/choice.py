"""Candidates and pairs taken for refinement, and evidence opened by handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beside as B
from ..operators import candidates as C
from ..operators import evidence as V
from ..operators import match as M
from ..operators import refine as R
from ..session import settled
from .cjk import _HAN_SQL, _T, _WRITTEN, RULES, _person, han
from .discovery import _TOK, common, docs
from .registry import query

NAMES, PAIRS = 512, 1000
_SUFFIXES, _BACKDROP = ("王子", "城主"), ("马罗", "克尔")
_H = _HAN_SQL.replace("text", "{}", 1)


def _importance(spark: SparkSession, d: str) -> DataFrame:
    """Names in Han characters with their counts."""
    counted = C.counts(docs(spark, d), "text", common(spark)).groupBy(han(F.col("name")).alias("name")).agg(F.sum("count").alias("importance"))
    return settled(counted.filter("name <> '' and importance >= 3"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """How often two names stand side by side."""
    beside = M.neighbour_counts(docs(spark, d), "text").select(han(F.col("a")).alias("a"), han(F.col("b")).alias("b"), "count").filter("a <> b and a <> '' and b <> ''")
    return settled(beside.groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.sum("count").alias("count")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    importance = _importance(spark, d)
    value = R.surface_value(F.col("name"), RULES, _SUFFIXES, _BACKDROP)
    return settled(R.scores(importance, B.strongest(docs(spark, d), "text", importance, _WRITTEN), value, R.prefix_shadows(importance, RULES)))


_BASE = _TOK + f""", imp as (select * from (select {_H.format('name')} as name, cast(sum(count) as bigint) as importance from cnt group by 1) where name <> '' and importance >= 3),
 nx as (select {_H.format('token')} as a, {_H.format('b')} as b from (select token, lead(token) over (partition by id order by n) as b from tok) where b is not null),
 prs as (select least(a, b) as "left", greatest(a, b) as "right", count(*) as count from nx where a <> b and a <> '' and b <> '' group by all),
 ppl as (select * from imp where {_person('name')}),
 shd as (select name, long from (select s.name, l.name as long, s.importance as i, l.importance as its, row_number() over w as r, coalesce(lead(l.importance) over w, 0) as second from ppl s join ppl l on left(l.name, length(l.name) - 1) = s.name window w as (partition by s.name order by l.importance desc, l.name)) where r = 1 and its / i >= 0.92 and second / its < 0.5),
 asc_ as (select name, count(*) as degree, max(count / sqrt(i.importance * j.importance)) as association from (select "left" as name, "right" as other, count from prs union all select "right", "left", count from prs) e join imp i using (name) join imp j on j.name = e.other group by name),
 scr as (select name, importance, coalesce(degree, 0) as degree, coalesce(association, 0) as association, name in (select name from shd) as shadowed, ln(1 + importance) * 18.0::double + coalesce(association, 0) * 14.0::double
   + case when {_person('name')} then 12.0::double else 0 end + case when regexp_full_match(name, '{_T}+') then 10.0::double else 0 end + case when length(name) >= 3 then 2.0::double else 0 end + case when length(name) >= 3 and (name like '%王子' or name like '%城主') then 7.0::double else 0 end + case when length(name) = 2 and contains('{R.TWO_CHAR_ENDS}', right(name, 1)) then 4.0::double else 0 end
   - case when length(name) >= 3 then (case when contains('{R.NONREFERENTIAL_FIRST}', left(name, 1)) then 6.0::double else 0 end + case when contains('{R.NONREFERENTIAL_LAST}', right(name, 1)) then 6.0::double else 0 end + case when regexp_matches(name, '[{R.NONREFERENTIAL_INSIDE}]') then 4.0::double else 0 end) else 0 end
   - case when name in ('马罗', '克尔') then 12.0::double else 0 end - case when name in (select name from shd) then 16.0::double else 0 end as score from imp left join asc_ using (name)),
 rk as (select *, row_number() over (partition by shadowed order by score desc, importance desc, length(name) desc, name) as r, row_number() over (partition by shadowed order by importance desc, length(name) desc, name) as q from scr),
 tr as (select *, case when shadowed then 3 when r <= {NAMES - NAMES // 4} then 0 when q <= {NAMES // 4} then 1 else 2 end as tier from rk),
 sel as (select name, importance, score, place from (select *, row_number() over (order by tier, case when tier in (0, 2) then r else q end) as place from tr) where place <= {NAMES}) """


@query(_BASE + "select name, long from shd")
def prefix_shadows(spark: SparkSession, d: str) -> DataFrame:
    return R.prefix_shadows(_importance(spark, d), RULES)


@query(_BASE + "select name, importance, degree, round(association, 6) as association, round(score, 6) as score, shadowed from scr")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumns({"association": F.round("association", 6), "score": F.round("score", 6)})


@query(_BASE + "select name, importance, round(score, 6) as score, place from sel")
def refinement_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """512 names: three quarters by score, a quarter by importance, then the rest."""
    return R.tiered(_scored(spark, d), NAMES).withColumns({"score": F.round("score", 6), "place": F.col("place").cast("long")})


@query(_BASE + f"""select "left", "right", count, round(count * (1 + count / sqrt(a.importance * b.importance)) + least(a.score, b.score) * 0.35::double, 6) as score from prs join sel a on a.name = "left" join sel b on b.name = "right" order by score desc, count desc, "left", "right" limit {PAIRS}""")
def refinement_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked_pairs(_pairs(spark, d), R.tiered(_scored(spark, d), NAMES), PAIRS).withColumn("score", F.round("score", 6))


_SEGS = """with sg as (select doc_id as chapter_id, doc_id * 10000000 + k as segment_id, k as ordinal, k * 500 as s, least((k + 1) * 500, length(text)) as e from documents, unnest(range(0, (length(text) + 499) // 500)) t(k)),
 ask as (select distinct source as request, handle from (select source, 'segment::' || (doc_id * 10000000 + k) as handle from documents, unnest([doc_id % 5, doc_id % 5 + 1, doc_id % 5 + 3]) t(k) union all select source, 'range::' || doc_id || '::' || doc_id % 700 || '::' || doc_id % 900 from documents union all select source, 'other::' || doc_id % 10 from documents)),
 res as (select a.request, a.handle, 'segment' as kind, sg.chapter_id, min(n.s) as s, max(n.e) as e from ask a join sg on a.handle = 'segment::' || sg.segment_id join sg n on n.chapter_id = sg.chapter_id and n.ordinal between sg.ordinal - 1 and sg.ordinal + 1 group by all
   union all select request, handle, 'range', cast(split_part(handle, '::', 2) as bigint), cast(split_part(handle, '::', 3) as bigint), cast(split_part(handle, '::', 4) as bigint) from ask where handle like 'range::%' and cast(split_part(handle, '::', 3) as bigint) <= cast(split_part(handle, '::', 4) as bigint)),
 all_ as (select * from res union all select request, handle, 'unknown', null, null, null from ask where (request, handle) not in (select (request, handle) from res)),
 wd as (select request, handle, chapter_id, greatest(0, s - 200) as s, least(length(text), e + 300) as e from all_ join documents on doc_id = chapter_id where kind <> 'unknown'),
 fl as (select *, max(e) over (partition by request, chapter_id order by s, e, handle rows between unbounded preceding and 1 preceding) as reach from wd where s < e),
 il as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by request, chapter_id order by s, e, handle rows unbounded preceding) as island from fl),
 rg as (select request, chapter_id, min(s) as s, max(e) as e, array_to_string(list_sort(list(distinct handle)), '|') as handles from il group by request, chapter_id, island) """


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each source asks for segments, ranges and things that are none."""
    rows, k = docs(spark, d), F.col("doc_id")
    by_segment = rows.select(F.col("source").alias("request"), F.explode(F.array(k % 5, k % 5 + 1, k % 5 + 3)).alias("k"), "doc_id").select("request", V.segment_handle(k * 10_000_000 + F.col("k")).alias("handle"))
    by_range = rows.select(F.col("source").alias("request"), V.range_handle(k, k % 700, k % 900).alias("handle"))
    other = rows.select(F.col("source").alias("request"), F.concat(F.lit("other::"), k % 10).alias("handle"))
    ordinals = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500))
    segments = rows.filter("length(text) > 0").select(k.alias("chapter_id"), F.length("text").alias("size"), F.explode(ordinals).alias("ordinal"))
    segments = segments.select("chapter_id", (F.col("chapter_id") * 10_000_000 + F.col("ordinal")).alias("segment_id"), "ordinal", (F.col("ordinal") * 500).alias("start_pos"), F.least((F.col("ordinal") + 1) * 500, F.col("size")).alias("end_pos"))
    return by_segment.unionByName(by_range).unionByName(other), segments


@query(_SEGS + 'select request, handle, kind, chapter_id, s as start, e as "end" from all_')
def evidence_handles(spark: SparkSession, d: str) -> DataFrame:
    return V.resolved(*_asked(spark, d), neighbours=1)


@query(_SEGS + 'select request, chapter_id, s as start, e as "end", handles, md5(substr(text, cast(s + 1 as integer), cast(e - s as integer))) as digest from rg join documents on doc_id = chapter_id')
def evidence_read(spark: SparkSession, d: str) -> DataFrame:
    """The texts that handles open, where they overlap put together."""
    asked, segments = _asked(spark, d)
    rows = docs(spark, d)
    ranges = V.merged(V.resolved(asked, segments, neighbours=1), rows.select(F.col("doc_id").alias("chapter_id"), F.length("text").cast("long").alias("length")), after=300)
    out = V.read(ranges, rows.select(F.col("doc_id").alias("chapter_id"), F.col("text").alias("content")))
    return out.select("request", "chapter_id", "start", "end", F.array_join("handles", "|").alias("handles"), F.md5("text").alias("digest"))
