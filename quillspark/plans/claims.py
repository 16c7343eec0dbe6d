"""Claims in two sentences for each order, with the order's nation as place, group or owner; half of the orders are in Chinese."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..session import table
from .cjk import HAN as LETTERS
from .registry import query

LATIN = [
    "{n} is in {v} while it rains.", "Once {n} was at the {v} gate, they say.", "{n} walked to {v}: no more.", "If {n} joined {v}, all would change.", "{n} is with {v} of the North.",
    "{n} became Captain of {v}.", "{n} was killed in {v}.", "{n} , as they say, is missing.", "{n} belongs to {v} and no other.", "In {v}, {n} never went missing.",
]
HAN = ["{n}不在{v}城门，却在北{v}书院里。", "{n}如今在{v}的旧街。", "听说{n}加入了{v}宗。", "{n}是{v}派弟子。", "{n}担任大长老。", "{n}已经失踪。", "{n}归{v}手中。", "{n}曾在这座城。", "如果{n}没有{v}，{n}还活着。", "{n}可能在{v}的家里。"]
NAMES = {"latin": ["Ada", "Bo Li", "Cy"], "zh": ["林月", "石岩", "白露"]}


def _segments(spark: SparkSession, d: str) -> DataFrame:
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
    zh = F.floor(k / 4) % 2 == 1
    rows = table(spark, d, "orders").join(table(spark, d, "nation"), k % 25 == F.col("n_nationkey"))
    rows = rows.withColumns({"zh": zh, "name": F.when(zh, pick(NAMES["zh"], who)).otherwise(pick(NAMES["latin"], who)), "v": F.when(zh, F.substring(F.lit(LETTERS), F.col("n_nationkey") + 1, F.lit(2))).otherwise(F.concat(F.lit("N"), "n_nationkey"))})
    text = lambda at: F.when(zh, pick(HAN, at)).otherwise(F.concat(pick(LATIN, at), F.lit(" ")))
    content: Column = F.replace(F.replace(F.concat(text(F.floor(k / 3)), text(F.floor(k / 7))), F.lit("{n}"), F.col("name")), F.lit("{v}"), F.col("v"))
    return rows.select(k.alias("segment"), who.alias("chapter"), (who % 3).alias("target_id"), (k % 5 == 0).alias("artifact"), "name", content.alias("content"))


def _one_of(words: list[str], at: str) -> str:
    return f"[{', '.join(_text(w) for w in words)}][cast({at} % {len(words)} + 1 as integer)]"


def _text(value: str | None) -> str:
    return "cast(null as varchar)" if value is None else "'" + value.replace("'", "''") + "'"


def _hit(rule: C.Rule) -> str:
    pattern = _text(rule.pattern)
    lead, value = f"length(regexp_extract(after, {pattern}, 1))", f"regexp_extract(after, {pattern}, 2)"
    at = "start" if rule.value or rule.cues == C.NEGATED else f"e + {lead}"
    fits = f"zh = {rule.script == 'zh'} and artifact = {rule.slot == 'owner'} and regexp_matches(after, {pattern})"
    fixed = "cast(null as integer)" if rule.cues is None else f"cast({rule.cues} as integer)"
    return f"case when {fits} then struct_pack(slot := '{rule.slot}', raw := {value}, given := {_text(rule.value)}, anchor := {at}, upto := e + {lead} + length({value}), confidence := cast({rule.confidence} as double), salience := cast({rule.salience} as double), fixed := {fixed}) end"


def _to_suffix(value: str, suffixes: list[str]) -> str:
    end = f"list_max(list_transform([{', '.join(_text(s) for s in suffixes)}], lambda s: case when instr({value}, s) > 0 then instr({value}, s) + length(s) - 1 end))"
    return f"substr({value}, 1, coalesce({end}, length({value})))"


def _after(script: str) -> str:
    marks = C.TERMINATORS[script]
    return f"regexp_extract(substr(content, start + 1, {C.WINDOW}), {_text(rf'^[^{marks}\n]*(?:[{marks}\n][{C.CLOSERS}]*)?')})"


_LIFE = [f"coalesce({', '.join(_hit(r) for r in C.RULES if r.first and r.script == s)})" for s in ("zh", "latin")]
_CLAIMS = (
    f"""with seg as (select o_orderkey as segment, o_custkey as chapter, o_custkey % 3 as target_id, o_orderkey % 5 = 0 as artifact, (o_orderkey // 4) % 2 = 1 as zh, case when (o_orderkey // 4) % 2 = 1 then {_one_of(NAMES["zh"], "o_custkey")} else {_one_of(NAMES["latin"], "o_custkey")} end as name,
  case when (o_orderkey // 4) % 2 = 1 then substr('{LETTERS}', cast(n_nationkey + 1 as bigint), 2) else 'N' || n_nationkey end as v, case when (o_orderkey // 4) % 2 = 1 then {_one_of(HAN, "(o_orderkey // 3)")} || {_one_of(HAN, "(o_orderkey // 7)")} else {_one_of(LATIN, "(o_orderkey // 3)")} || ' ' || {_one_of(LATIN, "(o_orderkey // 7)")} || ' ' end as form
  from orders join nation on o_orderkey % 25 = n_nationkey),
 txt as (select *, replace(replace(form, '{{n}}', name), '{{v}}', v) as content from seg),
 pl as (select *, generate_subscripts(parts, 1) as nth, unnest(parts) as part from (select *, string_split(content, name) as parts from txt)),
 fnd as (select * exclude (parts, nth, part), cast(sum(length(part)) over w + length(name) * (nth - 1) as bigint) as start, len(parts) as n, nth from pl window w as (partition by segment order by nth)),
 mat as (select *, start + length(name) as e, substr(case when zh then {_after("zh")} else {_after("latin")} end, length(name) + 1) as after from fnd where nth < n),
 hit as (select segment, chapter, target_id, content, start, unnest(list_filter([{", ".join([_hit(r) for r in C.RULES if not r.first] + _LIFE)}], lambda x: x is not null)) as h from mat),
 p0 as (select segment, chapter, target_id, content, start, h.slot as slot, h.raw as raw, h.given as given, h.anchor as anchor, h.upto as upto, h.confidence as confidence, h.salience as salience, h.fixed as fixed, regexp_replace(trim(trim(h.raw, {_text(C.STOP)})), '^(?:(?:{"|".join(C.LEADING)})\\s*)+(.)', '\\1') as p from hit),
 p1 as (select *, regexp_split_to_array(p, '\\s+') as words from p0),
 p2 as (select *, case when regexp_matches(p, '[\\x{{3400}}-\\x{{9FFF}}]') then p else array_to_string(words[1:coalesce(list_max(list_transform(words, lambda w, k: case when regexp_matches(trim(w, '''"-'), '\\p{{Lu}}') and lower(trim(w, '''"-')) not in ({", ".join(_text(c) for c in C.CONNECTORS)}) then k end)), 0)], ' ') end as q from p1),
 p3 as (select *, trim(regexp_extract(q, '[^的]*$')) as tail from p2),
 p4 as (select *, regexp_replace({_to_suffix("tail", C.PLACES)}, '[里中处内外上下]+$', '') as place, {_to_suffix("tail", C.GROUPS)} as grp from p3),
 p5 as (select *, case when slot = 'role' then lower(raw) when given is not null then given else nullif(trim(case slot when 'location' then case when not regexp_matches(place, {_text(C.DETERMINER)}) then place end when 'affiliation' then grp else q end), '') end as surface,
   lower(reverse(regexp_extract(reverse(substr(content, 1, start)), {_text(f"^[^{C.BREAKS}]*")})) || substr(content, start + 1, upto - start) || regexp_extract(substr(content, upto + 1), {_text(f"^[^{C.BREAKS}]*")})) as clause from p4),
 p6 as (select *, """
    + " + ".join(f"case when regexp_matches(clause, {_text('|'.join(words))}) then {bit} else 0 end" for bit, words in C.CUES.items())
    + """ as bits from p5 where surface is not null),
 p7 as (select *, coalesce(fixed, case when bits = 0 then 1 else bits end) as cue, case when slot in ('role', 'life_state') or n_nationkey is null then surface else n_name end as value from p6 left join (select * from nation where n_nationkey % 2 = 0) on 'N' || n_nationkey = surface),
 cl as (select chapter, segment, target_id, slot, value, arg_max(anchor, (confidence, -anchor)) as anchor, max(confidence) as confidence, max(salience) as salience, bit_or(cast(cue as integer)) as cues from p7 group by all) """
)


@query(_CLAIMS + "select chapter, segment, target_id, slot, value, anchor, confidence, salience, cues, row_number() over (partition by chapter order by segment, anchor, slot, value, target_id) as claim_id from cl")
def segment_claims(spark: SparkSession, d: str) -> DataFrame:
    segments = _segments(spark, d)
    at = F.explode(F.filter(F.expr("array(instr(content, name), locate(name, content, instr(content, name) + 1), locate(name, content, locate(name, content, instr(content, name) + 1) + 1))"), lambda p: p > 0))
    found = segments.select("segment", "target_id", "artifact", "name", at.alias("p")).select("segment", (F.col("p") - 1).alias("start"), (F.col("p") - 1 + F.length("name")).alias("end"), "target_id", "artifact")
    names = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("surface"), F.col("n_name").alias("canonical"))
    return C.claims(found, segments.select("segment", "chapter", "content"), names).withColumn("anchor", F.col("anchor").cast("long"))
