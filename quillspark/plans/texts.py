"""Text and ingest queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..session import table
from .registry import query


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_COUNTS = r"""with c as (select doc_id, source, text, length(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]', '', 'g')) as han, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as latin,
 length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) as kana, length(regexp_replace(text, '[^\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]', '', 'g')) as hangul,
 length(regexp_replace(text, '[^ \t\n\r]', '', 'g')) as spaces, length(text) as chars from documents) """
_LANG = "case when hangul >= 2 and (han + kana = 0 or 3 * hangul >= han + kana) then 'ko' when kana >= 2 and (han + hangul = 0 or 3 * kana >= han + hangul) then 'ja' when han > 0 and (han >= latin or coalesce(spaces * 1.0 / nullif(chars, 0), 0) < 0.05) then 'zh' else 'en' end"


@query(_COUNTS + f"select doc_id, cast(latin as bigint) as latin, {_LANG} as language from c")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, d).select("doc_id", T.script_counts(text)["latin"].cast("long").alias("latin"), T.detect_language(text).alias("language"))


@query(_COUNTS + f", s as (select source, sum(han) as han, sum(latin) as latin, sum(kana) as kana, sum(hangul) as hangul, sum(spaces) as spaces, sum(chars) + count(*) - 1 as chars from c group by source) select source, cast(chars as bigint) as chars, {_LANG} as language from s")
def language_of_source(spark: SparkSession, d: str) -> DataFrame:
    """One language for all texts of a source, from sums that are merged map-side; a joint counts as a character."""
    text = F.col("text")
    sums = {k: F.sum(v).alias(k) for k, v in T.script_counts(text).items()}
    rows = docs(spark, d).groupBy("source").agg(*sums.values(), F.sum(F.regexp_count(text, F.lit(r"[ \t\n\r]"))).alias("spaces"), (F.sum(F.length(text)) + F.count("*") - 1).alias("chars"))
    return rows.select("source", "chars", T.language_of_counts(*[F.col(c) for c in ("han", "latin", "kana", "hangul", "spaces", "chars")]).alias("language"))


@query("""select doc_id, lang || '-' || source as code, array_to_string(list_distinct_ordered, '>') as chain, case when lang in ('fr', 'de') then lang else 'en' end as locale
 from (select doc_id, lang, source, case when lang = 'en' then [lang || '-' || source, 'en'] else [lang || '-' || source, lang, 'en'] end as list_distinct_ordered from documents)""")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.upper("lang"), F.lit("_"), F.initcap("source"), F.lit(" "))
    return docs(spark, d).select("doc_id", T.language_code(raw, "en").alias("code"), F.array_join(T.fallback_chain(raw, "en"), ">").alias("chain"), T.supported_locale(raw, ["fr", "de"], "en").alias("locale"))


@query(r"""select doc_id, case when length(text) <= 300 then text when regexp_extract(substring(text, 301, 40), '(?s)^.*?[.!?。！？…]["''”’」』）)\]]*', 0) <> '' then substring(text, 1, 300) || regexp_extract(substring(text, 301, 40), '(?s)^.*?[.!?。！？…]["''”’」』）)\]]*', 0)
 when regexp_extract(substring(text, 1, 300), '(?s)^.*[.!?。！？…]["''”’」』）)\]]*', 0) <> '' then regexp_extract(substring(text, 1, 300), '(?s)^.*[.!?。！？…]["''”’」』）)\]]*', 0) else substring(text, 1, 300) end as trimmed from documents""")
def sentence_trim(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.trim_to_sentence(F.col("text"), 300, 40).alias("trimmed"))


@query("select o_orderkey, nullif(o_orderkey % 10000, 0) as value from orders")
def chinese_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Each key's last four digits are written as a Chinese numeral and read back."""
    n, names = F.col("o_orderkey") % 10000, F.array(*[F.lit(c) for c in "零一二三四五六七八九"])
    digit = lambda k: F.element_at(names, (F.floor(n / k) % 10 + 1).cast("int"))
    token = F.concat(*[F.when(F.floor(n / k) % 10 > 0, F.concat(digit(k), F.lit(u))).otherwise("") for k, u in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))])
    return table(spark, d, "orders").select("o_orderkey", T.chinese_number(token).cast("long").alias("value"))


@query(r"select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as signature from documents")
def chapter_signature(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.signature(F.col("text")).alias("signature"))


@query("""select doc_id, cast(p as bigint) as pos, case when greatest(1, p - 30) > 1 then '…' else '' end || replace(substring(text, greatest(1, p - 30), least(length(text), p + 32) - greatest(1, p - 30) + 1), chr(10), ' ') || case when least(length(text), p + 32) < length(text) then '…' else '' end as snippet
 from (select *, instr(text, 'the') as p from documents) where p > 0""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "the")
    rows = docs(spark, d).withColumn("pos", at).filter("pos > 0")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), T.snippet(F.col("text"), F.col("pos"), F.lit(3)).alias("snippet"))


@query(r"""select conv_id, turn, case when contains(low, 'what can') or contains(low, 'that in') then 'capability' when length(low) <= 40 and (contains(low, 'the') or contains(low, 'der')) then 'smalltalk' else 'task' end as intent,
 cast(greatest(1, length(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]', '', 'g')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')) + len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) // 4) as integer) as tokens from (select *, lower(trim(text)) as low from conversations)""")
def turn_intents(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent(text, ["the", "der"], ["what can", "that in"]).alias("intent"), T.token_estimate(text).alias("tokens"))


@query("select doc_id, 'pk_' || substring(sha256(concat_ws('|', source, lang, doc_id)), 1, 8) as pack_id, cast(least(16000, greatest(100, ceil(length(text) * 2.5::double * 1.1::double))) as integer) as max_tokens, round((length(text) * 3.0::double + doc_id * 15.0::double) / 1e6, 9) as cost from documents")
def scalar_mix(spark: SparkSession, d: str) -> DataFrame:
    chars = F.length("text")
    return docs(spark, d).select("doc_id", T.pack_id("pk", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("pack_id"), T.max_tokens(chars).alias("max_tokens"), F.round(T.cost_usd(chars, F.col("doc_id"), F.lit(3.0), F.lit(15.0)), 9).alias("cost"))


_HEADING = r"^((The|Of|And|Der|Die|Le|La|El))( .{0,60})$"


@query(r"""with l as (select doc_id as id, generate_subscripts(parts, 1) as n, unnest(parts) as line from (select doc_id, string_split(text, chr(10)) as parts from documents)),
 h as (select *, regexp_matches(line, '^((The|Of|And|Der|Die|Le|La|El))( .{0,60})$') as is_h from l), any_h as (select id, bool_or(is_h) as has from h group by id),
 c as (select h.*, has, case when has then sum(is_h::int) over (partition by h.id order by n) else 1 end as chapter from h join any_h using (id))
 select id, cast(chapter as bigint) as chapter, max(case when is_h and has then regexp_extract(line, '^((The|Of|And|Der|Die|Le|La|El))( .{0,60})$', 1) end) as label, nullif(trim(max(case when is_h and has then regexp_extract(line, '^((The|Of|And|Der|Die|Le|La|El))( .{0,60})$', 3) end)), '') as title,
 regexp_replace(coalesce(string_agg(case when not is_h then line end, chr(10) order by n), ''), '^\s+|\s+$', '', 'g') as content from c where chapter > 0 group by id, chapter""")
def chapter_split(spark: SparkSession, d: str) -> DataFrame:
    """The documents hold no headings, so lines that begin with an article stand for them."""
    out = I.split_chapters(docs(spark, d), "doc_id", "text", [("any", _HEADING)])
    return out.select("id", F.col("chapter").cast("long").alias("chapter"), "label", "title", "content")


@query(r"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: not (regexp_matches(lower(x), 'https?://|www\.|\.(?:com|net|org)\b') or contains(lower(x), 'license') or regexp_matches(x, '^\s*[-=*_~#]{3,}\s*$'))) as kept, len(string_split(text, chr(10))) as n from documents)
 select doc_id as id, regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text, n - len(kept) as dropped from l""")
def clean_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return I.clean_lines(docs(spark, d), "doc_id", "text", ["license"])


@query("""select doc_id, len(s) as windows, list_sum(s) as starts from (select doc_id, list_distinct(list_concat(range(0, greatest(length(text) - 500, 0) + 1, 250), [greatest(length(text) - 500, 0)])) as s from documents where length(text) > 0)""")
def text_windows(spark: SparkSession, d: str) -> DataFrame:
    s = I.window_starts(F.length("text"))
    total = F.aggregate(F.transform(s, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs(spark, d).filter("length(text) > 0").select("doc_id", F.size(s).cast("long").alias("windows"), total.alias("starts"))


@query("""select doc_id as id, k as chunk, trim(substring(text, k * 900 + 1, 1000)) as content from documents, range(0, 8) t(k) where k * 900 <= greatest(0, length(text) - 101) and trim(substring(text, k * 900 + 1, 1000)) <> ''""")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.chunks(docs(spark, d), "doc_id", "text", 1000, 100, 8).withColumn("chunk", F.col("chunk").cast("long"))


@query("""select id, k as chunk, trim(substring(text, k * 6500 + 1, 7000)) as content from (select doc_id as id, text, unnest(range(0, greatest(0, length(text) - 501) // 6500 + 1)) as k from documents) where trim(substring(text, k * 6500 + 1, 7000)) <> ''""")
def text_chunks_whole(spark: SparkSession, d: str) -> DataFrame:
    return I.chunks(docs(spark, d), "doc_id", "text").withColumn("chunk", F.col("chunk").cast("long"))


@query("""with s as (select doc_id, md5(text) as v from documents where doc_id % 5 <> 0), g as (select doc_id, case when doc_id % 7 = 0 then 'changed' else md5(text) end as v from documents where doc_id % 3 <> 0)
 select coalesce(s.doc_id, g.doc_id) as doc_id, case when s.doc_id is null then 'insert' when g.doc_id is null then 'delete' when s.v = g.v then 'keep' else 'update' end as action from s full join g on s.doc_id = g.doc_id""")
def chapter_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.md5("text").alias("v"))
    given = rows.filter("doc_id % 3 <> 0").withColumn("v", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("v")))
    return I.sync_actions(rows.filter("doc_id % 5 <> 0"), given, ["doc_id"], "v")


@query("select doc_id, score, row_number() over (partition by h order by score desc, doc_id desc) = 1 as stays from (select doc_id, md5(text) as h, length(source) + doc_id % 3 as score from documents)")
def duplicate_novels(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), "source")
    out = I.best_duplicate(rows, "h", F.length("source") + F.col("id") % 3)
    return out.select(F.col("id").alias("doc_id"), "score", "stays")


@query("select source, doc_id, lang from (select *, row_number() over (partition by source, lang order by doc_id desc) as r from documents) where r = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_rows(docs(spark, d).select("source", "doc_id", "lang"), ["source", "lang"], "doc_id")
