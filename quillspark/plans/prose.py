"""Prose checks by language family; German documents are written in Han characters, English ones in words, others may be either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phrases as P
from ..session import table
from .cjk import _HAN_SQL, han
from .registry import query

_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
_TEXTS = f"with t as (select doc_id as version, case when lang = 'de' then 'cjk' when lang = 'en' then 'whitespace' else 'both' end as kind, case when lang = 'de' then {_HAN_SQL} else text end as text from documents)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("lang") == "de", han(text)).otherwise(text).alias("text"))


def _family() -> Column:
    return F.when(F.col("lang") == "de", "cjk").when(F.col("lang") == "en", "whitespace").otherwise("both")


@query(_TEXTS + rf""", w as (select version, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') as w from t where kind <> 'cjk'),
 r as (select version, generate_subscripts(l, 1) as r, unnest(l) as run from (select version, regexp_extract_all(text, '{_CJK}+') as l from t where kind <> 'whitespace')),
 g as (select version, 'whitespace' as family, array_to_string(w[k:(k + n - 1)], ' ') as gram, 0 as r, k as place from w, range(3, 6) s(n), unnest(range(1, len(w) - n + 2)) u(k)
  union all select version, 'cjk', substr(run, cast(k as bigint), n), r, k from r, range(3, 7) s(n), unnest(range(1, length(run) - n + 2)) u(k)),
 c as (select version, family, gram, count(*) as count, min((r, place)) as first from g group by all having count(*) >= 3)
 select version, family, gram, count from (select *, row_number() over (partition by version, family order by count desc, length(gram) desc, first, gram) as nth from c) where nth = 1""")
def repeated_phrases(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_phrases(_texts(spark, d), "doc_id", "text", _family())


@query(_TEXTS + rf""", s as (select version, kind, list_filter(regexp_extract_all(text, '[^。！？.!?…\n]+[。！？.!?…]?'), lambda x: regexp_matches(x, '[。！？.!?…]$')) as c, list_filter(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: regexp_matches(x, '[.!?]$')) as w from t),
 e as (select version, 'cjk_chars' as unit, generate_subscripts(c, 1) - 1 as sentence, len(regexp_extract_all(unnest(c), '{_CJK}')) as length from s where kind <> 'whitespace'
  union all select version, 'words', generate_subscripts(w, 1) - 1, len(regexp_extract_all(unnest(w), '[^\x20\x09-\x0D]+')) from s where kind <> 'cjk')
 select version, unit, sentence, length from e where length > case unit when 'words' then 60 else 200 end""")
def abnormal_sentences(spark: SparkSession, d: str) -> DataFrame:
    return P.abnormal_sentences(_texts(spark, d), "doc_id", "text", _family())
