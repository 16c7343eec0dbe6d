"""What a text's language decides: script family, tokeniser, word list, sentence ends, label suffixes and keys for matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import detect_language

#: The marks around tokens, and for each language what differs from others.
TRIM = " \t\r\n.,!?;:\"'()[]{}<>，。！？；：、“”‘’（）【】《》、…·-—"
CJK_ENDS, OTHER_ENDS = ("。", "！", "？", "!", "?", "…", "."), (".", "!", "?", "…", "。", "！", "？")
CJK_SUFFIXES = ("关系", "關係", "関係", "관계")
POLICIES = {
    "zh": ("cjk", "dictionary", "zh", CJK_ENDS, ("关系", "關係")),
    "ja": ("cjk", "cjk_bigram", "zh", CJK_ENDS, ("関係",)),
    "ko": ("cjk", "cjk_bigram", "zh", OTHER_ENDS, ("관계",)),
}
OTHERS = ("whitespace", "whitespace", "en", OTHER_ENDS, ())
_POLICY = "struct<language:string,base:string,family:string,tokenizer:string,words:string,ends:array<string>,suffixes:array<string>>"


def base_language(language: Column) -> Column:
    """The part of a language code before its first hyphen."""
    return F.element_at(F.split(language, "-"), 1)


def _code(code: Column) -> Column:
    """A language code in lower case with hyphens and without blank parts; null if nothing is left."""
    parts = F.filter(F.transform(F.split(F.translate(F.lower(code), "_", "-"), "-"), lambda p: F.trim(p)), lambda p: p != "")
    return F.nullif(F.array_join(parts, "-"), F.lit(""))


def processing_language(code: Column, sample: Column | None = None, default: str = "zh") -> Column:
    """The code if there is one, else the language of the sample if that is not empty, else the default."""
    found = _code(code)
    if sample is None:
        return F.coalesce(found, F.lit(default))
    return F.coalesce(found, F.when(F.length(sample) > 0, detect_language(sample)), F.lit(default))


def policy(code: Column, sample: Column | None = None, default: str = "zh") -> Column:
    """The policy of a language as a struct: language, base, family, tokenizer, words, ends, suffixes."""
    language = processing_language(code, sample, default)
    base = base_language(language)

    def made(kind: tuple) -> Column:
        family, tokenizer, words, ends, suffixes = kind
        texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return F.struct(language, base, *map(F.lit, (family, tokenizer, words)), texts(ends), texts(suffixes)).cast(_POLICY)

    out = made(OTHERS)
    for name, kind in POLICIES.items():
        out = F.when(base == name, made(kind)).otherwise(out)
    return out


def is_cjk(code: Column) -> Column:
    """Whether a language's words have no borders: zh, ja or ko."""
    return F.coalesce(base_language(_code(code)).isin(*POLICIES), F.lit(False))


def _normal(text: pd.Series, base: pd.Series, variants: Mapping[int, str]) -> pd.Series:
    out = text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")
    if variants:
        zh = base.eq("zh") & out.notna()
        out = out.where(~zh, out[zh].map(lambda t: t.translate(variants)))
    return out


def _table(variants: Mapping[str, str] | None) -> dict[int, str]:
    return {ord(a): b for a, b in (variants or {}).items()}


def match_key(text: Column, base: Column | None = None, variants: Mapping[str, str] | None = None) -> Column:
    """A text as keys are compared: compatibility-normalised, variant characters (of Chinese) unified, case-folded; null stays null."""
    table = _table(variants)

    @F.pandas_udf(StringType())
    def key(text: pd.Series, base: pd.Series) -> pd.Series:
        return _normal(text, base, table).map(str.casefold, na_action="ignore")

    return key(text, F.lit("") if base is None else base)


def clean_token(token: Column, base: Column | None = None, variants: Mapping[str, str] | None = None) -> Column:
    """A token compatibility-normalised, with variant characters unified and without the marks around it."""
    table = _table(variants)

    @F.pandas_udf(StringType())
    def clean(token: pd.Series, base: pd.Series) -> pd.Series:
        return _normal(token, base, table).map(lambda t: t.strip(TRIM), na_action="ignore")

    return clean(token, F.lit("") if base is None else base)


def label_key(label: Column, family: Column, suffixes: Sequence[str] = CJK_SUFFIXES) -> Column:
    """A relationship's label in one form: folded, blanks collapsed, in CJK languages without one of the suffixes; a label that is only a suffix stays."""
    one = F.btrim(F.regexp_replace(match_key(label), r"\s+", " "))
    cut = F.rtrim(F.regexp_replace(one, "(?:" + "|".join(s.casefold() for s in suffixes) + ")$", ""))
    return F.when((family == "cjk") & (cut != ""), cut).otherwise(one)
