"""Scalar text functions as Column expressions; offsets and lengths count code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN, KANA, HANGUL = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]", r"[\x{3040}-\x{30FF}]", r"[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]"
#: Sentence ends and what may close after them.
ENDS, CLOSERS = r"[.!?。！？…]", r"[\"'”’」』）)\]]"
#: The marks around tokens.
MARKS = "\"'.,;:!?()[]{}<>*#-_ "
#: Digits and units of Chinese numerals (fixed values).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def language_code(code: Column, default: str = "zh") -> Column:
    """Trimmed, lower-case parts joined by -, without blanks; default if nothing is left."""
    parts = F.filter(F.transform(F.split(F.translate(F.lower(code), "_", "-"), "-"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "-")).otherwise(F.lit(default))


def fallback_chain(code: Column, default: str = "zh") -> Column:
    """The code, its primary language and the default, each once."""
    full = language_code(code, default)
    return F.array_distinct(F.array(full, F.element_at(F.split(full, "-"), 1), F.lit(default)))


def supported_locale(code: Column, supported: Sequence[str], default: str) -> Column:
    """The first of the code's chain that is supported, else the default."""
    hits = F.filter(fallback_chain(code, default), lambda c: c.isin(*supported))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(default))


def script_counts(text: Column) -> dict[str, Column]:
    """How many characters are Han, ASCII letters, kana and hangul."""
    return {"han": F.regexp_count(text, F.lit(HAN)), "latin": F.regexp_count(text, F.lit("[A-Za-z]")), "kana": F.regexp_count(text, F.lit(KANA)), "hangul": F.regexp_count(text, F.lit(HANGUL))}


def language_of_counts(han: Column, latin: Column, kana: Column, hangul: Column, spaces: Column, chars: Column) -> Column:
    """ko or ja if that script dominates (2 or more and a third of the others), zh by Han over Latin or few spaces, else en."""

    def dominant(n: Column, others: Column) -> Column:
        return (n >= 2) & ((others == 0) | (3 * n >= others))

    few = F.coalesce(spaces / F.nullif(chars, F.lit(0)), F.lit(0.0)) < 0.05
    return F.when(dominant(hangul, han + kana), "ko").when(dominant(kana, han + hangul), "ja").when((han > 0) & ((han >= latin) | few), "zh").otherwise("en")


def detect_language(text: Column) -> Column:
    c = script_counts(text)
    return language_of_counts(c["han"], c["latin"], c["kana"], c["hangul"], F.regexp_count(text, F.lit(r"[ \t\n\r]")), F.length(text))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded text, for which Spark has no function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def normal_token(token: Column, trim: str = MARKS) -> Column:
    """A token without the marks around it."""
    return F.btrim(token, F.lit(trim))


def has_boundaries(text: Column, start: Column, length: Column, cjk: Column) -> Column:
    """Whether a match at start (from 1) stands alone: any in CJK text, else no letter, digit, _ or - beside it."""
    inside = r"[\p{L}\p{N}_-]"
    before = F.when(start > 1, F.substring(text, start - 1, F.lit(1))).otherwise("")
    return cjk | (~before.rlike(inside) & ~F.substring(text, start + length, F.lit(1)).rlike(inside))


def canonical_label(label: Column, suffixes: Sequence[str] = ("relationship", "relation", "关系", "関係", "관계")) -> Column:
    """A relationship's label in one form: blanks collapsed, lower case, one relation suffix dropped."""
    one = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    cut = F.trim(F.regexp_replace(one, "(?:" + "|".join(suffixes) + ")$", ""))
    return F.when(cut != "", cut).otherwise(one)


def trim_to_sentence(text: Column, target: int, overrun: int = 0) -> Column:
    """At most target characters, up to the first sentence end within overrun more, else the last one before, else cut."""
    head = F.substring(text, 1, target)
    tail = F.regexp_extract(F.substring(text, target + 1, overrun), f"(?s)^.*?{ENDS}{CLOSERS}*", 0) if overrun else F.lit("")
    back = F.regexp_extract(head, f"(?s)^.*{ENDS}{CLOSERS}*", 0)
    return F.when(F.length(text) <= target, text).when(tail != "", F.concat(head, tail)).when(back != "", back).otherwise(head)


def chinese_number(token: Column) -> Column:
    """The value of a Chinese numeral up to 万万 or of plain digits; null for none or 0."""
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number"))

    def step(acc: Column, c: Column) -> Column:
        u = F.try_element_at(unit, c)
        n = F.when((acc["number"] == 0) & u.isNotNull(), 1).otherwise(acc["number"])
        total = F.when(c == "万", acc["total"] + (acc["section"] + acc["number"]) * 10000).otherwise(acc["total"])
        section = F.when(c == "万", 0).when(u.isNotNull(), acc["section"] + n * u).otherwise(acc["section"])
        number = F.when((c == "万") | u.isNotNull(), 0).otherwise(F.coalesce(F.try_element_at(digit, c), acc["number"]))
        return F.struct(total.alias("total"), section.alias("section"), number.alias("number"))

    value = F.aggregate(F.split(token, ""), zero, step, lambda a: a["total"] + a["section"] + a["number"])
    plain = F.when(token.rlike(r"^[0-9]+$"), token.cast("int"))
    return F.nullif(F.coalesce(plain, F.when(token.rlike("^[" + "".join([*DIGITS, *UNITS]) + "万]+$"), value)), F.lit(0))


def roman_number(token: Column) -> Column:
    """The value of a roman numeral; null for other text."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    step = lambda a, c: F.struct((a["sum"] + F.when(value[c] > a["last"], value[c] - 2 * a["last"]).otherwise(value[c])).alias("sum"), value[c].alias("last"))
    upper = F.upper(token)
    total = F.aggregate(F.split(upper, ""), F.struct(F.lit(0).alias("sum"), F.lit(1000).alias("last")), step, lambda a: a["sum"])
    return F.when(upper.rlike("^(?=[MDCLXVI])M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def source_number(token: Column) -> Column:
    """A chapter's number in full-width or plain digits, Chinese or roman."""
    plain = F.translate(F.trim(token), "０１２３４５６７８９", "0123456789")
    return F.coalesce(chinese_number(plain), roman_number(plain))


def normal_chapter(text: Column) -> Column:
    """Unix newlines, at most one blank line in a row, no white space around."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def signature(text: Column) -> Column:
    """What tells whether a chapter has changed."""
    return F.sha2(normal_chapter(text), 256)


def snippet(text: Column, start: Column, length: Column, around: int = 30) -> Column:
    """The match at start (from 1) with around characters on either side, … where text was cut, newlines as blanks."""
    lo = F.greatest(F.lit(1), start - around)
    hi = F.least(F.length(text), start + length - 1 + around)
    body = F.translate(F.substring(text, lo, hi - lo + 1), "\n", " ")
    return F.concat(F.when(lo > 1, "…").otherwise(""), body, F.when(hi < F.length(text), "…").otherwise(""))


def script_mode(text: Column) -> Column:
    """cjk_heavy if at least three in ten characters that are not blank are Han."""
    dark = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when((dark > 0) & (F.regexp_count(text, F.lit(HAN)) >= 0.3 * dark), "cjk_heavy").otherwise("latin_heavy")


def token_estimate(text: Column) -> Column:
    """CJK characters, Latin words and a fourth of the punctuation, at least 1."""
    cjk = F.regexp_count(text, F.lit(f"{HAN}|{KANA}|{HANGUL}"))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]"))
    return F.greatest(F.lit(1), cjk + F.regexp_count(text, F.lit("[A-Za-z0-9]+")) + F.floor(marks / 4)).cast("int")


def strip_thinking(text: Column) -> Column:
    """Generated text without thinking blocks and a leading answer label."""
    out = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(F.trim(out), r"(?i)^(?:final|answer)\s*[::]\s*", ""))


def intent(text: Column, smalltalk: Sequence[str], capability: Sequence[str]) -> Column:
    """smalltalk, capability or task, by the phrases in a turn's text."""
    low = F.lower(F.trim(text))
    short = F.length(low) <= 40
    return F.when(F.exists(F.array(*map(F.lit, capability)), lambda p: F.contains(low, p)), "capability").when(short & F.exists(F.array(*map(F.lit, smalltalk)), lambda p: F.contains(low, p)), "smalltalk").otherwise("task")


def pack_id(prefix: str, *parts: Column) -> Column:
    """prefix and 8 hex digits of the parts' hash."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))


def request_hash(values: Column) -> Column:
    """A hash of a map that does not depend on its order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))), 256)


def cost_usd(prompt: Column, completion: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars for tokens at rates for a million."""
    return (prompt * rate_in + completion * rate_out) / 1e6


def max_tokens(chars: Column) -> Column:
    """Tokens to allow for a target length in characters: 2.75 each, from 100 to 16,000."""
    return F.least(F.lit(16000), F.greatest(F.lit(100), F.ceil(chars * 2.5 * 1.1))).cast("int")


def is_boilerplate(line: Column, phrases: Sequence[str]) -> Column:
    """Whether a line is a link, a navigation phrase or a bare separator."""
    low = F.lower(line)
    return low.rlike(r"https?://|www\.|\.(?:com|net|org)\b") | F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)) | line.rlike(r"^\s*[-=*_~#]{3,}\s*$")
