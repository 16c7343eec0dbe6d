"""Claims about targets in segments of text, in Chinese and in Latin script, by rules on what follows a name.

No rule holds the name: the text after a match is looked at up to the end of its sentence, so all
names share one set of expressions and matches meet only their segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import script_mode
from .state import ASSERTED, HISTORICAL, HYPOTHETICAL, NEGATED

# The words and marks that the rules know.
WINDOW = 192
TERMINATORS = {"zh": "。！？；…", "latin": ".?!;:"}
CLOSERS = "\"'”’」』）】》"
BREAKS = "，,。！？；：:、\n"
STOP = "，。！？；：、“”‘’（）()[]{}<>《》「」『』\n\r\t"
LEADING = ["并不是", "不是", "并非", "不在", "没有", "未在", "并不", "不再", "非", "了", "着", "过", "又", "还", "仍", "正", "就", "便", "却", "都", "也"]
CONNECTORS = ["of", "the", "de", "du", "van", "von"]
PLACES = ["旧街", "码头", "书院", "后院", "前院", "城门", "城", "街", "巷", "门", "司", "院", "阁", "楼", "坊", "铺", "堂", "宫", "殿", "桥", "寨", "营", "镇", "村", "山", "谷", "河", "湖", "港", "港口"]
MORE_PLACES = ["桥头", "门口", "入口", "出口", "家", "家里", "家中", "室", "室内", "屋内", "屋外", "厅", "大厅", "房", "房内", "馆", "公司", "公寓", "旅馆", "酒吧", "教堂"]
GROUPS, MORE_GROUPS = ["宗", "门", "会", "帮", "派", "盟", "营", "司", "府", "书院"], ["组织"]
ROLES = {
    "zh": ["大长老", "长老", "门主", "掌门", "城主", "队长", "统领", "侍女", "弟子", "护卫", "掌柜", "账房", "信使", "先生", "老师", "师父", "族长", "少主"],
    "latin": ["captain", "commander", "master", "teacher", "guard", "keeper", "messenger", "clerk"],
}
LIFE = {
    "zh": {"dead": ["死了", "已死", "身亡", "死亡", "殒命", "丧命"], "missing": ["失踪", "下落不明"], "incapacitated": ["昏迷", "重伤昏迷", "失去意识", "瘫倒"], "alive": ["还活着", "仍活着", "活着", "活了下来"]},
    "latin": {"dead": ["is dead", "was killed", "died"], "missing": ["is missing", "went missing"], "incapacitated": ["is unconscious", "is incapacitated"], "alive": ["is alive", "stays alive"]},
}
CUES = {
    HISTORICAL: ["曾", "曾经", "从前", "过去", "此前", "之前", "当年", "昔日", "once", "formerly", "previously", "used to"],
    HYPOTHETICAL: ["若", "如果", "假如", "或许", "也许", "可能", "传言", "听说", "据说", "rumor", "maybe", "might", "could", "would", "if "],
    NEGATED: ["不在", "并非", "不是", "没有", "未在", "no longer", "not ", "never", "without"],
}
DETERMINER = "^(?:这|那|某|一)(?:座|间|条|处|个|所|片|家)"
NOT_VALUE = "，。！？；：、“”‘’（）()\\n"
_LATIN = r"[A-Z][A-Za-z0-9']*(?:[ -](?:[A-Z][A-Za-z0-9']*|(?:of|the|de|du|van|von))){0,5}"


def any_of(words: list[str]) -> str:
    """A pattern for any of words, the longest first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


_PLACE = rf"[^{NOT_VALUE}]{{0,14}}{any_of(PLACES + MORE_PLACES)}(?:里|中|内|外|上|下)?"
_GROUP = rf"[^{NOT_VALUE}]{{0,12}}{any_of(GROUPS + MORE_GROUPS)}"


@dataclass(frozen=True)
class Rule:
    """What follows a name: group 1 leads to the value, group 2. cues None are read from the clause; of rules with one group name the first that fits speaks."""

    slot: str
    script: str
    pattern: str
    confidence: float
    salience: float = 1.0
    value: str | None = None
    cues: int | None = None
    first: str | None = None


# What leads to a value, and how sure it is.
RULES = [
    Rule("location", "zh", rf"^((?:不在|并非在|不再在|未在))({_PLACE})[，,；;]?(?:却|但|而)?又?(?:在|于){_PLACE}", 0.9, cues=NEGATED),
    Rule("location", "zh", rf"^((?:不在|并非在|不再在|未在){_PLACE}[，,；;]?(?:却|但|而)?又?(?:在|于))({_PLACE})", 0.9, 1.1, cues=ASSERTED),
    Rule("location", "zh", rf"^((?:此时|现在|如今|这时|当下)?(?:正|仍|还|已|曾|曾经|可能|也许|或许)?(?:在|于|来到|回到|留在|待在|身处|位于|赶到|住在))({_PLACE})", 0.9, 1.1),
    Rule("location", "latin", rf"(?i)^(\s+(?:is|was|remains|stays|stayed)\s+(?:in|at|inside)\s+)({_LATIN})", 0.9, 1.1),
    Rule("location", "latin", rf"(?i)^(\s+(?:arrived|returned|came|went|walked|moved)\s+(?:to|into)\s+)({_LATIN})", 0.9, 1.1),
    Rule("affiliation", "zh", rf"^((?:加入|投靠|归入|归属于?|隶属于?))({_GROUP})", 0.85),
    Rule("affiliation", "zh", rf"^((?:是|作为))({_GROUP})(?:弟子|成员|门人|客卿)", 0.85),
    Rule("affiliation", "latin", rf"(?i)^(\s+(?:joined|belongs to|is with)\s+)({_LATIN})", 0.85),
    Rule("role", "zh", rf"^((?:如今|现在|现为|仍是|还是|是|成为|担任|出任|任))({any_of(ROLES['zh'])})", 0.9),
    Rule("role", "latin", rf"(?i)^(\s+(?:is|became|serves as|served as)\s+)({any_of(ROLES['latin'])})", 0.9),
    *[Rule("life_state", "zh", rf"(?i)^()((?:如今|现在|已经|已|还|仍|仍然|就|也|便|却)?[^，。！？；：\n]{{0,4}}{any_of(words)})", 0.9 if state == "incapacitated" else 1.0, value=state, first="life") for state, words in LIFE["zh"].items()],
    *[Rule("life_state", "latin", rf"(?i)^()([^。！？!\n]{{0,12}}{any_of(words)})", 0.9 if state == "incapacitated" else 1.0, value=state, first="life") for state, words in LIFE["latin"].items()],
    Rule("owner", "zh", rf"^((?:如今|现在)?(?:在|落在|回到|归于|归属于?|归))([^{NOT_VALUE}]{{2,12}})(?:手中|名下|所有)", 0.9),
    Rule("owner", "latin", rf"(?i)^(\s+(?:belongs to|is with|rests with)\s+)({_LATIN})", 0.9),
]


def sentence_after(content: Column, start: Column, end: Column, zh: Column) -> Column:
    """What follows a name at start to end in its sentence, closing marks included, within WINDOW characters of start."""
    window = F.substring(content, start + 1, F.lit(WINDOW))
    upto = lambda t: F.regexp_extract(window, rf"^[^{t}\n]*+(?:[{t}\n][{CLOSERS}]*+)?", 0)
    return F.substring(F.when(zh, upto(TERMINATORS["zh"])).otherwise(upto(TERMINATORS["latin"])), end - start + 1, F.lit(WINDOW))


def clause_around(content: Column, start: Column, end: Column) -> Column:
    """The clause around start to end, in lower case."""
    before = F.reverse(F.regexp_extract(F.reverse(F.substring(content, F.lit(1), start)), rf"^[^{BREAKS}]*+", 0))
    after = F.regexp_extract(F.substring(content, end + 1, F.length(content)), rf"^[^{BREAKS}]*+", 0)
    return F.lower(F.concat(before, F.substring(content, start + 1, end - start), after))


def cues_of(clause: Column) -> Column:
    """The cues of a clause, asserted without any."""
    bits = [F.when(clause.rlike("|".join(words)), bit).otherwise(0) for bit, words in CUES.items()]
    return F.element_at(F.transform(F.array(bits[0] + bits[1] + bits[2]), lambda b: F.when(b == 0, ASSERTED).otherwise(b)), 1)


def _to_suffix(value: Column, suffixes: list[str]) -> Column:
    """A value cut after the suffix that ends last, each looked for once from the left."""
    end = F.array_max(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.when(F.call_function("instr", value, s) > 0, F.call_function("instr", value, s) + F.length(s) - 1)))
    return F.substring(value, F.lit(1), F.coalesce(end, F.length(value)))


def with_normal_value(rows: DataFrame) -> DataFrame:
    """rows (slot, raw) with normal: the value without marks and noise at its ends, of a place or group what follows the last 的 up to its suffix; null if nothing is left or a determiner begins a place.

    Each step is a column of its own, so that none is worked out twice.
    """
    noise = rf"^(?:(?:{'|'.join(LEADING)})\s*)+(?=.)"
    rows = rows.withColumn("plain", F.regexp_replace(F.trim(F.btrim("raw", F.lit(STOP))), noise, ""))
    rows = rows.withColumn("words", F.split("plain", r"\s+"))
    names = F.transform(F.transform("words", lambda w: F.btrim(w, F.lit("'\"-"))), lambda w, k: F.when(w.rlike(r"\p{Lu}") & ~F.lower(w).isin(CONNECTORS), k + 1))
    latin = F.array_join(F.slice("words", F.lit(1), F.coalesce(F.array_max(names), F.lit(0))), " ")
    rows = rows.withColumn("plain", F.when(F.col("plain").rlike(r"[\x{3400}-\x{9FFF}]"), F.col("plain")).otherwise(latin))
    rows = rows.withColumn("tail", F.trim(F.substring_index("plain", "的", -1)))
    rows = rows.withColumn("tail", F.when(F.col("slot") == "location", F.regexp_replace(_to_suffix(F.col("tail"), PLACES), "[里中处内外上下]+$", "")).when(F.col("slot") == "affiliation", _to_suffix(F.col("tail"), GROUPS)).otherwise(F.col("plain")))
    done = F.when((F.col("slot") != "location") | ~F.col("tail").rlike(DETERMINER), F.trim("tail"))
    return rows.withColumn("normal", F.nullif(done, F.lit(""))).drop("plain", "words", "tail")


def claims(found: DataFrame, segments: DataFrame, names: DataFrame) -> DataFrame:
    """(chapter, claim_id, segment, target_id, slot, value, anchor, confidence, salience, cues).

    found are matches (segment, start, end, target_id, artifact), places counted from 0 in segments
    (segment, chapter, content); artifacts have owners only, others the rest. A value that is a
    name (surface, canonical), each surface once, becomes its canonical name. A segment's claims of
    one target, slot and value are one: the surest, then earliest, place, all cues, the highest
    figures. Ids number a chapter's claims by segment, place, slot, value and target. Null content
    and matches without segment give nothing.
    """
    text, start, end = F.col("content"), F.col("start").cast("int"), F.col("end").cast("int")
    rows = found.distinct().join(segments, "segment").filter("content is not null").withColumn("zh", script_mode(text) == "cjk_heavy")
    rows = rows.withColumn("after", sentence_after(text, start, end, F.col("zh")))

    def hit(rule: Rule) -> Column:
        fits = (F.col("zh") == F.lit(rule.script == "zh")) & (F.coalesce("artifact", F.lit(False)) == F.lit(rule.slot == "owner")) & F.col("after").rlike(rule.pattern)
        lead, value = F.length(F.regexp_extract("after", rule.pattern, 1)), F.regexp_extract("after", rule.pattern, 2)
        at = start if rule.value or rule.cues == NEGATED else end + lead
        struct = F.struct(F.lit(rule.slot).alias("slot"), value.alias("raw"), F.lit(rule.value).cast("string").alias("given"), at.alias("anchor"), (end + lead + F.length(value)).alias("upto"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.salience).alias("salience"), F.lit(rule.cues).cast("int").alias("fixed"))
        return F.when(fits, struct)

    groups = {r.first for r in RULES if r.first}
    hits = [hit(r) for r in RULES if not r.first] + [F.coalesce(*[hit(r) for r in RULES if r.first == g and r.script == s]) for g in sorted(groups) for s in TERMINATORS]
    each = rows.select("segment", "chapter", "target_id", "content", "start", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("*", "h.*").drop("h")
    each = with_normal_value(each).withColumn("clause", clause_around(text, start, F.col("upto")))
    spoken = F.when(F.col("slot") == "role", F.lower("raw")).when(F.col("given").isNotNull(), F.col("given")).otherwise(F.col("normal"))
    # Claims without a value are left out in a list of one: as a filter, the condition would be written out with all steps of the value below them.
    one = F.filter(F.array(F.struct(spoken.alias("surface"), F.coalesce("fixed", cues_of(F.col("clause"))).alias("cues"))), lambda c: c["surface"].isNotNull())
    made = each.select("segment", "chapter", "target_id", "slot", "anchor", "confidence", "salience", F.inline(one))
    known = made.join(names.select("surface", "canonical"), "surface", "left")
    value = F.when(F.col("slot").isin("role", "life_state"), F.col("surface")).otherwise(F.coalesce("canonical", "surface"))
    best = F.max_by("anchor", F.struct("confidence", -F.col("anchor")))
    merged = known.withColumn("value", value).groupBy("chapter", "segment", "target_id", "slot", "value").agg(best.alias("anchor"), F.max("confidence").alias("confidence"), F.max("salience").alias("salience"), F.bit_or("cues").alias("cues"))
    order = Window.partitionBy("chapter").orderBy("segment", "anchor", "slot", "value", "target_id")
    return merged.withColumn("claim_id", F.row_number().over(order))
