"""Chinese candidate names: shapes, recovered spans, bound fragments, grown surfaces and their canonical forms.

Word lists are the user's; the small defaults only show their form. Texts are cut into blocks first,
so no row is larger than a block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import recursive, settled
from .overlaps import most_inside, overlap_matches

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
#: Characters that make surfaces of little worth, and limits.
MODIFIER_PREFIXES = "大小老新旧高低前后左右上下内外"
LOW_PREFIXES = "一都这那没了着出个自给将把向从对跟比于其各每该本此"
LOW_SUFFIXES = "了着过啊呀吧呢吗么的"
LOW_INTERIOR = "的"
FUNCTION_CHARS = "了不的来去都也就在上里看说没是有把将和与着出个给这那好太很再更向从对跟比于到等让"
HINT_SUFFIXES = "星际焰兽师士器盘镯石药炉体子司营府院门宗派盟帮城港谷湖河山殿宫阁楼坊铺"
ROLE_SUFFIXES = "后帝王君皇妃司师使神主尊圣"
EXTRA_SURNAMES = "林花贺兰佟柯"
LEAST_OCCURRENCES, LEAST_BLOCKS, LEAST_ENTROPY = 3, 1, 0.55
PAIR_LEAST, PAIR_SHARE, FRAGMENT_CHARS = 3, 0.85, 3
PERSON_CONTAINMENT, PERSON_MARGIN = 0.90, 0.75
FAMILY_ENTROPY, FAMILY_CONTAINMENT, FAMILY_SECOND = 1.6, 0.82, 0.5


def _any(chars: str) -> str:
    return "[" + "".join(chars) + "]"


def _either(words) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


@dataclass(frozen=True)
class NameRules:
    """Word lists: surnames of one and of two characters, characters that trail names, characters of foreign names, titles after names."""

    singles: str = "王李张刘陈杨赵黄周吴"
    compounds: tuple[str, ...] = ("欧阳", "司马")
    noise: str = "的了着说道"
    translit: str = "克斯尔特拉罗尼亚维"
    titles: tuple[str, ...] = ("先生", "王子", "公主")
    common: tuple[str, ...] = field(default=())

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> NameRules:
        """Lists from text files singles, compounds, noise, translit, titles and common (.txt), characters or a word a line; blank lines and those with # do not count."""

        def words(name: str) -> list[str]:
            rows = spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("w")).filter("w <> '' and not startswith(w, '#')").distinct()
            return sorted(r.w for r in rows.collect())

        chars = {k: "".join(sorted({c for w in words(k) for c in w if not c.isspace()})) for k in ("singles", "noise", "translit")}
        return cls(**chars, **{k: tuple(words(k)) for k in ("compounds", "titles", "common")})

    def is_person(self, token: Column) -> Column:
        """A surname and one or two more characters."""
        return token.rlike(f"^(?:{_any(self.singles)}|{_either(self.compounds)}){CJK}{{1,2}}$")

    def is_translit(self, token: Column) -> Column:
        """Characters of foreign names only."""
        return token.rlike(f"^{_any(self.translit)}+$")

    def is_title(self, token: Column) -> Column:
        return token.isin(*self.titles)

    def without_noise(self, token: Column) -> Column:
        """A person's name without the character that trails it, else null."""
        name = F.substring(token, F.lit(1), F.length(token) - 1)
        return F.when(token.rlike(f"^{CJK}{{3,}}$") & token.rlike(f"{_any(self.noise)}$") & self.is_person(name), name)

    def is_person_like(self, token: Column) -> Column:
        """is_person, or two characters of which the first is a surname and the last no function word."""
        two = f"^{_any(self.singles + EXTRA_SURNAMES)}[^{FUNCTION_CHARS}]$"
        return self.is_person(token) | token.rlike(two)


def zh_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, token): neighbouring pairs of characters in Han runs, single ones as they are; the tokeniser where no dictionary is given."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{CJK}+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda k: F.substring(r, k, F.lit(2))))))
    return texts.select(F.col(id_col).alias("id"), F.posexplode(pairs).alias("n", "token"))


def split_names(texts: DataFrame, text_col: str, rules: NameRules, least: int = 2) -> DataFrame:
    """(name, count): people's names in Han runs, from left to right the longest of 4, 3 and 2 characters that is no common word, found at least that often."""
    singles, compounds = _any(rules.singles), _either(rules.compounds)
    common = lambda n: "".join(f"(?!{_either(ws)})" for ws in [[w for w in rules.common if len(w) == n]] if ws)
    spans = f"{common(4)}{compounds}{CJK}{{2}}|{common(3)}(?:{singles}{CJK}{{2}}|{compounds}{CJK})|{common(2)}{singles}{CJK}"
    rows = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(spans), F.lit(0))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def translit_spans(texts: DataFrame, text_col: str, rules: NameRules) -> DataFrame:
    """(name, count): whole runs of three or more characters of foreign names, with the longest title that follows; common words do not count."""
    spans = f"{_any(rules.translit)}{{3,}}{_either(rules.titles)}?"
    rows = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(spans), F.lit(0))).alias("name")).filter(~F.col("name").isin(*rules.common) if rules.common else F.lit(True))
    return rows.groupBy("name").agg(F.count("*").alias("count"))


def fragment_pairs(tokens: DataFrame, rules: NameRules) -> DataFrame:
    """(left, right, count): fragments, foreign-name pieces and titles of up to 3 characters, that stand side by side in tokens (id, n, token)."""
    token = F.col("token")
    is_piece = (F.length(token) <= FRAGMENT_CHARS) & (rules.is_translit(token) | rules.is_title(token))
    if rules.common:
        is_piece &= ~token.isin(*rules.common)
    pieces = tokens.filter(F.coalesce(is_piece, F.lit(False)))
    order = Window.partitionBy("id").orderBy("n")
    beside = pieces.withColumns({"right": F.lead("token").over(order), "next": F.lead("n").over(order)}).filter("next = n + 1")
    return beside.groupBy(token.alias("left"), "right").agg(F.count("*").alias("count"))


def bound_edges(pairs: DataFrame, rules: NameRules) -> DataFrame:
    """(left, right, count, starts): pairs that bind, each the best of both its ends; starts: left has no binding predecessor and can begin a name.

    A pair binds if it occurs PAIR_LEAST times and is PAIR_SHARE of what follows left and of what
    precedes right. Equal best ones are ambiguous and bind nothing; a title ends a name.
    """
    out, into = Window.partitionBy("left"), Window.partitionBy("right")
    strong = pairs.withColumns({"o": F.sum("count").over(out), "i": F.sum("count").over(into)}).filter((F.col("count") >= PAIR_LEAST) & (F.col("count") / F.col("o") >= PAIR_SHARE) & (F.col("count") / F.col("i") >= PAIR_SHARE))
    best = strong.withColumns({"lo": F.max("count").over(out), "li": F.max("count").over(into)})
    tied = best.withColumns({"to": F.count_if(F.col("count") == F.col("lo")).over(out), "ti": F.count_if(F.col("count") == F.col("li")).over(into)})
    edges = tied.filter((F.col("count") == F.col("lo")) & (F.col("count") == F.col("li")) & (F.col("to") == 1) & (F.col("ti") == 1) & ~rules.is_title(F.col("left")))
    followed = strong.select(F.col("right").alias("left")).distinct().withColumn("follows", F.lit(True))
    starts = F.col("follows").isNull() & rules.is_translit(F.col("left"))
    return settled(edges.select("left", "right", "count").join(followed, "left", "left").select("left", "right", "count", starts.alias("starts")))


CHAINS = """
with recursive walk(first, at, name, count, size) as (
  select `left`, `right`, concat(`left`, `right`), count, 2 from {edges} where starts
  union all
  select w.first, e.`right`, concat(w.name, e.`right`), least(w.count, e.count), w.size + 1 from walk w join {edges} e on e.`left` = w.at)
select first, name, count, size from walk
"""


def bound_names(edges: DataFrame, rules: NameRules) -> DataFrame:
    """(first, name, count, size): names made of fragments that are bound to each other, walked from each start to the end; count is the weakest link.

    Links have one predecessor and one successor, so a walk from a start meets no piece twice; pieces that only
    form a ring have no start. Names need 3 characters and two different ones, and may not be common words.
    """
    walked = recursive(CHAINS, edges=edges)
    ends = walked.groupBy("first").agg(F.max_by(F.struct("name", "count", "size"), "size").alias("w")).select("first", "w.name", "w.count", "w.size")
    good = (F.length("name") >= 3) & (F.size(F.array_distinct(F.split("name", ""))) >= 2)
    return ends.filter(good & ~F.col("name").isin(*rules.common) if rules.common else good)


def with_bound_names(counted: DataFrame, edges: DataFrame, rules: NameRules) -> DataFrame:
    """Candidate counts (name, count) with bound names added and the occurrences they took subtracted from their pieces; what has none left goes."""
    found = settled(bound_names(edges, rules))
    pieces = recursive(
        """with recursive walk(first, at, size) as (select `left`, `left`, 1 from {edges} where starts union all
           select w.first, e.`right`, w.size + 1 from walk w join {edges} e on e.`left` = w.at) select first, at as name from walk""", edges=edges)
    taken = pieces.join(found.select("first", F.col("count").alias("took")), "first").groupBy("name").agg(F.sum("took").alias("took"))
    whole = found.groupBy("name").agg(F.max("count").alias("bound"))
    both = counted.join(whole, "name", "full_outer").select("name", F.greatest("count", "bound").alias("count"))
    return both.join(taken, "name", "left").select("name", (F.col("count") - F.coalesce("took", F.lit(0))).alias("count")).filter("count > 0")


def without_fragments(counted: DataFrame, rules: NameRules) -> DataFrame:
    """Candidate counts without pieces of foreign names, and titles, that lie in a longer foreign name (with a title or not) counted as often."""
    name = F.col("name")
    whole = counted.filter((F.length(name) >= 3) & name.rlike(f"^{_any(rules.translit)}+$|^{_any(rules.translit)}{{3,}}{_either(rules.titles)}$"))
    pieces = counted.filter(rules.is_translit(name) | rules.is_title(name))
    most = most_inside(whole, pieces.select(name.alias("alias")))
    lost = pieces.join(most.withColumnRenamed("alias", "name"), "name").filter("count <= most").select("name")
    return counted.join(lost, "name", "left_anti")


def _has(chars: str, c: Column) -> Column:
    return F.coalesce(F.contains(F.lit(chars), c), F.lit(False))


def _low_value(s: Column, rules: NameRules) -> Column:
    """Whether a surface is not worth counting: one character repeated, function words, 的 inside, weak ends."""
    n, first, last = F.length(s), F.substring(s, 1, 1), F.substring(s, -1, 1)
    same = F.replace(s, first, F.lit("")) == ""
    two = (n == 2) & ~s.rlike(f"^{_any(rules.singles + EXTRA_SURNAMES)}[^{FUNCTION_CHARS}]$") & ~_has(HINT_SUFFIXES, last) & (_has(FUNCTION_CHARS, first) | _has(FUNCTION_CHARS, last))
    inside = (n <= 4) & s.rlike(_any(LOW_INTERIOR)) & ~rules.is_person(s)
    return same | two | inside | ((n >= 3) & (_has(LOW_PREFIXES, first) | _has(LOW_SUFFIXES, last)))


def _symbol(c: Column) -> Column:
    """A neighbour as boundaries count it: the character, or one sign for white space and one for marks."""
    return F.when(c.rlike(r"^\s$"), " ").when(c.rlike(r"^[\p{L}\p{N}]$") | c.rlike(CJK), c).when(c.isNotNull(), ".")


def seed_kinds(s: Column, rules: NameRules) -> dict[str, Column]:
    """What a seed's kind allows: by how many characters, to which side, and what it needs there."""
    person_like, compound = rules.is_person_like(s), s.isin(*rules.compounds)
    foreign = (F.length(s) <= FRAGMENT_CHARS) & rules.is_translit(s)
    generic = (F.length(s) == 2) & ~person_like & ~compound & ~foreign
    return {
        "budget": F.when(foreign | compound | generic, 2).otherwise(1), "generic": generic, "person_like": person_like, "free": foreign | compound, "both_ways": foreign | rules.is_title(s),
        "leftward": foreign | rules.is_title(s) | (~person_like & ~compound & (F.length(s) <= 3)), "rightward": person_like | compound | foreign | generic,
        "weak_seed": _has(MODIFIER_PREFIXES + LOW_PREFIXES + FUNCTION_CHARS, F.substring(s, 1, 1)),
    }


def not_counted(surface: Column, rules: NameRules) -> Column:
    """Whether a grown surface is of little worth or a common word; as a seed it still counts."""
    bad = _low_value(surface, rules)
    return bad | surface.isin(*rules.common) if rules.common else bad


def grown_occurrences(blocks: DataFrame, seeds: DataFrame, rules: NameRules) -> DataFrame:
    """(id, start, end, surface, left, right) once for each place: seeds (name) in blocks (id, text), and seeds grown by up to two characters of the same Han run, as the seed's kind allows."""
    s = F.col("alias")
    kinds = seed_kinds(s, rules)
    names = seeds.filter(F.col("name").rlike(f"^{CJK}{{2,}}$")).select(F.col("name").alias("alias")).distinct().withColumns(kinds)
    before, after, following = F.col("before"), F.col("after"), F.substring("after", 1, 1)
    hits = overlap_matches(blocks, names.withColumn("target_id", F.struct(*kinds)), "id", "text", F.lit(True), around=3)
    sides = {"into_left": F.length(F.regexp_extract(before, f"{CJK}*\\z", 0)), "into_right": F.length(F.regexp_extract(after, f"^{CJK}*", 0)), "weak": _has(FUNCTION_CHARS + LOW_SUFFIXES + rules.noise, following), "role": _has(ROLE_SUFFIXES, following)}
    flag = lambda k: F.col(f"target_id.{k}")
    stands = following != ""
    right_fits = F.when(flag("free"), True).when(flag("generic"), stands & ~F.col("weak") & (~flag("weak_seed") | F.col("role"))).when(~flag("person_like"), True).otherwise(stands & F.col("weak"))
    growths = [F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"))]
    for p, q in ((0, 1), (0, 2), (1, 0), (1, 1), (2, 0)):
        allowed = (flag("budget") >= p + q) & (F.col("into_left") >= p) & (F.col("into_right") >= q)
        allowed &= (flag("leftward") if p else F.lit(True)) & (flag("rightward") if q else F.lit(True))
        if q:
            allowed &= flag("both_ways") if p else F.col("fits")
        growths.append(F.when(allowed, F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"))))
    grown = hits.withColumns(sides).withColumn("fits", right_fits).withColumn("g", F.explode(F.array_compact(F.array(*growths))))
    p, q = F.col("g.p"), F.col("g.q")
    surface = F.concat(F.right(before, p), s, F.left(after, q))
    left = F.when(F.length(before) > p, F.substring(before, F.length(before) - p, F.lit(1)))
    right = F.when(F.length(after) > q, F.substring(after, q + 1, F.lit(1)))
    rows = grown.select("id", (F.col("start") - p).alias("start"), (F.col("end") + q).alias("end"), surface.alias("surface"), left.alias("left"), right.alias("right"), (p + q == 0).alias("seed"))
    once = rows.groupBy("id", "start", "end", "surface", "left", "right").agg(F.max("seed").alias("seed"))  # strings as keys, so that rows are hashed and not sorted
    bad = not_counted(F.col("surface"), rules)
    signs = {"left": F.coalesce(_symbol(F.col("left")), F.lit("^")), "right": F.coalesce(_symbol(F.col("right")), F.lit("$"))}
    return once.filter(F.col("seed") | ~bad).select("id", "start", "end", "surface", *[v.alias(k) for k, v in signs.items()])


def surface_sides(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surface, side, c, n): how often c stands on that side; and (surface, blocks)."""
    per = occurrences.groupBy("surface", "id", "left", "right").agg(F.count("*").alias("n"))
    sides = per.select("surface", "n", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("c")), F.struct(F.lit("right").alias("side"), F.col("right").alias("c")))).alias("s"))
    each = sides.groupBy("surface", "s.side", "s.c").agg(F.sum("n").alias("n"))
    return each, per.select("surface", "id").distinct().groupBy("surface").agg(F.count("*").alias("blocks"))


def grown_surfaces(occurrences: DataFrame, seeds: DataFrame, rules: NameRules, least: int = LEAST_OCCURRENCES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(surface, n, blocks, left, right, score, kept) of each surface of occurrences, see scored_surfaces()."""
    return scored_surfaces(*surface_sides(occurrences), seeds, rules, least, least_blocks)


def scored_surfaces(each: DataFrame, blocks: DataFrame, seeds: DataFrame, rules: NameRules, least: int = LEAST_OCCURRENCES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(surface, n, blocks, left, right, score, kept) of each surface: occurrences, blocks, entropy in bits of what stands on either side, discovery score.

    kept ones occur often enough and have open ends, or are seeds, or carry a trailing character, or extend a seed of two characters by a
    fragment that can be trusted.
    """
    bits = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    side = each.groupBy("surface", "side").agg(bits.alias("bits"), F.sum("n").alias("n"))
    entropy = side.groupBy("surface").agg(*[F.max(F.when(F.col("side") == k, F.col("bits"))).alias(k) for k in ("left", "right")], F.max("n").alias("n"))
    names = seeds.select(F.col("name").alias("surface")).distinct()
    s = F.col("surface")
    stats = entropy.join(blocks, "surface").join(names.withColumn("is_seed", F.lit(True)), "surface", "left")
    for cut in (1, 2):
        shorter = names.select(F.col("surface").alias(f"base{cut}"), F.lit(True).alias(f"has{cut}"))
        stats = stats.withColumn(f"base{cut}", F.when(F.length(s).between(3, 4), F.substring(s, F.lit(1), F.length(s) - cut))).join(shorter, f"base{cut}", "left")
    trusted = F.lit(False)
    for cut in (1, 2):
        base = F.col(f"base{cut}")
        generic = (F.length(base) == 2) & ~rules.is_person_like(base) & ~base.isin(*rules.compounds) & ~rules.is_translit(base)
        weak = _has(MODIFIER_PREFIXES + LOW_PREFIXES + FUNCTION_CHARS, F.substring(base, 1, 1))
        trusted |= F.coalesce(F.col(f"has{cut}") & generic & (~weak | _has(ROLE_SUFFIXES, F.substring(s, 3, 1))), F.lit(False))
    noisy = rules.without_noise(s).isNotNull()
    low = F.least("left", "right")
    shape = F.when(rules.is_person_like(s), 3.0).otherwise(0.0) + F.when(F.length(s) >= 3, 1.0).when(_has(HINT_SUFFIXES, F.substring(s, -1, 1)), 1.25).otherwise(-1.0) - F.when(noisy, 1.5).otherwise(0.0)
    score = 2 * low + 2.2 * F.ln(F.col("n") + 1.0) + 2.8 * F.ln(F.col("blocks") + 1.0) + shape
    kept = (F.col("n") >= least) & (F.col("blocks") >= least_blocks) & ((low >= LEAST_ENTROPY) | F.coalesce("is_seed", F.lit(False)) | noisy | trusted)
    return stats.select("surface", "n", "blocks", "left", "right", score.alias("score"), kept.alias("kept"))


class Counted:
    """Blocks that hold both of some pairs, counted before."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    def both(self, pairs: DataFrame) -> DataFrame:
        return self.counts.join(pairs.select("short", "long").distinct(), ["short", "long"])


def _overlaps(pairs: DataFrame, present) -> DataFrame:
    """pairs (short, long) with the number of blocks that hold both; present is (surface, id), or what counts blocks itself: a Growth, Counted."""
    if not isinstance(present, DataFrame):
        return present.both(pairs)
    held = pairs.join(present.select(F.col("surface").alias("short"), "id"), "short").join(present.select(F.col("surface").alias("long"), "id"), ["long", "id"])
    return held.groupBy("short", "long").agg(F.count("*").alias("both"))


def _best_two(options: DataFrame, by: list[Column], value: Column, *more: Column) -> DataFrame:
    """(short, long, best, second, ...): the first option of each short one, and the second's value."""
    order = Window.partitionBy("short").orderBy(*by)
    return options.withColumns({"r": F.row_number().over(order), "second": F.lead(value).over(order)}).filter("r = 1").select("short", "long", value.alias("best"), "second", *more)


def _dominant_pairs(surfaces: DataFrame, rules: NameRules) -> tuple[DataFrame, DataFrame]:
    """People's names without their trailing character (surface, target), and pairs (short, long, its, blocks) of person-like surfaces and longer names."""
    kept, names = surfaces.filter("kept"), surfaces.select(F.col("surface").alias("target"))
    noisy = kept.select("surface", rules.without_noise(F.col("surface")).alias("target")).join(names, "target", "left_semi").select("surface", "target")
    long = kept.filter(rules.is_person(F.col("surface")) & (F.least("left", "right") >= LEAST_ENTROPY))
    n = F.length("surface")
    pieces = F.array_distinct(F.filter(F.array(*[x for cut in (1, 2) for x in (F.substring("surface", F.lit(1), n - cut), F.substring(F.col("surface"), F.lit(cut + 1), n - cut))]), lambda x: x != ""))
    pairs = long.select(F.col("surface").alias("long"), F.col("score").alias("its"), F.explode(pieces).alias("short")).filter(F.coalesce(rules.without_noise(F.col("long")) != F.col("short"), F.lit(True)))
    short = kept.filter((F.col("blocks") > 1) & rules.is_person_like(F.col("surface"))).join(noisy.select("surface"), "surface", "left_anti").select(F.col("surface").alias("short"), "blocks")
    return noisy, pairs.join(short, "short")


def dominant_extensions(surfaces: DataFrame, present: DataFrame, rules: NameRules) -> DataFrame:
    """(surface, target): people's names with a trailing character stand for the name without it; a short person-like surface for the one longer name that nearly always goes with it."""
    noisy, pairs = _dominant_pairs(surfaces, rules)
    options = pairs.join(_overlaps(pairs.select("short", "long"), present), ["short", "long"]).withColumn("containment", F.col("both") / F.col("blocks")).filter(F.col("containment") >= PERSON_CONTAINMENT)
    options = options.withColumn("specific", F.col("its") + (F.length("long") - F.length("short")) * 0.5)
    best = _best_two(options, [F.desc("specific"), F.desc("containment"), F.desc(F.length("long")), F.col("long")], F.col("specific"))
    sure = best.filter(F.col("second").isNull() | (F.col("best") - F.col("second") >= PERSON_MARGIN))
    return noisy.unionByName(sure.select(F.col("short").alias("surface"), F.col("long").alias("target")))


def _family_pairs(surfaces: DataFrame, rules: NameRules) -> list[tuple[str, DataFrame]]:
    """For each side, pairs (short, long, rank, blocks, left, right) of surfaces that are no people's names and those one character longer on that side, where it is nearly fixed."""
    ranked = surfaces.filter("kept").withColumn("rank", F.struct((-F.col("score")).alias("a"), (-F.col("blocks")).alias("b"), (-F.col("n")).alias("c"), (-F.length("surface")).alias("d"), F.col("surface").alias("e")))
    own = ranked.filter((F.length("surface") >= 2) & ~rules.is_person(F.col("surface"))).select(F.col("surface").alias("short"), "rank", "blocks", "left", "right")
    parts = (("left", F.substring(F.col("surface"), F.lit(2), F.length("surface") - 1)), ("right", F.substring("surface", F.lit(1), F.length("surface") - 1)))
    return [(side, surfaces.select(F.col("surface").alias("long"), part.alias("short")).join(own.filter(F.col(side) <= FAMILY_ENTROPY), "short")) for side, part in parts]


def family_edges(surfaces: DataFrame, present: DataFrame, rules: NameRules) -> DataFrame:
    """(surface, target) between surfaces that are no people's names and those one character longer, where the neighbour on that side is nearly fixed.

    The longer one is the target, unless the added character is weak; then the shorter one is. In order of score, a surface
    that has become another's source by a weak extension makes no edge of its own; of two edges from
    one surface the later counts.
    """
    lengths = surfaces.filter("kept").select(F.col("surface").alias("long"), F.length("surface").alias("size"))
    found = []
    for side, pairs in _family_pairs(surfaces, rules):
        options = pairs.join(_overlaps(pairs.select("short", "long"), present), ["short", "long"]).withColumn("containment", F.col("both") / F.col("blocks")).filter(F.col("containment") >= FAMILY_CONTAINMENT).join(lengths, "long", "left")
        best = _best_two(options, [F.desc("containment"), F.desc("both"), F.desc(F.coalesce("size", F.lit(0))), F.col("long")], F.col("both"), F.col("rank"))
        sure = best.filter(F.col("second").isNull() | (F.col("second") / F.col("best") < FAMILY_SECOND))
        c = F.substring("long", 1, 1) if side == "left" else F.substring("long", -1, 1)
        weak = _has(MODIFIER_PREFIXES + LOW_PREFIXES + FUNCTION_CHARS if side == "left" else LOW_SUFFIXES + FUNCTION_CHARS + rules.noise, c)
        found.append(sure.select("short", "long", "rank", weak.alias("weak"), F.lit(side).alias("side")))
    found = [settled(f) for f in found]
    either = found[0].unionByName(found[1].join(found[0].select("short"), "short", "left_anti"))
    made = None
    for size in sorted(r[0] for r in either.select(F.length("short").alias("k")).distinct().collect()):  # a few lengths
        mine = either.filter(F.length("short") == size)
        if made is not None:
            taken = made.filter("weak").select(F.col("long").alias("short"), F.col("rank").alias("before"))
            mine = mine.join(taken, (mine["short"] == taken["short"]) & (F.col("before") < F.col("rank")), "left_anti")
        made = settled(mine if made is None else made.unionByName(mine))
    if made is None:
        return either.select(F.col("short").alias("surface"), F.col("long").alias("target"))
    edges = made.select(F.when(F.col("weak"), F.col("long")).otherwise(F.col("short")).alias("surface"), F.when(F.col("weak"), F.col("short")).otherwise(F.col("long")).alias("target"), "rank")
    return edges.groupBy("surface").agg(F.max_by("target", "rank").alias("target"))


def weak_affixes(surfaces: DataFrame, rules: NameRules) -> DataFrame:
    """(surface, target): surfaces of three characters and more without a weak first, else a weak last character, where what is left is a surface too."""
    s, n = F.col("surface"), F.length("surface")
    names = surfaces.select(F.col("surface").alias("target"))
    head = F.when(_has(MODIFIER_PREFIXES + LOW_PREFIXES + FUNCTION_CHARS, F.substring(s, 1, 1)), F.substring(s, F.lit(2), n - 1))
    tail = F.when(_has(LOW_SUFFIXES + FUNCTION_CHARS + rules.noise, F.substring(s, -1, 1)), F.substring(s, F.lit(1), n - 1))
    rows = surfaces.filter(n >= 3).select("surface", F.explode(F.filter(F.array(F.struct(F.lit(1).alias("k"), head.alias("target")), F.struct(F.lit(2).alias("k"), tail.alias("target"))), lambda x: x["target"].isNotNull())).alias("x")).select("surface", "x.k", "x.target")
    return rows.join(names, "target", "left_semi").groupBy("surface").agg(F.min_by("target", "k").alias("target"))


FOLLOW = """
with recursive walk(surface, at, path) as (
  select surface, surface, array(surface) from {surfaces} where kept
  union all
  select w.surface, e.target, concat(w.path, array(e.target)) from walk w join {edges} e on e.surface = w.at where not array_contains(w.path, e.target))
select surface, at as canonical, size(path) as steps from walk
"""


def canonical_surfaces(surfaces: DataFrame, present: DataFrame, rules: NameRules) -> DataFrame:
    """(surface, canonical): kept surfaces and what they stand for, followed to the end; a ring is left where it would close.

    Weak affixes come before families, these before dominant extensions. A present that counts
    blocks itself looks at them once for all pairs.
    """
    if not isinstance(present, DataFrame):
        pairs = [p for _, p in _family_pairs(surfaces, rules)] + [_dominant_pairs(surfaces, rules)[1]]
        named = [p.select("short", "long") for p in pairs]
        present = Counted(settled(present.both(named[0].unionByName(named[1]).unionByName(named[2]))))
    maps = [weak_affixes(surfaces, rules), family_edges(surfaces, present, rules), dominant_extensions(surfaces, present, rules)]
    ranked = [m.select("surface", "target", F.lit(k).alias("k")) for k, m in enumerate(maps)]
    edges = settled(ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("surface").agg(F.min_by("target", "k").alias("target")))
    walked = recursive(FOLLOW, surfaces=surfaces, edges=edges)
    return walked.groupBy("surface").agg(F.max_by("canonical", "steps").alias("canonical"))


def canonical_candidates(surfaces: DataFrame, present: DataFrame, canonical: DataFrame, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(canonical, importance, blocks, n, score, surfaces): surfaces (as an array, the canonical one first, then by score) under one name, with importance blocks + min(n / 2, blocks)."""
    if isinstance(present, DataFrame):
        held = present.join(canonical, "surface").select("canonical", "id").distinct().groupBy("canonical").agg(F.count("*").alias("blocks"))
    else:
        # A surface that stands for itself alone is held by the blocks that were counted; the texts are looked at for the others.
        sized = settled(canonical.join(canonical.groupBy("canonical").agg(F.count("*").alias("members")), "canonical"))
        lone = surfaces.join(sized.filter("members = 1"), "surface").select("canonical", "blocks")
        held = lone.unionByName(present.held(sized.filter("members > 1").select("surface", "canonical")))
    s = F.struct((F.col("surface") != F.col("canonical")).alias("other"), (-F.col("score")).alias("score"), (-F.length("surface")).alias("size"), "surface")
    grouped = surfaces.join(canonical, "surface").groupBy("canonical").agg(F.sum("n").alias("n"), (F.max("score") + (F.count("*") - 1) * 0.1).alias("score"), F.transform(F.array_sort(F.collect_list(s)), lambda x: x["surface"]).alias("surfaces"))
    return grouped.join(held, "canonical").filter(F.col("blocks") >= least_blocks).select("canonical", (F.col("blocks") + F.least(F.floor(F.col("n") / 2), F.col("blocks"))).alias("importance"), "blocks", "n", "score", "surfaces")
