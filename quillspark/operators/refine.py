"""Which candidates and pairs are taken: scores with surface bonus and penalty, prefix shadows, quota tiers, pair ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zh_names import NameRules

#: Characters and weights of the score.
NONREFERENTIAL_FIRST, NONREFERENTIAL_LAST, NONREFERENTIAL_INSIDE = "一都这那没", "吗呢吧啊呀么", "不没"
TWO_CHAR_ENDS = "会者界城司派盟帮"
IMPORTANCE_WEIGHT, ASSOCIATION_WEIGHT, PERSON_BONUS, TRANSLIT_BONUS, LONG_BONUS, SUFFIX_BONUS, TWO_CHAR_BONUS = 18.0, 14.0, 12.0, 10.0, 2.0, 7.0, 4.0
FIRST_PENALTY, LAST_PENALTY, INSIDE_PENALTY, BACKDROP_PENALTY, SHADOW_PENALTY, ENDPOINT_WEIGHT = 6.0, 6.0, 4.0, 12.0, 16.0, 0.35
SHADOW_RATIO, SHADOW_SECOND = 0.92, 0.5


def shortlist_limit(limit: int, times: int = 4, most: int = 512) -> int:
    """How many candidates are looked at for a limit of names."""
    return min(max(limit * times, limit, 1), max(limit, most))


def window_threshold(windows: int, least: int = 3, share: float = 0.005, most: int = 8) -> int:
    """In how many of so many windows a name must be: a share of them rounded up, from least (1 if there are fewer windows) to most; 0 without windows."""
    if windows <= 0:
        return 0
    return max(1 if windows < least else least, min(math.ceil(windows * share), most))


def _ends_in(chars: str, c: Column) -> Column:
    return F.contains(F.lit(chars), c) & (c != "")


def surface_value(name: Column, rules: NameRules, suffixes: Sequence[str] = (), backdrop: Sequence[str] = ()) -> Column:
    """The bonus of a Chinese surface less its penalty: people's and foreign names, entity suffixes; function words at its ends or inside, words of the backdrop."""
    n, first, last = F.length(name), F.substring(name, 1, 1), F.substring(name, -1, 1)
    put = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    entity = name.rlike("(?:" + "|".join(suffixes) + r")\z") if suffixes else F.lit(False)
    bonus = put(rules.is_person(name), PERSON_BONUS) + put(rules.is_translit(name), TRANSLIT_BONUS) + put(n >= 3, LONG_BONUS) + put((n >= 3) & entity, SUFFIX_BONUS) + put((n == 2) & _ends_in(TWO_CHAR_ENDS, last), TWO_CHAR_BONUS)
    phrase = put(_ends_in(NONREFERENTIAL_FIRST, first), FIRST_PENALTY) + put(_ends_in(NONREFERENTIAL_LAST, last), LAST_PENALTY) + put(name.rlike(f"[{NONREFERENTIAL_INSIDE}]"), INSIDE_PENALTY)
    return bonus - F.when(n >= 3, phrase).otherwise(0.0) - put(name.isin(*backdrop) if backdrop else F.lit(False), BACKDROP_PENALTY)


def prefix_shadows(importance: DataFrame, rules: NameRules) -> DataFrame:
    """(name, long): people's names of which one longer by a character is nearly as frequent, and no second one is half as frequent as that one.

    importance is (name, importance); the longer name meets its prefix in an equi-join.
    """
    people = importance.filter((F.col("importance") > 0) & rules.is_person(F.col("name")))
    longer = people.select(F.substring("name", F.lit(1), F.length("name") - 1).alias("name"), F.col("name").alias("long"), F.col("importance").alias("its"))
    order = Window.partitionBy("name").orderBy(F.desc("its"), "long")
    best = people.join(longer, "name").withColumns({"r": F.row_number().over(order), "second": F.coalesce(F.lead("its").over(order), F.lit(0))}).filter("r = 1")
    return best.filter((F.col("its") / F.col("importance") >= SHADOW_RATIO) & (F.col("second") / F.col("its") < SHADOW_SECOND)).select("name", "long")


def strongest(importance: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, degree, association): how many names stand beside each of importance, and the most that one of them is associated with it."""
    live = importance.filter("importance > 0")
    sides = [pairs.filter("count > 0").select(F.col(a).alias("name"), F.col(b).alias("other"), "count") for a, b in (("left", "right"), ("right", "left"))]
    ends = sides[0].unionByName(sides[1]).join(live.select("name", F.col("importance").alias("i")), "name").join(live.select(F.col("name").alias("other"), F.col("importance").alias("j")), "other")
    return ends.groupBy("name").agg(F.count("*").alias("degree"), F.max(F.col("count") / F.sqrt(F.col("i") * F.col("j"))).alias("association"))


def candidate_scores(importance: DataFrame, pairs: DataFrame, value: Column, shadows: DataFrame) -> DataFrame:
    """The scores() of names with pairs (left, right, count) of them."""
    return scores(importance, strongest(importance, pairs), value, shadows)


def scores(importance: DataFrame, strongest: DataFrame, value: Column, shadows: DataFrame) -> DataFrame:
    """(name, importance, degree, association, score, shadowed): 18 ln(1 + importance) + 14 times the strongest association, the surface's value, less for shadowed names."""
    live = importance.filter("importance > 0")
    rows = live.join(strongest, "name", "left").join(shadows.select("name", F.lit(True).alias("shadowed")), "name", "left")
    rows = rows.withColumns({"degree": F.coalesce("degree", F.lit(0)), "association": F.coalesce("association", F.lit(0.0)), "shadowed": F.coalesce("shadowed", F.lit(False))})
    score = F.log1p("importance") * IMPORTANCE_WEIGHT + F.col("association") * ASSOCIATION_WEIGHT + value - F.when(F.col("shadowed"), SHADOW_PENALTY).otherwise(0.0)
    return rows.select("name", "importance", "degree", "association", score.alias("score"), "shadowed")


def tiered(scored: DataFrame, most: int) -> DataFrame:
    """(name, importance, score, place): most names in order: three quarters by score, a quarter by importance, then the rest by score, shadowed names last.

    Each tier is a top-k of at most most rows, so only a few times most rows meet in one place.
    """
    reserve = min(most, max(most // 4, 1))
    primary = max(most - reserve, 1)
    by_score = [F.desc("score"), F.desc("importance"), F.desc(F.length("name")), F.col("name")]
    by_count = [F.desc("importance"), F.desc(F.length("name")), F.col("name")]
    open_, shut = scored.filter("not shadowed"), scored.filter("shadowed")
    top = lambda rows, order, n, tier: rows.orderBy(*order).limit(n).select("name", "importance", "score", F.lit(tier).alias("tier"))
    chosen = top(open_, by_score, primary, 0).unionByName(top(open_, by_count, reserve, 1)).unionByName(top(open_, by_score, primary + most, 2)).unionByName(top(shut, by_count, most, 3))
    once = chosen.groupBy("name", "importance", "score").agg(F.min("tier").alias("tier"))
    # Within a tier names are in the tier's own order.
    key = F.when(F.col("tier").isin(0, 2), F.struct((-F.col("score")).alias("a"), (-F.col("importance")).alias("b"))).otherwise(F.struct((-F.col("importance")).cast("double").alias("a"), F.lit(0).cast("long").alias("b")))
    order = Window.orderBy("tier", key, F.desc(F.length("name")), "name")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("name", "importance", "score", "place")


def ranked_pairs(pairs: DataFrame, selected: DataFrame, most: int) -> DataFrame:
    """(left, right, count, score): the most best pairs of selected names by count (1 + association) and the weaker end's score."""
    end = lambda side: selected.select(F.col("name").alias(side), F.col("importance").alias(f"{side}_i"), F.col("score").alias(f"{side}_s"))
    both = pairs.filter("count > 0").join(end("left"), "left").join(end("right"), "right")
    score = F.col("count") * (1 + F.col("count") / F.sqrt(F.col("left_i") * F.col("right_i"))) + F.least("left_s", "right_s") * ENDPOINT_WEIGHT
    return both.withColumn("score", score).orderBy(F.desc("score"), F.desc("count"), "left", "right").limit(most).select("left", "right", "count", "score")
