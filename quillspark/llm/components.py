"""Connected components, and links found through buckets of candidates without expanding their pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is itself a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    wrong = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1 and up > 0")
    return wrong.isEmpty()


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, component) for every end of links (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds; each is a few shuffles of the links, and their
    number grows with the logarithm of a component's size. Links that are stars already take none.
    No links give no rows. keep() cuts a round's lineage; the result reads what it kept last.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not _stars(edges):
        # Large star: every larger neighbour goes to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node itself, goes to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(joined.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _apart(rows: DataFrame, labels: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with their component, of the buckets that hold members of several."""
    rows = rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    return keep(rows.join(mixed, "bucket"))


def close_members(members: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """The members (bucket, id, data) that have a near one of another id in their bucket."""
    near_one = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") != F.col("y.id")) & near(F.col("x.data"), F.col("y.data"))
    return members.alias("x").join(members.alias("y"), near_one, "left_semi")


#: Further turns go on while more than so many pairs a member are left; each takes so many hubs of a bucket.
FEW, HUBS = 4, 4


def _pairs_left(rows: DataFrame) -> tuple[int, int]:
    """How many pairs of different components the buckets of rows hold, and how many rows there are."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").cast("double").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    pairs, members = buckets.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.sum("n")).first()
    return int(pairs or 0), int(members or 0)


#: Most members of a block, on average.
BLOCK = 1024


def _blocks(rows: DataFrame) -> DataFrame:
    """(bucket, m, o, main, copies): into how many blocks a bucket's largest component (main) and its other members are dealt, and how many rows meetings() makes of them."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
    few = F.col("n") <= BLOCK
    m, o = (F.when(few, k).otherwise(F.ceil(n / BLOCK)) for k, n in ((0, F.col("most")), (1, F.col("n") - F.col("most"))))
    copies = F.when(few, F.col("n")).otherwise(F.col("most").cast("double") * F.col("o") + (F.col("n") - F.col("most")).cast("double") * (F.col("m") + F.col("o")))
    return sizes.withColumns({"m": m.cast("int"), "o": o.cast("int")}).select("bucket", "m", "o", "main", "n", copies.alias("copies"))


def meetings(rows: DataFrame) -> DataFrame:
    """rows with meeting and first, once for each meeting of two blocks of their bucket: all members of different components meet, those of block first in a meeting of two the others, or all of a block one another.

    A bucket of at most BLOCK members is one block. Else its largest component and its other members
    are dealt into blocks apart, and blocks of the largest component do not meet one another. So a row
    is copied as often as there are blocks for it to meet, and no meeting holds more than two blocks.
    """
    dealt = rows.join(_blocks(rows).drop("n", "copies"), "bucket")
    inside = (F.col("component") == F.col("main")) & (F.col("m") > 0)
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    block = F.when(inside, deal(F.greatest(F.lit(1), F.col("m")))).otherwise(F.col("m") + deal(F.col("o")))
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.when(inside, F.col("m")).otherwise(0), F.col("m") + F.col("o") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select(*rows.columns, (low * (F.col("m") + F.col("o")).cast("long") + high).alias("meeting"), F.when(low == high, None).otherwise(F.col("block") == low).alias("first"))


def _copies(rows: DataFrame) -> tuple[int, int]:
    """How many rows meetings() makes of rows, and how many rows there are."""
    made, members = _blocks(rows).agg(F.sum("copies"), F.sum("n")).first()
    return int(made or 0), int(members or 0)


def _hub_pairs(rows: DataFrame, turn: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b), a < b, of members outside their bucket's largest component with a few members of it, others each turn."""
    main = rows.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    seen = rows.join(main, "bucket")
    # The choice goes by id, so that buckets with the same members mostly make the same pairs.
    chosen = [F.min_by(F.struct("id", "data"), F.xxhash64("id", F.lit(turn), F.lit(k))) for k in range(HUBS)]
    hubs = seen.filter("component = main").groupBy("bucket").agg(F.array(*chosen).alias("hubs")).select("bucket", F.explode("hubs").alias("hub"))
    met = seen.filter("component != main").join(hubs, "bucket").filter(near(F.col("data"), F.col("hub.data")))
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def linked_components(members: DataFrame, near: Callable[[Column, Column], Column], prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], known: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, met_links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) over known links (a, b) and those between members (bucket, id, data) of one bucket.

    near(x, y) tells from two members' data whether they can be linked at all; members without a
    near one should be left out, see close_members(), and the rest be without lineage. prepare() gets the ids (id) of all members
    and returns a function that, given pairs (a, b) with a < b, returns those that are linked.
    First every bucket's members meet one of them, the least; so alike members become one component
    by a row each. While many pairs are left and turns help, members outside a bucket's largest
    component meet a few others of it. At last all near members of different components of a bucket
    meet, so all links count, while pairs inside a component are never made. A bucket is no task's:
    it is summed with partial aggregates and joined back, and a join's large side may be split.
    With met_links() the last pairs are no rows: members come in the meetings() of blocks, and it
    returns links (a, b) that connect what is linked. Rows then grow with the square of a bucket's
    blocks, comparisons still with that of its members.
    keep() cuts the lineage between the turns: checkpoints, or tables of scratch(), whose shuffle
    files go at once; then the result must be cut before they do.
    """
    rows = members
    links = keep(known.select("a", "b"))
    if rows.isEmpty():
        return components(links, keep)
    linked = prepare(rows.select("id").distinct())
    hubs = rows.groupBy("bucket").agg(F.min(F.struct("id", "data")).alias("hub"))
    met = rows.join(hubs, "bucket").filter((F.col("id") != F.col("hub.id")) & near(F.col("data"), F.col("hub.data")))
    pairs = met.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    links = links.union(keep(linked(pairs).select("a", "b")))

    labels = components(links, keep)
    rows = _apart(rows, labels, keep)
    if rows.isEmpty():
        return labels
    measure = _pairs_left if met_links is None else _copies
    turn, (left, count) = 0, measure(rows)
    while left > FEW * count:
        turn, before = turn + 1, left
        found = keep(linked(_hub_pairs(rows, turn, near)).select("a", "b"))
        # The labels found so far are stars, so few rounds are left.
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), keep)
        rows = _apart(rows.drop("component"), labels, keep)
        left, count = measure(rows)
        if 4 * left > 3 * before:
            break
    if not count:
        return labels
    if met_links is not None:
        found = keep(met_links(meetings(rows)).select("a", "b"))
        return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), keep)
    other = rows.select("bucket", F.col("id").alias("id2"), F.col("data").alias("data2"), F.col("component").alias("component2"))
    met = rows.join(other, "bucket").filter((F.col("component") < F.col("component2")) & near(F.col("data"), F.col("data2")))
    found = keep(linked(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()).select("a", "b"))
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), keep)
