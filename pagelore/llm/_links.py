"""Links among the members of many lists, without making all pairs of a list.

Members of a list are compared with one representative, then (among what isn't yet in
one component) with another. The member that stands in the most lists represents: of near
copies that is the one that the others differ least from. Of the members that are still in different components, a
pair is compared in full only if it can link: the distances of both to each
representative (known exactly, in elements) differ by no more than two linked sets do, and
so do their odd sketches. Both tests stand in the join, and neither loses a link. Whatever
else is never compared is in one component already, so the components of the links are
those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm._common import components, materialize

Fits = Callable[[str, str], Column]
Verify = Callable[[DataFrame, str], DataFrame]


def shared_lists(entries: DataFrame, name: str) -> DataFrame:
    """Entries (class, n, sig) of the lists with several members."""
    several = entries.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    return materialize(entries.join(several, "sig"), f"{name}-lists")


def open_lists(live: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Entries of the lists whose members aren't all in one component, with their component."""
    comp = components(links, name)
    with_comp = live.join(comp, F.col("class") == F.col("id"), "left").select("sig", "class", "n", "degree", F.coalesce("component", "class").alias("comp"))
    mixed = with_comp.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return materialize(with_comp.join(mixed, "sig"), name)


def _differ(x: DataFrame, y: DataFrame, words: int) -> Column:
    """In how many bits two odd sketches of so many integers differ."""
    return sum((F.bit_count(x[f"x{i}"].bitwiseXOR(y[f"y{i}"])) for i in range(words)), F.lit(0))


def link_lists(entries: DataFrame, verify: Verify, fits: Fits, name: str, sketches: DataFrame, spread: int) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs that share a list.

    ``sketches``: class, q0, q1, ..., the odd sketch of its set. Sets that link differ in at
    most (n + m) / ``spread`` elements.
    ``entries``: class, n (a size), sig (a list). ``fits(n, m)``: can these sizes link?
    ``verify(pairs, name)``: the pairs (a, b) with their ``distance`` (elements in just one
    of the two sets) and whether they link (``linked``)."""
    live = shared_lists(entries, name)
    degree = live.groupBy("class").agg(F.count("*").alias("degree"))
    live = materialize(live.join(degree, "class").select("sig", "class", "n", "degree"), f"{name}-live")
    hub = F.struct((-F.col("degree")).alias("d"), "class", "n")
    heads = live.groupBy("sig").agg(F.min(hub).alias("h")).select("sig", F.col("h.class").alias("f"), F.col("h.n").alias("fn"))
    heads = materialize(heads, f"{name}-heads")
    star = live.join(heads, "sig").where((F.col("class") != F.col("f")) & fits("fn", "n"))
    first = verify(star.select(F.col("f").alias("a"), F.col("class").alias("b")).distinct(), f"{name}-star")
    links = first.where("linked").select("a", "b")

    rest = open_lists(live, links, f"{name}-open")
    if rest.isEmpty():
        return links
    # the best representative of what isn't in the first one's component
    ruled = rest.join(heads.select("sig", "f"), "sig")
    ruled = ruled.join(ruled.where("class = f").select("sig", F.col("comp").alias("fc")), "sig")
    again = ruled.where("comp <> fc").groupBy("sig").agg(F.min(F.struct((-F.col("degree")).alias("d"), "class", "n", "comp")).alias("h")).select("sig", F.col("h.class").alias("g"), F.col("h.n").alias("gn"), F.col("h.comp").alias("gc"))
    again = materialize(again, f"{name}-heads2")
    star = rest.join(again, "sig").where((F.col("comp") != F.col("gc")) & fits("gn", "n"))
    second = verify(star.select(F.col("g").alias("a"), F.col("class").alias("b")).distinct(), f"{name}-again")
    links = links.union(second.where("linked").select("a", "b"))

    rest = open_lists(rest.select("sig", "class", "n", "degree"), links, f"{name}-rest")
    if rest.isEmpty():
        return links
    # every entry with its distances to the two heads of its list (null where they were not compared)
    rest = rest.join(heads.select("sig", "f"), "sig").join(again.select("sig", "g"), "sig")
    rest = rest.join(first.select(F.col("a").alias("f"), F.col("b").alias("class"), F.col("distance").alias("df")), ["f", "class"], "left")
    rest = rest.join(second.select(F.col("a").alias("g"), F.col("b").alias("class"), F.col("distance").alias("dg")), ["g", "class"], "left")
    rest = rest.withColumn("df", F.when(F.col("class") == F.col("f"), 0).otherwise(F.col("df"))).withColumn("dg", F.when(F.col("class") == F.col("g"), 0).otherwise(F.col("dg")))
    # a pair is met in the first list that both stand in, and in no other one
    mine = rest.groupBy("class").agg(F.collect_list("sig").alias("sigs"))
    rest = rest.join(mine, "class").withColumn("earlier", F.expr("filter(sigs, s -> s < sig)"))
    words = len(sketches.columns) - 1
    rest = materialize(rest.select("sig", "class", "n", "comp", "df", "dg", "earlier").join(sketches, "class"), f"{name}-sketched")
    x = rest.select("sig", *(F.col(c).alias(f"{c}_x") for c in ("class", "n", "comp", "df", "dg", "earlier")), *(F.col(f"q{i}").alias(f"x{i}") for i in range(words)))
    y = rest.select("sig", *(F.col(c).alias(f"{c}_y") for c in ("class", "n", "comp", "df", "dg", "earlier")), *(F.col(f"q{i}").alias(f"y{i}") for i in range(words)))
    most = F.col("n_x") + F.col("n_y")
    near = spread * _differ(x, y, words) <= most
    for d in ("df", "dg"):
        near = F.coalesce(spread * F.abs(F.col(f"{d}_x") - F.col(f"{d}_y")) <= most, F.lit(True)) & near
    near = near & ~F.arrays_overlap("earlier_x", "earlier_y")
    met = x.join(y, (x.sig == y.sig) & (x.class_x < y.class_y) & (x.comp_x != y.comp_y) & fits("n_x", "n_y") & near)
    last = verify(met.select(F.col("class_x").alias("a"), F.col("class_y").alias("b")).distinct(), f"{name}-full")
    return links.union(last.where("linked").select("a", "b"))
