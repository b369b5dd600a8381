"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow routes the token capacity of each pattern to the quotas of its
sources; a pattern's capacity comes in tiers, one per repetition, at rising
cost, so nothing is repeated while fresh text is left.  The flow of a pattern
then becomes whole repetitions of all its documents plus a seeded selection.

A source whose documents belong to no other source is a network of one path,
and its flow a formula of the source table; only patterns of sources that
overlap with others meet in the flow.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textstrata.llm.shared import materialise, word_count
from textstrata.operators.prefix import running_sum

#: Hash ranges whose sizes are summed before any document is ranked.
RANGES_BITS = 12
MAX_REPEATS = 3


def source_table(patterns: DataFrame, weights=None, cap: float = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(pattern, members, mass)``.

    Shares of all tokens by weight, none above ``cap`` times the size of its source.
    What a capped source can't take is shared again by weight among the others:
    every round is one aggregation that gives the tokens left over and the weight of
    the sources that are still open, so the driver only ever holds those numbers.
    """
    spark = patterns.sparkSession
    sizes = patterns.select(F.explode("members").alias("source"), "mass").groupBy("source").agg(F.sum("mass").alias("source_size"))
    if weights is None:
        place = running_sum(sizes, [F.asc_nulls_last("source")], F.lit(1), "place")
        table = place.select("source", "source_size", ((F.col("place") - 1) % 3 + 1).cast("double").alias("weight"))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "w_source string, weight double")
        table = sizes.join(given, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    table = materialise(table, "mix-sources")
    total = float(patterns.agg(F.sum("mass")).first()[0] or 0)
    limit = F.lit(cap) * F.col("source_size")
    rest, whole, n_open = total, table.agg(F.sum("weight")).first()[0] or 1.0, table.count()
    while True:
        share = F.lit(rest) * F.col("weight") / F.lit(whole)
        over = share > limit  # a round's share is never below the one before, so capped sources stay capped
        r = table.agg(F.count_if(~over).alias("open"), F.sum(F.when(over, limit)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("whole")).first()
        if r.open == n_open or not r.open:
            return table.select("source", "source_size", F.least(share, limit.cast("double")).alias("target"))
        rest, whole, n_open = total - float(r.capped), r.whole, r.open


def min_cost_flow(n: int, arcs: Sequence[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a largest flow of least cost.

    Successive shortest paths with potentials; costs are not negative.
    """
    to, room, cost = [], [], []
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for a, b, cap, price in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            room.append(cap)
            cost.append(price)
    potential = [0] * n
    while True:
        dist, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if room[e] > 0:
                    there = d + cost[e] + potential[u] - potential[to[e]]
                    if there < dist.get(to[e], 1 << 62):
                        dist[to[e]], via[to[e]] = there, e
                        heapq.heappush(heap, (there, to[e]))
        if sink not in dist:
            return [room[2 * i + 1] for i in range(len(arcs))]
        far = max(dist.values())
        for v in range(n):
            potential[v] += dist.get(v, far)
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def route(patterns: dict[str, tuple[tuple, int]], targets: dict[str | None, float], repeats: int = MAX_REPEATS) -> dict[str, int]:
    """Tokens to take from each pattern: ``patterns`` maps a key to its sources and size."""
    keys, names = sorted(patterns), list(targets)
    node = {k: 1 + i for i, k in enumerate(keys)} | {("source", s): 1 + len(keys) + i for i, s in enumerate(names)}
    sink = 1 + len(keys) + len(names)
    arcs, tiers = [], []
    for k in keys:
        for tier in range(repeats):
            tiers.append(k)
            arcs.append((0, node[k], patterns[k][1], tier))
    for k in keys:
        arcs += [(node[k], node["source", s], repeats * patterns[k][1], 0) for s in patterns[k][0]]
    arcs += [(node["source", s], sink, round(targets[s]), 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    taken = dict.fromkeys(keys, 0)
    for k, f in zip(tiers, flow):
        taken[k] += f
    return taken


def _fits() -> Column:
    return (~F.col("chosen")) & (F.col("mass") > 0) & (F.col("mass") <= F.col("want"))


def _select(units: DataFrame) -> DataFrame:
    """One round of ``chosen``: the unchosen units of each pattern that fit ``want``, in seeded order.

    Hash ranges that fit whole are taken whole; only the range in which the sum
    passes ``want`` is ranked, 1 / 2**RANGES_BITS of a pattern.  Units with one
    hash are peers and share the decision.
    """
    fits = _fits()
    span = F.shiftrightunsigned("h", 64 - RANGES_BITS)
    sums = units.where(fits).groupBy("pattern", span.alias("span")).agg(F.sum("mass").alias("mass"), F.max("want").alias("want"))
    run = sums.withColumn("upto", F.sum("mass").over(Window.partitionBy("pattern").orderBy("span")))
    cut = run.where("upto > want").groupBy("pattern").agg(F.min(F.struct("span", (F.col("upto") - F.col("mass")).alias("before"))).alias("cut"))
    at = units.join(_per_pattern(cut.withColumnRenamed("pattern", "cut_pattern"), "mix-cuts"), F.col("pattern") == F.col("cut_pattern"), "left").withColumn("fits", fits).withColumn("span", span)
    edge = F.col("fits") & F.coalesce(F.col("span") == F.col("cut.span"), F.lit(False))
    whole = at.where(~edge).withColumn("chosen", F.col("chosen") | (F.col("fits") & F.coalesce(F.col("span") < F.col("cut.span"), F.lit(True))))
    order = Window.partitionBy("pattern").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = at.where(edge).withColumn("chosen", F.col("cut.before") + F.sum("mass").over(order) <= F.col("want"))
    return whole.unionByName(ranked).select("id", "size", "n", "mass", "pattern", "h", "chosen")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> DataFrame:
    """``(id, size, pattern)`` per row: words of the text and the key of its set of sources."""
    return docs.select(F.col(id_col).cast("long").alias("id"), word_count(F.col(text_col)).alias("size"), _pattern(sources).alias("pattern"))


def _pattern(sources: Column | None) -> Column:
    """Key of a set of sources; no list of sources is the empty set."""
    member = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    return F.to_json(member)


def _per_pattern(table: DataFrame, name: str) -> DataFrame:
    """A table of one short row per pattern, written, so that its join is planned by its bytes."""
    return materialise(table, name)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``mix_sized`` over the rows of ``docs``; a document's sources default to its ``source`` column."""
    return mix_sized(sized(docs, id_col, text_col, sources), **options)


def _flows(patterns: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """``(pattern, mass, flow)``: tokens to take from each pattern.

    A pattern of one source that no other pattern has takes that source's target,
    at most ``repeats`` times its own size.  Sources that some pattern joins, and all
    patterns that touch them, form the network of ``route``.
    """
    member = F.explode("members").alias("source")
    joint = materialise(patterns.where(F.size("members") > 1).select(member).distinct(), "mix-joint")
    pairs = patterns.select("pattern", "mass", "members", member)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    alone = pairs.join(joint, same(pairs, joint), "left_anti")
    alone = alone.join(sources, same(alone, sources)).select("pattern", "mass", F.least(F.bround("target").cast("long"), F.lit(repeats) * F.col("mass")).alias("flow"))
    nodes = [r for r in pairs.join(joint, same(pairs, joint), "left_semi").select("pattern", "mass", "members").distinct().collect()]
    targets = {r.source: r.target for r in sources.join(joint, same(sources, joint), "left_semi").collect()}
    flow = route({r.pattern: (tuple(r.members), int(r.mass)) for r in nodes}, targets, repeats)
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("mass", T.LongType()), T.StructField("flow", T.LongType())])
    return alone.unionByName(patterns.sparkSession.createDataFrame([(r.pattern, int(r.mass), flow[r.pattern]) for r in nodes], schema))


def mix_sized(rows: DataFrame, weights=None, repeats: int = MAX_REPEATS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(units, sources)``: how often each document is taken, and each source's size and target.

    ``units`` is ``(id, size, pattern, copies)``, one row per distinct id, size
    and pattern; repeated rows share the decision.  ``sources`` is ``(source,
    source_size, target)``.  A null source is a source of
    its own, last in order.  Weights default to 1,
    2, 3, repeating over the sources in code point order.  Each source gets its
    weight's share of all tokens, at most ``repeats`` times its size.  A null
    text has size 0; documents of size 0 are never taken, and those of no source at
    all are not among the units.

    Only the patterns of overlapping sources reach the driver.  Rounds go on, each filling
    what the one before left with documents that fit, in seeded order, until
    none fits any more.
    """
    units = materialise(rows.groupBy("id", "size", "pattern").agg(F.count("*").alias("n")).withColumn("mass", F.col("size") * F.col("n"))
                        .withColumn("h", F.xxhash64("id", "size", F.lit(seed))), "mix-units")
    patterns = materialise(units.groupBy("pattern").agg(F.sum("mass").alias("mass")).withColumn("members", F.from_json("pattern", "array<string>")), "mix-patterns")
    sources = materialise(source_table(patterns, weights, repeats), "mix-targets")
    rest = F.when(F.col("mass") > 0, F.col("flow") % F.col("mass")).otherwise(0)
    whole = F.when(F.col("mass") > 0, F.expr("flow div mass")).otherwise(0)
    plan = _per_pattern(_flows(patterns, sources, repeats).select(F.col("pattern").alias("p"), whole.alias("whole"), rest.alias("rest")), "mix-plan")
    now, used = units.withColumn("chosen", F.lit(False)), -1
    while True:
        taken = now.where("chosen").groupBy("pattern").agg(F.sum("mass").alias("used"))
        left = _per_pattern(plan.join(taken, F.col("p") == F.col("pattern"), "left").select("p", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("want")), "mix-wants")
        wanted = now.join(left, F.col("pattern") == F.col("p")).drop("p")
        state = wanted.agg(F.count_if(_fits()).alias("open"), F.count_if("chosen").alias("used")).first()
        if not state.open or state.used == used:  # nothing fits, or only rows of one hash that don't fit together
            break
        now, used = materialise(_select(wanted), "mix-round"), state.used
    chosen = now.join(plan, F.col("pattern") == F.col("p")).select("id", "size", "pattern", (F.col("whole") + F.col("chosen").cast("long")).alias("copies"))
    return chosen.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0)), sources


def with_copies(docs: DataFrame, units: DataFrame, id_col: str, text_col: str, sources: Column | None = None, name: str = "copies") -> DataFrame:
    """``docs`` with the ``copies`` of its unit as a last column ``name``; every row stays."""
    free = "_u"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    u = units.select(F.col("id").alias(f"{free}_id"), F.col("size").alias(f"{free}_size"), F.col("pattern").alias(f"{free}_pattern"), F.col("copies").alias(name))
    match = docs[id_col].cast("long").eqNullSafe(u[f"{free}_id"]) & (word_count(docs[text_col]) == u[f"{free}_size"]) & (_pattern(sources) == u[f"{free}_pattern"])
    joined = docs.join(u, match, "left").drop(f"{free}_id", f"{free}_size", f"{free}_pattern")
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def repeat_rows(docs: DataFrame, units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    name = "_copies"
    while name in docs.columns:
        name += "_"
    mixed = with_copies(docs, units, id_col, text_col, name=name)
    return mixed.where(F.col(name) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).drop(name)
