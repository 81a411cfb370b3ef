"""Link graphs as edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarium.functions import markdown
from tessarium.lineage import checkpointed

#: Nodes of most links through which paths are told (a bit each), starts of a group in one task, and tasks at most.
HUBS, STARTS, TASKS = 60, 1024, 1000


def edges_of(pages: DataFrame, before: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """src, dst, context of pages (page_id, body): no links in code or to the page itself, each once, with the context of its first place.

    With the edges from before (src, dst, linked_at) also linked_at: theirs, or now for new ones.
    """
    found = pages.select(F.col("page_id").alias("src"), F.posexplode(markdown.links(F.col("body"), F.col("page_id").cast("string"))).alias("pos", "l")).select("src", F.col("l.dst").alias("dst"), "pos", F.col("l.context").alias("context"))
    found = found.groupBy("src", "dst").agg(F.min_by("context", "pos").alias("context"))
    if before is None:
        return found
    return found.join(before.select("src", "dst", "linked_at"), ["src", "dst"], "left").withColumn("linked_at", F.coalesce("linked_at", now))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of edges and of their reverses, each once, in one pass over them."""
    return edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def most_connected(edges: DataFrame, n: int = 10) -> DataFrame:
    return degrees(edges).select("node", (F.col("inbound") + F.col("outbound")).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def outbound(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi")


def inbound(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Edges into any of the seeds; the limit is over all of them, by source then target."""
    return edges.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi").orderBy("src", "dst").limit(limit).select("src", "dst")


def hop_ranking(edges: DataFrame, seeds: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """Targets of the seeds' links that aren't seeds themselves, by number of links and then the newest page; without retired pages, sources and indexes."""
    pages = pages.where(~F.coalesce("status", F.lit("")).isin("deprecated", "archived") & ~F.coalesce("type", F.lit("")).isin("source", "index"))
    targets = outbound(edges, seeds).join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n_links"))
    return targets.join(pages, targets["dst"] == pages["page_id"]).select("dst", "n_links", "modified").orderBy(F.desc("n_links"), F.desc("modified"), "dst").limit(n)


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that nothing links to."""
    return pages.join(edges.select(F.col("dst").alias("page_id")), "page_id", "left_anti")


def broken(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to pages that are missing or retired, with the reason; links from retired pages don't count."""
    known = pages.select("page_id", "status")
    out = edges.join(known.select(F.col("page_id").alias("src"), F.col("status").alias("src_status")), "src", "left").join(known.select(F.col("page_id").alias("dst"), F.col("status").alias("dst_status")), "dst", "left")
    retired = ~F.col("dst_status").isin("active", "stub", "dormant")
    out = out.where(~F.coalesce(F.col("src_status").isin("deprecated", "archived"), F.lit(False)) & (F.col("dst_status").isNull() | retired))
    return out.select("src", "dst", F.when(F.col("dst_status").isNull(), "missing").otherwise(F.col("dst_status")).alias("reason"))


def path_lengths(edges: DataFrame, start, depth: int) -> DataFrame:
    """node, hops: undirected shortest paths from a node up to a depth; a frontier at a time, each written before the next."""
    return _search(edges, start, depth).select("node", "hops")


def _search(edges: DataFrame, start, depth: int, target=None) -> DataFrame:
    """node, hops, before: the smallest neighbour on a shortest path back to the start; ends where nothing new or the target is found."""
    kind = edges.schema["src"].dataType
    both = checkpointed(both_ways(edges))
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("before"))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        frontier = checkpointed(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "before"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    return seen


def path_lengths_many(edges: DataFrame, pairs: DataFrame, depth: int = 32) -> DataFrame:
    """a, b, hops of distinct pairs (a, b): the length of a shortest undirected path of at most depth links, null if there is none or an end is null or has no links."""
    pairs = checkpointed(pairs.select("a", "b").distinct())
    # a struct, as null is an end like others
    group = F.struct("b").alias("group")
    return _lengths(edges, pairs.select("a", group), pairs.select("b", group).distinct(), depth)


def path_lengths_of_groups(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int = 32) -> DataFrame:
    """a, b, hops as path_lengths_many() for all pairs of a start (a, group) and an end (b, group) of a group, each pair once, without a list of the pairs."""
    sides = {}
    for name, rows in (("a", starts), ("b", ends)):
        # a pair that stands in several groups is given in the smallest of them
        mine = F.collect_set("group").over(Window.partitionBy(name))
        rows = rows.select(name, "group").where("group IS NOT NULL").distinct().withColumn("_all", mine)
        sides[name] = checkpointed(rows.select(name, "group", F.filter("_all", lambda g: g < F.col("group")).alias(f"_less_{name}")))
    return _lengths(edges, sides["a"], sides["b"], depth)


def _meeting(a: list[Column], b: list[Column], depth: int) -> Column:
    """The fewest links by way of a hub, from the hubs within 0, 1, ... links of both ends."""
    out = F.lit(None).cast("int")
    for total in reversed(range(min(depth, len(a) + len(b) - 2) + 1)):
        shared = [a[i].bitwiseAND(b[total - i]) for i in range(len(a)) if 0 <= total - i < len(b)]
        out = F.when(reduce(Column.bitwiseOR, shared) != 0, total).otherwise(out)
    return out


def _lengths(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """Of distinct starts and ends (with group, and maybe _less_a and _less_b).

    A shortest path leads through a hub, one of the nodes of most links, or avoids them all. Each node knows the hubs within 0, 1, ... links of it as
    bits, so a pair's length by way of hubs is told from its two ends' bits. What is shorter is found by searching from each start without the hubs, only
    as far as some end of its groups is farther by way of hubs. Bits and what was found stand beside the starts, and pairs are made last: they aren't
    shuffled or written. Work grows with links, starts, nodes near them without hubs, and pairs.
    """
    spark = edges.sparkSession
    both = checkpointed(both_ways(edges.where("src IS NOT NULL AND dst IS NOT NULL")))
    hubs = [r[0] for r in both.where("src <> dst").groupBy("src").count().orderBy(F.desc("count"), "src").limit(HUBS).collect()]
    bits = F.lit(0).cast("long")
    for i, hub in enumerate(hubs):
        bits = F.when(F.col("node") == F.lit(hub), F.lit(1 << i)).otherwise(bits)
    known = checkpointed(both.select(F.col("src").alias("node")).distinct().withColumn("_m0", bits.cast("long")))
    levels = ["_m0"]
    while len(levels) <= depth:
        near = both.join(known.where(F.col(levels[-1]) != 0).select(F.col("node").alias("src"), levels[-1]), "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or(levels[-1]).alias("_near"))
        level = f"_m{len(levels)}"
        more = checkpointed(known.join(near, "node", "left").withColumn(level, F.col(levels[-1]).bitwiseOR(F.coalesce("_near", F.lit(0).cast("long")))).drop("_near"))
        if more.where(F.col(level) != F.col(levels[-1])).isEmpty():
            break
        known, levels = more, [*levels, level]
    # a column for each end's bits
    mine, theirs = ([F.col(f"{m}_{name}") for m in levels] for name in "ab")
    starts, ends = (rows.join(known.select(F.col("node").alias(name), *(F.col(m).alias(f"{m}_{name}") for m in levels)), name, "left") for name, rows in (("a", starts), ("b", ends)))
    starts, ends = checkpointed(starts), checkpointed(ends)
    # how far a start looks without hubs: as far as the hubs that are near all ends of a group leave open
    common = ends.where(theirs[0].isNotNull()).groupBy("group").agg(*(F.bit_and(c).alias(f"{m}_b") for c, m in zip(theirs, levels)))
    wide = F.coalesce(_meeting(mine, theirs, depth) - 1, F.lit(depth))
    last = checkpointed(starts.where((mine[0] == 0)).join(common, "group").groupBy("a").agg(F.max(wide).alias("wide")).where("wide > 0").select("a", F.col("a").alias("node"), "wide"))
    rest = both.where((F.col("src") != F.col("dst")) & ~F.col("src").isin(hubs) & ~F.col("dst").isin(hubs))
    seen, near, moved = last.select("a", "node"), last.select("a", F.col("node").alias("b"), F.lit(0).alias("_hops")), 0
    while moved < depth and not last.isEmpty():
        moved += 1
        reached = last.where(F.col("wide") >= moved).join(rest, F.col("node") == F.col("src")).select("a", F.col("dst").alias("node"), "wide").distinct()
        last = checkpointed(reached.join(seen, ["a", "node"], "left_anti"))
        seen, near = seen.unionByName(last.select("a", "node")), near.unionByName(last.select("a", F.col("node").alias("b"), F.lit(moved).alias("_hops")))
    # what was found of a start's ends, by group
    found = near.join(starts.select("a", "group"), "a").join(ends.select("b", "group"), ["group", "b"]).groupBy("group", "a").agg(F.map_from_entries(F.collect_list(F.struct("b", "_hops"))).alias("_found"))
    # a group's starts are dealt over tasks, each of which meets all ends
    sizes = checkpointed(starts.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / STARTS).cast("int").alias("_n")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sizes.agg(F.sum("_n")).first()[0] or 1, TASKS))
    x = starts.join(found, ["group", "a"], "left").join(sizes, "group").withColumn("_slice", F.pmod(F.xxhash64("a"), F.col("_n")).cast("int")).drop("_n").repartition(tasks, "group", "_slice")
    y = ends.join(sizes, "group").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").repartition(tasks, "group", "_slice")
    pairs = x.join(y.hint("merge"), ["group", "_slice"])
    if "_less_a" in starts.columns:
        pairs = pairs.where((F.size("_less_a") == 0) | (F.size("_less_b") == 0) | ~F.arrays_overlap("_less_a", "_less_b"))
    hops = F.when((F.col("a") == F.col("b")) & mine[0].isNotNull(), 0).otherwise(F.least(_meeting(mine, theirs, depth), F.col("_found")[F.col("b")]))
    return pairs.select("a", "b", hops.alias("hops"))


def path(edges: DataFrame, start, target, depth: int = 32) -> list | None:
    """The nodes of a shortest undirected path, or None; of several the one that goes back by smallest nodes."""
    if start == target:
        known = edges.where((F.col("src") == start) | (F.col("dst") == start))
        return None if known.isEmpty() else [start]
    found = _search(edges, start, depth, target)
    out, at = [], target
    # at most depth lookups, each of one row
    for _ in range(depth + 1):
        row = found.where(F.col("node") == at).select("before").first()
        if row is None:
            return None
        out.append(at)
        if row[0] is None:
            return out[::-1]
        at = row[0]
    return None


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node with the smallest one of its component. Labels fall to the smallest neighbour's, then to that one's label, until none changes."""
    both = checkpointed(both_ways(edges))
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("other"))
        lower = labels.join(near, "node").select("node", F.least("root", "other").alias("via"), F.col("root").alias("old"))
        jumped = lower.join(labels.select(F.col("node").alias("via"), F.col("root").alias("far")), "via", "left")
        new = checkpointed(jumped.select("node", F.least("via", F.coalesce("far", "via")).alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def nested(edges: DataFrame) -> DataFrame:
    """page_id, with sorted lists of its inbound and outbound pages; where edges have linked_at, also the latest one."""
    dated = "linked_at" in edges.columns
    into = edges.groupBy(F.col("dst").alias("page_id")).agg(F.sort_array(F.collect_set("src")).alias("inbound"), *([F.max("linked_at").alias("_i")] if dated else []))
    out = edges.groupBy(F.col("src").alias("page_id")).agg(F.sort_array(F.collect_set("dst")).alias("outbound"), *([F.max("linked_at").alias("_o")] if dated else []))
    both = into.join(out, "page_id", "full_outer")
    return both.withColumn("last_linked_at", F.greatest("_i", "_o")).drop("_i", "_o") if dated else both


def page_links(edges: DataFrame, pages: DataFrame, page_id) -> DataFrame:
    """direction, page_id, title of a page's links both ways; the id stands for a missing title."""
    out = edges.where(F.col("src") == page_id).select(F.lit("outbound").alias("direction"), F.col("dst").alias("page_id"))
    into = edges.where(F.col("dst") == page_id).select(F.lit("inbound").alias("direction"), F.col("src").alias("page_id"))
    return out.unionByName(into).join(pages.select("page_id", "title"), "page_id", "left").select("direction", "page_id", F.coalesce("title", F.col("page_id").cast("string")).alias("title"))


def counted(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages with inbound and outbound counts, 0 for those without links."""
    counts = degrees(edges).withColumnRenamed("node", "page_id")
    return pages.drop("inbound", "outbound").join(counts, "page_id", "left").fillna(0, ["inbound", "outbound"])


def preview(edges: DataFrame, pages: DataFrame, n: int = 3) -> DataFrame:
    """page_id, inbound, shown: titles of the first few pages that link to each, and how many more there are."""
    titled = edges.join(pages.select(F.col("page_id").alias("src"), "title"), "src", "left")
    ranked = titled.selectExpr("dst AS page_id", "src", "title", "row_number() OVER (PARTITION BY dst ORDER BY src) AS n", "count(*) OVER (PARTITION BY dst) AS inbound").where(F.col("n") <= n)
    listed = ranked.groupBy("page_id", "inbound").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", F.coalesce("title", F.col("src").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("shown"))
    return listed.select("page_id", "inbound", F.when(F.col("inbound") > n, F.concat("shown", F.lit(", and "), (F.col("inbound") - n).cast("string"), F.lit(" more"))).otherwise(F.col("shown")).alias("shown"))
