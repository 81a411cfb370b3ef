"""Quality checks of a page collection; each gives rows (check, page_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.functions import text as tx
from tessarium.operators import links

#: Days after which an active page counts as dormant, by type (fixed values).
WINDOWS = {"entity": 180, "concept": 120, "synthesis": 60}
DEFAULT_WINDOW = 90


def age_days(now: Column, moment: Column) -> Column:
    """Whole days gone by (not calendar days)."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400)


def window_days(kind: Column, own: Column) -> Column:
    """A page's own window, or its type's if the page has none or zero."""
    by_type = F.lit(DEFAULT_WINDOW)
    for name, days in WINDOWS.items():
        by_type = F.when(kind == name, days).otherwise(by_type)
    return F.coalesce(F.nullif(own, F.lit(0)), by_type)


def dormant(pages: DataFrame, now: Column) -> DataFrame:
    """Active pages older than their window, with age and window."""
    out = pages.withColumns({"age": age_days(now, F.col("modified")), "window": window_days(F.col("type"), F.col("dormant_window"))})
    return out.where((F.col("status") == "active") & (F.col("age") > F.col("window")))


def oldest_dormant(pages: DataFrame, now: Column, n: int) -> DataFrame:
    return dormant(pages, now).orderBy(F.desc("age"), "page_id").limit(n)


def stale(pages: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Active pages not modified for more than some days, counted with fractions, the oldest first."""
    late = (now.cast("double") - F.col("modified").cast("double")) / 86400 > days
    return pages.where((F.col("status") == "active") & late).orderBy("modified", "page_id")


def stale_by_window(pages: DataFrame, now: Column) -> DataFrame:
    """Active pages whose whole days exceed their own window, whatever their type."""
    return pages.where((F.col("status") == "active") & (age_days(now, F.col("modified")) > F.col("dormant_window")))


def missing_fields(pages: DataFrame, required: list[str]) -> DataFrame:
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), c) for c in required)))
    return pages.select("page_id", lacking.alias("missing")).where(F.size("missing") > 0)


def index_drift(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Symmetric difference of two sets of page_id."""
    a, b = stored.select("page_id").distinct().withColumn("stored", F.lit(True)), listed.select("page_id").distinct().withColumn("listed", F.lit(True))
    both = a.join(b, "page_id", "full_outer").where("stored IS NULL OR listed IS NULL")
    return both.select("page_id", F.when(F.col("stored").isNull(), "not stored").otherwise("not listed").alias("drift"))


def sub_index_drift(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Folders (folder, name) whose index lists other pages than are there; a folder without index has drifted."""
    a, b = (frame.select("folder", "name").distinct().withColumn(s, F.lit(True)) for frame, s in ((stored, "_s"), (listed, "_l")))
    return a.join(b, ["folder", "name"], "full_outer").where("_s IS NULL OR _l IS NULL").select("folder").distinct()


def contradictions(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.inline("contradictions"))


def contradiction_ranking(pages: DataFrame) -> DataFrame:
    """page_id, title, type, n: pages with contradictions, those with most first."""
    return pages.where(F.size("contradictions") > 0).select("page_id", "title", "type", F.size("contradictions").alias("n")).orderBy(F.desc("n"), "page_id")


def orphan_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that nothing links to; deprecated ones, sources and indexes aside."""
    return links.orphans(pages, edges).where(~F.coalesce("type", F.lit("")).isin("source", "index") & (F.coalesce("status", F.lit("")) != "deprecated"))


def promoted(pages: DataFrame) -> DataFrame:
    """Pages that an update of a missing page made, deprecated ones aside."""
    return pages.where((F.coalesce("status", F.lit("")) != "deprecated") & F.coalesce("promoted", F.lit(False)))


#: Findings that ask for a fix, and those that are only tracked.
WARNINGS = ("broken link", "duplicate", "missing field", "index drift", "contradiction")
TRACKED = ("orphan", "dormant", "stub", "promoted")


def run_all(pages: DataFrame, edges: DataFrame, now: Column, required: list[str], pairs: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """All nine checks as one tall table (check, page_id, detail, target; target is a broken link's, else null): broken links, duplicates, missing fields, index drift, contradictions, orphans, dormant
    pages, stubs, pages promoted by an update. pairs are suggestions of duplicates (winner, loser, safe), drift folders; contradictions and
    promoted need their columns."""

    def rows(check: str, frame: DataFrame, page: str, detail: Column, target: Column = F.lit(None)) -> DataFrame:
        return frame.select(F.lit(check).alias("check"), F.col(page).cast("string").alias("page_id"), detail.cast("string").alias("detail"), target.cast("string").alias("target"))

    found = [
        rows("broken link", links.broken(edges, pages), "src", F.concat_ws(" ", F.col("dst").cast("string"), "reason"), F.col("dst")),
        rows("orphan", orphan_pages(pages, edges), "page_id", F.lit("")),
        rows("dormant", dormant(pages, now), "page_id", F.col("age")),
        rows("missing field", missing_fields(pages, required), "page_id", F.array_join("missing", ",")),
        rows("stub", pages.where("status = 'stub'"), "page_id", F.lit("")),
    ]
    if pairs is not None:
        found.append(rows("duplicate", pairs, "loser", F.concat_ws(" ", F.col("winner").cast("string"), F.when(F.col("safe"), "safe").otherwise("review"))))
    if drift is not None:
        found.append(rows("index drift", drift, "folder", F.lit("")))
    if "contradictions" in pages.columns:
        found.append(rows("contradiction", pages.select("page_id", F.explode("contradictions").alias("c")), "page_id", F.to_json("c")))
    if "promoted" in pages.columns:
        found.append(rows("promoted", promoted(pages), "page_id", F.lit("")))
    return reduce(DataFrame.union, found)


def totals(report: DataFrame) -> DataFrame:
    """Findings by check, and whether they're only tracked."""
    return report.groupBy("check").agg(F.count(F.lit(1)).alias("n")).withColumn("tracked_only", F.col("check").isin(*TRACKED))


def health(report: DataFrame) -> DataFrame:
    """One row: warnings, tracked findings, duplicates that can be merged without asking, and whether there are no warnings."""
    safe = F.count_if((F.col("check") == "duplicate") & F.col("detail").endswith(" safe"))
    out = report.agg(F.count_if(F.col("check").isin(*WARNINGS)).alias("warnings"), F.count_if(F.col("check").isin(*TRACKED)).alias("tracked"), safe.alias("safe_merges"))
    return out.withColumn("healthy", F.col("warnings") == 0)


def fix_all(pages: DataFrame, report: DataFrame, human: DataFrame, now: Column) -> DataFrame:
    """Pages with broken links of a report (run_all()) stripped and missing titles, types, states and dates filled in, and what was done: fix is links, header, both,
    skipped (the page is a person's: page_id of human) or null. Dormant pages, duplicates and contradictions are left to the user."""
    broken = report.where("check = 'broken link'").select("page_id", F.col("target").alias("dst")).distinct().groupBy("page_id").agg(F.sort_array(F.collect_list("dst")).alias("_dst"))
    lacking = report.where("check = 'missing field'").select("page_id", F.lit(True).alias("_lacks")).distinct()
    mine = human.select(F.col("page_id").cast("string").alias("page_id"), F.lit(True).alias("_human")).distinct()
    kind = pages.schema["page_id"].dataType
    out = pages
    for frame in (broken, lacking, mine):
        out = out.join(frame.withColumn("page_id", F.col("page_id").cast(kind)), "page_id", "left")
    free = F.col("_human").isNull()
    body = F.when(free & F.col("_dst").isNotNull(), F.aggregate(F.coalesce("_dst", F.array().cast("array<string>")), F.col("body"), tx.strip_link)).otherwise(F.col("body"))
    blank = lambda c: free & F.col("_lacks") & (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    name = F.initcap(F.replace(F.regexp_replace(F.col("page_id").cast("string"), "^.*/", ""), F.lit("-"), F.lit(" ")))
    filled = {"title": name, "type": tx.type_of(F.col("page_id").cast("string")), "status": F.lit("active"), "created": now, "modified": now}
    mended = F.lit(False)
    for c in filled:
        if c in pages.columns:
            mended = mended | F.coalesce(blank(c), F.lit(False))
    stripped = free & (body != F.col("body"))
    out = out.withColumns({"_stripped": F.coalesce(stripped, F.lit(False)), "_mended": mended, "_new": body})
    out = out.withColumns({c: F.when(blank(c), v.cast(pages.schema[c].dataType)).otherwise(F.col(c)) for c, v in filled.items() if c in pages.columns})
    skipped = ~free & (F.col("_dst").isNotNull() | F.col("_lacks"))
    fix = F.when(F.col("_stripped") & F.col("_mended"), "both").when(F.col("_stripped"), "links").when(F.col("_mended"), "header").when(skipped, "skipped")
    return out.withColumns({"body": F.col("_new"), "fix": fix}).drop("_dst", "_lacks", "_human", "_stripped", "_mended", "_new")
