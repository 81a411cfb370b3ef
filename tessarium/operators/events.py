"""Event logs: parsing, costs, and their commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^## \[([^\]]+)\] (\S+) \| (.+)$"
FIELD = r"^- \*\*([^*]+)\*\*: (.+)$"
#: Fields of an entry, as they stand in the log (fixed values), and the columns they become.
FIELDS = {"Created": "created", "Updated": "updated", "Deprecated": "deprecated", "Contradictions": "contradictions", "Links inserted": "links", "Tokens used": "tokens_used", "Cost": "cost", "Commit": "commit"}


def parsed(lines: DataFrame) -> DataFrame:
    """Events of a text log (file, pos, line), the newest first: a header line starts an event, field lines belong to the last header; of a repeated
    field the last one counts. Blocks are numbered within their file; pos is that of the header."""
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum(F.col("line").rlike(HEADER).cast("int")).over(order)).where("block > 0")
    name, value = F.trim(F.regexp_extract("line", FIELD, 1)), F.trim(F.regexp_extract("line", FIELD, 2))
    last = (F.max_by(F.when(name == said, value), F.when(name == said, F.col("pos"))).alias(column) for said, column in FIELDS.items())
    out = blocks.groupBy("file", "block").agg(F.max(F.when(F.col("line").rlike(HEADER), F.col("line"))).alias("head"), F.min("pos").alias("pos"), *last)
    number = lambda c: F.regexp_replace(c, "[$,]", "")
    typed = {"tokens_used": number("tokens_used").try_cast("long"), "cost": number("cost").try_cast("double"), "contradictions": F.col("contradictions").try_cast("int"), "links": F.col("links").try_cast("int")}
    head = [F.try_to_timestamp(F.regexp_extract("head", HEADER, 1)).alias("ts"), F.regexp_extract("head", HEADER, 2).alias("event_type"), F.trim(F.regexp_extract("head", HEADER, 3)).alias("description")]
    return out.withColumns(typed).select("file", "block", "pos", *head, *FIELDS.values()).orderBy("file", F.desc("block"))


def usage(events: DataFrame) -> DataFrame:
    """Tokens, cost and number by type; only types that cost anything."""
    return events.groupBy("event_type").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.count(F.lit(1)).alias("n")).where("tokens > 0 OR cost > 0")


def usage_rollup(events: DataFrame) -> DataFrame:
    return events.rollup("event_type").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.count(F.lit(1)).alias("n"))


def month_to_date(events: DataFrame) -> DataFrame:
    """Spending by month, and the running sum of each day in its month."""
    daily = events.groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.sum("cost").alias("cost"))
    run = F.expr("sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY day)")
    return daily.select("day", F.round("cost", 4).alias("cost"), F.round(run, 4).alias("to_date"))


def month_total(events: DataFrame, now: Column) -> DataFrame:
    """One row: what events cost in the month of a moment."""
    return events.where(F.date_trunc("month", F.col("ts")) == F.date_trunc("month", now)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def same_beginning(a: Column, b: Column) -> Column:
    """Whether the shorter of two descriptions begins the other, dots at their ends aside; not if one is empty."""
    x, y = (F.rtrim(F.rtrim(c, F.lit("."))) for c in (a, b))
    n = F.least(F.length(x), F.length(y))
    return (n > 0) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))


def nearest_commit(events: DataFrame, commits: DataFrame, seconds: int = 300) -> DataFrame:
    """event_id, hash, gap: of commits with the event's key the nearest in time, less than some seconds away; ties to the smaller hash. Where both sides have a
    description, one must begin the other.

    Times fall into buckets of that width, so each event meets three buckets of its key and no other rows.
    """
    described = "description" in events.columns and "description" in commits.columns
    a = events.withColumn("t", F.unix_timestamp("ts")).withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.unix_timestamp("ts") / seconds) + d)))
    b = commits.select("key", F.unix_timestamp("ts").alias("u"), "hash", *([F.col("description").alias("said")] if described else [])).withColumn("bucket", F.floor(F.col("u") / seconds))
    near = a.join(b, ["key", "bucket"]).withColumn("gap", F.abs(F.col("t") - F.col("u"))).where(F.col("gap") < seconds)
    if described:
        near = near.where(same_beginning(F.col("description"), F.col("said")))
    return near.groupBy("event_id").agg(F.min_by("hash", F.struct("gap", "hash")).alias("hash"), F.min("gap").alias("gap"))


def with_commits(events: DataFrame, commits: DataFrame, seconds: int = 300) -> DataFrame:
    """Events (event_id, event_type, description, ts, commit) that lack their commit get it from commits (hash, ts, message) whose subject begins with the event's type."""
    subject = F.substring_index("message", "\n", 1)
    typed = commits.where(F.instr(subject, ": ") > 0).select(F.substring_index(subject, ": ", 1).alias("key"), F.regexp_replace(subject, "^[^:]*: ", "").alias("description"), "ts", "hash")
    bare = events.where(F.coalesce("commit", F.lit("")) == "").withColumn("key", F.col("event_type"))
    found = nearest_commit(bare.select("event_id", "key", "description", "ts"), typed, seconds).select("event_id", F.col("hash").alias("_hash"))
    return events.join(found, "event_id", "left").withColumn("commit", F.coalesce(F.nullif("commit", F.lit("")), "_hash")).drop("_hash")
