"""Mentions in texts: finding spans, resolving them to pages, inserting links, and what stays open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarium.functions import markdown, names
from tessarium.functions import text as tx
from tessarium.lineage import checkpointed
from tessarium.operators import name_index, search

#: Cosines from which a link counts as high, medium, or pending (fixed values).
HIGH, MEDIUM, PENDING = 0.75, 0.60, 0.50
#: Pages that a span is compared with, and the name's score from which they are (fixed values).
SHORTLIST, NAME_SCORE = 10, 60.0
#: Characters of names that one automaton holds.
AUTOMATON = 1_000_000
#: Texts, the most frequent ones, that are sent to all tasks rather than meet their spans in one; any other is less than one in so many spans.
FREQUENT = 256
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())]))


def bucket(cosine: Column, high: float = HIGH, medium: float = MEDIUM, pending: float = PENDING) -> Column:
    return F.when(cosine >= high, "high").when(cosine >= medium, "medium").when(cosine >= pending, "pending").otherwise("drop")


def alias_table(pages: DataFrame) -> DataFrame:
    """alias, page_id: titles and aliases of active pages (page_id, title, aliases, status, pos) in lower case; of equal ones the last page's counts."""
    names = pages.where("status = 'active'").select("page_id", "pos", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "alias"))
    return names.where("alias IS NOT NULL").groupBy(F.lower("alias").alias("alias")).agg(F.max_by("page_id", F.struct("pos", "n")).alias("page_id"))


def find_by_alias(pages: DataFrame, names: DataFrame) -> DataFrame:
    """name, page_id: for names the first page (by pos) that bears one as its title or alias, whatever its status, without regard to case."""
    held = pages.select("page_id", "pos", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    first = held.groupBy(F.lower("alias").alias("k")).agg(F.min_by("page_id", "pos").alias("page_id"))
    return names.withColumn("k", F.lower("name")).join(first, "k").drop("k")


def gazetteer(pages: DataFrame) -> DataFrame:
    """alias, label: titles and aliases of active pages (title, aliases, status, type); ORG for those of an entity, else CONCEPT."""
    held = pages.where("status = 'active'").select(F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "type")
    return held.where("alias <> ''").groupBy("alias").agg(F.when(F.max(F.col("type") == "entity"), "ORG").otherwise("CONCEPT").alias("label"))


def mentions(pages: DataFrame, aliases: DataFrame, characters: int = AUTOMATON, groups: int | None = None) -> DataFrame:
    """page_id, text, label, start, end: where pages (page_id, body) mention a name (alias, label), without regard to case, from word to word.

    One pass of an automaton over each body finds names of any length; of overlapping ones the longest stays, then the first. Names of at most some
    characters in all, by a sum, are sent to every task, and bodies aren't shuffled. More names are dealt out by their first word, each part with an
    automaton of its own, and a body goes to the parts of its words; groups: tasks among which a part's bodies are dealt. Empty names and bodies
    match nothing; of a name's labels the greatest counts that isn't CONCEPT.
    """
    spark = pages.sparkSession
    label = F.coalesce(F.max(F.when(F.col("label") != "CONCEPT", F.col("label"))), F.lit("CONCEPT"))  # spellings meet in the automaton
    known = aliases.where("alias <> ''").groupBy("alias").agg(label.alias("label"))
    bodies = pages.select("page_id", "body").where("body <> ''")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, spans array<struct<start:int,end:int,label:string,text:string>>"
    total = known.agg(F.sum(F.length("alias"))).first()[0] or 0
    if total <= characters:
        # bounded by the sum
        held, token = spark.sparkContext.broadcast([tuple(r) for r in known.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = names.built(token, held.value)
            for batch in batches:
                yield _spans(batch.column("page_id"), [names.apart(found.find(b)) for b in batch.column("body").to_pylist()])

        spans = bodies.mapInArrow(run, schema)
    else:
        parts = -(-total // max(characters, 1))
        # each group makes its part's automaton again, so the more parts, the fewer groups
        spans = _by_parts(bodies, known, parts, groups or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)), schema)
    return spans.select("page_id", F.explode("spans").alias("x")).select("page_id", "x.text", "x.label", "x.start", "x.end")


def _spans(pages: pa.Array, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pages, pa.array([[dict(zip(("start", "end", "label", "text"), x)) for x in xs] for xs in found], SPANS)], names=["page_id", "spans"])


def _by_parts(bodies: DataFrame, known: DataFrame, parts: int, groups: int, schema: str) -> DataFrame:
    """Spans of names that don't fit one automaton: rows are ordered by part, names before bodies, so that a task holds one part's automaton at a time."""

    @F.pandas_udf("int")
    def part_of(name: pd.Series) -> pd.Series:
        return name.map(lambda x: names.part_of(names.first_word(names.folded(x)), parts))

    @F.pandas_udf("array<int>")
    def parts_of(body: pd.Series) -> pd.Series:
        return body.map(lambda x: names.parts_of(x, parts))

    kind = bodies.schema["page_id"].dataType
    mine = known.select(part_of("alias").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), F.col("alias").alias("text"), "label")
    theirs = bodies.select(F.explode(parts_of("body")).alias("part"), F.pmod(F.xxhash64("page_id"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "page_id", F.col("body").alias("text"), F.lit(None).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], None
        for batch in batches:
            at, out = [], []
            for i, (part, group, which, text, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "group", "kind", "text", "label")))):
                if key != (part, group):
                    key, rows, found = (part, group), [], None
                if which == 0:
                    rows.append((text, label))
                else:
                    found = found or names.Names(rows)
                    at.append(i)
                    out.append(found.find(text))
            yield _spans(batch.column("page_id").take(pa.array(at, pa.int64())), out)

    dealt = mine.unionByName(theirs).repartition(parts * groups, "part", "group").sortWithinPartitions("part", "group", "kind")
    partial = dealt.mapInArrow(run, schema).where(F.size("spans") > 0)

    @F.pandas_udf(partial.schema["spans"].dataType)
    def apart(spans: pd.Series) -> pd.Series:
        return spans.map(lambda xs: [dict(zip(("start", "end", "label", "text"), x)) for x in names.apart([tuple(y[c] for c in ("start", "end", "label", "text")) for y in xs])])

    # a page's spans are bounded by its body
    return partial.groupBy("page_id").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumn("spans", apart("spans"))


def proper_names(pages: DataFrame) -> DataFrame:
    """page_id, text, label, start, end: runs of capitalised words of pages (page_id, body), as concepts: what a finder without a model can tell."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def found(body: pd.Series) -> pd.Series:
        return body.map(lambda b: [{"start": s, "end": e, "text": b[s:e]} for s, e in names.proper_runs(b)] if b else [])

    return pages.select("page_id", F.explode(found("body")).alias("x")).select("page_id", "x.text", F.lit("CONCEPT").alias("label"), "x.start", "x.end")


def candidates(pages: DataFrame, *found: DataFrame) -> DataFrame:
    """Spans of several finders, with pos by their order, for link_all(); without finders those of the pages' own names and of proper_names()."""
    found = found or (mentions(pages, gazetteer(pages)), proper_names(pages))
    return reduce(DataFrame.unionByName, (f.select("page_id", "text", "label", "start", "end").withColumn("pos", F.lit(i)) for i, f in enumerate(found)))


def deduplicated(spans: DataFrame) -> DataFrame:
    """Of spans of the same place one: the first that isn't a mere concept, else the first (by pos)."""
    order = Window.partitionBy("page_id", "start", "end").orderBy(F.col("label") == "CONCEPT", "pos")
    return spans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_safe_place(start: Column, end: Column, zones: Column) -> Column:
    return F.exists(zones, lambda z: (z["s"] <= start) & (end <= z["e"]))


def linkable(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans that may become links: outside code, links, headings and the like, and no stop words; stub pages have none. They carry their context."""
    zones = pages.where(F.coalesce("status", F.lit("active")) != "stub").select("page_id", "body", markdown.safe_ranges("body").alias("zones"))
    # one shuffle by page serves places and pages
    found = deduplicated(spans.repartition("page_id")).join(zones, "page_id").where(in_safe_place(F.col("start"), F.col("end"), F.col("zones")))
    plain = F.trim(F.lower("text"))
    return found.where(~plain.isin(*tx.LINK_STOP_WORDS) & (plain != "")).withColumn("context", context(F.col("body"), F.col("start"), F.col("end"))).drop("body", "zones")


def shortlist(texts: DataFrame, aliases: DataFrame, k: int = SHORTLIST, least: float = NAME_SCORE) -> DataFrame:
    """text, page_id, score, rank: of distinct texts (text) the k pages whose best alias (alias, page_id) is most similar, as whole numbers."""
    # the k * 3 best aliases are looked at
    near = name_index.nearest_names(texts.select(F.trim(F.lower("text")).alias("a")), aliases.select(F.trim(F.lower("alias")).alias("b")), k * search.OVERSHOOT, least)
    best = near.join(aliases.select(F.trim(F.lower("alias")).alias("b"), "page_id").distinct(), "b").groupBy(F.col("a").alias("text"), "page_id").agg(F.max("score").alias("score"))
    return best.selectExpr("*", "row_number() OVER (PARTITION BY text ORDER BY score DESC, page_id) AS rank").where(F.col("rank") <= k)


def resolved(spans: DataFrame, aliases: DataFrame, vectors: DataFrame, embed, k: int = SHORTLIST, least: float = NAME_SCORE) -> DataFrame:
    """Spans with target, score, method and cosine: of a name's own page, else of the shortlisted page whose vector (page_id, v) is nearest to that of the
    span's context; embed makes a vector column from a text column. Spans without such a page stay, without target.

    Distinct texts are resolved once, each text's shortlist being an array of at most k pages with their vectors; vectors are made of shortlisted pages only.
    The most frequent texts are sent to their spans, so that no task has all spans of a text; spans of others are shuffled to theirs.
    """
    spans = spans.withColumn("k", F.trim(F.lower("text")))
    own = checkpointed(spans.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(aliases.select(F.col("alias").alias("k"), F.col("page_id").alias("own")), "k", "left"))
    near = checkpointed(shortlist(own.where("own IS NULL").select(F.col("k").alias("text")), aliases, k, least).select(F.col("text").alias("k"), F.col("page_id").alias("target"), "score", "rank"))
    vectors = vectors.select(F.col("page_id").alias("target"), "v").join(near.select("target").distinct(), "target", "left_semi")
    listed = near.join(vectors, "target").groupBy("k").agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("rank", "target", "score", "v", tx.norm(F.col("v")).alias("v_norm")))).alias("near"))
    texts = checkpointed(own.join(listed.where(F.size("near") > 0), "k", "left"))
    frequent = checkpointed(texts.orderBy(F.desc("n"), "k").limit(FREQUENT).drop("n"))
    found = spans.join(F.broadcast(frequent), "k")
    if texts.count() > FREQUENT:
        few = F.broadcast(frequent.select("k"))
        found = found.unionByName(spans.join(few, "k", "left_anti").join(texts.drop("n").join(few, "k", "left_anti"), "k"))
    found = found.withColumn("q", F.when(F.col("near").isNotNull(), embed(F.col("context"))))
    size = F.col("q_norm")

    def scored(x: Column) -> Column:
        cosine = tx.dot(x["v"], F.col("q")) / (x["v_norm"] * size + 1e-12)
        return F.struct(cosine.alias("cosine"), (-x["rank"]).alias("order"), x["target"].alias("target"), x["score"].alias("score"))

    found = found.withColumn("q_norm", tx.norm(F.col("q"))).withColumn("best", F.array_max(F.transform("near", scored)))
    is_own = F.col("own").isNotNull()
    return found.select(
        "page_id", "text", "label", "start", "end", "pos", F.coalesce("own", F.col("best")["target"]).alias("target"), F.when(is_own, F.lit(100)).otherwise(F.col("best")["score"]).alias("score"),
        F.when(is_own, "exact").when(F.col("best").isNotNull(), "hybrid").alias("method"), F.when(~is_own, F.col("best")["cosine"]).alias("cosine"),
    )


def decided(spans: DataFrame, high: float = HIGH, medium: float = MEDIUM, pending: float = PENDING) -> DataFrame:
    """Resolved spans with their bucket and action: link (the first high or medium one of a target in a page), pending, self, again (its target is linked
    before), or open. A text that is handled anywhere in a page isn't open elsewhere in it."""
    level = F.when(F.col("method") == "exact", "high").when(F.col("target").isNull(), "drop").otherwise(bucket(F.col("cosine"), high, medium, pending))
    # all windows are by page and something else
    spans = spans.withColumn("bucket", level).repartition("page_id")
    first = F.min(F.when(F.col("bucket").isin("high", "medium"), F.struct("start", "pos"))).over(Window.partitionBy("page_id", "target"))
    here = F.struct("start", "pos")
    action = (
        F.when(F.col("target").isNull(), "open")
        .when(F.col("target") == F.col("page_id"), "self")
        .when(here == first, "link")
        .when(here > first, "again")
        .when(F.col("bucket") == "pending", "pending")
        .otherwise("open")
    )
    spans = spans.withColumn("action", action)
    handled = F.max(F.col("action") != "open").over(Window.partitionBy("page_id", F.lower("text")))
    return spans.withColumn("action", F.when((F.col("action") == "open") & handled, "handled").otherwise(F.col("action")))


def link_all(pages: DataFrame, spans: DataFrame | None, aliases: DataFrame, vectors: DataFrame, embed, high: float = HIGH, medium: float = MEDIUM, pending: float = PENDING, least: float = NAME_SCORE) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, body, status) with links put in, and all decided spans; spans have page_id, text, label, start, end, pos, and are those of
    candidates() if None is given, for which pages need title, aliases and type too."""
    spans = candidates(pages) if spans is None else spans
    # written once each: spans serve texts and places, names texts and shortlists, decisions serve bodies and whatever the caller makes of them
    found = checkpointed(decided(resolved(checkpointed(linkable(spans, pages)), checkpointed(aliases), vectors, embed, least=least), high, medium, pending))
    links = found.where("action = 'link'").groupBy("page_id").agg(F.collect_list(F.struct("start", "end", "target")).alias("_spans"))
    body = F.when(F.col("_spans").isNotNull(), insert_links(F.col("body"), F.col("_spans"))).otherwise(F.col("body"))
    return pages.join(links, "page_id", "left").withColumn("body", body).drop("_spans"), found


def pending_links(found: DataFrame, now: Column) -> DataFrame:
    """Rows of the list of links to be reviewed."""
    return found.where("action = 'pending'").select(F.col("page_id").alias("source_page"), F.col("text").alias("matched_text"), F.col("target").alias("candidate_page_id"), "score", "label", F.round("cosine", 4).alias("cosine_score"), now.alias("added_at"))


def pending_filtered(items: DataFrame, least: float) -> DataFrame:
    """Pending links from a cosine on; those without one stay."""
    return items.where(F.col("cosine_score").isNull() | (F.col("cosine_score") >= least))


def apply_pending(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages with accepted links at the first place of their text, in the list's order (pos)."""
    mine = items.groupBy(F.col("source_page").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("matched_text", F.lit("")).alias("m"), F.coalesce("candidate_page_id", F.lit("")).alias("c")))).alias("_items"))
    body = F.aggregate(F.coalesce("_items", F.array().cast("array<struct<pos:bigint,m:string,c:string>>")), F.col("body"), lambda text, i: tx.with_pending_link(text, i["m"], i["c"]))
    return pages.join(mine, "page_id", "left").withColumn("body", body).drop("_items")


def stubs(found: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Stub pages for texts that nothing resolves: one per slug (the first in order), unless the page exists."""
    # each text's first place, then each slug's, so that a frequent text is made a slug once
    first = F.min(F.struct("page_id", "start", "pos", "label")).alias("at")
    open_ = found.where("action = 'open'").groupBy("text").agg(first).withColumn("slug", tx.slug(F.col("text"))).where("slug <> ''")
    open_ = open_.groupBy("slug").agg(F.min_by(F.struct("text", "at.label"), "at").alias("x")).select("slug", "x.text", "x.label")
    kind = F.when(F.col("label").isin("PERSON", "ORG", "GPE", "PRODUCT"), "entity").otherwise("concept")
    new = open_.select(F.concat(tx.directory_of(kind), F.lit("/"), "slug").alias("page_id"), F.col("text").alias("title"), kind.alias("type"), F.lit("stub").alias("status"), F.concat(F.lit("Stub page for "), "text", F.lit(".")).alias("summary"), F.array(F.lower("text")).alias("aliases"), F.lit("low").alias("confidence"), F.concat(F.lit("# "), "text", F.lit("\n\n*Stub — awaiting content.*\n")).alias("body"), now.alias("created"))
    return new.join(pages.select("page_id"), "page_id", "left_anti")


def exact(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    """spans (span_id, text) with the page of the same name, without regard to case; of several the smallest."""
    names = aliases.select(F.lower(F.trim("alias")).alias("k"), "page_id").groupBy("k").agg(F.min("page_id").alias("page_id"))
    return spans.withColumn("k", F.lower(F.trim("text"))).join(names, "k").drop("k")


def fuzzy(spans: DataFrame, aliases: DataFrame, k: int = SHORTLIST, least: float = NAME_SCORE) -> DataFrame:
    """span_id, page_id, score, rank: the k pages whose best alias is most similar to each span (span_id, text)."""
    ranked = shortlist(spans, aliases, k, least)
    return spans.withColumn("text", F.trim(F.lower("text"))).join(ranked, "text").select("span_id", "page_id", "score", "rank")


def first_mentions(spans: DataFrame) -> DataFrame:
    """Of each target in a page the first mention."""
    order = Window.partitionBy("page_id", "target").orderBy("start", "end")
    return spans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged_ranges(ranges: Column) -> Column:
    """Overlapping ranges of an array of struct(s, e) as one, in order: a range begins where no earlier one reaches; each step looks at one number."""
    ordered = F.sort_array(ranges)
    reach = F.aggregate(ordered, F.struct(F.array().cast("array<int>").alias("all"), F.lit(None).cast("int").alias("top")), lambda a, r: F.struct(F.concat(a["all"], F.array(a["top"])).alias("all"), F.greatest(a["top"], r["e"]).alias("top")), lambda a: F.concat(a["all"], F.array(a["top"])))
    marked = F.struct(ordered.alias("r"), reach.alias("t"))

    def islands(x: Column) -> Column:
        # places of ranges that begin an island, and one past the last
        begins = F.filter(F.transform(x["r"], lambda r, i: F.when(F.get(x["t"], i).isNull() | (r["s"] > F.get(x["t"], i)), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(x["r"])))
        return F.zip_with(begins, ends, lambda i, j: F.struct(F.get(x["r"], i)["s"].alias("s"), F.get(x["t"], j).alias("e")))

    # a one-element array binds the sorted ranges to a name, so that they're made once
    return F.when(F.size(ranges) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(F.get(F.transform(F.array(marked), islands), F.lit(0)))


def free_ranges(merged: Column, length: Column) -> Column:
    """The gaps between merged ranges, up to a length."""
    zero, end = F.array(F.lit(0)), F.array(length)
    starts = F.concat(zero, F.transform(merged, lambda r: r["e"]))
    ends = F.concat(F.transform(merged, lambda r: r["s"]), end)
    return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))), lambda r: r["s"] < r["e"])


def insert_links(body: Column, spans: Column) -> Column:
    """Links for spans (start, end, target) put in from back to front; offsets are code points."""
    latest_first = F.reverse(F.sort_array(spans))

    def put(text: Column, s: Column) -> Column:
        shown = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.substring(text, F.lit(1), s["start"]), F.lit("[["), s["target"], F.lit("|"), shown, F.lit("]]"), F.substring(text, s["end"] + 1, F.length(text)))

    return F.aggregate(latest_first, body, put)


def context(body: Column, start: Column, end: Column, width: int = 200) -> Column:
    at = F.greatest(F.lit(0), start - width)
    return F.substring(body, at + 1, end + width - at)
