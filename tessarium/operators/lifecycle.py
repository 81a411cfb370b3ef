"""Changes to page tables: keyed updates, merges, proposals, protection, deletions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarium.functions import text as tx
from tessarium.lineage import checkpointed
from tessarium.operators import duplicates, links

#: Commits that the engine itself makes; a page last touched by another one was edited by a person (fixed values).
AUTOMATIC = ("ingest", "query", "lint", "merge", "deprecate", "migration", "dormant")
#: Similarity of names from which a new page is taken for an existing one (fixed value).
COLLISION = 95.0
_SOURCES = "array<struct<hash:string,name:string,raw_path:string,url:string,chunk_ids:array<string>>>"


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in new give way to new's rows; the rest stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def set_by_key(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """A column's new values by key (the last of each by pos); rows without one keep theirs."""
    last = new.groupBy(key).agg(F.max_by(column, "pos").alias("_new"))
    return old.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def latest(rows: DataFrame, key: str, moment: str) -> DataFrame:
    """The latest row of each key, whole; of equally late ones the greatest."""
    others = [c for c in rows.columns if c not in (key, moment)]
    return rows.groupBy(key).agg(F.max(F.struct(moment, *others)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rows.columns if c != key))


def new_sources(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sources whose content the catalog lacks, each content once (the row of smallest id, whole)."""
    fresh = sources.join(catalog.select("content_hash"), "content_hash", "left_anti")
    others = [c for c in fresh.columns if c not in ("content_hash", "source_id")]
    return fresh.groupBy("content_hash").agg(F.min(F.struct("source_id", *others)).alias("_r")).select("content_hash", "_r.*")


def catalog_upsert(catalog: DataFrame, ingests: DataFrame) -> DataFrame:
    """Counters and the union of pages, by content hash."""
    both = catalog.unionByName(ingests)
    pages = F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages"))))
    return both.groupBy("content_hash").agg(F.sum("ingest_count").alias("ingest_count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), pages.alias("pages"))


def manifest_upsert(manifest: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """page_id, title, aliases, created, modified: new entries replace old ones, but keep the day they were created; aliases once, whatever their case."""
    new = entries.groupBy("page_id").agg(F.max(F.struct("pos", "title", "aliases")).alias("e"))
    out = manifest.join(new, "page_id", "full_outer")
    there = F.col("e").isNotNull()
    aliases = united(F.coalesce(F.when(there, F.col("e.aliases")).otherwise(F.col("aliases")), F.array().cast("array<string>")))
    return out.select("page_id", F.when(there, F.col("e.title")).otherwise(F.col("title")).alias("title"), aliases.alias("aliases"), F.coalesce("created", now).alias("created"), F.when(there, now).otherwise(F.col("modified")).alias("modified"))


def united(strings: Column) -> Column:
    """Strings in order, each once without regard to case."""
    return F.filter(strings, lambda x, i: ~F.exists(F.slice(strings, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def alias_union(pairs: DataFrame) -> DataFrame:
    """page_id, aliases: of (page_id, pos, alias) the first spelling of each alias, in order, without regard to case."""
    first = pairs.groupBy("page_id", F.lower("alias").alias("_l")).agg(F.min(F.struct("pos", "alias")).alias("x"))
    return first.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["alias"]).alias("aliases"))


def source_key(hash_: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(hash_, F.lit("")), F.lower(name))


def source_union(sources: DataFrame) -> DataFrame:
    """Sources of (page_id, pos, hash, name, chunk_ids, and others): one per hash (or name without a hash), as it first stands, with all chunk ids in order."""
    others = [c for c in sources.columns if c not in ("page_id", "pos", "chunk_ids")]
    key = source_key(F.col("hash"), F.col("name"))
    listed = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_ids"))), lambda x: x["chunk_ids"])))
    out = sources.groupBy("page_id", key.alias("key")).agg(F.min(F.struct("pos", *others)).alias("_s"), listed.alias("chunk_ids"))
    return out.select("page_id", "key", *(F.col(f"_s.{c}").alias(c) for c in others), F.filter("chunk_ids", lambda c: c.isNotNull() & (c != "")).alias("chunk_ids"))


def united_sources(sources: Column) -> Column:
    """An array of sources, one per hash or name in order, with all chunk ids of equals."""
    key = lambda s: source_key(s["hash"], s["name"])
    ids = lambda s: F.coalesce(s["chunk_ids"], F.array().cast("array<string>"))
    first = F.filter(sources, lambda s, i: ~F.exists(F.slice(sources, F.lit(1), i), lambda t: key(t) == key(s)))
    return F.transform(first, lambda s: s.withField("chunk_ids", F.array_distinct(F.flatten(F.transform(F.filter(sources, lambda t: key(t) == key(s)), ids)))))


def deprecate(pages: DataFrame, retired: DataFrame, now: Column | None = None) -> DataFrame:
    """Pages of retired (page_id, superseded_by) become deprecated; other pages keep their own superseded_by, and where now is given their modified."""
    old = pages if "superseded_by" in pages.columns else pages.withColumn("superseded_by", F.lit(None).cast("string"))
    gone = retired.groupBy("page_id").agg(F.max("superseded_by").alias("_by"), F.lit(True).alias("_gone"))
    out = old.join(gone, "page_id", "left").withColumns({"status": F.when(F.col("_gone"), "deprecated").otherwise(F.col("status")), "superseded_by": F.when(F.col("_gone"), F.col("_by")).otherwise(F.col("superseded_by"))})
    if now is not None:
        out = out.withColumn("modified", F.when(F.col("_gone"), now).otherwise(F.col("modified")))
    return out.drop("_by", "_gone")


def archive_name(page_id: Column) -> Column:
    return F.concat(F.replace(page_id, F.lit("/"), F.lit("__")), F.lit(".md"))


def merge_plan(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """loser, winner for pairs: chains end at their last winner. Raises if a page is merged with itself, into two, in a circle, if one is missing, or if
    a loser isn't active."""
    known = pages.select("page_id", "status")
    pairs = pairs.select("winner", "loser").distinct()
    seen = pairs.join(known.select(F.col("page_id").alias("loser"), F.col("status").alias("ls")), "loser", "left").join(known.select(F.col("page_id").alias("winner"), F.lit(True).alias("w")), "winner", "left")
    doubled = seen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("loser")))
    fault = F.when(F.col("winner") == F.col("loser"), "a page can't be merged with itself").when(F.col("w").isNull(), "the winner is missing").when(F.col("ls").isNull(), "the loser is missing").when(F.col("ls") != "active", "the loser isn't active").when(F.col("n") > 1, "the loser has two winners")
    bad = doubled.select("winner", "loser", fault.alias("fault")).where("fault IS NOT NULL").first()
    if bad:
        raise ValueError(f"{bad.loser} into {bad.winner}: {bad.fault}")
    ends = checkpointed(pairs)
    # each round doubles the length of the chains that are followed; a longer one than all pairs make is a circle
    for _ in range(ends.count().bit_length() + 1):
        on = ends.select(F.col("loser").alias("winner"), F.col("winner").alias("next"))
        if ends.join(on, "winner", "left_semi").isEmpty():
            return ends
        ends = checkpointed(ends.join(on, "winner", "left").select("loser", F.coalesce("next", "winner").alias("winner")))
    raise ValueError("pages are merged in a circle")


def merge(pages: DataFrame, pairs: DataFrame, now: Column | None = None) -> DataFrame:
    """pages after merging losers into winners (winner, loser); see merge_plan() for what is refused.

    A winner gets each loser's body under a heading, its title and aliases as aliases, its sources and their chunk ids, and the sum of the counts; the
    losers are deprecated. Links to a loser lead to its winner, in all pages that aren't retired. Columns: page_id, title, body, status, and where
    present aliases, sources, source_count, modified.
    """
    plan = merge_plan(pages, pairs)
    has = set(pages.columns)
    none = F.array().cast("array<string>")
    parts = {
        "body": F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", ""),
        "names": F.concat(F.coalesce("aliases", none) if "aliases" in has else none, F.array("title")),
        **({"sources": F.coalesce("sources", F.array().cast(_SOURCES))} if "sources" in has else {}),
        **({"count": F.coalesce("source_count", F.lit(0)).cast("long")} if "source_count" in has else {}),
    }
    losing = plan.join(pages.select(F.col("page_id").alias("loser"), "title", *(v.alias(f"_{k}") for k, v in parts.items())), "loser")
    added = losing.groupBy(F.col("winner").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("loser", "title", *(f"_{k}" for k in parts)))).alias("_in"))
    out = pages.join(added, "page_id", "left")
    won = F.col("_in").isNotNull()
    piece = lambda x: F.when(x["_body"] != "", F.concat(F.lit("\n\n<!-- merged from page: "), x["title"], F.lit(' -->\n## Merged content from "'), x["title"], F.lit('"\n\n'), x["_body"])).otherwise("")
    new = {"body": F.concat(F.regexp_replace("body", r"(?U)\s+$", ""), F.array_join(F.transform("_in", piece), ""), F.lit("\n"))}
    if "aliases" in has:
        new["aliases"] = united(F.concat(F.coalesce("aliases", none), F.flatten(F.transform("_in", lambda x: x["_names"]))))
    if "sources" in has:
        new["sources"] = united_sources(F.concat(F.coalesce("sources", F.array().cast(_SOURCES)), F.flatten(F.transform("_in", lambda x: x["_sources"]))))
    if "source_count" in has:
        new["source_count"] = F.coalesce("source_count", F.lit(0)) + F.aggregate("_in", F.lit(0).cast("long"), lambda n, x: n + x["_count"])
    if now is not None and "modified" in has:
        new["modified"] = now
    out = out.withColumns({c: F.when(won, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_in")
    out = redirected(out, plan)
    return deprecate(out, plan.select(F.col("loser").alias("page_id"), F.col("winner").alias("superseded_by")), now)


def redirected(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Links to losers lead to their winners (loser, winner); retired pages stay as they are."""
    live = ~F.col("status").isin("deprecated", "archived")
    linked = pages.where(live).select("page_id", F.explode(F.array_distinct(tx.wikilinks(F.col("body")))).alias("loser")).join(moves.select("winner", "loser"), "loser")
    mine = linked.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("loser", "winner"))).alias("_moves"))
    body = F.aggregate(F.coalesce("_moves", F.array().cast("array<struct<loser:string,winner:string>>")), F.col("body"), lambda text, m: tx.retarget_links(text, m["loser"], m["winner"]))
    return pages.join(mine, "page_id", "left").withColumn("body", body).drop("_moves")


def first_proposals(proposals: DataFrame) -> DataFrame:
    """The first proposal of each (type, slug) in chunk order."""
    order = Window.partitionBy("type", "slug").orderBy("chunk_index", "pos")
    return proposals.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def routed(proposals: DataFrame, page_ids: DataFrame, threshold: float = COLLISION) -> DataFrame:
    """New pages (type, slug, chunk_index, pos) with redirect: the existing page (page_id), or an earlier proposal's, whose id is nearly the same; null
    for new ones and for a page's own id. The first proposal of each type and slug counts.

    Existing ids are compared by a join. What proposals make of each other depends on their order, but only near ids matter to each other: each
    connected component of the proposals' own near ids is folded by itself, and whatever has no such neighbour isn't grouped at all.
    """
    first = first_proposals(proposals).withColumn("folder", tx.directory_of(F.col("type"))).withColumn("id", F.when(F.col("slug") != "", F.concat("folder", F.lit("/"), "slug")))
    # written once: ids serve both comparisons and the result
    first = checkpointed(first)
    ids = first.where("id IS NOT NULL").select(F.col("id").alias("a")).distinct()

    def near(others: DataFrame) -> DataFrame:
        return duplicates.similar_texts(ids, others, threshold).where(F.substring_index("a", "/", 1) == F.substring_index("b", "/", 1))

    known = near(page_ids.select(F.col("page_id").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b").alias("page_id"))).alias("k"))
    known = known.select("id", (-F.col("k.s")).alias("score"), F.col("k.page_id").alias("known"))
    pairs = checkpointed(near(ids.select(F.col("a").alias("b"))).where("a <> b"))
    roots = links.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), "root")
    beside = pairs.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct(F.col("b").alias("other"), F.col("score").alias("s"))).alias("near"))
    rows = first.join(known, "id", "left").join(roots.join(beside, "id"), "id", "left")
    columns = [c for c in first.columns if c not in ("folder", "id")]
    kinds = ", ".join(f"`{c}` {first.schema[c].dataType.simpleString()}" for c in columns)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, int] = {}
        out = []
        pdf = pdf.sort_values(["chunk_index", "pos"])
        for id_, near, known, score in zip(pdf["id"], pdf["near"], pdf["known"], pdf["score"]):
            best, at = (score, known) if isinstance(known, str) else (0.0, None)
            for other in sorted((x for x in near if x["other"] in made), key=lambda x: made[x["other"]]):
                if other["s"] > best:
                    best, at = other["s"], other["other"]
            hit = at if at is not None and at != id_ else None
            out.append(hit)
            if hit is None:
                made[id_] = len(made)
        return pdf[columns].assign(redirect=out)

    alone = rows.where("root IS NULL").select(*columns, F.when(F.col("known") != F.col("id"), F.col("known")).alias("redirect"))
    return alone.unionByName(rows.where("root IS NOT NULL").groupBy("root").applyInPandas(fold, f"{kinds}, redirect string"))


def create_id(kind: Column, slug: Column, title: Column) -> Column:
    """The id of a proposed page; null for an unknown type."""
    return F.concat(tx.directory_of(kind), F.lit("/"), F.coalesce(F.nullif(tx.slug(slug), F.lit("")), F.nullif(tx.slug(title), F.lit("")), F.lit("untitled")))


def write_pages(pages: DataFrame, proposals: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """pages (page_id, title, type, status, summary, body, confidence, created, modified, promoted) after proposals (pos, intent, type, slug, title, path,
    body, confidence), and outcome: created, updated, skipped, or null for pages that none concerns.

    Creates come first, in order. A create of an existing page is skipped, or with force replaces what is below the marker. Updates are appended
    there; the first one of a missing page makes it, with a title from its id, and marks it as promoted. An update wakes a dormant page.
    """
    id_ = F.when(F.col("intent") == "create", create_id(F.col("type"), F.col("slug"), F.col("title"))).otherwise(tx.page_id_of(F.coalesce("path", F.lit(""))))
    asked = proposals.withColumn("page_id", id_).where("page_id IS NOT NULL AND page_id <> ''")
    # a missing page's update makes the page of its directory's type
    known = pages.select("page_id").unionByName(asked.where("intent = 'create'").select("page_id")).distinct()
    asked = asked.join(known.withColumn("_known", F.lit(True)), "page_id", "left")
    kind = tx.type_of(F.col("page_id"))
    moved = F.when(F.col("_known") | (F.col("intent") == "create"), F.col("page_id")).otherwise(create_id(kind, F.regexp_replace("page_id", "^[^/]*/", ""), F.lit("")))
    asked = asked.withColumn("page_id", moved).where("page_id IS NOT NULL")
    row = F.struct("pos", "type", "title", F.coalesce("body", F.lit("")).alias("body"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium")).alias("confidence"))
    grouped = asked.groupBy("page_id").agg(F.sort_array(F.collect_list(F.when(F.col("intent") == "create", row))).alias("_c"), F.sort_array(F.collect_list(F.when(F.col("intent") != "create", row))).alias("_u"))
    out = pages.join(grouped, "page_id", "full_outer")
    there, n_c, n_u = F.col("status").isNotNull(), F.coalesce(F.size("_c"), F.lit(0)), F.coalesce(F.size("_u"), F.lit(0))
    made = ~there & (n_c > 0)
    promoted = ~there & (n_c <= 0) & (n_u > 0)
    replaced = there & (n_c > 0) if force else F.lit(False)
    first, last = F.get("_c", F.lit(0)), F.element_at("_c", -1)
    page = last if force else first
    base = F.when(made, tx.marked(first["body"])).when(promoted, tx.marked(F.get("_u", F.lit(0))["body"])).otherwise(F.col("body"))
    if force:
        rest = F.when(made, F.slice("_c", F.lit(2), F.greatest(n_c, F.lit(1)))).otherwise(F.coalesce("_c", F.expr("slice(_c, 1, 0)")))
        base = F.when(n_c > 0, F.aggregate(rest, base, lambda body, c: tx.joined_parts(tx.human_part(body), c["body"]))).otherwise(base)
    more = F.when(promoted, F.slice("_u", F.lit(2), F.greatest(n_u, F.lit(1)))).otherwise(F.col("_u"))

    def append(body: Column, u: Column) -> Column:
        auto = tx.auto_part(body)
        joined = F.concat(F.regexp_replace(auto, r"(?U)\s+$", ""), F.lit("\n\n"), F.regexp_replace(u["body"], r"(?U)^\s+", ""))
        return tx.joined_parts(tx.human_part(body), F.when(auto != "", joined).otherwise(u["body"]))

    body = F.when(n_u > 0, F.aggregate(more, base, append)).otherwise(base)
    fresh = made | replaced
    slug = F.regexp_replace("page_id", "^[^/]*/", "")
    text = F.when(fresh, tx.first_prose(page["body"])).when(promoted, tx.first_prose(F.get("_u", F.lit(0))["body"])).otherwise(F.col("summary"))
    touched = fresh | promoted | (there & (n_u > 0))
    return out.select(
        "page_id",
        F.when(fresh, page["title"]).when(promoted, F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))).otherwise(F.col("title")).alias("title"),
        F.when(fresh, page["type"]).when(promoted, tx.type_of(F.col("page_id"))).otherwise(F.col("type")).alias("type"),
        F.when(fresh | promoted, "active").when((F.col("status") == "dormant") & (n_u > 0), "active").otherwise(F.col("status")).alias("status"),
        text.alias("summary"), body.alias("body"),
        F.when(fresh, page["confidence"]).when(promoted, "medium").otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("created", now).alias("created"), F.when(touched, now).otherwise(F.col("modified")).alias("modified"),
        F.when(promoted, True).when(fresh, False).otherwise(F.coalesce("promoted", F.lit(False))).alias("promoted"),
        F.when(made | promoted, "created").when(replaced | (there & (n_u > 0)), "updated").when(n_c > 0, "skipped").alias("outcome"),
    )


def source_pages(sources: DataFrame) -> DataFrame:
    """source_id, page_id of sources (source_id, name, content_hash): the slug of the file's name without suffix, with a counter from 2 where different
    contents share it, in order of source_id; equal contents share a page."""
    stem = F.coalesce(F.nullif(tx.slug(F.regexp_replace("name", r"\.[^.]*$", "")), F.lit("")), F.lit("source"))
    first = sources.withColumn("slug", stem).groupBy("slug", "content_hash").agg(F.min("source_id").alias("source_id"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("source_id")))
    page = F.concat(F.lit("sources/"), "slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""))
    return sources.withColumn("slug", stem).join(ranked.select("slug", "content_hash", page.alias("page_id")), ["slug", "content_hash"]).select("source_id", "page_id")


def appended_source(sources: Column, source: Column, chunk_ids: Column) -> Column:
    """A page's sources with one more, or with more chunk ids of the one that has its hash (or, without a hash, its name)."""
    new = source.withField("chunk_ids", chunk_ids)
    return united_sources(F.concat(F.coalesce(sources, F.array().cast(_SOURCES)), F.array(new)))


def added_contradictions(old: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(old, new), F.coalesce(new, old))


def chunk_owner(writes: DataFrame) -> DataFrame:
    """chunk_id, page_id: the page that a chunk fed last (chunk_id, page_id, pos)."""
    return writes.groupBy("chunk_id").agg(F.max(F.struct("pos", "page_id")).alias("x")).select("chunk_id", F.col("x.page_id").alias("page_id"))


def set_status(pages: DataFrame, keys: DataFrame, status: str, only: str | None = None) -> DataFrame:
    """Another status for pages of some keys; with only, for those of one status."""
    out = pages.join(keys.select("page_id").distinct().withColumn("_hit", F.lit(True)), "page_id", "left")
    hit = F.col("_hit") if only is None else F.col("_hit") & (F.col("status") == only)
    return out.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_hit")


def purge(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Deletes deprecated pages of the given keys; others stay."""
    return pages.join(keys.select("page_id", F.lit("deprecated").alias("status")), ["page_id", "status"], "left_anti")


def human_edited(commits: DataFrame) -> DataFrame:
    """page_id, commit_type, human of commits (page_id, ts, message): whether the latest one isn't the engine's own."""
    last = latest(commits.select("page_id", "ts", "message"), "page_id", "ts")
    kind = tx.commit_type(F.col("message"))
    return last.select("page_id", kind.alias("commit_type"), (~kind.isin(*AUTOMATIC)).alias("human"))


def protection_drift(pages: DataFrame, commits: DataFrame) -> DataFrame:
    """page_id, says, truth, commit_type of pages (page_id, human_edited) whose flag differs from their history; pages without history don't."""
    both = pages.select("page_id", F.coalesce("human_edited", F.lit(False)).alias("says")).join(human_edited(commits), "page_id")
    return both.where("says <> human").select("page_id", "says", F.col("human").alias("truth"), "commit_type")


def protected(pages: DataFrame, commits: DataFrame) -> DataFrame:
    """Pages with their flags set by their history."""
    drift = protection_drift(pages, commits).select("page_id", "truth")
    return pages.join(drift, "page_id", "left").withColumn("human_edited", F.coalesce("truth", "human_edited")).drop("truth")


def saved(pages: DataFrame, before: DataFrame, now: Column) -> DataFrame:
    """Edited pages (page_id, body, status, human_edited) as saved over those before (page_id, body): newly modified, no longer dormant, and flagged if
    the human region changed or the page is new."""
    old = before.select("page_id", tx.human_part(F.col("body")).alias("_old"))
    out = pages.join(old, "page_id", "left")
    human = F.col("_old").isNull() | (F.col("_old") != tx.human_part(F.col("body")))
    return out.withColumns({"human_edited": human | F.coalesce("human_edited", F.lit(False)), "freshened": F.col("status") == "dormant", "status": F.when(F.col("status") == "dormant", "active").otherwise(F.col("status")), "modified": now}).drop("_old")


def answer_page(history: DataFrame, now: Column) -> DataFrame:
    """Saved answers (question, answer, confidence, sources) as pages."""
    slug = F.coalesce(F.nullif(F.substring(tx.slug(F.col("question")), 1, 60), F.lit("")), F.lit("query-answer"))
    return history.select(F.concat(F.lit("syntheses/"), slug).alias("page_id"), F.col("question").alias("title"), F.lit("synthesis").alias("type"), F.lit("active").alias("status"), F.replace(F.substring("answer", 1, 160), F.lit("\n"), F.lit(" ")).alias("summary"), F.col("answer").alias("body"), F.coalesce("confidence", F.lit("medium")).alias("confidence"), F.size(F.coalesce("sources", F.array().cast("array<string>"))).alias("source_count"), now.alias("created"))


def kept_history(history: DataFrame, n: int, group: str, *order) -> DataFrame:
    """The newest n rows of each group."""
    return history.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n") <= n)


def history_entry(history: DataFrame, asked: str) -> DataFrame:
    """The row that an id's beginning or a number from 1 (the newest) means; none if several begin so. A number reads the newest rows up to it, each task its own;
    a beginning at most two rows."""
    if asked.isdigit():
        n = int(asked)
        newest = history.orderBy(F.desc("ts"), "query_id").limit(n)
        # the last of the newest n; none if there are fewer
        return newest.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("_n") == n).drop("_n").orderBy("ts", F.desc("query_id")).limit(1) if n else history.limit(0)
    two = history.where(F.col("query_id").startswith(asked)).limit(2)
    return two.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("_n = 1").drop("_n")


def fed_chunks(writes: DataFrame) -> DataFrame:
    """page_id, chunk_ids: all chunks that creates, updates and sources (page_id, pos, chunk_ids) feed to a page, each once, in order."""
    each = writes.select("page_id", "pos", F.posexplode("chunk_ids").alias("i", "chunk_id")).where("chunk_id IS NOT NULL AND chunk_id <> ''")
    first = each.groupBy("page_id", "chunk_id").agg(F.min(F.struct("pos", "i")).alias("at"))
    return first.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


def touched(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, paths: of each commit (hash, paths) the paths that are among those wanted (path), in order; commits without one are left out."""
    each = commits.select("hash", F.explode(F.array_distinct("paths")).alias("path")).join(wanted.select("path").distinct(), "path", "left_semi")
    return each.groupBy("hash").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def chunk_status(chunks: DataFrame) -> DataFrame:
    """source, total, pending (indexes in order), complete: how far the chunks (source, chunk_index, done) of each ingest have come."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.when(~F.col("done"), F.col("chunk_index")))).alias("pending"), F.bool_and("done").alias("complete"))
