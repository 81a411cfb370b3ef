"""Reports over a collection: state, links, costs, synthesis runs, answers, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarium.functions import text as tx
from tessarium.operators import checks, links

#: Folders of the root index, in order, with titles and descriptions (fixed values).
CATEGORIES = (
    ("entities", "Entities", "People, organizations, tools, projects."),
    ("concepts", "Concepts", "Ideas, methods, patterns, principles."),
    ("sources", "Sources", "Summaries of ingested raw documents."),
    ("syntheses", "Syntheses", "Cross-cutting analyses and comparisons."),
    ("decisions", "Decisions", "Decision records with rationale."),
)
PAGE_TYPES, CONFIDENCES, RELEVANCES = ("entity", "concept", "synthesis", "decision"), ("high", "medium", "low"), ("primary", "supporting", "tangential")


def live_pages(pages: DataFrame) -> DataFrame:
    """Pages that a model is told of: all but deprecated ones."""
    return pages.where(F.coalesce("status", F.lit("active")) != "deprecated")


def statistics(pages: DataFrame, edges: DataFrame, chunks: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One row: pages, by state, edited by people, aliases, links, orphans, and of chunks and sources (source_hash), if given, how many there are; each counted in
    one pass over its table."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = pages.agg(F.count(F.lit(1)).alias("pages"), *map(is_, ("active", "stub", "dormant", "deprecated")), F.count_if("human_edited").alias("human_edited"), F.sum(F.size(F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"))
    # each side is one row
    one = lambda frame, name: F.broadcast(frame.agg(F.count(F.lit(1)).alias(name)))
    out = counts.join(one(edges, "links")).join(one(checks.orphan_pages(pages, edges), "orphans"))
    if chunks is not None:
        out = out.join(one(chunks, "chunks"))
    return out if sources is None else out.join(one(sources.select("source_hash").distinct(), "sources"))


def link_summary(edges: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: links, linked pages, pending links and the band of their cosines."""
    ends = edges.select(F.col("src").alias("p")).unionByName(edges.select(F.col("dst").alias("p")))
    band = pending.agg(F.count(F.lit(1)).alias("pending"), F.min("cosine_score").alias("least"), F.max("cosine_score").alias("most"))
    # one row each
    return band.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("links")))).join(F.broadcast(ends.agg(F.count_distinct("p").alias("linked"))))


def pending_by_page(pending: DataFrame, n: int = 5) -> DataFrame:
    return pending.where(F.coalesce("source_page", F.lit("")) != "").groupBy("source_page").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_page").limit(n)


def stub_ranking(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs by how many pages link to them."""
    counts = edges.groupBy(F.col("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    return pages.where("status = 'stub'").join(counts, "page_id", "left").withColumn("inbound", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.desc("inbound"), "page_id")


def recent_pages(pages: DataFrame, n: int = 100) -> DataFrame:
    """The rows that a model sees of a collection: the newest pages, deprecated ones aside, with clipped summaries, as lines of a Markdown table."""
    newest = live_pages(pages).orderBy(F.desc_nulls_last("modified"), "page_id").limit(n)
    cells = [F.col("page_id").cast("string"), F.col("type"), F.replace("title", F.lit("|"), F.lit("\\|")), tx.clipped(tx.escaped(F.coalesce("summary", F.lit(""))), 80)]
    return newest.select("page_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def sub_indexes(pages: DataFrame) -> DataFrame:
    """folder, n, body of each folder's index: its pages, the newest first, then by name."""
    rows = pages.withColumn("folder", F.substring_index("page_id", "/", 1)).withColumn("name", tx.slug_part(F.col("page_id")))
    day = F.coalesce(F.date_format("modified", "yyyy-MM-dd"), F.lit(""))
    line = F.concat(F.lit("| ["), tx.escaped(F.coalesce(F.nullif("title", F.lit("")), "name")), F.lit("]("), "name", F.lit(".md) | "), tx.escaped(F.coalesce("summary", F.lit(""))), F.lit(" | "), day, F.lit(" | "), F.coalesce("source_count", F.lit(0)).cast("string"), F.lit(" | "), F.coalesce("inbound", F.lit(0)).cast("string"), F.lit(" |"))
    listed = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce(F.unix_timestamp("modified"), F.lit(0))).alias("t"), "name", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("# "), F.initcap("folder"), F.lit(" Index ("), F.col("n").cast("string"), F.lit(" pages)\n\n| Page | Summary | Modified | Sources | Links |\n|------|---------|----------|---------|-------|\n"))
    return listed.select("folder", "n", F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("body"))


def category_counts(pages: DataFrame) -> DataFrame:
    """pos, folder, title, n of the fixed folders, with 0 for empty ones."""
    counts = pages.groupBy(F.substring_index("page_id", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    fixed = pages.sparkSession.createDataFrame([(i, f, t, d) for i, (f, t, d) in enumerate(CATEGORIES)], "pos int, folder string, title string, description string")
    return fixed.join(counts, "folder", "left").select("pos", "folder", "title", "description", F.coalesce("n", F.lit(0)).alias("n"))


def root_index(pages: DataFrame) -> DataFrame:
    """One row: the body of the root index."""
    part = F.concat(F.lit("## "), "title", F.lit(" ("), F.col("n").cast("string"), F.lit(" pages)\n"), "description", F.lit("\n→ See ["), "folder", F.lit("/index.md]("), "folder", F.lit("/index.md)\n"))
    listed = category_counts(pages).agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("x"))
    return listed.select(F.concat(F.lit("# Wiki Index\n\n"), F.array_join(F.transform("x", lambda x: x["part"]), "\n")).alias("body"))


def rebuilt_indexes(pages: DataFrame, report: DataFrame) -> DataFrame:
    """name, body: the index files of folders that drifted in a report (checks.run_all()), and the root index if any did."""
    drifted = report.where("check = 'index drift'").select(F.col("page_id").alias("folder")).distinct()
    each = sub_indexes(pages).join(drifted, "folder", "left_semi").select(F.concat("folder", F.lit("/index.md")).alias("name"), "body")
    # at most one row
    root = root_index(pages).join(F.broadcast(drifted.limit(1)), how="left_semi").select(F.lit("index.md").alias("name"), "body")
    return each.unionByName(root)


def outcomes(runs: DataFrame) -> DataFrame:
    """outcome, n, created, updated, tokens, cost of a batch (error, chunks_failed and counters): complete, partial or failed."""
    kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("chunks_failed") > 0, "partial").otherwise("complete")
    total = lambda c: F.sum(F.when(F.col("error").isNull(), F.col(c)).otherwise(0)).alias(c)
    return runs.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), *map(total, ("created", "updated", "tokens", "cost")))


def synthesis_totals(results: DataFrame) -> DataFrame:
    """One row over chunks (tokens_in, tokens_out, cost, error, entities, concepts): sums of those that worked, numbers, sorted names."""
    ok = F.col("error").isNull()
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(ok, F.col(c)))))).alias(c)
    sums = (F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cost"))
    return results.agg(*sums, F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), names("entities"), names("concepts"))


def over_budget(tokens: DataFrame, price_in: float, price_out: float, budget: float) -> DataFrame:
    """One row: estimated cost of chunks (tokens), half as many tokens coming out as going in, and whether it exceeds a budget (none at 0)."""
    into = F.coalesce(F.sum(F.greatest(F.lit(1), "tokens")), F.lit(0))
    out = tokens.agg(into.alias("tokens_in")).withColumn("tokens_out", F.greatest(F.lit(1), F.floor(F.col("tokens_in") / 2)))
    cost = F.col("tokens_in") * price_in + F.col("tokens_out") * price_out
    return out.withColumn("cost", cost).withColumn("refused", (F.lit(budget) > 0) & (F.col("cost") > budget))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, tokens_in, tokens_out) with their cost by prices (model, price_in, price_out); 0 for unknown models."""
    out = calls.join(prices, "model", "left")
    return out.withColumn("cost", F.coalesce(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out"), F.lit(0.0))).drop("price_in", "price_out")


def budget_share(usage: DataFrame, budget: float) -> DataFrame:
    """One row over usage by type (tokens, cost, n): totals and the percentage of a budget, 0 without one."""
    out = usage.agg(F.sum("n").alias("events"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return out.withColumn("percent", F.col("cost") / budget * 100 if budget > 0 else F.lit(0.0))


def provenance(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """chunk_id, source_name, origin: of chunks (chunk_id, source_hash) the source's name and its file, else its address, else a dash."""
    out = chunks.join(catalog.select(F.col("content_hash").alias("source_hash"), "name", "raw_path", "url"), "source_hash", "left")
    return out.select("chunk_id", F.coalesce("name", F.lit("<unknown source>")).alias("source_name"), F.coalesce(F.nullif("raw_path", F.lit("")), F.nullif("url", F.lit("")), F.lit("—")).alias("origin"))


def consulted(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Consulted pages (query_id, page_id, relevance) with title and the name of the first named source."""
    named = F.get(F.filter(F.transform("sources", lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.lit(0))
    about = pages.select("page_id", "title", named.alias("source"), F.when(F.col("status") != "active", F.col("status")).alias("state"))
    return answers.join(about, "page_id", "left").select("query_id", "page_id", "relevance", F.coalesce("title", F.col("page_id").cast("string")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), "state")


def rejected(sources: DataFrame, max_mb: float, least_chars: int) -> DataFrame:
    """source_id, reason: sources (source_id, kind, bytes, text) that are too large, or give too little text; images and code may."""
    large = (F.lit(max_mb) > 0) & (F.col("bytes") / (1024 * 1024) > max_mb)
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    reason = F.when(large, "too large").when(~F.col("kind").isin("image", "code") & (F.length(bare) < least_chars), "empty")
    return sources.select("source_id", reason.alias("reason")).where("reason IS NOT NULL")


def _kind(path: str, payload: str = "payload") -> Column:
    """The kind of a JSON value: OBJECT, ARRAY, STRING and so on; null if it's missing."""
    return F.expr(f"try_variant_get(v, '{path}', 'variant')")


def answer_errors(answers: DataFrame) -> DataFrame:
    """query_id, errors of answers (query_id, payload as JSON text): missing fields, and values that aren't allowed."""
    v = answers.withColumn("v", F.try_parse_json("payload"))
    schema = lambda path: F.schema_of_variant(_kind(path))
    there = lambda path: _kind(path).isNotNull()
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    missing = F.array_compact(F.array(*(F.when(~there(f"$.{n}"), f"missing required field: {n}") for n in ("answer", "sources_consulted", "confidence"))))
    sources = F.from_json(F.to_json(_kind("$.sources_consulted")), "array<map<string,string>>")

    def of_source(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("sources_consulted["), i.cast("string"), F.lit("]"))
        relevance = F.try_element_at(s, F.lit("relevance"))
        return F.array_compact(F.array(
            F.when(s.isNull(), F.concat(at, F.lit(" must be an object"))),
            F.when(s.isNotNull() & F.try_element_at(s, F.lit("page_path")).isNull(), F.concat(at, F.lit(".page_path missing"))),
            F.when(s.isNotNull() & relevance.isNull(), F.concat(at, F.lit(".relevance missing"))).when(~relevance.isin(*RELEVANCES), F.concat(at, F.lit(".relevance invalid: '"), relevance, F.lit("'"))),
        ))

    confidence = F.expr("try_variant_get(v, '$.confidence', 'string')")
    wrong = F.concat(
        F.array_compact(F.array(F.when(schema("$.answer") != "STRING", "answer must be a string"), F.when(~schema("$.sources_consulted").startswith("ARRAY"), "sources_consulted must be an array"))),
        F.coalesce(F.flatten(F.transform(sources, of_source)), F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(~F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)), F.concat(F.lit("confidence invalid: '"), F.coalesce(confidence, F.lit("")), F.lit("'"))))),
    )
    errors = F.when(~is_object, F.array(F.lit("response must be a JSON object"))).when(F.size(missing) > 0, missing).otherwise(wrong)
    return v.select("query_id", errors.alias("errors"))


def proposal_errors(proposals: DataFrame) -> DataFrame:
    """pos, errors of proposed pages (pos, intent, type, slug, title, path, body, confidence): missing fields and values that aren't allowed."""
    need = lambda c, name: F.when(F.col(c).isNull(), f"{name} missing")
    create = F.array(need("type", "type"), need("slug", "suggested_slug"), need("title", "title"), need("body", "content_markdown"), need("confidence", "confidence"), F.when(~F.col("type").isin(*PAGE_TYPES), F.concat(F.lit("type invalid: '"), "type", F.lit("'"))), F.when(~F.col("confidence").isin(*CONFIDENCES), F.concat(F.lit("confidence invalid: '"), "confidence", F.lit("'"))))
    update = F.array(need("path", "existing_path"), need("body", "additions_markdown"))
    return proposals.select("pos", F.when(F.col("intent") == "create", F.array_compact(create)).otherwise(F.array_compact(update)).alias("errors"))


def event_lines(events: DataFrame, *carried: str) -> DataFrame:
    """ts, entry: events (ts, event_type, description, created, updated, deprecated, contradictions, links, tokens, cost, commit) as entries of the text log, with columns
    that tell events of the same moment apart."""
    names = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"- **{label}**: "), F.array_join(c, ", ")))
    lines = [
        F.concat(F.lit("## ["), tx.utc_iso(F.col("ts")), F.lit("] "), "event_type", F.lit(" | "), "description"), names("created", "Created"), names("updated", "Updated"), names("deprecated", "Deprecated"),
        F.when(F.col("contradictions") > 0, F.concat(F.lit("- **Contradictions**: "), F.col("contradictions").cast("string"))), F.when(F.col("links") > 0, F.concat(F.lit("- **Links inserted**: "), F.col("links").cast("string"))),
        F.when(F.col("tokens") > 0, F.concat(F.lit("- **Tokens used**: "), F.format_number("tokens", 0))), F.when(F.col("cost") > 0, F.concat(F.lit("- **Cost**: $"), F.format_string("%.2f", F.col("cost").cast("double")))),
        F.when(F.coalesce("commit", F.lit("")) != "", F.concat(F.lit("- **Commit**: "), F.substring("commit", 1, 8))),
    ]
    return events.select("ts", *carried, F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("entry"))


def changed_paths(commits: DataFrame, since: Column) -> DataFrame:
    """Paths of commits (path, ts) after a moment, each once, in order."""
    return commits.where(F.col("ts") > since).select("path").distinct().orderBy("path")


def history_of(commits: DataFrame, path: str) -> DataFrame:
    """A path's commits (path, ts, hash, author, message), the newest first, with their types."""
    return commits.where(F.col("path") == path).withColumn("commit_type", tx.commit_type(F.col("message"))).orderBy(F.desc("ts"), "hash")


def recent(rows: DataFrame, n: int, moment: str = "ts", *ties: str) -> DataFrame:
    """The newest rows, for logs, edits and histories."""
    return rows.orderBy(F.desc(moment), *ties).limit(n)


def human_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    return recent(commits.where(F.col("message").startswith("human-edit:")), n, "ts", "hash")


def linked_counts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return links.counted(pages, edges)


def first_source_name(sources: Column) -> Column:
    return F.get(F.filter(F.transform(sources, lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.lit(0))


def ordered(frame: DataFrame, *columns) -> DataFrame:
    """Rows numbered in an order, so that it survives later shuffles."""
    return frame.withColumn("pos", F.row_number().over(Window.orderBy(*columns)))
