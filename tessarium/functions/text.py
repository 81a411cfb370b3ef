"""Text functions, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never make a search term (fixed values).
SEARCH_STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its may me might my no not of on "
    "or our shall she should so some such than that the their them then there these they this to us was we were what when where which who will with would you your"
).split()
#: Words that are never linked, even if a page bears them as its title (fixed values).
LINK_STOP_WORDS = (
    "the a an and or but if then else data model system method approach result results paper study work use used using way case type value values time thing things "
    "part parts example note section figure table chapter this that these those some any all also such more less most least is are was were be been being have has had do does did"
).split()
#: Stands between a page's human and its generated region; set it to the marker of a collection that has another one.
AUTO_MARKER = "<!-- generated -->"
#: Directories of page types (fixed values).
DIRECTORIES = {"entity": "entities", "concept": "concepts", "synthesis": "syntheses", "decision": "decisions", "source": "sources"}
#: Characters of a context before a link, and around a mention.
LINK_CONTEXT, MENTION_CONTEXT = 60, 200


def chunk_id(source_hash: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source_hash, index.cast("string")), 256), 1, 12)


def query_id(moment: Column, question: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", moment, question), 256), 1, 10)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens; Unicode letters stay."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Words of a document: ASCII letters folded, everything beyond ASCII kept as it is."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), "")


def query_phrases(text: Column) -> Column:
    """What a question searches for, with repeats; any of them matches. White space separates; other characters than letters, digits, hyphens and
    underscores are dropped; stop words go. A word whose inner hyphens or underscores part it is a phrase of neighbouring words, joined by spaces."""
    raw = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_-]", "")))
    kept = F.filter(raw, lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, SEARCH_STOP_WORDS)), w))
    return F.filter(F.transform(kept, lambda w: F.array_join(tokens(w), " ")), lambda p: p != "")


def snippet(text: Column, width: int = 200) -> Column:
    """White space collapsed; longer texts cut and marked by an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…")))


def summary(text: Column, width: int = 120) -> Column:
    """At most width characters, ending after a whole word, without punctuation at the end; a text without such a word is cut."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, 1, width), r"(?s) [^ ]*$", ""), r"[.,;:!?]+$", "")
    return F.when(F.length(text) <= width, text).when(cut != "", F.concat(cut, F.lit("…"))).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def first_heading(text: Column) -> Column:
    found = F.transform(F.split(text, "\n"), lambda line: F.regexp_extract(line, r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", 1))
    return F.get(F.filter(found, lambda h: h != ""), F.lit(0))


def sections(text: Column) -> Column:
    """Parts that begin with a heading of level one or two."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,2}\s+)"), lambda part: F.regexp_replace(part, r"(?U)^\s+|\s+$", "")), lambda part: part != "")


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]] links, wherever they stand; see markdown.links for those outside code."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]+)?\]\]"), F.lit(1)), F.trim)


def quoted(text: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def replacement(text: Column) -> Column:
    """A text as it is, in place of a match."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def strip_link(text: Column, target: Column) -> Column:
    """A broken link gives way to what it shows, or to its target."""
    shown = F.regexp_replace(text, F.concat(F.lit(r"\[\[\s*"), quoted(target), F.lit(r"\s*\|\s*([^\]\n]*[^\]\s]|)\s*\]\]")), F.lit("$1"))
    return F.regexp_replace(shown, F.concat(F.lit(r"\[\[\s*"), quoted(target), F.lit(r"\s*\]\]")), replacement(target))


def retarget_links(text: Column, old: Column, new: Column) -> Column:
    """Links to one page lead to another; what they show stays."""
    pattern = F.concat(F.lit(r"\[\["), quoted(old), F.lit(r"(\|[^\]]*)?\]\]"))
    return F.regexp_replace(text, pattern, F.concat(F.lit("[["), replacement(new), F.lit("$1]]")))


def bound(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often use refers to it: as the variable of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_bag(text: Column) -> Column:
    """Eight counts of characters by code point modulo 8, scaled to length one: an embedding for tests."""
    # ASCII characters become digits, which whole strings count; a text with others is taken apart
    digits = F.translate(F.lower(text), "".join(map(chr, range(1, 128))), "".join(str(c % 8) for c in range(1, 128)))
    usual = bound(digits, lambda s: F.transform(F.array(*(F.lit(str(d)) for d in range(8))), lambda d: (F.length(s) - F.length(F.replace(s, d, F.lit("")))).cast("double")))
    slots = F.transform(F.array_remove(F.split(F.lower(text), ""), ""), lambda c: F.ascii(c) % 8)
    counts = bound(slots, lambda found: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.size(F.filter(found, lambda s: s == d)).cast("double")))
    return scaled(F.when(digits.rlike("^[0-7]*$"), usual).otherwise(counts))


def scaled(vector: Column) -> Column:
    return bound(vector, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def is_plural(a: Column, b: Column) -> Column:
    """Whether one of two names is the other's plural: +s, +es, or y to ies."""

    def one(x: Column, y: Column) -> Column:
        return (y == F.concat(x, F.lit("s"))) | (y == F.concat(x, F.lit("es"))) | (x.endswith("y") & (y == F.concat(x.substr(F.lit(1), F.length(x) - 1), F.lit("ies"))))

    return one(a, b) | one(b, a)


def name_tokens(name: Column) -> Column:
    return F.array_remove(F.split(name, "-"), "")


def drops_token(a: Column, b: Column) -> Column:
    """Whether the longer of two hyphenated names is the other with one more token."""
    x, y = name_tokens(a), name_tokens(b)
    short, long = F.when(F.size(x) < F.size(y), x).otherwise(y), F.when(F.size(x) < F.size(y), y).otherwise(x)
    without = F.exists(F.sequence(F.lit(1), F.greatest(F.size(long), F.lit(1))), lambda i: F.array_join(F.concat(F.slice(long, F.lit(1), i - 1), F.slice(long, i + 1, F.size(long))), "-") == F.array_join(short, "-"))
    return (F.abs(F.size(x) - F.size(y)) == 1) & without


def commit_type(message: Column) -> Column:
    """What stands before the colon of a commit's first line."""
    subject = F.substring_index(message, "\n", 1)
    return F.when(F.instr(subject, ":") > 0, F.trim(F.substring_index(subject, ":", 1))).otherwise("unknown")


def ingest_stats(created: Column, updated: Column, links: Column) -> Column:
    """What a commit's subject says of an ingest, without zeros."""

    def part(n: Column, before: str, unit: str) -> Column:
        return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise("")))

    inner = F.concat_ws(", ", part(created, "+", "page"), part(updated, "~", "page"), part(links, "", "link"))
    return F.when(inner != "", F.concat(F.lit(" ["), inner, F.lit("]"))).otherwise("")


def unfenced(text: Column) -> Column:
    """Without the code fence around a JSON answer."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```\w*\n?|\n?```\s*$", ""))


def thousands(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).otherwise(F.format_string("%.1fk", F.bround(n / 1000.0, 1)))


def elapsed(seconds: Column) -> Column:
    long = F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds % 60))
    return F.when(seconds >= 60, long).otherwise(F.format_string("%.1fs", seconds.cast("double")))


def shown_time(iso: Column) -> Column:
    """An ISO time for display; anything else stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.rtrim(iso, F.lit("Z"))), "yyyy-MM-dd HH:mm:ss"), iso)


def page_id_of(path: Column) -> Column:
    """A page's id from what a user or a model calls it: without leading slash, wiki folder and suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), "^/+", ""), "^wiki/", ""), r"\.md$", "")


def slug_part(page_id: Column) -> Column:
    """A page's id without its first directory."""
    return F.when(F.instr(page_id, "/") > 0, F.regexp_replace(page_id, "^[^/]*/", "")).otherwise(page_id)


def type_of(page_id: Column) -> Column:
    """A page's type from its directory; concept if there's no such directory."""
    out = F.lit("concept")
    for kind, folder in DIRECTORIES.items():
        out = F.when(F.substring_index(page_id, "/", 1) == folder, kind).otherwise(out)
    return out


def directory_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, folder in DIRECTORIES.items():
        out = F.when(kind == name, folder).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    """Safe in a cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def clipped(text: Column, width: int) -> Column:
    """At most width characters, the last three of them dots if the text is longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def first_prose(body: Column, width: int = 160) -> Column:
    """The first line that's neither empty, a heading nor a comment, cut to a width; a page's summary."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), F.trim), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("<!--"))
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(line) > width, F.concat(F.rtrim(F.substring(line, 1, width - 3)), F.lit("..."))).otherwise(line)


def human_part(body: Column) -> Column:
    """What stands before the marker; all of it without one."""
    return F.substring_index(body, AUTO_MARKER, 1)


def auto_part(body: Column) -> Column:
    at = F.instr(body, AUTO_MARKER)
    return F.when(at > 0, F.substring(body, at + len(AUTO_MARKER), F.length(body))).otherwise("")


def joined_parts(human: Column, auto: Column) -> Column:
    """Both regions with the marker between, one blank line on either side."""
    head = F.concat(F.regexp_replace(human, r"(?U)\s+$", ""), F.lit(f"\n\n{AUTO_MARKER}\n"))
    rest = F.ltrim(auto, F.lit("\n"))
    return F.when(rest != "", F.concat(head, F.lit("\n"), rest)).otherwise(head)


def marked(body: Column) -> Column:
    """With the marker before it, unless it has one."""
    return F.when(F.instr(body, AUTO_MARKER) > 0, body).otherwise(F.concat(F.lit(f"{AUTO_MARKER}\n\n"), F.regexp_replace(body, r"(?U)^\s+", "")))


def with_pending_link(body: Column, matched: Column, target: Column) -> Column:
    """The first occurrence of a text as a link."""
    at = F.instr(body, matched)
    linked = F.concat(F.substring(body, F.lit(1), at - 1), F.lit("[["), target, F.lit("|"), matched, F.lit("]]"), F.substring(body, at + F.length(matched), F.length(body)))
    return F.when((at > 0) & (matched != "") & (target != ""), linked).otherwise(body)


def with_related(body: Column, related: Column) -> Column:
    """A section of links to related pages (structs page_id, title) at the end, without those that it lists already."""
    listed = F.when(F.instr(body, "## Related Pages") > 0, F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\s*- \[\[([^\]|]+)"), F.lit(1)), lambda x: x)).otherwise(F.array().cast("array<string>"))
    new = F.filter(related, lambda r: ~F.array_contains(listed, r["page_id"]))
    lines = F.array_join(F.transform(new, lambda r: F.concat(F.lit("- [["), r["page_id"], F.lit("|"), r["title"], F.lit("]]"))), "\n")
    head = F.when(F.instr(body, "## Related Pages") > 0, "\n").otherwise("\n\n## Related Pages\n\n")
    return F.when(F.size(new) > 0, F.concat(F.regexp_replace(body, r"(?U)\s+$", ""), head, lines, F.lit("\n"))).otherwise(body)


def all_chunk_ids(sources: Column) -> Column:
    """Distinct chunk ids of a page's sources, in order."""
    return F.array_distinct(F.filter(F.flatten(F.transform(sources, lambda x: F.coalesce(x["chunk_ids"], F.array().cast("array<string>")))), lambda c: c.isNotNull() & (c != "")))


def query_id_matches(query_id: Column, position: Column, asked: str) -> Column:
    """Whether a history row is meant by the beginning of its id or, if asked is a number, by its place from 1."""
    return position == int(asked) if asked.isdigit() else query_id.startswith(asked)


def utc_iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def source_budget(per_operation: Column, overhead: Column) -> Column:
    """Tokens left for a source of what an operation may take: a quarter is kept for prompts and answers."""
    return F.greatest(F.lit(1), per_operation - (overhead + F.greatest(F.lit(1), F.floor(per_operation / 4))))
