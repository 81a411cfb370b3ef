"""Readers of files into document rows: path, kind, text, metadata."""

from __future__ import annotations

import base64
import io
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarium.functions import text as tx

#: Languages of code and settings, by suffix (fixed values).
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "React TypeScript component", "jsx": "React JavaScript component", "go": "Go", "rs": "Rust", "java": "Java",
    "rb": "Ruby", "cs": "C#", "cpp": "C++", "c": "C", "sh": "Shell/Bash script", "sql": "SQL database query or schema definition", "tf": "Terraform infrastructure-as-code",
    "hcl": "HashiCorp Configuration Language", "proto": "Protocol Buffers schema definition", "graphql": "GraphQL schema or query", "yaml": "YAML configuration",
    "yml": "YAML configuration", "json": "JSON configuration or data", "toml": "TOML configuration", "dockerfile": "Docker container definition",
}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}
#: Reader by suffix (fixed values); anything else is plain text.
KINDS = {"md": "markdown", "txt": "markdown", "rst": "markdown", "pdf": "pdf", "docx": "office", "pptx": "office", **dict.fromkeys(MIME, "image"), **dict.fromkeys(LANGUAGES, "code")}
#: Folders for copies of sources, by kind (fixed values).
RAW_FOLDERS = {"markdown": "articles", "pdf": "papers", "image": "images", "code": "code", "office": "articles", "web": "articles"}
RESULT = "path string, kind string, text string, metadata map<string,string>, pages array<string>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def route(path: Column) -> Column:
    """The reader for a path or URL."""
    return F.when(path.rlike("^https?://"), "web").when(path.rlike(r"(?i)(^|/)dockerfile$"), "code").otherwise(F.coalesce(_looked_up(KINDS, suffix(path)), F.lit("markdown")))


def can_handle(path: Column) -> Column:
    """Whether there's a reader for a path, other than that of plain text for unknown ones."""
    return path.rlike("^https?://") | path.rlike(r"(?i)(^|/)dockerfile$") | F.coalesce(_looked_up(KINDS, suffix(path)).isNotNull(), F.lit(False))


def raw_folder(kind: Column) -> Column:
    return F.coalesce(_looked_up(RAW_FOLDERS, kind), F.lit("misc"))


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder).where(~F.col("path").rlike(r"/\.[^/]*$"))


def page_files(spark: SparkSession, folder: str, archive: bool = False) -> DataFrame:
    """page_id, body of a tree of Markdown pages, without index and log, and without the archive unless asked for."""
    found = files(spark, folder, "*.md").where(~F.col("path").rlike(r"/(index|log)\.md$"))
    found = found if archive else found.where(~F.col("path").rlike("/archive/"))
    root = F.lit(re.sub(r"^file:/*", "/", folder).rstrip("/"))
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), r"\.md$", "")
    return found.select(F.substring(name, F.length(root) + 2, F.length(name)).alias("page_id"), F.col("content").cast("string").alias("body"))


def code_text(name: Column, text: Column) -> Column:
    """Code with its language above it."""
    language = F.when(name.rlike(r"(?i)(^|/)dockerfile$"), LANGUAGES["dockerfile"]).otherwise(F.coalesce(_looked_up(LANGUAGES, suffix(name)), F.lit("source code")))
    return F.concat(F.lit("[File: "), F.substring_index(name, "/", -1), F.lit(" | Language: "), language, F.lit("]\n\n"), text)


def office_text(content: bytes, kind: str) -> str:
    """Paragraphs of a docx, or slides of a pptx below headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:

        def paragraphs(name: str) -> list[str]:
            found = []
            for p in ElementTree.fromstring(z.read(name)).iter():
                if p.tag.endswith("}p"):
                    found.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
            return [p for p in found if p.strip()]

        if kind == "docx":
            return "\n\n".join(paragraphs("word/document.xml"))
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return "\n\n".join(f"# Slide {i}\n\n" + "\n".join(paragraphs(n)) for i, n in slides)


class MainText(HTMLParser):
    """The main content of a web page as Markdown; scripts, styles, navigation and comments are dropped, tables, links and emphasis kept."""

    SKIPPED = {"script", "style", "nav", "footer", "aside", "head", "noscript", "form", "iframe"}
    BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "blockquote", "pre"}
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self):
        super().__init__()
        self.out, self.depth, self.cells, self.rows, self.links = [], 0, None, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIPPED
        if self.depth:
            return
        if tag in self.BREAKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))
            self.rows = 0 if tag == "table" else self.rows
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(len(self.out))
        elif tag == "a":
            self.links.append((len(self.out), dict(attrs).get("href")))
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIPPED and self.depth > 0
        if self.depth:
            return
        if tag in self.BREAKS:
            self.out.append("\n")
        elif tag == "tr" and self.cells:
            edges = [*self.cells, len(self.out)]
            row = [" ".join("".join(self.out[a:b]).split()).replace("|", "\\|") for a, b in zip(edges, edges[1:])]
            line = f"\n| {' | '.join(row)} |" + ("\n|" + "---|" * len(row) if not self.rows else "")
            self.out[edges[0] :] = [line]
            self.cells, self.rows = None, self.rows + 1
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            shown = "".join(self.out[at:])
            if href and shown.strip():
                self.out[at:] = [f"[{shown.strip()}]({href})"]
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def web_text(html: str) -> str:
    parser = MainText()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    text = ""
    for line in filter(None, lines):
        # rows of a table stay together
        text += ("\n" if line.startswith("|") and text.rsplit("\n", 1)[-1].startswith("|") else "\n\n" if text else "") + line
    return text


def pdf_pages(content: bytes) -> list[str]:
    """The texts of a PDF's pages; needs pymupdf."""
    try:
        import pymupdf
    except ImportError as error:
        raise ValueError("no PDF reader is installed") from error
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document]


def extracted(kind: str, path: str, content: bytes) -> tuple[str, dict[str, str], list[str] | None]:
    """Text, metadata and pages of a file."""
    name = path.rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1].lower()
    if kind == "office":
        return office_text(content, ending), {"filename": name}, None
    if kind == "image":
        about = {"filename": name, "byte_size": str(len(content)), "mime_type": MIME.get(ending, "application/octet-stream"), "image_base64": base64.b64encode(content).decode()}
        return f"[Image: {name} | {len(content)} bytes | requires LLM vision]", about, None
    if kind == "pdf":
        pages = pdf_pages(content)
        return "\n\n".join(pages), {"filename": name, "page_count": str(len(pages))}, pages
    text = content.decode("utf-8", "replace")
    if kind == "web" or ending in ("html", "htm"):
        return web_text(text), {"url": path}, None
    if kind == "code":
        language = LANGUAGES.get("dockerfile" if name.lower() == "dockerfile" else ending, "source code")
        return f"[File: {name} | Language: {language}]\n\n{text}", {"filename": name, "language": language}, None
    return text, {"filename": name}, None


def extract(found: DataFrame, readers: dict[str, Callable[[str, str, bytes], tuple]] | None = None) -> DataFrame:
    """Rows of RESULT for files (path, content); a file that can't be read gives an error in its metadata instead of ending the job.

    readers replace or add readers by kind: functions of kind, path and content that give text, metadata and pages.
    """
    known = readers or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, path, content in zip(pdf["kind"], pdf["path"], pdf["content"]):
                try:
                    out.append(known.get(kind, extracted)(kind, path, content))
                except Exception as error:  # one bad file must not end the batch
                    out.append((None, {"error": str(error)}, None))
            yield pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], **{c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("text", "metadata", "pages"))}})

    return found.select("path", route(F.col("path")).alias("kind"), "content").mapInPandas(run, RESULT)


def front_matter(pages: DataFrame) -> DataFrame:
    """page_id, header and body: what stands between two lines of three dashes, or no header."""
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    found = F.col("body").rlike(pattern)
    return pages.select("page_id", F.when(found, F.regexp_extract("body", pattern, 1)).alias("header"), F.when(found, F.regexp_extract("body", pattern, 2)).otherwise(F.col("body")).alias("body"))


#: Fields of a page's header and what stands for a missing one (fixed values).
HEADER = "title string, type string, status string, created string, modified string, summary string, aliases array<string>, sources array<struct<hash:string,name:string,raw_path:string,url:string,chunk_ids:array<string>>>, source_count int, confidence string, dormant_window int, human_edited boolean, superseded_by string, contradictions array<struct<existing:string,new:string,source:string>>, tags array<string>, related_pages array<string>, promoted boolean"


def parsed_header(text: str) -> tuple[dict | None, str]:
    """The fields of a header between two lines of dashes, and the body; no fields, and all of the text, if it isn't a YAML mapping."""
    import yaml

    parts = text.split("---", 2)
    if not text.startswith("---") or len(parts) < 3:
        return None, text
    try:
        data = yaml.load(parts[1], Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None, text
    if not isinstance(data, dict):
        return None, text
    said = lambda x: None if x is None else str(x)
    rows = lambda name, keys: [{k: said(x.get(k)) if k != "chunk_ids" else [str(c) for c in x.get(k) or []] for k in keys} for x in data.get(name) or [] if isinstance(x, dict)]
    strings = lambda name: [str(x) for x in data.get(name) or []]
    out = {k: said(data.get(k, d)) for k, d in (("title", ""), ("type", "entity"), ("status", "active"), ("created", ""), ("modified", ""), ("summary", ""), ("confidence", "medium"), ("superseded_by", None))}
    out |= {"aliases": strings("aliases"), "tags": strings("tags"), "related_pages": strings("related_pages"), "sources": rows("sources", ("hash", "name", "raw_path", "url", "chunk_ids")), "contradictions": rows("contradictions", ("existing", "new", "source"))}
    out |= {"source_count": int(data.get("source_count") or 0), "dormant_window": int(data.get("dormant_window_days", data.get("staleness_window_days", 90)) or 0), "human_edited": bool(data.get("human_edited", False)), "promoted": bool(data.get("promoted_from_update", False))}
    return out, parts[2].lstrip("\n")


def read_headers(pages: DataFrame) -> DataFrame:
    """page_id, header (a struct of HEADER, null without one) and body of pages (page_id, body)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [parsed_header(b or "") for b in pdf["body"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "header": pd.Series([h for h, _ in found], dtype=object), "body": [b for _, b in found]})

    nested = HEADER.replace(" ", ":").replace(",:", ",")
    return pages.select("page_id", "body").mapInPandas(run, f"page_id {kind}, header struct<{nested}>, body string")


def header_field(header: Column, name: str) -> Column:
    """One plain field of a header, without quotes; null if missing."""
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.nullif(F.regexp_replace(F.trim(value), "^['\"]|['\"]$", ""), F.lit(""))


def header_list(header: Column, name: str) -> Column:
    """A list in brackets or of dashed lines below a field."""
    inline = F.split(F.regexp_extract(header, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1), r"\s*,\s*")
    dashed = F.split(F.regexp_extract(header, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*(?:\n|$))+)", 1), "\n")
    items = F.transform(F.concat(inline, dashed), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^- *", ""), "^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: x != "")


def manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """page_id and fields of a JSON object of objects; unknown fields are dropped, missing ones are null."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{entry}>>")).alias("page_id", "e")).select("page_id", "e.*")


def edge_file(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, context, linked_at of a stored link file: an object of pages with outbound lists; each link once, those without target left out."""
    raw = spark.read.text(path, wholetext=True)
    entry = "struct<updated_at:string,links:map<string,struct<outbound:array<struct<to:string,context:string,confidence:string,linked_at:string>>>>>"
    found = raw.select(F.from_json("value", entry).alias("f")).select("f.updated_at", F.explode("f.links").alias("src", "e")).select("src", "updated_at", F.posexplode("e.outbound").alias("pos", "o")).where("o.to IS NOT NULL AND o.to <> ''")
    first = found.groupBy("src", F.col("o.to").alias("dst")).agg(F.min_by("o", "pos").alias("o"), F.first("updated_at").alias("u"))
    return first.select("src", "dst", F.coalesce("o.context", F.lit("")).alias("context"), F.coalesce("o.linked_at", "u").alias("linked_at"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a stored source catalog, by content hash, with defaults for missing fields."""
    entry = "struct<sources:map<string,struct<name:string,content_type:string,size_bytes:long,raw_path:string,first_ingested_at:string,last_ingested_at:string,ingest_count:int,url:string,pages_produced:array<string>>>>"
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)["sources"]).alias("content_hash", "e")).select("content_hash", "e.*")
    return found.fillna({"name": "", "content_type": "", "size_bytes": 0, "ingest_count": 1}).withColumn("pages_produced", F.coalesce("pages_produced", F.array().cast("array<string>")))


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Links to be reviewed, of a list or of an object that holds one; none if the file is neither."""
    item = "array<struct<source_page:string,matched_text:string,candidate_page_id:string,score:int,label:string,cosine_score:double,added_at:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.when(F.col("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json("value", f"struct<pending:{item}>")["pending"])
    return raw.select(F.posexplode(listed).alias("pos", "i")).select("pos", "i.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Asked questions, the newest first, with known fields only; an unreadable file has none. A file of one old entry counts as one question."""
    entry = "query_id:string,timestamp:string,question:string,answer:string,confidence:string,tokens_in:int,tokens_out:int,cost_usd:double"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", f"struct<entries:array<struct<{entry}>>>")["entries"]).alias("pos", "e")).select("pos", "e.*")
    old = raw.select(F.from_json("value", f"struct<{entry}>").alias("e")).where("e.question IS NOT NULL").select(F.lit(0).alias("pos"), "e.*")
    old = old.withColumn("query_id", F.coalesce("query_id", tx.query_id(F.coalesce("timestamp", F.lit("")), F.col("question"))))
    return rows.unionByName(old)


def lookup(table: DataFrame, key: str, ids: list | DataFrame) -> DataFrame:
    """Rows of some ids; unknown ones are left out. Many ids come as a table of one column of the key's name."""
    return table.where(F.col(key).isin(*ids)) if isinstance(ids, list) else table.join(ids.select(key), key, "left_semi")


def chunks_of(chunks: DataFrame, source_hash: str) -> DataFrame:
    return chunks.where(F.col("source_hash") == source_hash).orderBy("chunk_index")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text logs."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return raw.select("file", "pos", F.rtrim("line").alias("line"))


def batch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder itself, without hidden ones, in order."""
    return files(spark, folder, recursive=False).orderBy("path")


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """Sources listed in a text file; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("source")).where("source <> '' AND NOT startswith(source, '#')")


def config(text: str, known: dict[str, tuple[str, ...]]) -> dict[str, dict]:
    """Sections of a TOML text, with known keys only."""
    found = tomllib.loads(text)
    return {section: {k: v for k, v in found.get(section, {}).items() if k in keys} for section, keys in known.items()}
