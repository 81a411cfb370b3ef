"""Writing collections: tables, indexes kept in step, exports, logs and page files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessarium.functions import text as tx
from tessarium.operators import lifecycle, reports, search
from tessarium.operators.retrieval import Fingerprint, checked

#: Texts that an embedder is given at a time (fixed value).
EMBED_BATCH = 32


def embedded(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", to: str = "v") -> DataFrame:
    """Rows with vectors of their texts. make gives an embedder, once a worker; a batch that fails is tried text by text, and a text that fails has no vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()

        def tried(texts: list[str]) -> list:
            try:
                found = embed(texts)
                if len(found) == len(texts):
                    return list(found)
            except Exception:  # a provider's failure must not end the job
                pass
            return [x for t in texts for x in tried([t])] if len(texts) > 1 else [None] * len(texts)

        for batch in batches:
            out: list = []
            texts = [t or "" for t in batch]
            for i in range(0, len(texts), EMBED_BATCH):
                out += tried(texts[i : i + EMBED_BATCH])
            yield pd.Series(out, dtype=object)

    return rows.withColumn(to, run(text))


def replaced_chunks(stored: DataFrame, new: DataFrame, stored_by: Fingerprint | None, active: Fingerprint) -> DataFrame:
    """Chunks after a source is chunked again: all of its old ones go. Vectors of another embedder are refused."""
    if stored_by is not None:
        checked(stored_by, active)
    return lifecycle.replace_keys(stored, new, "source_hash")


def refreshed_postings(index: DataFrame, changed: DataFrame, gone: DataFrame, doc: str = "doc_id", fields: tuple[str, ...] = ("text",), stem: bool = True) -> DataFrame:
    """An index of search.postings() after some documents changed and some (doc) went: only these are read again."""
    keys = changed.select(F.col(doc).alias("doc")).unionByName(gone.select("doc")).distinct()
    return index.join(keys, "doc", "left_anti").unionByName(search.postings(changed, doc, fields, stem))


def synced(table: DataFrame, fresh: DataFrame, changed: list | None, key: str = "page_id") -> DataFrame:
    """A table after files changed: all of fresh for None, the table itself for an empty list, else fresh rows for the changed keys; those that fresh lacks go."""
    if changed is None:
        return fresh
    if not changed:
        return table
    keys = table.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(changed)], f"{key} {table.schema[key].dataType.simpleString()}")
    return table.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside a table, then moves there. A failed write or move leaves the old table, or puts it back; between two moves there is none for a
    moment, so readers that can't wait need versions.Versions, whose states change in one step."""
    spark = rows.sparkSession
    made = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.write.parquet(made)
    jvm = spark._jvm.org.apache.hadoop.fs
    new, target = jvm.Path(made), jvm.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"{path} can't be moved; the new table is at {made}")
    if not files.rename(new, target):
        if had and not files.rename(old, target):
            raise OSError(f"the old table is at {old}, the new one at {made}")
        raise OSError(f"{made} can't be moved; the old table is in its place")
    if had:
        files.delete(old, True)


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """value: one JSON object a row, in the order of a key, so that equal tables give equal files."""
    return rows.orderBy(key).select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def export_json(rows: DataFrame, key: str, path: str) -> None:
    json_lines(rows, key).write.mode("overwrite").text(path)


def tab_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """value: columns joined by tabs, for pipes; a dash stands for null."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("value"))


def export_tabs(rows: DataFrame, path: str, *columns: str) -> None:
    tab_lines(rows, *columns).write.mode("overwrite").text(path)


def append_events(events: DataFrame, path: str) -> None:
    """Adds entries to a text log's folder."""
    reports.event_lines(events).orderBy("ts").select("entry").write.mode("append").text(path)


def _write_files(rows: DataFrame, folder: str) -> DataFrame:
    """path of files written (name, content in bytes) below a folder that all executors share; a repeated attempt writes the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"path": [f"{folder}/{n}" for n in pdf["name"]]})

    return rows.select("name", "content").mapInPandas(run, "path string")


def header_text(pages: DataFrame) -> DataFrame:
    """page_id, text of pages: their columns other than the body as a header, each value in JSON, which YAML reads."""
    fields = [c for c in pages.columns if c not in ("page_id", "body")]
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(""))
    lines = [F.concat(F.lit(f"{c}: "), F.when(F.col(c).isNull(), "null").otherwise(value(c))) for c in fields]
    return pages.select("page_id", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def write_pages(pages: DataFrame, folder: str) -> list[str]:
    """Page files with headers below a shared folder; their paths."""
    named = header_text(pages).select(F.concat("page_id", F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return [r.path for r in _write_files(named, folder).collect()]


def copy_raw(found: DataFrame, folder: str) -> list[str]:
    """Copies of sources (path, kind, content) below a shared folder, by kind."""
    from tessarium.sources.readers import raw_folder

    named = found.select(F.concat(raw_folder(F.col("kind")), F.lit("/"), F.substring_index("path", "/", -1)).alias("name"), "content")
    return [r.path for r in _write_files(named, folder).collect()]


def write_indexes(pages: DataFrame, folder: str) -> list[str]:
    """The index of each folder and the root index."""
    each = reports.sub_indexes(pages).select(F.concat("folder", F.lit("/index.md")).alias("name"), "body")
    root = reports.root_index(pages).select(F.lit("index.md").alias("name"), "body")
    return [r.path for r in _write_files(each.unionByName(root).select("name", F.encode("body", "UTF-8").alias("content")), folder).collect()]


def add_alias(manifest: DataFrame, page_id, alias: str) -> DataFrame:
    """One more alias of a page, in lower case, unless it has it."""
    new = alias.lower().strip()
    has = F.exists("aliases", lambda a: F.lower(a) == new)
    return manifest.withColumn("aliases", F.when((F.col("page_id") == page_id) & ~has & F.lit(bool(new)), F.array_append("aliases", F.lit(new))).otherwise(F.col("aliases")))


def fingerprint(spark: SparkSession, provider: str, model: str, dimensions: int) -> DataFrame:
    """One row to be stored beside an index."""
    return spark.createDataFrame([(provider, model, dimensions)], "provider string, model string, dimensions int")


def page_key(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_key", tx.page_id_of(F.col("page_id").cast("string")))
