"""Collections whose tables change together: a small file, written last, names the folders of one state.

A root folder holds data folders, which never change, and numbered files that each describe a whole state: for each table its schema, its number of
buckets and the folder of each bucket. A state is there once its file is, so readers see the old or the new state of all tables, whatever happens to a
writer on its way; two writers can't both write the next file, and the second one fails. A bucket holds the rows of some keys, by hash; a change
writes the buckets that it touches, and the new state refers to the old folders of all others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessarium.lineage import checkpointed
from tessarium.operators import links, search

#: Rows of a bucket, the most buckets, and times that many rows before a table is dealt out anew.
ROWS, BUCKETS, GROWN = 100_000, 1024, 4
ORDER, GONE, BUCKET = "_order", "_gone", "_bucket"


class Conflict(RuntimeError):
    """Another writer was first."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, at = _path(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


class Versions:
    """The states of a folder's tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self, number: int | None = None) -> dict:
        """The newest state that was written whole, or that of a number; one without tables where there is none."""
        for name in reversed(_names(self.spark, f"{self.root}/states")):
            if number is None or int(name.removesuffix(".json")) == number:
                files, at = _path(self.spark, f"{self.root}/states/{name}")
                stream = files.open(at)
                try:
                    return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                except json.JSONDecodeError:  # a writer ended in the middle of it
                    continue
                finally:
                    stream.close()
        return {"number": 0, "tables": {}}

    def read(self, table: str, state: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, with their order and whether they're gone where it has these; of some buckets only, if given."""
        held = (state or self.state())["tables"][table]
        folders = [f for b, f in held["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")

    def written(self, rows: DataFrame, key: str, n: int) -> dict[str, str]:
        """Folders of the buckets of some rows; nothing refers to them yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket(F.col(key), n)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        return {x.removeprefix(f"{BUCKET}="): f"{folder}/{x}" for x in _names(self.spark, f"{self.root}/{folder}") if x.startswith(f"{BUCKET}=")}

    def whole(self, rows: DataFrame, key: str) -> dict:
        """A table's description after all of its rows were written."""
        rows = checkpointed(rows)
        count = rows.count()
        n = min(BUCKETS, max(1, -(-count // ROWS)))
        return {"key": key, "buckets": n, "rows": count, "schema": rows.schema.jsonValue(), "folders": self.written(rows, key, n)}

    def replaced(self, state: dict, table: str, keys: DataFrame, rows: DataFrame) -> dict:
        """A table's description after all rows of some keys (key) gave way to others of the same keys. Only their buckets are read and written."""
        held = state["tables"][table]
        if held["rows"] > GROWN * ROWS * held["buckets"] and held["buckets"] < BUCKETS:
            old = self.read(table, state)
            return self.whole(old.join(keys.select(F.col("key").alias(held["key"])), held["key"], "left_anti").unionByName(rows), held["key"])
        # at most as many numbers as buckets
        touched = [r[0] for r in keys.select(self.bucket(F.col("key"), held["buckets"])).distinct().collect()]
        old = self.read(table, state, touched).join(keys.select(F.col("key").alias(held["key"])), held["key"], "left_anti")
        new = self.written(old.unionByName(rows.select(*old.columns)), held["key"], held["buckets"])
        kept = {b: f for b, f in held["folders"].items() if int(b) not in touched}
        return held | {"rows": held["rows"] + rows.count(), "folders": kept | new}

    def commit(self, state: dict, tables: dict[str, dict]) -> dict:
        """The next state, from one that was read and what changed in it. The last step; until it's done nothing has happened."""
        taken = [int(x.removesuffix(".json")) for x in _names(self.spark, f"{self.root}/states")]
        if self.state()["number"] != state["number"]:
            raise Conflict(f"state {state['number']} isn't the newest any more")
        new = {"number": max(taken, default=0) + 1, "tables": state["tables"] | tables}
        files, at = _path(self.spark, f"{self.root}/states/{new['number']:020d}.json")
        try:
            out = files.create(at, False)
        except Exception as error:
            raise Conflict(f"state {new['number']} is there already") from error
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return new

    def vacuum(self, keep: int = 2) -> None:
        """Deletes states but for the newest ones, and data that none of these refers to. Not while a writer is at work."""
        names = _names(self.spark, f"{self.root}/states")
        states = [self.state(int(x.removesuffix(".json"))) for x in names[-keep:]]
        used = {f.split("/")[1] for s in states for t in s["tables"].values() for f in t["folders"].values()}
        for folder, gone in (("states", names[:-keep]), ("data", [x for x in _names(self.spark, f"{self.root}/data") if x not in used])):
            for x in gone:
                files, at = _path(self.spark, f"{self.root}/{folder}/{x}")
                files.delete(at, True)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """One row a key, that of the greatest order; of equal orders one that stays rather than one that goes, then the greatest by its columns."""
    others = [c for c in rows.columns if c not in (key, ORDER, GONE)]
    # columns without an order of their own, such as maps, are compared by their text
    return rows.groupBy(F.col(key)).agg(F.max_by(F.struct(ORDER, GONE, *others), F.struct(F.col(ORDER), (~F.col(GONE)).alias("stays"), F.to_json(F.struct(*others)))).alias("_r")).select(key, "_r.*")


class Table(Versions):
    """One keyed table, whose rows have an order across batches."""

    def __init__(self, spark: SparkSession, root: str, key: str, name: str = "rows"):
        super().__init__(spark, root)
        self.key, self.name = key, name

    def upserted(self, state: dict, rows: DataFrame, order: Column, gone: Column | None = None) -> tuple[dict, DataFrame]:
        """The table's description after a batch, and the rows that counted: of a key's rows, stored ones included, the last by order."""
        batch = latest(rows.withColumns({ORDER: order, GONE: F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)}).where(F.col(self.key).isNotNull()), self.key)
        if self.name not in state["tables"]:
            batch = checkpointed(batch)
            return self.whole(batch, self.key), batch
        batch = checkpointed(batch)
        n = state["tables"][self.name]["buckets"]
        touched = [r[0] for r in batch.select(self.bucket(F.col(self.key), n)).distinct().collect()]
        stored = self.read(self.name, state, touched).select(self.key, F.col(ORDER).alias("_stored"))
        won = batch.join(stored, self.key, "left").where(F.col("_stored").isNull() | F.coalesce(F.col(ORDER) >= F.col("_stored"), F.lit(False))).drop("_stored")
        won = checkpointed(won)
        return self.replaced(state, self.name, won.select(F.col(self.key).alias("key")), won), won

    def upsert(self, rows: DataFrame, order: Column, gone: Column | None = None) -> dict:
        state = self.state()
        table, _ = self.upserted(state, rows, order, gone)
        return self.commit(state, {self.name: table})

    def rows(self, state: dict | None = None) -> DataFrame:
        """The rows that aren't gone."""
        state = state or self.state()
        return self.read(self.name, state).where(~F.col(GONE)).drop(GONE, ORDER)


class Collection(Table):
    """Pages (page_id, title, aliases, status, pos, summary, body, and others) with what follows from them: names, edges, the bridge to chunks where pages have
    sources, and postings of their stems. All of one state."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "page_id", "pages")

    def derived(self, pages: DataFrame) -> dict[str, tuple[DataFrame, str]]:
        """Tables made of pages, with the column that tells whose rows they are."""
        names = pages.where("status = 'active'").select("page_id", "pos", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "alias")).where("alias IS NOT NULL")
        out = {"names": (names, "page_id"), "edges": (links.edges_of(pages.select("page_id", "body")), "src")}
        out["postings"] = (search.postings(pages.select("page_id", F.col("page_id").alias("name"), "title", "summary", "body"), "page_id", ("name", "title", "summary", "body"), True), "doc")
        if "sources" in pages.columns:
            out["bridge"] = (pages.select("page_id", F.explode(F.flatten(F.transform("sources", lambda s: s["chunk_ids"]))).alias("chunk_id")).distinct(), "page_id")
        return out

    def sync(self, rows: DataFrame, order: Column, gone: Column | None = None) -> dict:
        """Changed pages, and pages that went, in any order across batches: pages and all that follows from those that count change in one step. A page whose body
        is null has an empty one."""
        state = self.state()
        pages, won = self.upserted(state, rows.withColumn("body", F.coalesce("body", F.lit(""))), order, gone)
        tables, keys = {self.name: pages}, won.select(F.col("page_id").alias("key"))
        for name, (made, key) in self.derived(won.where(~F.col(GONE))).items():
            tables[name] = self.replaced(state, name, keys, made) if name in state["tables"] else self.whole(made, key)
        return self.commit(state, tables)

    def rebuild(self, rows: DataFrame, order: Column) -> dict:
        """All tables from all pages, whatever was there before."""
        state = self.state()
        batch = checkpointed(latest(rows.withColumn("body", F.coalesce("body", F.lit(""))).withColumns({ORDER: order, GONE: F.lit(False)}).where("page_id IS NOT NULL"), "page_id"))
        return self.commit(state, {self.name: self.whole(batch, "page_id")} | {name: self.whole(made, key) for name, (made, key) in self.derived(batch).items()})

    def aliases(self, state: dict | None = None) -> DataFrame:
        """alias, page_id, as linking.alias_table() finds them."""
        return self.read("names", state).groupBy(F.lower("alias").alias("alias")).agg(F.max_by("page_id", F.struct("pos", "n")).alias("page_id"))
