"""Search over batches of queries: BM25, exact vectors, rank fusion, budgets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructType

from tessarium.functions import text as tx
from tessarium.functions.stems import stem as stem_of
from tessarium.lineage import checkpointed
from tessarium.operators import cells

K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60
#: Candidates of each lane for each result wanted.
OVERSHOOT = 3
#: Rows of one side of a block pair; a left side of so many rows at most is broadcast.
BLOCK = 4096
#: Scores that are held at once (8 bytes each), and documents that are cut into words at once.
TILE, AT_ONCE = 1 << 20, 512
#: Pairs of similar vectors that leave a task at once.
PAIRS = 1 << 16
#: Queries times phrases up to which their weights are sent to all tasks (8 bytes each).
SENT = 4_000_000
#: Different phrases of questions up to which documents are scored as rows of a matrix (8 bytes each, 1,024 rows at a time).
PHRASES = 20_000
#: The row of a document that tells its length stands under this term.
LENGTH = ""
#: ASCII letters in lower case, everything else than letters, digits and bytes beyond ASCII as space: what parts words.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def stemmed(word: bytes) -> str:
    return stem_of(word.decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


class Vocabulary(dict):
    """Numbers of words, and the terms that they stand for; equal terms share a number."""

    def __init__(self, stem: bool):
        super().__init__()
        self.stem, self.numbers, self.terms = stem, {}, []

    def __missing__(self, word: bytes) -> int:
        term = stemmed(word) if self.stem else word.decode("utf-8", "replace")
        if (number := self.numbers.setdefault(term, len(self.terms))) == len(self.terms):
            self.terms.append(term)
        self[word] = number
        return number


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few documents at a time, so that their words stay small in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def postings(docs: DataFrame, doc: str = "doc_id", fields: tuple[str, ...] = ("text",), stem: bool = False) -> DataFrame:
    """doc, term, tf, dl, at: one row for each distinct word of a document, and one for its length, made in one pass without a shuffle.

    at has the word's places; words of different fields are no neighbours. Write it to a table, bucketed by term, to search it more than once.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(stem)
        for batch in sliced(batches):
            if len(known) > 300_000:
                known = Vocabulary(stem)
            codes, places, lengths = [], [], np.zeros(batch.num_rows, np.int64)
            for i, values in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, len(fields) + 1)))):
                gap = 0
                for value in values:
                    words = value.encode().translate(FOLD).split() if value else ()
                    codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    places.append(np.arange(gap, gap + len(words)))
                    lengths[i] += len(words)
                    gap += len(words) + 1
            if not batch.num_rows:
                continue
            row, code, place = np.repeat(np.arange(batch.num_rows), lengths), np.concatenate(codes), np.concatenate(places)
            key = row * (len(known.terms) + 1) + code
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            n = np.diff(starts, append=len(key))
            terms = pa.array(known.terms, pa.string()).take(pa.array(code[order][starts]))
            at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
            ids = batch.column(0)
            names = ["doc", "term", "tf", "dl", "at"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[order][starts])), terms, pa.array(n, pa.int32()), pa.array(lengths[row[order][starts]], pa.int32()), at], names=names)
            yield pa.RecordBatch.from_arrays([ids, pa.array([LENGTH] * len(ids), pa.string()), *[pa.array(lengths, pa.int32())] * 2, pa.array([[]] * len(ids), pa.list_(pa.int32()))], names=names)

    return docs.select(F.col(doc).alias("doc"), *fields).mapInArrow(run, f"doc {kind}, term string, tf int, dl int, at array<int>")


@F.pandas_udf(StringType())
def stemmed_phrase(phrase: pd.Series) -> pd.Series:
    return phrase.map(lambda p: " ".join(stemmed(w.encode()) for w in p.split(" ")))


def forward(docs: DataFrame, phrases: list[str], doc: str, fields: tuple[str, ...], stem: bool) -> DataFrame:
    """doc, dl, units, tf: each document's length, and of some phrases (words joined by spaces) those that it holds, by number, and how often."""
    kind = docs.schema[doc].dataType.simpleString()
    units = [tuple(p.split(" ")) for p in phrases]
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for u in units for t in u))}
    single = np.full(len(numbers) + 1, -1)
    for i, u in enumerate(units):
        if len(u) == 1:
            single[numbers[u[0]]] = i
    longer = [(i, [numbers[t] for t in u]) for i, u in enumerate(units) if len(u) > 1]

    class Stems(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 300_000:
                self.clear()
            found = self[word] = numbers.get(stemmed(word), -1)
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stem:
            numbered = lambda words, get=Stems().__getitem__: map(get, words)
        else:
            numbered = lambda words, get={t.encode(): i for t, i in numbers.items()}.get: map(get, words, repeat(-1))
        for batch in sliced(batches):
            parts, dl, ends = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, values in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, len(fields) + 1)))):
                for value in values:
                    words = value.encode().translate(FOLD).split() if value else ()
                    # a place that no word takes ends each field, so that phrases don't run on
                    parts += [np.fromiter(numbered(words), np.int64, len(words)), np.array([-1])]
                    dl[i] += len(words)
                    ends[i] += len(words) + 1
            code, row = np.concatenate(parts), np.repeat(np.arange(batch.num_rows), ends)
            del parts
            hits = [(row[at := np.flatnonzero(code >= 0)], single[code[at]])]
            if longer:
                order = np.argsort(code, kind="stable")
                for i, u in longer:
                    at = order[np.searchsorted(code, u[0], "left", sorter=order) : np.searchsorted(code, u[0], "right", sorter=order)]
                    for k, c in enumerate(u[1:], 1):
                        at = at[(at + k < len(code)) & (code[np.minimum(at + k, len(code) - 1)] == c)]
                    hits.append((row[at], np.full(len(at), i)))
            rows, unit = (np.concatenate(x) for x in zip(*hits))
            keys, n = np.unique((rows * len(units) + unit)[unit >= 0], return_counts=True)
            offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1) * len(units))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (keys % max(len(units), 1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), *lists], names=["doc", "dl", "units", "tf"])

    return docs.select(F.col(doc).alias("doc"), *fields).mapInArrow(run, f"doc {kind}, dl int, units array<int>, tf array<int>")


def phrases_of(queries: DataFrame, stem: bool) -> DataFrame:
    """query_id, phrase, times of questions (query_id, question)."""
    asked = queries.select("query_id", F.explode(tx.query_phrases(F.col("question"))).alias("phrase"))
    if stem:
        asked = asked.withColumn("phrase", stemmed_phrase("phrase"))
    return asked.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("times"))


def weights(units: np.ndarray, n_docs: int) -> np.ndarray:
    """Of phrases in so many documents each."""
    return np.maximum(np.log((n_docs - units + 0.5) / (units + 0.5)), LEAST_IDF)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, scope: DataFrame | None = None, doc: str = "doc_id", fields: tuple[str, ...] = ("text",), stem: bool = False, index: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score, rank for queries (query_id, question). Any phrase of a question matches, and counts as often as it stands there.

    scope (doc, or query_id and doc) limits results, not statistics. Documents are read once. If the questions' phrases, counted first, are few
    enough to be sent to all tasks, each batch of documents is scored as a matrix product and only its best rows go on, of a scope by query only those in
    it; otherwise, and without k, or with an index of postings(), postings are joined with the phrases. Blank questions find nothing.
    """
    asked = checkpointed(phrases_of(queries, stem))
    if index is None and k is not None and k > 0:
        n_queries, n_phrases, n = asked.agg(F.count_distinct("query_id"), F.count_distinct("phrase"), F.count(F.lit(1))).first()
        if n_queries * n_phrases <= SENT and n_phrases <= PHRASES and n <= SENT // 16:
            return _scored(docs, asked.collect(), k, scope, doc, fields, stem, queries.schema["query_id"].dataType)
    return _joined(docs, asked, k, scope, doc, fields, stem, index)


def _scored(docs: DataFrame, asked: list, k: int, scope: DataFrame | None, doc: str, fields: tuple[str, ...], stem: bool, kind: DataType) -> DataFrame:
    """bm25() for phrases that fit into one matrix (queries x phrases)."""
    phrases, ids = sorted({r.phrase for r in asked}), sorted({r.query_id for r in asked})
    at, of = {p: i for i, p in enumerate(phrases)}, {q: i for i, q in enumerate(ids)}
    held = checkpointed(forward(docs, phrases, doc, fields, stem))
    doc_kind = held.schema["doc"].dataType.simpleString()
    n_docs, total = held.agg(F.count(F.lit(1)), F.sum(F.col("dl").cast("long"))).first()
    df = np.zeros(len(phrases))
    # as many rows as phrases
    for unit, n in held.select(F.explode("units").alias("u")).groupBy("u").agg(F.count(F.lit(1))).collect():
        df[unit] = n
    W = np.zeros((len(phrases), len(ids)))
    idf = weights(df, n_docs)
    for r in asked:
        W[at[r.phrase], of[r.query_id]] = r.times * idf[at[r.phrase]]
    mean = (total or 0) / max(n_docs, 1) or 1.0
    by_query = scope is not None and "query_id" in scope.columns
    if by_query:
        # numbers of the questions, no more than there are, that a document counts for
        numbers = F.create_map(*(F.lit(x) for q, i in of.items() for x in (q, i))) if of else F.lit(None).cast(f"map<{kind.simpleString()},int>")
        held = held.join(scope.select("doc", numbers[F.col("query_id")].alias("q")).where("q IS NOT NULL").groupBy("doc").agg(F.collect_set("q").alias("asked")), "doc")
    elif scope is not None:
        held = held.join(scope, "doc", "left_semi")
    names = pa.array(ids, to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                units, tf = batch.column("units"), batch.column("tf").flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(units.offsets.to_numpy()))
                dl = batch.column("dl").to_numpy()[row]
                D = np.zeros((batch.num_rows, len(phrases)))
                D[row, units.flatten().to_numpy()] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                S = D @ W
                if by_query:
                    counts = np.zeros(S.shape, bool)
                    counts[np.repeat(np.arange(batch.num_rows), np.diff(batch.column("asked").offsets.to_numpy())), batch.column("asked").flatten().to_numpy()] = True
                    S[~counts] = 0
                bar = np.partition(S, -k, 0)[-k] if len(S) > k else np.zeros(len(ids))
                # ties of the k-th best stay; what matches nothing scores 0
                i, j = np.nonzero((S >= bar * (1 - 1e-9) - 1e-9) & (S > 0))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), batch.column("doc").take(pa.array(i)), pa.array(S[i, j])], names=["query_id", "doc", "score"])

    return top(held.mapInArrow(run, f"query_id {kind.simpleString()}, doc {doc_kind}, score double"), k)


def _joined(docs: DataFrame, asked: DataFrame, k: int | None, scope: DataFrame | None, doc: str, fields: tuple[str, ...], stem: bool, index: DataFrame | None) -> DataFrame:
    """bm25() for any number of phrases, by joins of postings."""
    phrases = asked.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
    wanted = phrases.select(F.explode("words").alias("term")).union(phrases.sparkSession.createDataFrame([(LENGTH,)], "term string")).distinct()
    source = index if index is not None else postings(docs, doc, fields, stem)
    hits = checkpointed(source.join(wanted, "term", "left_semi"))
    lengths = hits.where(F.col("term") == LENGTH).select("doc", F.col("tf").alias("dl"))
    sizes = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    found = hits.where(F.col("term") != LENGTH).select("doc", F.col("term").alias("phrase"), "tf")
    # the queries are read once more, to see whether a phrase of several words is among them
    if not phrases.where(F.size("words") > 1).isEmpty():
        parts = phrases.where(F.size("words") > 1).select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
        starts = hits.join(parts, "term").select("doc", "phrase", "n", "i", F.explode("at").alias("p")).groupBy("doc", "phrase", "n", (F.col("p") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("seen"))
        found = found.unionByName(starts.where("seen = n").groupBy("doc", "phrase").agg(F.count(F.lit(1)).cast("int").alias("tf")))
        found = found.join(phrases.select("phrase"), "phrase", "left_semi")
    df = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # one row
    weighted = asked.join(df, "phrase").join(F.broadcast(sizes)).select("query_id", "phrase", "avgdl", (idf * F.col("times")).alias("weight"))
    parts = found.join(weighted, "phrase")
    if scope is not None:
        parts = parts.join(scope, [c for c in ("query_id", "doc") if c in scope.columns], "left_semi")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = parts.join(lengths, "doc").groupBy("query_id", "doc").agg(F.sum(part).alias("score"))
    return scores if k is None else top(scores, k)


def top(scores: DataFrame, k: int, best: str = "DESC") -> DataFrame:
    """The k best of each query, ties by id; Spark limits each task's groups before the shuffle. None for k <= 0."""
    return scores.selectExpr("*", f"row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {best}, doc) AS rank").where(F.col("rank") <= max(k, 0))


def _matrix(column, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones count as followed by zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    out = np.zeros((len(rows), max([dims or 0, *map(len, rows)])))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """The same of an Arrow column; null is a row of zeros."""
    column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whose = np.repeat(np.arange(len(n)), n)
    out[whose, np.arange(len(flat)) - (np.cumsum(n) - n)[whose]] = flat
    return out


def _matrices(left, right) -> tuple[np.ndarray, np.ndarray]:
    A, B_ = _matrix(left), _matrix(right)
    dims = max(A.shape[1], B_.shape[1])
    return np.pad(A, ((0, 0), (0, dims - A.shape[1]))), np.pad(B_, ((0, 0), (0, dims - B_.shape[1])))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can be compared: not null, of finite components, of some length."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.col("v").isNotNull()).where(finite).where(square > 0)


def _ids(values: list) -> np.ndarray:
    """Numbers, or whatever else can be ordered."""
    return np.array(values, object if values and not isinstance(values[0], int) else np.int64)


def block_pairs(left: DataFrame, right: DataFrame, best, schema: str) -> DataFrame:
    """Compare two sets of (id, v, left also skip) in blocks: best(ids, vectors, skip, ids, vectors) gives rows of two matrices.

    A left side of one block at most, by a count, is broadcast: then the right side is neither shuffled nor repeated. Larger ones meet in pairs of blocks,
    whose partitions are given by number, as vectors are few bytes for their work.
    """
    spark = left.sparkSession
    counts = [left.count(), right.count()]
    skipped = left.agg(F.sum(F.size("skip"))).first()[0] or 0 if counts[0] <= BLOCK else 0
    if counts[0] <= BLOCK and skipped <= SENT:
        rows = left.select("id", "v", "skip").collect()
        held = spark.sparkContext.broadcast((_ids([r[0] for r in rows]), _matrix([r[1] for r in rows]), [r[2] for r in rows]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine, vectors, skip = held.value
            for pdf in batches:
                for at in range(0, len(pdf) if len(mine) else 0, BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    yield best(mine, vectors, skip, part["id"].to_numpy(), _matrix(part["v"]))

        return right.select("id", "v").mapInPandas(run, schema)
    n = {side: max(1, -(-count // BLOCK)) for side, count in zip("lr", counts)}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n["l"] * n["r"], cells.TASKS))
    a = left.withColumn("_l", F.pmod(F.xxhash64("id"), F.lit(n["l"])).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n["r"] - 1)))).repartition(tasks, "_l", "_r")
    # columns of new names, as both sides may come from the same table
    b = right.select(F.col("id").alias("id_"), F.col("v").alias("v_"), F.pmod(F.xxhash64("id"), F.lit(n["r"])).cast("int").alias("_r_")).withColumn("_l_", F.explode(F.sequence(F.lit(0), F.lit(n["l"] - 1)))).repartition(tasks, "_l_", "_r_")

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return best(x["id"].to_numpy(), _matrix(x["v"]), list(x["skip"]), y["id_"].to_numpy(), _matrix(y["v_"]))

    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l_", "_r_")).applyInPandas(solve, schema)


def cosine_matrix(A: np.ndarray, B_: np.ndarray) -> np.ndarray:
    return A @ B_.T / (np.linalg.norm(A, axis=1)[:, None] * np.linalg.norm(B_, axis=1)[None, :] + 1e-12)


def same_width(A: np.ndarray, B_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = max(A.shape[1], B_.shape[1])
    return tuple(X if X.shape[1] == dims else np.pad(X, ((0, 0), (0, dims - X.shape[1]))) for X in (A, B_))


def distances(A: np.ndarray, B_: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of one matrix and rows j of another, so many at a time that their differences stay small."""
    out, step = np.empty(len(i)), max(1, TILE // max(A.shape[1], 1))
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((A[i[at : at + step]] - B_[j[at : at + step]]) ** 2).sum(1))
    return out


def best_pairs(A: np.ndarray, B_: np.ndarray, k: int, metric: str, barred: Callable[[int, int], tuple[np.ndarray, np.ndarray]], floor: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and score of the k best of each row, and of all that may be as good by rounding, a slice of rows at a time; barred gives
    rows and columns of a slice that don't count."""
    if not len(B_) or k <= 0:
        return
    squares = (A * A).sum(1), (B_ * B_).sum(1)
    step = max(1, TILE // len(B_))
    for at in range(0, len(A), step):
        X = A[at : at + step]
        if metric == "l2":
            # differences of squares choose, with room for their rounding, and exact distances decide
            value = X @ B_.T
            value *= 2
            value -= squares[0][at : at + step, None]
            value -= squares[1]
            room = 1e-9 * (1 + squares[0][at : at + step].max(initial=0) + squares[1].max(initial=0))
        else:
            value, room = cosine_matrix(X, B_), 1e-8
        value[barred(at, at + len(X))] = -np.inf
        if floor is not None:
            value[value < (-(floor * floor) - room if metric == "l2" else floor)] = -np.inf
        bar = np.partition(value, -k, 1)[:, -k] if value.shape[1] > k else np.full(len(X), -np.inf)
        if metric == "l2":
            bar = bar - room - 1e-8 * np.sqrt(np.maximum(np.where(np.isfinite(bar), -bar, 0), 0))
        else:
            bar = bar - room
        i, j = np.nonzero((value >= bar[:, None]) & (value > -np.inf))
        score = distances(X, B_, i, j) if metric == "l2" else value[i, j]
        if metric == "l2" and floor is not None:
            i, j, score = (x[score <= floor] for x in (i, j, score))
        yield i + at, j, score


def nearest(data: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", excluded: Column | None = None, floor: float | None = None, itself: bool = False, without: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score, rank: exact nearest vectors (id, v) of each query (id, v); the query's own id is left out unless itself.

    Vectors that are null, have null or non-finite components, or have no length match nothing; shorter ones count as followed by zeros. Ids may be
    of any type that has an order. excluded rows don't take part, and pairs of without (query_id, doc) don't; a floor drops results in the block where
    they arise. A task holds one block of vectors, a slice of its scores, and k rows a query.
    """
    if excluded is not None:
        data = data.where(~F.coalesce(excluded, F.lit(False)))
    sign = -1.0 if metric == "l2" else 1.0
    kinds = queries.schema["id"].dataType.simpleString(), data.schema["id"].dataType.simpleString()

    def best(q: np.ndarray, A: np.ndarray, skip: list, d: np.ndarray, B_: np.ndarray) -> pd.DataFrame:
        A, B_ = same_width(A, B_)
        by_id = np.argsort(d, kind="stable")
        ids, places = d[by_id], np.argsort(by_id)

        def barred(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            """Places of the queries' own rows and of those that they are to skip."""
            own = [[x] if not itself else [] for x in q[start:end].tolist()]
            gone = [o + list(s if s is not None else ()) for o, s in zip(own, skip[start:end])]
            rows, names = np.repeat(np.arange(end - start), [len(g) for g in gone]), [x for g in gone for x in g]
            if not names or not len(ids):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            names = np.array(names, ids.dtype)
            lo, hi = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
            n = hi - lo
            return np.repeat(rows, n), by_id[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

        out = [(q[:0], d[:0], np.zeros(0))]
        for i, j, score in best_pairs(A, B_, k, metric, barred, floor):
            order = np.lexsort((places[j], -np.round(sign * score, 9), i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            out.append((q[i[first]], d[j[first]], score[first]))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "doc", "score"), zip(*out))})

    asked = usable(queries.select("id", "v"))
    if without is None:
        asked = asked.withColumn("skip", F.array().cast(f"array<{kinds[1]}>"))
    else:
        mine = without.join(data.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi").groupBy(F.col("query_id").alias("id")).agg(F.collect_set("doc").alias("skip"))
        asked = asked.join(mine, "id", "left").withColumn("skip", F.coalesce("skip", F.array().cast(f"array<{kinds[1]}>")))
    found = block_pairs(asked, usable(data.select("id", "v")), best, f"query_id {kinds[0]}, doc {kinds[1]}, score double")
    return top(found, k, "ASC" if metric == "l2" else "DESC")


def angles(A: np.ndarray, B_: np.ndarray) -> np.ndarray:
    """Between rows of length one."""
    return np.arccos(np.clip(A @ B_.T, -1, 1))


def similar_pairs(vectors: DataFrame, threshold: float, key: str | None = None, report: dict | None = None, found: Callable | None = None, schema: StructType | None = None) -> DataFrame:
    """a < b and their cosine, for pairs of vectors (id, v) at or above a threshold; with a key, of equal values only (null equals nothing).

    Angles obey the triangle inequality, so a vector visits only blocks of cells (see cells) that reach within the threshold's angle of it, each pair
    of blocks from one side. Ids may be of any type that has an order; rows of equal id are no pair. A report gets the pairs met and all pairs. What else is to be made of
    pairs is up to found(rows, i, j, cosine), which yields batches of a schema from the columns of vectors; a task holds a slice of two blocks' pairs at a time.
    """
    vectors = usable(vectors).where(F.col("id").isNotNull())
    kind = vectors.schema["id"].dataType.simpleString()
    schema = schema or StructType.fromDDL(f"a {kind}, b {kind}, score double")
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 1

    def unit(values: list) -> np.ndarray:
        X = _matrix(values, dims)
        return X / np.linalg.norm(X, axis=1, keepdims=True)

    names = ["id", "v", *([key] if key else [])] if found is None else vectors.columns
    placed, of = cells.celled(vectors.select(*names), "v", cells.Space(unit, angles), F.xxhash64("id"))
    if of is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # a little more for rounding
    wide = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    home = placed.withColumn("_block", cells.own_block(of, F.xxhash64("id", F.monotonically_increasing_id()))).select(*names, "_block")
    home = checkpointed(home) if of.parts.max() > 1 else home

    @F.pandas_udf("array<int>")
    def later(v: pd.Series, own: pd.Series) -> pd.Series:
        X = unit(list(v))
        visits = of.visits(of.within(angles(X, of.pivots), wide)) if len(X) else []
        return pd.Series([b[b > o].tolist() for b, o in zip(visits, own)], dtype=object)

    visitors = home.withColumn("_block", F.explode(later("v", "_block")))

    def plain(rows: pa.Table, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = rows["id"].combine_chunks()
        a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
        first = pc.less(a, b)
        yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(score)], names=["a", "b", "score"])

    def pairs(rows: pa.Table, left: np.ndarray, right: np.ndarray, X: np.ndarray, kinds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Rows of a table against others of it, a slice at a time; those against themselves once."""
        step = max(1, TILE // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            near = cosine_matrix(X[some], X[right])
            ok = reaching(near, X[some], X[right], threshold)
            if kinds is not None:
                ok &= (kinds[some, None] == kinds[right][None, :]) & (kinds[some, None] >= 0)
            if left is right:
                ok &= some[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            score, i, j = near[i, j], some[i], right[j]
            for k in range(0, len(i), PAIRS):
                yield from (found or plain)(rows, i[k : k + PAIRS], j[k : k + PAIRS], score[k : k + PAIRS])

    def solve(x: pa.Table, y: pa.Table, first: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables([x, y]).combine_chunks()
        X = matrix_of(rows["v"])
        # null is no kind
        kinds = None
        if key:
            of_rows = rows[key].combine_chunks().dictionary_encode()
            kinds = pc.fill_null(of_rows.indices, -1).to_numpy(zero_copy_only=False)
        here, there = np.arange(len(x)), np.arange(len(x), len(rows))
        if len(there) and len(here):
            yield from pairs(rows, here, there, X, kinds)
        if first and len(here):
            yield from pairs(rows, here, here, X, kinds)

    if report is not None:
        n = int(of.size.sum())
        report["all"] = n * (n - 1) // 2
    out = cells.met(home, visitors, solve, schema, F.xxhash64("id", F.monotonically_increasing_id()), report, streamed=True)
    return out.where("a < b") if found is None else out


def reaching(cosines: np.ndarray, A: np.ndarray, B_: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of two matrices' rows reach a threshold; what is within rounding of it is decided by exact sums, alike in whatever blocks two rows meet."""
    ok = cosines >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosines - threshold) < 1e-12)):
        a, b = A[i], B_[j]
        ok[i, j] = math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)) + 1e-12) >= threshold
    return ok


def fused(first: DataFrame, second: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lanes: the fused score, a floor, then the k best; ties as in the first lane, then the second."""
    lanes = first.select("query_id", "doc", F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(second.select("query_id", "doc", F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2")))
    share = F.coalesce(1.0 / (RRF + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("r2")), F.lit(0.0))
    scores = lanes.groupBy("query_id", "doc").agg(F.sum(share).alias("score"), F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    if least is not None:
        scores = scores.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0)).select("query_id", "doc", "score", "rank")


def within_budget(ranked: DataFrame, cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each query's ranking whose costs fit; the first row always stays, a null cost is 1."""
    run = F.sum(F.coalesce(cost, F.lit(1))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("run", run.cast("long")).where((F.col("rank") == 1) | (F.col("run") <= budget))


def topped_up(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first lane, filled to k by rows of the second that it lacks."""
    both = first.select("query_id", "doc", F.lit(0).alias("lane"), "rank").unionByName(second.select("query_id", "doc", F.lit(1).alias("lane"), "rank"))
    best = both.groupBy("query_id", "doc").agg(F.min(F.struct("lane", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.lane", "at.rank", "doc")
    return best.select("query_id", "doc", F.col("at.lane").alias("lane"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
