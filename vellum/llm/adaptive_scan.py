"""Approximate nearest neighbours: probed lists, scanned in column blocks of rotated vectors with early abandoning.

Vectors lie in lists around centroids fitted on a bounded sample. They are
turned by a random rotation and stored one Parquet column per block of
dimensions. After a rotation the distance over d of D dimensions, scaled up by
sqrt(D / d), is an estimate of the whole distance with an error that falls like
1 / sqrt(d), so after each block a hypothesis test abandons the candidates that
lie beyond the kth distance known so far. What survives is measured in double
precision on the original vectors. A first round scans the nearest list of each
query, which gives the bound with which the other lists are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import stage_table

#: Expected number of vectors the centroids and the share of lists to probe are fitted on; lists at most.
FIT_ROWS, MAX_LISTS = 32_768, 4_096
#: Rows of a list and queries that meet in one task; rows scanned before the bounds are tightened again.
CELL_ROWS, CELL_QUERIES, STEP_ROWS = 8_192, 512, 512
#: Dimensions of a column block; strictness of the test (larger abandons less); share of true neighbours in the probed lists.
BLOCK, STRICT, AIM = 16, 3.0, 0.985
SEED = 20240607


def usable(vector: Column) -> Column:
    """Not null, some component not zero, none null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


class Lists:
    """Centroids of the lists and how many of them a query has to probe."""

    def __init__(self, centroids: np.ndarray, probes: int) -> None:
        self.centroids, self.probes = centroids, probes

    def nearest(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The `count` lists nearest to each vector, nearest first."""
        out = np.empty((len(vectors), count), np.int32)
        for low in range(0, len(vectors), 1_024):
            far = _squared(vectors[low : low + 1_024], self.centroids)
            out[low : low + 1_024] = np.argsort(far, axis=1, kind="stable")[:, :count] if count > 1 else far.argmin(1)[:, None]
        return out


def fit_lists(sample: np.ndarray, lists: int, k: int, rounds: int = 8) -> Lists:
    """K-means on a sample; then the least number of probes that meets `AIM` of the true k neighbours of some of it.

    The sample is thinner than the whole table, so its neighbours lie further
    apart and in more lists than those of the table: the number is on the safe side.
    """
    random = np.random.default_rng(SEED)
    lists = min(lists, len(sample))
    centroids = sample[random.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = Lists(centroids, 1).nearest(sample, 1)[:, 0]
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], sample[random.permutation(len(sample))[:lists]])
    found = Lists(centroids, lists)
    if lists > 1:
        tried = random.permutation(len(sample))[:256]
        near = found.nearest(sample, 1)[:, 0]
        far = _squared(sample[tried], sample)
        far[np.arange(len(tried)), tried] = np.inf
        true = np.argsort(far, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.empty((len(tried), lists), np.int64)
        np.put_along_axis(place, found.nearest(sample[tried], lists).astype(np.int64), np.arange(lists)[None], axis=1)
        need = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
        found.probes = int(need[min(len(need) - 1, int(AIM * len(need)))]) + 1
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1) for p in parts if len(p)]).astype(kind)


def _blocks(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def scan(columns: list[np.ndarray], originals: np.ndarray, turned: np.ndarray, queries: np.ndarray, bound: np.ndarray, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance) of rows that no test abandoned and that lie within the bound known when they were met.

    `columns` are the blocks of the rotated rows, `turned` the rotated and
    `queries` the original queries. `bound` holds the wanted-th distance known
    of each query and shrinks in place.
    """
    dims, best = queries.shape[1], np.full((len(queries), wanted), np.inf)
    for low in range(0, len(originals), STEP_ROWS):
        high = min(low + STEP_ROWS, len(originals))
        edges = _blocks(dims)
        a, b = edges[0]
        partial = _squared(turned[:, a:b], columns[0][low:high])
        limit = lambda d: (bound * (1 + STRICT / np.sqrt(d))) ** 2 * (d / dims) if d < dims else (bound * (1 + 1e-4)) ** 2 + 1e-9
        q, row = np.nonzero(partial <= limit(b)[:, None])
        partial = partial[q, row]
        for (a, b), column in zip(edges[1:], columns[1:]):
            apart = column[low + row] - turned[q, a:b]
            partial = partial + (apart * apart).sum(1)
            keep = partial <= limit(b)[q]
            q, row, partial = q[keep], row[keep], partial[keep]
        apart = originals[low + row] - queries[q]
        exact = np.sqrt((apart * apart).sum(1))
        keep = exact <= bound[q]
        q, row, exact = q[keep], row[keep], exact[keep]
        yield q, low + row, exact
        # tighten the bounds with the wanted best of each query
        order = np.lexsort((exact, q))
        q, exact = q[order], exact[order]
        first = np.searchsorted(q, q)
        nth = np.arange(len(q)) - first
        own = nth < wanted
        fresh = np.full_like(best, np.inf)
        fresh[q[own], nth[own]] = exact[own]
        best = np.sort(np.concatenate([best, fresh], axis=1), axis=1)[:, :wanted]
        np.minimum(bound, best[:, -1], out=bound)


def _cell(wanted: int):
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "score": []}
        if len(rows) and len(asked):
            columns = [_matrix(rows[c], np.float64) for c in rows.column_names if c.startswith("block_")]
            queries = _matrix(asked["vector"], np.float64)
            bound = asked["bound"].to_numpy().astype(np.float64).copy()
            pieces = list(scan(columns, _matrix(rows["vector"], np.float64), queries @ rotation(queries.shape[1]), queries, bound, wanted))
            q, row, score = (np.concatenate(x) for x in zip(*pieces))
            keep = score <= bound[q]
            q, row, score = q[keep], row[keep], score[keep]
            ids = rows["ids"].combine_chunks()
            size = ids.value_lengths().to_numpy()[row]
            start = ids.offsets.to_numpy()[row] - ids.offsets[0].as_py()
            flat = ids.flatten().to_numpy()
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            found, q, score = flat[np.repeat(start, size) + inner], np.repeat(q, size), np.repeat(score, size)
            # an id counts once, with its least distance
            order = np.lexsort((score, found, q))
            q, found, score = q[order], found[order], score[order]
            once = np.ones(len(q), bool)
            once[1:] = (q[1:] != q[:-1]) | (found[1:] != found[:-1])
            q, found, score = q[once], found[once], score[once]
            order = np.lexsort((found, score, q))
            q, found, score = q[order], found[order], score[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < wanted
            out = {"query": asked["query"].to_numpy()[q[top]], "id": found[top], "score": score[top]}
        return pa.table({"query": pa.array(out["query"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return work


def _distinct(rows: DataFrame, row_id: str, vector: str, dims: int, keep: int) -> DataFrame:
    """(vector, ids): equal vectors are one entry with their `keep` smallest ids, cut inside the tasks before anything is shuffled."""
    right = rows.filter(F.col(row_id).isNotNull() & (F.size(vector) == dims)).filter(usable(F.col(vector)))
    # -0 and 0 are one value
    pairs = right.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: x + 0).alias("vector")).distinct()
    nth = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= keep).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(points: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Lists, int]:
    """The staged index (list, vector, ids, block_0, block_1, ...), its lists, and the number of dimensions.

    The commonest length of a vector is the number of dimensions (the greater
    one of a tie). Every usable vector of that length is in the index; only the
    centroids come from a sample.
    """
    spark = points.sparkSession
    lengths = points.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths.d if lengths else 0
    entries = stage_table(_distinct(points, row_id, vector, dims, k + 1))
    total = entries.count()
    share = min(1.0, 1.1 * FIT_ROWS / max(1, total))
    drawn = entries.filter(F.pmod(F.xxhash64("vector", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else entries
    sample = drawn.select("vector").limit(2 * FIT_ROWS).toArrow()
    lists = Lists(np.zeros((1, max(1, dims))), 1)
    if total:
        values = _matrix(sample["vector"], np.float64)
        values = values[np.lexsort(values.T[: min(8, dims)])]
        lists = fit_lists(values, int(np.clip(round(total**0.5), 1, MAX_LISTS)), k)
    kept = spark.sparkContext.broadcast(lists)
    blocks = _blocks(dims)
    schema = T.StructType([*entries.schema.fields, T.StructField("list", T.IntegerType()), *[T.StructField(f"block_{j}", T.ArrayType(T.FloatType())) for j in range(len(blocks))]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(0), np.float64)
                turned = (values @ rotation(dims)).astype(np.float32)
                columns = [pa.array(kept.value.nearest(values, 1)[:, 0], pa.int32())]
                for a, b in blocks:
                    edges = np.arange(len(values) + 1, dtype=np.int32) * (b - a)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(turned[:, a:b]).ravel())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return stage_table(entries.mapInArrow(place, schema)), lists, dims


def search(points: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every query but itself, by Euclidean distance and then by id.

    Vectors that are null, zero, of another length than most, or that hold null
    or non-finite components take no part, nor do null ids. Equal vectors are
    searched and stored once. An id that comes with several vectors counts once,
    with its least distance. With fewer than k other rows all that were found
    are returned; an empty table gives no rows. Other columns play no part.

    A list is cut into cells of bounded rows and queries, so neither a list nor
    the queries of one list have to fit into a task. The share of lists probed
    is fitted on the sample; `AIM` of the neighbours is what it is fitted for.
    """
    index, lists, dims = build_index(points, k, row_id, vector)
    asked = queries.filter(F.col(row_id).isNotNull() & (F.size(vector) == dims)).filter(usable(F.col(vector)))
    asked = asked.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: x + 0).alias("vector")).distinct()
    # equal queries are searched once, under the smallest of their ids
    groups = asked.groupBy("vector").agg(F.min("id").alias("query"))
    members = stage_table(asked.join(groups.hint("merge"), "vector").select("id", "query", "vector"))
    single = stage_table(members.groupBy("query", "vector").agg(F.count("*").alias("n")).select("query", "vector"))
    kept = members.sparkSession.sparkContext.broadcast(lists)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = kept.value.nearest(_matrix(batch.column(1), np.float64), kept.value.probes)
                edges = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(edges), pa.array(near.ravel(), pa.int32()))], names=["query", "vector", "lists"])

    probes = stage_table(single.mapInArrow(probe, T.StructType([*single.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])))
    # at most MAX_LISTS rows each
    rows_of = index.groupBy("list").agg(F.count("*").alias("rows"))

    def round_of(asked: DataFrame) -> DataFrame:
        """Scans the probed lists of asked(query, vector, bound, list)."""
        queries_of = asked.groupBy("list").agg(F.count("*").alias("queries"))
        cells = F.broadcast(rows_of.join(F.broadcast(queries_of), "list").select(
            "list", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("row_cells"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("query_cells")))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = index.join(cells, "list").select(*index.columns, part("vector", "row_cells").alias("row_cell"), every("query_cells").alias("query_cell"))
        right = asked.join(cells, "list").select(*asked.columns, part("query", "query_cells").alias("query_cell"), every("row_cells").alias("row_cell"))
        cell = ["list", "row_cell", "query_cell"]
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k + 1), "query long, id long, score double")

    place = W.partitionBy("query").orderBy("score", "id")
    cut = lambda found: found.groupBy("query", "id").agg(F.min("score").alias("score")).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1).drop("nth")
    first = stage_table(cut(round_of(probes.select("query", "vector", F.lit(float("inf")).alias("bound"), F.col("lists")[0].alias("list")))))
    bounds = first.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("far"))
    rest = probes.join(bounds, "query", "left").select(
        "query", "vector", F.when(F.col("n") > k, F.col("far")).otherwise(float("inf")).alias("bound"), F.explode(F.slice("lists", 2, lists.centroids.shape[0])).alias("list"))
    found = stage_table(cut(first.unionByName(round_of(stage_table(rest)))))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    answers = members.select(F.col("id").alias("query_id"), "query").join(found, "query").filter(F.col("id") != F.col("query_id")).groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
