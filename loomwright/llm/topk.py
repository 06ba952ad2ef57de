"""Exact top-k by inner product: distributed histogram selection.

Every candidate is scored against every query of a block, in tiles. A first
pass counts scores in equal bins per query; sums over all tasks show which bin
holds the k-th highest score, and further passes split that bin until it is
one score wide. A last pass keeps what reaches the k-th score and breaks ties
by the smaller id. Scores are computed anew in each pass and never stored.

A task reports only the bins of its own k highest scores and, at the end, its
own k best rows: the k-th score over all rows is at least as high as over the
rows of any task, so this leaves nothing out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm.common import table

#: Queries of one block: its vectors go to all tasks, so this bounds what is broadcast.
BLOCK_QUERIES = 4096
BINS = 1024
#: Scores computed at a time in a task.
TILE = 1 << 21


def quantise(column: pa.Array, scale: float | None) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which rows take part, and {length: (row numbers, integer matrix)}.

    A vector takes part if it isn't null and has no null or non-finite
    component. scale: components become floor(scale * x).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.isfinite(x)
    if values.null_count:
        good &= ~values.is_null().to_numpy(zero_copy_only=False)
    x = np.floor(x * scale) if scale else x
    x = np.where(good, x, 0)
    lengths = np.diff(offsets)
    sums = np.concatenate([[0.0], np.cumsum(~good)])
    ok = (sums[offsets[1:]] == sums[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == d))
        m = x[offsets[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        out[d] = (rows, m)
    return ok, out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: float64 where no sum can pass 2 ** 53, 64-bit integers below 2 ** 62, Python integers for the rare rest.

    OverflowError if a score itself is beyond a long.
    """
    with np.errstate(over="ignore"):
        a, b = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        bound = a.max(initial=0) * b.max(initial=0)
    if bound < 2.0**52:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    out = np.zeros((len(q), len(c)), np.int64)
    small = a * b.max() < 2.0**62
    some = b * a.max() < 2.0**62
    out[small] = scores(q[small], c) if small.any() else 0
    if some.any() and not small.all():
        out[np.ix_(~small, some)] = scores(q[~small], c[some])
    for i in np.flatnonzero(~small).tolist():
        one = [int(x) for x in q[i].tolist()]
        for j in np.flatnonzero(~some).tolist():
            exact = sum(x * int(y) for x, y in zip(one, c[j].tolist(), strict=True))
            if not -(1 << 63) < exact < 1 << 63:
                raise OverflowError("an inner product does not fit a long")
            out[i, j] = exact
    return out


def _tiles(batch: pa.RecordBatch, queries: dict, scale: float | None):
    """(query numbers, candidate ids, scores) tiles; a query's own rows score the lowest long."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    there = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
    _, by_length = quantise(batch.column(1), scale)
    for d, (rows, m) in by_length.items():
        keep = there[rows]
        rows, m = rows[keep], m[keep]
        if d not in queries or not len(rows):
            continue
        numbers, own, q = queries[d]
        step = max(1, TILE // len(numbers))
        for a in range(0, len(rows), step):
            s = scores(q, m[a : a + step])
            who = ids[rows[a : a + step]].astype(np.int64)
            s[own[:, None] == who[None, :]] = np.iinfo(np.int64).min
            yield numbers, who, s


def _run_block(spark, candidates: DataFrame, block, k: int, scale: float | None) -> DataFrame:
    """The k best of one block of queries: [(query id, components)]."""
    ids = np.array([r[0] for r in block], np.int64)
    vectors = pa.array([r[1] for r in block], pa.list_(pa.float64()))
    _, by_length = quantise(vectors, None)
    n = len(ids)
    sides = {d: (rows, ids[rows], m) for d, (rows, m) in by_length.items()}
    shared = spark.sparkContext.broadcast(sides)
    # Scores lie within the norms' product; a pass narrows each query's range by BINS.
    low, high = np.zeros(n, object), np.zeros(n, object)
    norms = candidates.select(F.max(_norm(scale))).first()[0] or 0.0
    for rows, _, m in sides.values():
        with np.errstate(over="ignore"):
            reach = np.minimum(np.ceil(np.sqrt((m * m).sum(axis=1)) * np.sqrt(float(norms))) * (1 + 2.0**-40) + 1, 2.0**63 - 2.0**11)
        for i, r in zip(rows.tolist(), reach.tolist(), strict=True):
            low[i], high[i] = -int(r) - 1, int(r) + 1  # high is exclusive
    above = np.zeros(n, np.int64)  # scores at or over `high`
    done = np.zeros(n, bool)  # fewer than k candidates: all are kept
    while True:
        live = [i for i in range(n) if not done[i] and high[i] - low[i] > 1]
        if not live:
            break
        width = np.array([max(1, -(-(high[i] - low[i]) // BINS)) for i in range(n)], np.int64)
        counts = _histogram(candidates, shared, np.array(low, np.int64), np.array(high, np.int64), width, set(live), k, scale)
        for i in live:
            seen = int(above[i])
            for b, c in sorted(counts.get(i, {}).items(), reverse=True):
                if seen + c >= k:
                    base = low[i]
                    low[i], high[i] = base + b * int(width[i]), min(high[i], base + (b + 1) * int(width[i]))
                    above[i] = seen
                    break
                seen += c
            else:
                done[i] = True
    floor = np.array([np.iinfo(np.int64).min + 1 if done[i] else low[i] for i in range(n)], np.int64)
    return _best(candidates, shared, floor, k, scale)


def _norm(scale: float | None):
    square = lambda x: F.pow(F.floor(x.cast("double") * scale) if scale else x.cast("double"), 2)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.coalesce(square(x), F.lit(float("nan"))))
    return F.when(F.isnan(total), None).otherwise(total)


def _histogram(candidates, shared, low, high, width, live, k, scale):
    """{query number: {bin: count}} over all candidates, from the bins of each task's k highest scores in range."""
    live = np.array(sorted(live))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(low), BINS), np.int32)
        on = np.zeros(len(low), bool)
        on[live] = True
        for batch in batches:
            for numbers, _, s in _tiles(batch, shared.value, scale):
                use = on[numbers]
                numbers, s = numbers[use], s[use]
                inside = (s >= low[numbers][:, None]) & (s < high[numbers][:, None])
                at, col = np.nonzero(inside)
                if len(at):
                    q = numbers[at]
                    np.add.at(held, (q, ((s[at, col].view(np.uint64) - low[q].view(np.uint64)) // width[q].view(np.uint64)).astype(np.int64)), 1)
        # the bins from the top down to the one in which the task's k-th score lies
        from_top = np.cumsum(held[:, ::-1], axis=1)[:, ::-1]
        q, b = np.nonzero((held > 0) & (from_top - held < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(held[q, b].astype(np.int64))], names=["q", "b", "c"])

    found: dict[int, dict[int, int]] = {}
    # at most k bins a query and task go in; out come a block's queries times their top bins
    for r in candidates.mapInArrow(run, "q int, b int, c long").groupBy("q", "b").agg(F.sum("c").alias("c")).groupBy("q").agg(F.collect_list(F.struct("b", "c")).alias("bins")).toLocalIterator():
        found[r.q] = {x.b: x.c for x in r.bins}
    return found


def _best(candidates, shared, floor, k, scale) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for numbers, who, s in _tiles(batch, shared.value, scale):
                at, col = np.nonzero(s >= floor[numbers][:, None])
                if len(at):
                    new = (numbers[at].astype(np.int64), who[col], s[at, col])
                    kept = tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
                    order = np.lexsort((kept[1], -kept[2], kept[0]))
                    kept = tuple(x[order] for x in kept)
                    first = np.searchsorted(kept[0], kept[0])
                    top = np.arange(len(first)) - first < k
                    kept = tuple(x[top] for x in kept)
        name = np.zeros(len(floor), np.int64)
        for rows, own, _ in shared.value.values():
            name[rows] = own
        yield pa.RecordBatch.from_arrays([pa.array(name[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    best = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float | None = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k highest integer inner products among all vectors but those with its own id.

    vectors and queries: id_column (long) and vector_column (array of numbers).
    Ties go to the smaller id. Fewer than k candidates: all. Vectors of
    another length than the query's are no candidates of it.

    A vector takes no part if it or its id is null or it has null or non-finite
    components. Scores are exact whatever their size; one beyond a long is an
    error (OverflowError), for it can't be returned.
    Repeated rows are candidates each. An id that queries hold more than once
    is one query, its smallest vector. Empty tables give no rows. Other columns
    are ignored.

    Queries come in blocks of at most block_queries; the vectors of one block
    are what the driver and each task hold, however many rows there are.
    """
    spark = vectors.sparkSession
    candidates = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec"))
    step = lambda x: F.floor(x.cast("double") * scale).cast("double") if scale else x.cast("double")
    clean = F.col(vector_column).isNotNull() & ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    mine = queries.where(F.col(id_column).isNotNull() & clean).select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, step).alias("vec"))
    mine = mine.groupBy("id").agg(F.min("vec").alias("vec"))
    out = None
    for block in _blocks(mine, block_queries):
        part = _run_block(spark, candidates, block, k, scale)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _blocks(queries: DataFrame, size: int):
    """Lists of at most size queries: one job reads them in order, a partition at a time."""
    block: list = []
    for row in queries.toLocalIterator():
        block.append((row.id, row.vec))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
with part as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from part q join part c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
QUERIES = {"op1_topk": op1_topk}
SQL = {"op1_topk": OP1_SQL}
