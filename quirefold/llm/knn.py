"""Exact top-k search by a Voronoi kNN join.

Vectors are dealt to the cell of their nearest pivot. Each cell's summary (rows, radius, largest norm, smallest distances
to the pivot) bounds every inner product with a query q: for o in the cell of pivot p at distance d,
``q.p - |q| d <= q.o <= q.p + |q| d``. The lower bounds give each query a score its k-th answer must reach; a query goes
only to cells whose upper bound reaches it, and each cell is solved locally. Large cells are cut into salted chunks and
the queries of a cell into blocks, so a task holds a bounded number of rows however common one vector is; a cell's rows are copied to
the blocks that need the cell, and to no others.

Defined results: vectors that are null, hold a null or non-finite component, or one whose scaled floor is no 64-bit integer
take no part, nor do rows with a null id. Vectors of unequal length are padded with zeros. Rows that share the query's id
are its own and never its answers; of several query rows with one id the largest vector is the query. Repeated rows of other
ids are answers of their own. Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import read, store

#: Pivots: a quarter of the root of the row count, within these bounds; the pivots and summaries of all cells are broadcast.
PIVOTS = (4, 256)
#: Most data rows of a chunk, and most queries of a block.
CHUNK_ROWS, BLOCK_QUERIES = 16_384, 8_192


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of vectors that take part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    odd = F.exists(F.col(vec_col), lambda x: F.coalesce(F.isnan(x) | (F.abs(scaled(x)) >= 2.0**63), F.lit(True)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~odd)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: F.floor(scaled(x))).alias("v"))


def _matrix(col: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    size = np.diff(off)
    width = max(int(size.max(initial=0)), dims or 0)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two blocks."""
    a, b = _same_width(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:  # every partial sum is an exact double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, p = (z.astype(np.float64) for z in _same_width(x, p))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :], 0))


def _blocks(homes: dict[int, int], apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the first block of its queries and how many it has. Cells follow each other from one to the nearest that is
    left, and share a block while their queries fit; a cell of more than ``most`` queries has blocks of its own."""
    first, n_blocks = np.zeros(len(apart), np.int64), np.ones(len(apart), np.int64)
    left, at, block, filled = set(homes), min(homes), -1, most
    while left:
        left.remove(at)
        if homes[at] > most:
            n_blocks[at] = -(-homes[at] // most)
            first[at], block, filled = block + 1, block + n_blocks[at], most
        else:
            if filled + homes[at] > most:
                block, filled = block + 1, 0
            first[at], filled = block, filled + homes[at]
        at = min(left, key=lambda c: (apart[at, c], c), default=None)
    return first, n_blocks


def top_k(data: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES, pivots: tuple[int, int] = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): the k rows of ``data`` with the highest integer inner product for each row of ``queries``."""
    spark = data.sparkSession
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    base = integer_vectors(data, id_col, vec_col, scale)
    n = base.count()
    if not n:
        return empty
    n_pivots = min(max(round(math.sqrt(n) / 4), pivots[0]), pivots[1])
    chosen = base.orderBy(F.xxhash64("id"), "id", "v").limit(n_pivots).collect()
    pivot_ids = np.array([r["id"] for r in chosen])
    width = max(len(r["v"]) for r in chosen)
    pivot = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in chosen], np.int64).reshape(len(chosen), width)

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _matrix(part.column(1))
                d = _distances(x, pivot)
                cell = d.argmin(1)
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array(norm), part.column(0), part.column(1)], ["cell", "dist", "norm", "id", "v"])

    dealt = store(base.mapInArrow(deal, "cell int, dist double, norm double, id long, v array<long>"), "knn-cells")
    stats = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm"))
    # Of each id its nearest row, and of these the k + 1 nearest: whatever the query's id, k rows of others stay.
    near = dealt.groupBy("cell", "id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id"))).where(F.col("r") <= k + 1)
    nearest = near.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("nearest"))  # k + 1 values each
    summary = sorted(stats.join(nearest, "cell").collect(), key=lambda r: r["cell"])  # one row a pivot
    cells = np.array([r["cell"] for r in summary])
    radius = np.array([r["radius"] for r in summary])
    norm = np.array([r["norm"] for r in summary])
    close, close_id = np.full((len(cells), k + 1), np.inf), np.zeros((len(cells), k + 1), np.int64)
    for i, r in enumerate(summary):
        for j, x in enumerate(r["nearest"]):
            close[i, j], close_id[i, j] = x["dist"], x["id"]
    n_chunks = {r["cell"]: -(-r["n"] // chunk_rows) for r in summary}

    def home(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                near = _distances(_matrix(part.column(1)), pivot).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32))], ["id", "v", "home"])

    # Queries of one cell need much the same cells, so they share blocks, together with those of cells nearby while there is room.
    asked = store(integer_vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.max("v").alias("v")).mapInArrow(home, "id long, v array<long>, home int"), "knn-asked")
    homes = {r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}  # one row a pivot
    if not homes:
        return empty
    first_block, n_blocks = _blocks(homes, _distances(pivot, pivot), block_queries)

    def route(batches):
        """One row for each cell chunk and query block, with the queries that need it packed together."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1))
                dot = products(q, pivot).astype(np.float64)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
                slack = 1e-6 * (1 + np.abs(dot).max() + length * radius.max(initial=0))  # for the rounding of distances
                low = dot[:, cells, None] - length[:, :, None] * close[None]
                low[~np.isfinite(close)[None].repeat(len(q), 0) | (close_id[None] == ids[:, None, None])] = -np.inf  # rows of the query's id are no answers
                low = low.reshape(len(q), -1)
                floor = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] >= k else np.full(len(q), -np.inf)
                known = np.where(ids[:, None] == pivot_ids[None], -np.inf, dot)
                if known.shape[1] >= k:
                    floor = np.maximum(floor, -np.partition(-known, k - 1, axis=1)[:, k - 1])
                floor = floor[:, None] - slack
                high = np.minimum(dot[:, cells] + length * radius[None], length * norm[None]) + slack
                at_home = part.column(2).to_numpy()
                block = first_block[at_home] + ids % n_blocks[at_home]
                for j, cell in enumerate(cells.tolist()):
                    for blk in np.unique(block).tolist():
                        need = np.flatnonzero((high[:, j] >= floor[:, 0]) & (block == blk))
                        if len(need):
                            m = n_chunks[cell]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([cell] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([blk] * m, pa.int32()), pa.array([q.shape[1]] * m, pa.int32()), pa.array([ids[need].tobytes()] * m, pa.binary()), pa.array([q[need].tobytes()] * m, pa.binary()), pa.array([floor[need, 0].tobytes()] * m, pa.binary())],
                                ["cell", "chunk", "block", "dims", "ids", "vectors", "floors"],
                            )

    # Stored, as it says which cells meet which blocks, and only these are copied: (cell, block) pairs, a few bytes each.
    routed = store(asked.mapInArrow(route, "cell int, chunk int, block int, dims int, ids binary, vectors binary, floors binary"), "knn-routed")
    needs = routed.groupBy("cell").agg(F.sort_array(F.collect_set("block")).alias("blocks"))  # one row a pivot
    parts = F.create_map(*[x for c, m in n_chunks.items() for x in (F.lit(c), F.lit(m))])
    chunk = F.pmod(F.xxhash64("id", "v", "salt"), parts[F.col("cell")]).cast("int").alias("chunk")
    chunks = dealt.withColumn("salt", F.monotonically_increasing_id()).join(needs, "cell").select("cell", chunk, F.explode("blocks").alias("block"), "id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), _matrix(left.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for r in right.to_pylist():
                qid = np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["vectors"], np.int64).reshape(len(qid), r["dims"])
                floor = np.frombuffer(r["floors"], np.float64)
                for at in range(0, len(qid), 256):
                    score = products(q[at : at + 256], x)
                    own = qid[at : at + 256, None] == ids[None]
                    for i in range(len(score)):
                        ok = np.flatnonzero(~own[i] & (score[i] >= floor[at + i]))
                        best = ok[np.argsort(-score[i][ok], kind="stable")[:k]]  # ids rise, so ties go to the smaller
                        out = [np.concatenate([o, z]) for o, z in zip(out, (np.full(len(best), qid[at + i]), ids[best], score[i][best]))]
        return pa.table({"query_id": out[0], "id": out[1], "score": out[2]})

    key = ["cell", "chunk", "block"]
    found = chunks.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, o.vec_id, list_inner_product(q.e, o.e)::bigint as score
  from v q join v o on o.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 10
"""
QUERIES = {"op1_voronoi_knn": op1_voronoi_knn}
ORACLE_SQL = {"op1_voronoi_knn": SQL}
