"""Exact top-k by inner product as a Voronoi kNN join (Lu et al. 2012, for inner products).

Vectors are grouped by their nearest pivot. Summaries of the groups (counts, radii, norms and the
distances nearest to the pivot) give each query group a score that its k-th best cannot fall
below; a vector is sent to a query group only if its best possible score there reaches that
bound. Groups are solved locally in blocks, and the blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import cut

#: Pivots; candidates and queries of one local block at most, on average.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 16, 16_384, 4_096


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); vectors that are null or hold null or non-finite values go."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    floor = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(F.coalesce(usable, F.lit(False))).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), floor.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where no sum can reach 2**53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, is_query, k: int = 20, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores over all rows but its own id.

    vectors: vec_id, v (array of long). is_query: condition on vec_id. Ties go to the smaller
    vec_id; repeated ids count as often as they stand there, save a query's own. Only pivots and
    summaries, both of a fixed number of rows, come to the driver.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.select("vec_id", "v"), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = [r["v"] for r in vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()]
    if not pivots:
        return empty
    dim = vectors.agg(F.max(F.size("v"))).first()[0]
    centre = np.zeros((len(pivots), dim))
    for i, p in enumerate(pivots):
        centre[i, : len(p)] = p

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(float)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1), 0))
            group = d.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(group, pa.int32()), pa.array(d[np.arange(len(d)), group]), pa.array(np.sqrt((x * x).sum(1)))], names=["vec_id", "v", "grp", "dist", "norm"])

    placed = vectors.mapInArrow(assign, "vec_id long, v array<long>, grp int, dist double, norm double")
    placed = cut(placed.withColumn("query", is_query), "placed")
    groups = placed.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("query").alias("nq"), F.max(F.when(F.col("query"), F.col("dist"))).alias("radius"), F.max(F.when(F.col("query"), F.col("norm"))).alias("norm")).collect()
    if not any(g["nq"] for g in groups):
        return empty
    # rows that may share a query's id, itself included, don't count towards its bound
    same = min(placed.groupBy("vec_id").count().agg(F.max("count")).first()[0], 4 * k)
    # the nearest distances of each group, by a partial top-k
    near = placed.select("grp", "dist", F.row_number().over(Window.partitionBy("grp").orderBy("dist")).alias("i")).where(F.col("i") <= k + same).collect()
    slack = 1e-6 * (1 + float(np.abs(centre).max()))
    asked = [g for g in groups if g["nq"]]
    bound, radius, at, pieces = {}, {}, {}, {}
    for g in asked:
        p, r = centre[g["grp"]], g["radius"] + slack
        # a vector at distance d of pivot c scores at least q.c - |q| d for each query q of the group
        low = sorted((float(p @ centre[x["grp"]]) - r * float(np.linalg.norm(centre[x["grp"]])) - (g["norm"] + slack) * (x["dist"] + slack) for x in near), reverse=True)
        bound[g["grp"]] = low[k + same - 1] - 1 if len(low) >= k + same and same < 4 * k else -np.inf
        radius[g["grp"]] = r
        pieces[g["grp"]] = max(1, -(-g["nq"] // QUERY_ROWS))
    total = sum(g["n"] for g in groups)
    blocks = max(1, -(-total // BLOCK_ROWS))
    numbers = sorted(bound)
    pivot = centre[numbers]
    limits, reach = np.array([bound[g] for g in numbers]), np.array([radius[g] for g in numbers])

    def replicate(batches):
        """A row for each query group that may need the vector."""
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(float)
            best = x @ pivot.T + np.sqrt((x * x).sum(1))[:, None] * reach
            row, col = np.nonzero(best + slack * (1 + np.abs(best)) >= limits)
            if len(row):
                picked = batch.take(pa.array(row))
                yield pa.record_batch([*picked.columns, pa.array(np.array(numbers, np.int32)[col], pa.int32())], names=["vec_id", "v", "grp"])

    data = placed.select("vec_id", "v").mapInArrow(replicate, "vec_id long, v array<long>, grp int")
    many = F.create_map(*[F.lit(x) for g in numbers for x in (g, pieces[g])])
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), many[F.col("grp")] - 1))).withColumn("query", F.lit(False))
    queries = placed.where("query").select("vec_id", "v", "grp").withColumn("piece", F.pmod(F.xxhash64("vec_id"), many[F.col("grp")]).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(True))

    def solve(table: pa.Table) -> pa.Table:
        mark = table.column("query").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        x = _matrix(table.column("v"), dim)
        order = np.flatnonzero(~mark)[np.argsort(ids[~mark], kind="stable")]
        out: list[tuple[np.ndarray, ...]] = []
        asks = np.flatnonzero(mark)
        for i in range(0, len(asks), 256):
            part = asks[i : i + 256]
            scores = _products(x[part], x[order])
            for q, row in zip(part, scores, strict=True):
                allowed = np.flatnonzero(ids[order] != ids[q])
                if len(allowed) > k:
                    least = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
                    above = allowed[row[allowed] > least]
                    allowed = np.concatenate([above, allowed[row[allowed] == least][: k - len(above)]])
                out.append((np.full(len(allowed), ids[q]), ids[order][allowed], row[allowed]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = data.unionByName(queries).groupBy("grp", "piece", "block").applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
