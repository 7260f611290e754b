"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances: every vector x gets the coordinate
``sqrt(M^2 - |x|^2)`` (M the greatest norm) and every query is scaled to length M
with 0 there, so a greater product is a smaller distance. Data fall into the cells
of a bounded set of pivots. A summary of every cell, its rows nearest to the pivot,
gives each query a distance within which its k results lie. Queries of neighbouring
cells form groups; for a group and a cell the triangle inequality leaves one ring
of distances to the pivot, and only rows in it are copied to the group, where
blocks of rows are compared by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, list_matrix, whole_numbers

#: Vectors that serve as pivots; with k, they bound the summaries.
PIVOTS = 128
#: Queries of a group and rows of a block: what one task holds at a time.
GROUP = 2048
ROWS = 4096
#: Entries beyond this are refused: products of up to 64 of them would not fit a long.
LARGEST = 2**28


class _Space:
    """The vectors as points: number of dimensions, greatest norm, pivots."""

    def __init__(self, d: int, most: int, norm2: int, pivots: np.ndarray):
        self.d, self.norm2 = d, norm2
        self.norm = float(np.sqrt(norm2))
        self.kind = np.int16 if most < 2**15 else np.int64
        self.exact = d * most * most < 2**53
        self.pivots = self.points(pivots)
        # Distances are differences of squares in doubles; bounds give way by this much.
        self.slack = 1e-5 * max(self.norm, 1.0)

    def unpack(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.d).astype(np.float64 if self.exact else np.int64)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0.0))
        return np.c_[x, rest]

    def factor(self, q: np.ndarray) -> np.ndarray:
        """What scales each query to length M; a zero query stays."""
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        return np.where(norm > 0, self.norm / np.maximum(norm, 1e-300), 0.0)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q * self.factor(q)[:, None], np.zeros(len(q))]

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2.0 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))


def _place(space):
    def run(batches):
        for batch in batches:
            x = list_matrix(batch.column(1), space.d)
            far = space.distances(space.points(x))
            cell = far.argmin(axis=1)
            packed = pa.array([row.tobytes() for row in x.astype(space.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(i) for i in (2, 3, 4)], packed, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell])],
                ["vec_id", "copies", "asks", "id", "v", "cell", "dist"],
            )

    return run


def _first_bounds(space, seeds, seed_ids, k):
    """Each query's cell, its k-th best product among the summaries and the distance that stands for it."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            q = space.unpack(batch.column(names.index("v")))
            cell = space.distances(space.queries(q)).argmin(axis=1)
            own = np.array([seed_ids.get(i, -1) for i in batch.column(names.index("id")).to_pylist()], dtype=np.int64)
            enough = len(seeds) - (own >= 0) >= k
            best = np.zeros(len(q), dtype=np.int64)
            for at in range(0, len(q), 256):
                scores = (q[at : at + 256] @ seeds.T).astype(np.int64)
                mine = np.flatnonzero(own[at : at + 256] >= 0)
                scores[mine, own[at : at + 256][mine]] = np.iinfo(np.int64).min
                if scores.shape[1] >= k:
                    best[at : at + 256] = np.partition(scores, -k, axis=1)[:, -k]
            factor = space.factor(q)
            squares = np.where(factor > 0, space.norm2, 0.0) + space.norm2 - 2.0 * factor * best
            within = np.where(enough, np.sqrt(np.maximum(squares, 0.0)) + space.slack, np.inf)
            least = pa.array(best, mask=~enough)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in ("vec_id", "asks", "id", "v")] + [pa.array(cell.astype(np.int32)), least, pa.array(within)],
                ["vec_id", "asks", "id", "v", "cell", "least", "within"],
            )

    return run


def _rings(space):
    """Per query group and cell: from which to which distance to the pivot a row may matter."""

    def run(batches):
        for batch in batches:
            far = space.distances(space.queries(space.unpack(batch.column(1))))
            within = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            group = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = far - within - space.slack, far + within + space.slack
            found, where = np.unique(group, return_inverse=True)
            lo, hi = np.full((len(found), far.shape[1]), np.inf), np.full((len(found), far.shape[1]), -np.inf)
            np.minimum.at(lo, where, low)
            np.maximum.at(hi, where, high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(found, far.shape[1])), pa.array(np.tile(np.arange(far.shape[1], dtype=np.int32), len(found))), pa.array(lo.ravel()), pa.array(hi.ravel())],
                ["group", "cell", "lo", "hi"],
            )

    return run


def _solve(space, k):
    def run(_, queries, rows):
        rows = rows.sort_by([("vec_id", "ascending"), ("id", "ascending")])
        q, x = space.unpack(queries.column("v")), space.unpack(rows.column("v"))
        known = {own: i for i, own in enumerate(rows.column("id").to_pylist())}
        own = np.array([known.get(i, -1) for i in queries.column("id").to_pylist()], dtype=np.int64)
        copies = rows.column("copies").to_numpy()
        least = queries.column("least").fill_null(np.iinfo(np.int64).min).to_numpy()
        qi, xi, si = [], [], []
        step = max(1, 2**20 // max(len(x), 1))
        for at in range(0, len(q) if len(x) else 0, step):
            scores = (q[at : at + step] @ x.T).astype(np.int64)
            hit = scores >= least[at : at + step, None]
            # A query's own row is no candidate, unless the same row is there again.
            mine = own[at : at + step]
            alone = np.flatnonzero((mine >= 0) & (copies[mine] == 1))
            hit[alone, mine[alone]] = False
            r, c = np.nonzero(hit)
            s = scores[r, c]
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            first = np.searchsorted(r, np.arange(hit.shape[0]))
            near = np.arange(len(r)) - first[r] < k
            qi.append(r[near] + at)
            xi.append(c[near])
            si.append(s[near])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        qi, xi, si = join(qi).astype(np.int64), join(xi).astype(np.int64), join(si).astype(np.int64)
        asks, takes = pa.array(qi), pa.array(xi)
        return pa.table(
            {
                "query": queries.column("id").take(asks),
                "query_id": queries.column("vec_id").take(asks),
                "asks": queries.column("asks").take(asks),
                "vec_id": rows.column("vec_id").take(takes),
                "copies": pa.array(np.where(own[qi] == xi, copies[xi] - 1, copies[xi]) if len(qi) else np.zeros(0, np.int64)),
                "score": pa.array(si),
            }
        )

    return run


def _group_of(counts: dict[int, int], pivots: np.ndarray, size: int) -> tuple[list[int], list[int], int]:
    """First group and number of groups of each cell: a chain of near pivots cut after ``size`` queries."""
    left, chain = set(range(len(pivots))), []
    at = 0
    while left:
        left.remove(at)
        chain.append(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(axis=1).argmin()])
    first, parts, group, filled = [0] * len(pivots), [1] * len(pivots), 0, 0
    for cell in chain:
        n = counts.get(cell, 0)
        if filled and filled + n > size:
            group, filled = group + 1, 0
        first[cell], parts[cell] = group, max(1, -(-n // size))
        group, filled = group + parts[cell] - 1, n if parts[cell] == 1 and not filled else filled + n
    return first, parts, group + 1


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, value: str = "embedding", key: str = "vec_id", pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row where ``is_query`` holds.

    Entries become ``floor(scale * c)``; the score is the inner product in whole
    numbers, ties go to the smaller key, null keys last. Candidates are all rows but
    the query's own: a row that occurs twice finds its other copy, and as a query
    gives its results twice. Fewer than ``k`` candidates give all of them.

    Rows whose vector is null or holds a null or non-finite entry take no part. A
    vector shorter than the longest ends in zeros. Entries beyond 2^28 are an error.
    An empty table, or no query, gives no rows. Other columns, whatever their names,
    are read by ``is_query`` alone.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(F.col(value), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("ask")).filter("x is not null")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    d, most, norm2 = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.max(norm)).collect()[0]
    if d is None:
        return spark.createDataFrame([], schema)
    d, most = max(d, 1), most or 0
    if most > LARGEST:
        raise ValueError(f"an entry of {most} is beyond {LARGEST}")
    # Pivots: distinct vectors with the least hashes, whatever the number of rows.
    hashed = rows.select(F.xxhash64("x").alias("h"), "x")
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(pivots).collect()]
    chosen = [r.x for r in hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("x").alias("x")).orderBy("h").collect()]
    space = _Space(d, most, norm2, np.array([v + [0] * (d - len(v)) for v in chosen], dtype=np.int64))

    # Equal rows become one with a count; what follows deals rows by hash, so a common vector spreads by its keys.
    points = rows.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.col("ask").cast("long")).alias("asks"))
    key_text = F.concat_ws(",", F.coalesce(F.col("vec_id").cast("string"), F.lit("-")), F.col("x").cast("array<string>"))
    points = points.select("vec_id", "x", "copies", "asks", F.md5(key_text).alias("id"))
    placed = points.mapInArrow(_place(space), "vec_id long, copies long, asks long, id string, v binary, cell int, dist double")
    placed = keep(placed, "placed")
    n = placed.count()

    in_cell = W.partitionBy("cell").orderBy("dist", "id")
    seeds = placed.withColumn("r", F.row_number().over(in_cell)).filter(F.col("r") <= k + 1).select("id", "v").collect()
    seed_x = np.frombuffer(b"".join(bytes(r.v) for r in seeds), space.kind).reshape(-1, d).astype(np.float64 if space.exact else np.int64)
    asked = placed.filter("asks > 0").mapInArrow(_first_bounds(space, seed_x, {r.id: i for i, r in enumerate(seeds)}, k), "vec_id long, asks long, id string, v binary, cell int, least long, within double")
    asked = keep(asked, "queries")
    counts = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    if not counts:
        return spark.createDataFrame([], schema)

    first, parts, groups = _group_of(counts, space.pivots, GROUP)
    pick = lambda numbers: F.element_at(F.array(*[F.lit(v) for v in numbers]), F.col("cell") + 1)
    asked = asked.withColumn("group", pick(first) + F.pmod(F.xxhash64("id"), pick(parts)).cast("int"))
    rings = asked.select("group", "v", "within").mapInArrow(_rings(space), "group int, cell int, lo double, hi double")
    rings = rings.groupBy("group", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    blocks = -(-n // ROWS)
    near = placed.join(rings, "cell").filter(F.col("dist").between(F.col("lo"), F.col("hi")))
    near = near.select("group", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "copies", "id", "v")
    asking = asked.select("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "asks", "id", "v", "least")
    found = asking.groupBy("group", "block").cogroup(near.groupBy("group", "block")).applyInArrow(
        _solve(space, k), "query string, query_id long, asks long, vec_id long, copies long, score long"
    )
    each = found.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asks"))).alias("__again")).drop("__again")
