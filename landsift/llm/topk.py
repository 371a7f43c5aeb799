"""Exact top-k by inner product: ball trees over shards of near vectors, searched by branch and bound.

Vectors are quantised to integers and dealt to cells by the nearest of at most CELLS centroids (k-means over a sample of
SAMPLE a cell; it only decides where a vector goes, every vector is indexed). A cell is cut into shards of about
`shard_rows` rows by hash, so that neither a dense region nor a vector that a third of all rows share makes a large
task. In a shard, nodes of a ball tree are visited by their upper bound q.c + |q| r, floored since scores are integers,
and a query ends when no open node can beat its kth result (score, then smaller id). Round one searches the shard of
the query's own row. Its kth score and place are then shared with the shards of all those cells, and only those, whose
own bound (centroid and largest distance) can beat it; round two prunes with it from the start. Queries stream through
a shard in blocks, so a task holds one shard and one block whatever the number of queries. What is broadcast or brought
to the driver has a fixed bound: the sample, the centroids, and a count and a radius a cell.

Scores are exact: vectors whose products could leave the integers that float64 holds make a cell of their own, and they
meet all others in Python's integers. Scores beyond 64 bits count as the largest (least) 64-bit number.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids, nor components
whose multiple by the scale is beyond float64; shorter vectors, empty ones too, count as padded with zeros; each row is a
candidate and, if its id is asked for, a query of its own, also where rows repeat an id or all; ties go to the smaller
id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, ship

SHARD_ROWS, LEAF, BLOCK = 16_384, 96, 512
CELLS, SAMPLE = 1024, 8
EXACT, MOST = 2.0**52, 2**63 - 1


def _finite(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    fit = F.col(id_col).isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return df.filter(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("x"))


def _centroids(sample: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """k-means; a centroid that loses all its vectors stays where it was."""
    c = np.unique(sample, axis=0)[:: max(1, len(sample) // number)][:number].copy()
    for _ in range(rounds):
        at = _nearest(sample, c)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


class BallTree:
    """Nodes in arrays; a node's points are contiguous."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.x = ids, points
        order, spans, self.children, centres, radii = np.arange(len(ids)), [(0, len(ids))], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = self.x[order[a:b]]
            centre = own.mean(axis=0)
            distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(distance.max(initial=0))
            kids = ()
            if b - a > LEAF and radii[-1] > 0:
                p = own[distance.argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (q - p), kind="stable")
                order[a:b] = order[a:b][side]
                mid = (a + b) // 2
                kids = (len(spans), len(spans) + 1)
                spans += [(a, mid), (mid, b)]
            self.children.append(kids)
            at += 1
        self.x, self.ids, self.spans = self.x[order], ids[order], spans
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.least = np.array([self.ids[a:b].min() for a, b in spans])

    def search(self, q: np.ndarray, k: int, floors: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """Of each query the k best (score, id) of this tree that beat its floor, a (score, id) that has k as good ones
        elsewhere, if there is one."""
        size = np.sqrt((q**2).sum(axis=1))
        upper = q @ self.centre.T
        slack = 1e-9 * (np.abs(upper) + size[:, None] * (self.radius + np.abs(self.centre).sum(axis=1))) + 1e-6
        upper = np.floor(upper + size[:, None] * self.radius + slack)
        out = []
        for i in range(len(q)):
            best = [(floors[i][0], -floors[i][1], 0)] * k if floors[i] else []  # a heap, the worst first; 1 marks own results
            u = upper[i]
            open_ = [(-u[0], 0)]
            while open_:
                top, node = heapq.heappop(open_)
                if len(best) == k and (-top < best[0][0] or (-top == best[0][0] and self.least[node] > -best[0][1])):
                    if -top < best[0][0]:
                        break
                    continue
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(open_, (-u[c], c))
                    continue
                a, b = self.spans[node]
                scores = self.x[a:b] @ q[i]
                ids = self.ids[a:b]
                if len(best) == k:
                    can = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[can], ids[can]
                if len(ids) > 4 * k:  # the k + 1 best by score and id are enough
                    can = np.lexsort((ids, -scores))[: k + 1]
                    scores, ids = scores[can], ids[can]
                for s, d in zip(scores.tolist(), ids.tolist(), strict=True):
                    x = (int(s), -d, 1)
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x[:2] > best[0][:2]:
                        heapq.heapreplace(best, x)
            out.append([(s, -d) for s, d, own in best if own])
        return out


def _matrix(vectors: list[list[float]], width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : min(len(v), width)] = v[:width]
    return m


def _exact(q: list[float], points: list[tuple[int, list[float]]], k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
    """search of one query over (id, vector) in Python's integers."""
    whole = [int(x) for x in q]
    found = [(max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(whole, v, strict=False)))), -d) for d, v in points]
    return [(s, -d) for s, d in heapq.nlargest(k, (x for x in found if floor is None or x > (floor[0], -floor[1])))]


def _shards(batches):
    """Of batches sorted by (shard, kind): for each shard its rows of kind 0, then blocks of its queries."""
    now, held, block = None, [], []
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != now:
                if now is not None:
                    yield now, held, block
                now, held, block = r["shard"], [], []
            if r["kind"] == 0:
                held.append((r["id"], r["v"]))
            else:
                block.append(r)
                if len(block) == BLOCK:
                    yield now, held, block
                    block = []
    if now is not None:
        yield now, held, block


PAIR = pa.struct([("score", pa.int64()), ("id", pa.int64())])
HIT = "id long, mark long, own long, hits array<struct<score:long,id:long>>"


def top_k(df: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), id_col, score: each query's k best other rows. is_query: maps the id column to a
    condition. A query's own row is searched for like any other, and one row with its id and score is then left out."""
    spark = df.sparkSession
    ship(spark)
    rows = _finite(df, id_col, vector)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width, number = width or 0, min(CELLS, max(1, math.ceil(n / shard_rows)))
    limit = math.sqrt(EXACT / max(1, width))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * number).collect()
    sample = np.floor(_matrix([r["x"] for r in drawn], width) * scale)
    sample = sample[np.abs(sample).max(axis=1, initial=0) < limit]
    centres = _centroids(sample, number) if len(sample) else np.zeros((1, width))
    wide = len(centres)  # the cell of vectors beyond the limit

    def place(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                v = [np.floor(np.array(x) * scale).tolist() for x in b.column("x").to_pylist()]
            fit = np.array([all(map(math.isfinite, x)) for x in v], dtype=bool)
            ids, v = b.column("id").to_numpy()[fit], [x for x, ok in zip(v, fit, strict=True) if ok]
            m = _matrix(v, width)
            narrow = np.abs(m).max(axis=1, initial=0) < limit
            cell = np.where(narrow, _nearest(np.where(narrow[:, None], m, 0), centres), wide)
            far = np.sqrt(((np.where(narrow[:, None], m, 0) - centres[np.minimum(cell, wide - 1)]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), pa.array(ids), pa.array(v, pa.list_(pa.float64()))], names=["cell", "far", "id", "v"])

    placed = cut(rows.mapInArrow(place, "cell int, far double, id long, v array<double>"))
    cells = sorted((r[0], r[1], r[2]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect())
    parts = [math.ceil(c / shard_rows) for _, c, _ in cells]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    shards = max(1, sum(parts))
    where = spark.createDataFrame([(c, a, p) for (c, *_), a, p in zip(cells, starts, parts, strict=True)], "cell int, first int, parts int")
    placed = placed.join(F.broadcast(where), "cell").select("cell", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int").alias("shard"), "id", "v")

    def search(batches):
        tree, of, points = None, None, []
        for shard, held, block in _shards(batches):
            if of != shard:
                of, points = shard, held
                m = _matrix([v for _, v in held], width)
                tree = BallTree(np.array([i for i, _ in held], dtype=np.int64), m) if held and np.abs(m).max(initial=0) < limit else None
            if not points or not block:
                continue
            q, floors = _matrix([r["v"] for r in block], width), [(r["floor"]["score"], r["floor"]["id"]) if r["floor"] else None for r in block]
            narrow = np.abs(q).max(axis=1, initial=0) < limit if tree is not None else np.zeros(len(q), bool)
            found = dict(zip(np.flatnonzero(narrow).tolist(), tree.search(q[narrow], k + 1, [f for f, ok in zip(floors, narrow, strict=True) if ok]) if narrow.any() else [], strict=True))
            hits = [found[i] if i in found else _exact(r["v"], points, k + 1, floors[i]) for i, r in enumerate(block)]
            yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in block], pa.int64()), pa.array([r["mark"] for r in block], pa.int64()), pa.array([int(x @ x) if ok else min(MOST, sum(int(c) ** 2 for c in r["v"])) for x, ok, r in zip(q, narrow, block, strict=True)], pa.int64()), pa.array([[{"score": s, "id": d} for s, d in h] for h in hits], pa.list_(PAIR))], names=["id", "mark", "own", "hits"])

    points = placed.select("shard", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("mark"), "v", F.lit(None).cast("struct<score:long,id:long>").alias("floor"))

    def searched(queries: DataFrame) -> DataFrame:
        return points.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(search, HIT)

    own = cut(placed.filter(is_query(F.col("id"))).groupBy("id", "v").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n")).withColumn("mark", F.xxhash64("v")))
    first = cut(searched(own.select("shard", F.lit(1).alias("kind"), "id", "mark", "v", F.lit(None).cast("struct<score:long,id:long>").alias("floor"))))
    radius = np.array([r for _, _, r in cells])
    centre = np.array([centres[min(c, wide - 1)] for c, *_ in cells]).reshape(len(cells), width)

    def visits(batches):
        """A row for each query and shard that can still improve on what its first shard has."""
        for b in batches:
            out = [[] for _ in range(5)]
            for r in b.to_pylist():
                q, floor = _matrix([r["v"]], width)[0], r["hits"][k] if len(r["hits"]) > k else None
                if floor and np.abs(q).max(initial=0) < limit:
                    upper = centre @ q
                    size = math.sqrt(q @ q)
                    upper += size * radius + 1e-9 * (np.abs(upper) + size * (radius + np.abs(centre).sum(axis=1))) + 1e-6
                    go = (np.floor(upper) >= floor["score"]) | np.array([c == wide for c, *_ in cells])
                else:
                    go = np.ones(len(cells), bool)
                for i in np.flatnonzero(go):
                    for shard in range(starts[i], starts[i] + parts[i]):
                        if shard != r["shard"]:
                            for c, x in zip(out, (shard, r["id"], r["mark"], r["v"], floor), strict=True):
                                c.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), PAIR)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["shard", "id", "mark", "v", "floor"])

    best_first = F.reverse(F.array_sort(F.transform("hits", lambda h: F.struct(h["score"].alias("score"), (-h["id"]).alias("id")))))
    ranked = first.select("id", "mark", F.transform(best_first, lambda h: F.struct(h["score"].alias("score"), (-h["id"]).alias("id"))).alias("hits"))
    going = own.join(ranked, ["id", "mark"]).select("id", "mark", "v", "shard", "hits").mapInArrow(visits, "shard int, id long, mark long, v array<double>, floor struct<score:long,id:long>")
    rest = searched(going.select("shard", F.lit(1).alias("kind"), "id", "mark", "v", "floor")) if shards > 1 else first.limit(0)
    hits = first.unionByName(rest).select("id", "mark", F.explode("hits").alias("hit"))
    best = hits.groupBy("id", "mark").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("hit.score")).alias("less"), F.col("hit.id").alias("id")))), 1, k + 1).alias("best"))
    itself = F.array_position("best", F.struct((-F.col("own")).alias("less"), F.col("id").alias("id"))).cast("int")
    others = F.when(F.col("at") > 0, F.concat(F.slice("best", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), F.slice("best", F.col("at") + 1, F.lit(k)))).otherwise(F.slice("best", 1, k))
    done = own.select("id", "mark", "n").join(first.select("id", "mark", "own"), ["id", "mark"]).join(best, ["id", "mark"]).withColumn("at", itself).select("id", "n", others.alias("best"))
    copies = done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select(F.col("id").alias("query_id"), F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.less")).alias("score"))
