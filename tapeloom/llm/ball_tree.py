"""Exact top-k by inner product: ball trees over shards, searched best node first.

Vectors are dealt evenly to shards; each shard has a ball tree whose nodes know centre, radius and smallest id, so
``q.c + |q| r`` bounds every inner product below a node. First each shard looks into its most promising leaf; the best k-th
score that any shard finds is a bound that all shards then start from, and each tightens it as it goes. Nodes are taken in
order of their bound and left out when it is below the k-th score (or equal with larger ids only). Scores are whole numbers.

Nulls: a vector that is null or has null or non-finite components, or whose id is null, takes no part. An empty vector has
score 0 with all. Shorter vectors count as filled up with zeros. Rows of equal id are candidates of their own for others'
queries and none for that id; repeated queries are asked once. Ties go to the smaller id. Fewer candidates than k: all of
them. An empty table gives no rows. Other columns are not read. Components beyond 2**26 in size raise an error, as
their products would not be exact.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.session import cut_lineage

SHARD_ROWS = 8192
BLOCK_ROWS = 8192
LEAF_ROWS = 64


def quantised(vector: Column, scale: int) -> Column:
    """Whole components; null if the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(x, lambda c: F.floor(c * scale)))


def _matrix(vectors: list, width: int = 0):
    import numpy as np

    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if out.size and np.abs(out).max() > 1 << 26:
        raise ValueError("a component is too large for exact products")
    return out


def grow(ids, x) -> dict:
    """A ball tree: rows in leaf order, and per node centre, radius, row range, children and smallest id."""
    import numpy as np

    f = x.astype(float)
    order = np.arange(len(ids))
    nodes: list[list] = []

    def add(lo: int, hi: int) -> int:
        rows = f[order[lo:hi]]
        centre = rows.mean(axis=0) if hi > lo else np.zeros(f.shape[1])
        far = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        nodes.append([centre, far.max() if hi > lo else 0.0, lo, hi, -1, -1, ids[order[lo:hi]].min() if hi > lo else 0])
        return len(nodes) - 1

    add(0, len(ids))
    todo = [0]
    while todo:
        n = todo.pop()
        centre, radius, lo, hi = nodes[n][:4]
        if hi - lo <= LEAF_ROWS:
            continue
        rows = f[order[lo:hi]]
        a = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
        b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
        order[lo:hi] = order[lo:hi][np.argsort(rows @ (b - a), kind="stable")]
        mid = (lo + hi) // 2
        nodes[n][4], nodes[n][5] = add(lo, mid), add(mid, hi)
        todo += nodes[n][4:6]
    c, r, lo, hi, left, right, least = zip(*nodes)
    return {"ids": ids[order], "x": x[order], "c": np.array(c), "r": np.array(r), "lo": lo, "hi": hi, "left": left, "right": right, "least": np.array(least)}


def search(tree: dict, ids, q, k: int, floors, probe: bool) -> list[tuple[int, int, int]]:
    """(query row, score, vec_id) of the k best of a shard with at least the floor's score; a probe looks into one leaf only."""
    import heapq

    import numpy as np

    width = max(q.shape[1], tree["x"].shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    qf, x = pad(q).astype(float), pad(tree["x"]).astype(float)  # whole numbers below 2**53: exact
    exact = width * max(1.0, np.abs(qf).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) < 2.0 ** 53
    qi, xi = (qf, x) if exact else (pad(q), pad(tree["x"]))
    norms = np.sqrt((qf ** 2).sum(axis=1))
    bounds = qf @ pad(tree["c"]).T + norms[:, None] * tree["r"]
    bounds += 1e-9 * (np.abs(bounds) + norms[:, None] + 1)  # rounding never hides a row
    out = []
    for i in range(len(ids)):
        best: list[tuple[int, int]] = []  # of (score, -vec_id), the worst first
        ahead = [(-bounds[i, 0], 0)]
        while ahead:
            bound, n = heapq.heappop(ahead)
            kth = max(best[0] if len(best) == k else (floors[i], -(1 << 63)), (floors[i], -(1 << 63)))
            if -bound < kth[0] or len(best) == k and np.floor(-bound) == kth[0] and -tree["least"][n] < kth[1]:
                if -bound < kth[0]:
                    break
                continue
            if tree["left"][n] >= 0:
                for child in (tree["left"][n], tree["right"][n]):
                    heapq.heappush(ahead, (-bounds[i, child], child))
                continue
            lo, hi = tree["lo"][n], tree["hi"][n]
            scores = xi[lo:hi] @ qi[i]
            for j in np.flatnonzero(scores >= kth[0]):
                got = (int(scores[j]), -int(tree["ids"][lo + j]))
                if -got[1] == ids[i]:
                    continue
                if len(best) < k:
                    heapq.heappush(best, got)
                elif got > best[0]:
                    heapq.heapreplace(best, got)
            if probe:
                break
        out += [(i, s, -v) for s, v in best] if not probe else [(i, best[0][0], 0)] if len(best) == k else []
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of each query row among all rows."""
    import pickle

    spark = vectors.sparkSession
    sound = cut_lineage(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where("vec_id is not null and v is not null")
    )
    asked = cut_lineage(sound.where("asks").select("vec_id", "v").distinct())
    shards, blocks = -(-sound.count() // SHARD_ROWS) or 1, -(-asked.count() // BLOCK_ROWS) or 1
    dealt = lambda df, n: df.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def pack(frame, tree: bool):
        import pandas as pd

        ids, x = frame["vec_id"].to_numpy(), _matrix(frame["v"].tolist())
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "packed": [pickle.dumps(grow(ids, x) if tree else (ids, x))]})

    index = cut_lineage(dealt(sound.select("vec_id", "v"), shards).groupBy("g").applyInPandas(lambda f: pack(f, True), "g int, packed binary")).select(F.col("g").alias("shard"), F.col("packed").alias("tree"))
    asks = cut_lineage(dealt(asked, blocks).groupBy("g").applyInPandas(lambda f: pack(f, False), "g int, packed binary")).select(F.col("g").alias("block"), F.col("packed").alias("asks"))
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), ["shard", "block"])

    def run(batches: Iterator, probe: bool) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in batches:
            for row in frame.itertuples():
                ids, q = pickle.loads(row.asks)
                floors = np.full(len(ids), -(1 << 62), np.int64)
                if not probe and row.floors is not None:
                    for f in row.floors:
                        floors[f["at"]] = f["floor"]
                found = search(pickle.loads(row.tree), ids, q, k, floors, probe)
                yield pd.DataFrame([(row.block, i, int(ids[i]), s, v) for i, s, v in found], columns=["block", "at", "query_id", "score", "vec_id"])

    schema = "block int, at int, query_id long, score long, vec_id long"
    floors = (
        pairs.mapInPandas(lambda b: run(b, True), schema).groupBy("block", "at").agg(F.max("score").alias("floor"))
        .groupBy("block").agg(F.collect_list(F.struct("at", "floor")).alias("floors"))  # at most BLOCK_ROWS
    )
    found = pairs.join(floors, "block", "left").mapInPandas(lambda b: run(b, False), schema)
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
