"""Exact top-k inner products by best-first search of M-trees.

Inner products become a metric by one more coordinate: a vector v gets sqrt(M^2 - |v|^2), M the largest norm, and a query
0; then distance^2 = |q|^2 + M^2 - 2 q.v, so the nearest are those of highest product. Vectors fall into cells around a few
pivots, as many as keep a cell near the size of a shard, larger cells into shards by row, and a shard's vectors into an M-tree
of pages: a page has a routing vector, a covering radius and its distance to the parent's routing vector; a leaf entry has
its distance to the leaf's. Queries of neighbouring cells make blocks, as they reach the same cells; pages go only to blocks
that reach their cell. The search of a block of queries takes the page with the least lower bound next and leaves out, per query, what the stored distances and the
triangle inequality rule out before any distance is computed. Scores themselves are integers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors in a leaf page, children of an inner page, vectors in a shard, pivots, vectors that give every query a first bound, queries in a block.
LEAF, FAN, SHARD, PIVOTS, SEEDS, BLOCK = 128, 8, 8192, 1024, 2048, 4096
PAGES = "dim int, cell int, sub int, page int, parent int, leaf boolean, router binary, radius double, to_parent double, ids binary, rows binary, vecs binary, dists binary"


def quantised(embedding: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null if the vector or a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(e.isNotNull() & fine, F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where every sum is below 2^53."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lift(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms sqrt(top)."""
    norm = (v.astype(np.float64) ** 2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(top - norm, 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0))


def build_pages(ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray, top: float) -> list[dict]:
    """Pages of an M-tree over vecs, the root first; rows number the vectors, whose ids may repeat."""
    points = lift(vecs, top)
    pages: list[dict] = []

    def add(members: np.ndarray, parent: int, parent_router: int) -> None:
        router = members[0]
        d = distances(points[members], points[[router]])[:, 0]
        to_parent = float(np.linalg.norm(points[router] - points[parent_router])) if parent >= 0 else 0.0
        leaf = len(members) <= LEAF
        page = {"page": len(pages), "parent": parent, "leaf": leaf, "router": vecs[router].tobytes(), "radius": float(d.max()), "to_parent": to_parent,
                "ids": ids[members].tobytes() if leaf else b"", "rows": rows[members].tobytes() if leaf else b"", "vecs": vecs[members].tobytes() if leaf else b"", "dists": d.tobytes() if leaf else b""}
        pages.append(page)
        if leaf:
            return
        # farthest-first centres, each taking the nearest; a centre leads its group, so it is the child's router
        centres, near = [0], d.copy()
        while len(centres) < FAN and near.max() > 0:
            centres.append(int(near.argmax()))
            near = np.minimum(near, distances(points[members], points[[members[centres[-1]]]])[:, 0])
        if len(centres) == 1:  # all are equal
            groups = [members[i : i + LEAF * FAN] for i in range(0, len(members), LEAF * FAN)] if len(members) > LEAF * FAN else [members[i : i + LEAF] for i in range(0, len(members), LEAF)]
        else:
            owner = distances(points[members], points[members[centres]]).argmin(1)
            owner[centres] = np.arange(len(centres))
            groups = [np.concatenate([[members[c]], members[(owner == g) & (np.arange(len(members)) != c)]]) for g, c in enumerate(centres)]
            if max(map(len, groups)) > 0.9 * len(members):  # outliers alone: rings of equal numbers keep the tree shallow
                by_distance = members[np.argsort(d, kind="stable")]
                groups = np.array_split(by_distance, FAN)
        for g in groups:
            add(g, page["page"], router)

    add(np.arange(len(ids)), -1, 0)
    return pages


def search_pages(pages: pd.DataFrame, q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, filled) of each query's k best in a shard's pages, its own row left out; places not filled hold nothing.

    floor: a score that each query's k-th best overall is known to reach.
    """
    dim, n = q.shape[1], len(q)
    scores, found, filled = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)
    norm = (q.astype(np.float64) ** 2).sum(1)
    lifted = np.concatenate([q.astype(np.float64), np.zeros((n, 1))], axis=1)
    slack = 1e-7 * (1 + np.sqrt(top) + np.sqrt(norm))
    children: dict[int, list] = {}
    for p in pages.itertuples(index=False):
        children.setdefault(p.parent, []).append(p)

    def reach() -> np.ndarray:
        """Distance beyond which a vector can't enter a query's list."""
        least = np.maximum(floor, np.where(filled[:, -1], scores[:, -1], np.iinfo(np.int64).min)).astype(np.float64)
        return np.sqrt(np.maximum(norm + top - 2 * least, 0)) + slack

    root = children[-1][0]
    d = distances(lifted, lift(np.frombuffer(root.router, np.int64).reshape(1, dim), top))[:, 0]
    low = np.maximum(d - root.radius, 0)
    heap = [(float(low.min()), 0, root, np.arange(n), d, low)]
    ties = 1
    while heap:
        _, _, page, of, d, low = heapq.heappop(heap)
        limit = reach()[of]
        ok = low <= limit
        of, d, limit = of[ok], d[ok], limit[ok]
        if not len(of):
            continue
        if page.leaf:
            ids, rows, dists = np.frombuffer(page.ids, np.int64), np.frombuffer(page.rows, np.int64), np.frombuffer(page.dists, np.float64)
            vecs = np.frombuffer(page.vecs, np.int64).reshape(-1, dim)
            near = np.abs(d[:, None] - dists[None]) <= limit[:, None]  # the stored distance rules out the rest
            some = near.any(1)
            of, near = of[some], near[some]
            used = np.flatnonzero(near.any(0))
            if not len(used):
                continue
            s = products(q[of], vecs[used])
            ok = near[:, used] & (rows[used][None] != q_rows[of][:, None]) & (s >= np.where(filled[of, -1], scores[of, -1], floor[of])[:, None])
            row = np.flatnonzero(ok.any(1))
            if not len(row):
                continue
            all_scores = np.concatenate([scores[of[row]], s[row]], axis=1)
            all_ids = np.concatenate([found[of[row]], np.broadcast_to(ids[used], (len(row), len(used)))], axis=1)
            all_fill = np.concatenate([filled[of[row]], ok[row]], axis=1)
            order = np.lexsort((all_ids, -all_scores, ~all_fill), axis=1)[:, :k]
            scores[of[row]], found[of[row]], filled[of[row]] = (np.take_along_axis(x, order, 1) for x in (all_scores, all_ids, all_fill))
            continue
        for child in children.get(page.page, ()):
            near = np.abs(d - child.to_parent) - child.radius <= limit  # before any distance to the child
            if not near.any():
                continue
            own = of[near]
            dc = distances(lifted[own], lift(np.frombuffer(child.router, np.int64).reshape(1, dim), top))[:, 0]
            low = np.maximum(dc - child.radius, 0)
            ok = low <= limit[near]
            if ok.any():
                heapq.heappush(heap, (float(low[ok].min()), ties, child, own[ok], dc[ok], low[ok]))
                ties += 1
    return scores, found, filled


def query_blocks(queries: dict[tuple[int, int], int], pivots: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
    """(first block, number of blocks) of each cell (length, cell) from its number of queries: cells in order of distance from the first
    pivot share a block while it has room, a cell of more queries than a block has blocks of its own."""
    far = {d: distances(p[:1], p)[0] for d, p in pivots.items()}
    out, at, held = {}, 0, 0
    last = None
    for d, c in sorted(queries, key=lambda k: (k[0], far[k[0]][k[1]], k[1])):
        n = queries[d, c]
        if last is not None and (d != last or held + n > BLOCK):
            at, held = at + max(1, -(-held // BLOCK)), 0
        out[d, c] = (at, max(1, -(-n // BLOCK)))
        held, last = held + n, d
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each query its k highest integer inner products, ties to the smaller id.

    is_query tells which rows of vectors are queries; candidates are all rows but the query's own, all of them if fewer
    than k. Vectors that are null or hold null or non-finite components, and rows without an id, take no part; a repeated row is a row of
    its own, as a query and as a candidate. Vectors of different lengths never meet. Other columns are not read; an empty table gives no rows.
    Beside the pages, the driver sees at most SEEDS vectors and a row per cell, for each length.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantised(vector_col, scale).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = staged(rows, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    tops = {r[0]: (float(r[1]), r[2]) for r in rows.groupBy("dim").agg(F.max(norm), F.count(F.lit(1))).collect()}
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in tops:
        some = rows.where(F.col("dim") == dim).select("row", "v").orderBy(F.xxhash64("id", "row"), "row").limit(SEEDS).toArrow()
        seeds[dim] = (np.array(some["row"].to_pylist(), np.int64), np.array(some["v"].to_pylist(), np.int64).reshape(-1, dim))
    pivots = {d: lift(s[1][: min(PIVOTS, -(-tops[d][1] // SHARD))], tops[d][0]) for d, s in seeds.items()}
    top_of = {d: t[0] for d, t in tops.items()}

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, vectors) of a batch by length of its vectors, the last column."""
        dims = batch.column(0).to_numpy(zero_copy_only=False)
        column = batch.column(batch.num_columns - 1)
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            yield dim, at, flat[offsets[at][:, None] + np.arange(dim)[None]].astype(np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in parts(batch):
                d = distances(lift(v, top_of[dim]), pivots[dim])
                cell = d.argmin(1)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(at)), cell]), *[batch.column(i).take(pick) for i in (1, 2, 3)], pa.array([x.tobytes() for x in v], pa.binary())],
                    ["dim", "cell", "d", "id", "row", "is_query", "vec"])

    placed = staged(rows.select("dim", "id", "row", "is_query", "v").mapInArrow(assign, "dim int, cell int, d double, id long, row long, is_query boolean, vec binary"), "placed")
    counts = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)), F.max("d"), F.sum(F.col("is_query").cast("long"))).collect()  # PIVOTS rows a length
    cells = {(r[0], r[1]): (-(-r[2] // SHARD), float(r[3])) for r in counts}
    spark = vectors.sparkSession
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = query_blocks({(r[0], r[1]): r[4] for r in counts}, pivots)
    sizes = spark.createDataFrame([(d, c, cells[d, c][0], *blocks[d, c]) for d, c in cells], "dim int, cell int, subs long, base long, blocks long")
    placed = placed.join(F.broadcast(sizes), ["dim", "cell"])
    shards = placed.withColumn("sub", F.pmod(F.xxhash64("row", F.lit(3)), F.col("subs")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pdf = pdf.sort_values(["d", "id", "row"])
        pages = build_pages(pdf["id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["vec"]), np.int64).reshape(-1, dim), top_of[dim])
        return pd.DataFrame(pages).assign(dim=dim, cell=pdf["cell"].iloc[0], sub=pdf["sub"].iloc[0])[[c.split()[0] for c in PAGES.split(", ")]]

    pages = staged(shards.select("dim", "cell", "sub", "d", "id", "row", "vec").groupBy("dim", "cell", "sub").applyInPandas(build, PAGES), "pages")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to the shards of every cell that its first bound, from the seeds, doesn't rule out."""
        for batch in batches:
            ids, row, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            vecs = batch.column(4)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = np.frombuffer(b"".join(vecs.take(pa.array(at)).to_pylist()), np.int64).reshape(-1, dim)
                s = products(v, seeds[dim][1])
                least = np.iinfo(np.int64).min
                s[row[at][:, None] == seeds[dim][0][None]] = least
                first = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(at), least)
                norm, top = (v.astype(np.float64) ** 2).sum(1), top_of[dim]
                reach = np.sqrt(np.maximum(norm + top - 2 * first.astype(np.float64), 0)) + 1e-7 * (1 + np.sqrt(top) + np.sqrt(norm))
                d = distances(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1), pivots[dim])
                for (cd, cell), (n, radius) in cells.items():
                    if cd != dim:
                        continue
                    go = np.flatnonzero(d[:, cell] - radius <= reach)
                    blob = [v[i].tobytes() for i in go]
                    for sub in range(n if len(go) else 0):
                        m = len(go)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, x, np.int32)) for x in (dim, cell, sub)] + [pa.array(x[at][go]) for x in (block, ids, row)] + [pa.array(blob, pa.binary()), pa.array(first[go])],
                            ["dim", "cell", "sub", "block", "id", "row", "vec", "first"])

    block = F.col("base") + F.pmod(F.xxhash64("row", F.lit(5)), F.col("blocks"))
    queries = placed.where("is_query").select("dim", "id", "row", block.alias("block"), "vec")
    routed = staged(queries.mapInArrow(route, "dim int, cell int, sub int, block long, id long, row long, vec binary, first long"), "routed")
    keys = ["dim", "cell", "sub", "block"]
    dealt = pages.join(staged(routed.select(*keys).distinct(), "reached"), ["dim", "cell", "sub"])

    def look(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "query_row", "vec_id", "score")})
        dim = int(q["dim"].iloc[0])
        v = np.frombuffer(b"".join(q["vec"]), np.int64).reshape(-1, dim)
        own = q["row"].to_numpy(np.int64)
        scores, found, filled = search_pages(p, own, v, q["first"].to_numpy(np.int64), k, top_of[dim])
        at, col = np.nonzero(filled)
        return pd.DataFrame({"query_id": q["id"].to_numpy(np.int64)[at], "query_row": own[at], "vec_id": found[at, col], "score": scores[at, col]})

    hits = routed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(look, "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for exact_top_k over {vectors}, queries by `vec_id % 50 = 0`, k = 5.
TOP_K_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM {vectors}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
