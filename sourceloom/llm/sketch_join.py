"""Near-duplicates by bottom-k sketches from one hash function.

A set's sketch is its `size` least shingle hashes. Two sets of similarity J or more agree in a binomial share of their union's
sketch, so they have at least `least_shared` retained values in common except with probability RISK. Inverted lists of the
retained values give these overlaps; the union's sketch, which both sketches hold, gives an estimate that rejects pairs below
the same bound; what is left is compared on the full sets, so no link is false.

Lists are kept short and in memory as follows:

1. Equal sets are one class.
2. Of a class's retained values the size - least_shared + 1 rarest must hold one that a partner's rarest hold too, ties and all. Values
   that no other class retains count towards them; the classes that share one of the others are connected, and the connected
   components of that relation are searched apart.
3. Components are packed into shards; a larger component is cut into chunks by size class and hash, and each pair of chunks whose sizes
   allow a link is a shard. Inside a shard a set meets the earlier ones, the most promising first, and passes over those that are already
   connected with it: components need no more, so a group of m near copies costs about m comparisons, not m squared. Sets that stay just
   below the threshold must all be compared: they are, by batches of array operations. A shard tells each set's least connected one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, staged
from .components import components
from .jaccard_join import BROADCAST_CLASSES, HEAVY, POSTED, SHARD_SHINGLES, all_sets, gather, n_packs, post, runs

#: Values that a sketch retains, and the chance that a pair on the threshold falls below the bound that follows.
SKETCH, RISK = 128, 1e-12
#: Shingles and retained values that a shard holds, so many that a chunk of a component holds.
SHARD_VALUES = 1_500_000
#: Candidates that are compared at once, and shingles of theirs.
BATCH, BATCH_SHINGLES = 1024, 1 << 20


def least_shared(size: int, num: int, den: int) -> int:
    """The greatest c for which `size` draws that each agree with chance num/den fall below c with a chance of at most RISK."""
    p, below = num / den, 0.0
    for c in range(size + 1):
        below += comb(size, c) * p**c * (1 - p) ** (size - c)
        if below > RISK:
            return c
    return size


def bound(n: int | np.ndarray, size: int, num: int, den: int) -> np.ndarray:
    """Retained values that a set of n shingles has in common with any partner. Where the union can't outgrow the sketch this is certain."""
    n = np.asarray(n, np.int64)
    return np.where(n * den <= size * num, -(-n * num // den), least_shared(size, num, den))


def union_shares(places: np.ndarray, retained: int, others: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, kept) in the sketch of the union of one set, which retains `retained` values, and each of several others.

    places: a row for each other set, for its retained values in order their place in the one set's sketch, -1 if it doesn't retain them.
    A shared value's place in the union is the sum of its places in both less the shared values before it.
    """
    same = places >= 0
    before = np.cumsum(same, axis=1, dtype=np.int32)
    kept = np.minimum(size, retained + others - before[:, -1])
    inside = places + np.arange(places.shape[1], dtype=np.int32) - (before - 1) < kept[:, None]
    return (same & inside).sum(axis=1), kept


def union_share(a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int]:
    """(shared, kept) in the sketch of the union, from the sorted sketches of both sets."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    agree, kept = union_shares(np.where(a[at] == b, at, -1)[None], len(a), np.array([len(b)]), size)
    return int(agree[0]), int(kept[0])


def sketch_links(tokens: list[np.ndarray], size: int, num: int, den: int, seen: Counter | None = None) -> list[tuple[int, int]]:
    """(i, j) among sorted sets in order of length: verified links that connect exactly what the sketches' candidates and their links connect.

    A set's candidates are estimated and compared in batches that double from one on, as near copies connect at once and sets below the
    threshold don't. seen, if given, counts the candidates, estimates, comparisons and batches.
    """
    seen, n = Counter() if seen is None else seen, len(tokens)
    length = np.array([len(t) for t in tokens], np.int64)
    retained = np.minimum(length, size)
    values, ids = np.unique(np.concatenate(tokens) if n else np.zeros(0, np.uint64), return_inverse=True)  # numbers keep the order of values
    ids, ends = ids.astype(np.int32), np.concatenate([[0], np.cumsum(length)])
    edges = np.concatenate([[0], np.cumsum(retained)])
    of, at = np.repeat(np.arange(n, dtype=np.int32), retained), np.arange(edges[-1]) - np.repeat(edges[:-1], retained)
    sketches = np.full((n, size), len(values), np.int32)
    sketches[of, at] = ids[ends[of] + at]
    order = np.argsort(sketches[of, at], kind="stable")  # by value, then by set
    lists = of[order]
    start, count = runs(sketches[of, at][order])
    head, place = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    head[order], place[order] = np.repeat(start, count), np.arange(len(of))
    need, floor = bound(length, size, num, den), least_shared(size, num, den)
    label, members, links = np.arange(n), {}, []
    own_place, own = np.full(len(values) + 1, -1, np.int32), np.zeros(len(values), np.uint8)  # of the values of one set at a time
    for x in range(n):
        mine = slice(edges[x], edges[x + 1])
        lo, hi = head[mine], place[mine]
        met = hi > lo
        if met.sum() < need[x]:
            continue
        count = np.bincount(np.concatenate([lists[a:b] for a, b in zip(lo[met].tolist(), hi[met].tolist(), strict=True)]))
        found = np.flatnonzero(count >= need[x])
        found = found[(den * length[found] >= num * length[x]) & (count[found] >= need[found])]
        found = found[np.argsort(-count[found], kind="stable")]
        seen["candidates"] += len(found)
        all_x = ids[ends[x] : ends[x + 1]]
        own_place[all_x[:size]], own[all_x] = np.arange(retained[x]), 1
        step, most = 1, max(1, min(BATCH, BATCH_SHINGLES // int(length[x])))  # candidates are no longer than x
        while len(found):
            batch, found, step = found[:step], found[step:], min(2 * step, most)
            seen["batches"] += 1
            seen["estimates"] += len(batch)
            agree, kept = union_shares(own_place[sketches[batch]], int(retained[x]), retained[batch], size)
            batch = batch[agree >= np.where(kept < size, -(-kept * num // den), floor)]
            seen["compared"] += len(batch)
            if not len(batch):
                continue
            theirs = np.concatenate([ids[a:b] for a, b in zip(ends[batch].tolist(), ends[batch + 1].tolist(), strict=True)])
            i = np.add.reduceat(own[theirs], np.cumsum(length[batch]) - length[batch], dtype=np.int64)
            linked = batch[den * i >= num * (length[x] + length[batch] - i)]
            for y in linked.tolist():
                p, q = int(label[x]), int(label[y])
                if p == q:
                    continue
                links.append((x, y))
                mp, mq = members.pop(p, [p]), members.pop(q, [q])
                if len(mp) < len(mq):
                    mp, mq, p = mq, mp, q
                label[mq] = p
                members[p] = mp + mq
            if len(linked):
                found = found[label[found] != label[x]]
        own_place[all_x[:size]], own[all_x] = -1, 0
    return links


def stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node that links connect it with) of all nodes but the least ones: the same components, one step deep."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in root if top(x) != x]


def sketch_join(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, size: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, text_hash (xxhash64).

    Words are runs of non-space characters with A-Z lowered; a set holds a text's distinct shingles of k words, or its whole
    sequence if it has fewer. Two rows link if den * |intersection| >= num * |union|; component_id is the least id that links lead to, and the row
    of that id is kept. Links are confirmed on full sets; one is missed only if its retained values fall below the bound (RISK each).
    A null, empty or blank text has no shingles, links with nothing, is its own component and is kept. Rows of one text are one class
    whatever their number; of rows that repeat an id all are judged by their text, so an id that leads a component is kept as often as it
    occurs in it. A null id never names a component unless all its ids are null, and is kept only then. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    arrow_id = source.limit(0).toArrow().schema.field("id").type

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, token, edges, key in all_sets(batch, 1, k):
                sketch = [token[a : min(b, a + size)].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(arrow_id), pa.array(np.diff(edges)), pa.array(key), pa.array(sketch, pa.binary()), batch.column(2).slice(i, j - i)], ["id", "n", "key", "sketch", "th"])

    hashed = source.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    about = staged(hashed.mapInArrow(describe, f"id {id_type}, n long, key long, sketch binary, th long"), "sketches")
    classes = about.where("key <> 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))  # all of a class have one sketch
    classes = staged(classes, "classes")
    n_values = int(classes.agg(F.sum(F.length("sketch") / 8)).first()[0] or 0)
    shards = max(1, -(-n_values // SHARD_SHINGLES))

    def post_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The inverted lists by ranges of values. A value that many classes of a batch retain is posted once, its holders are told at once."""
        for batch in batches:
            keys, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            owners = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) // 8 for x in packed])
            out, token, owner = post(keys, np.frombuffer(b"".join(packed), np.uint64), owners, shards)
            yield out
            order = np.argsort(owner, kind="stable")
            rows = [(keys[owner[order[a]]].tobytes(), token[order[a : a + b]].tobytes()) for a, b in zip(*runs(owner[order]), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[], []]
            empty = pa.array([b""] * len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), -1, np.int32)), *[pa.array(x, pa.binary()) for x in cols], empty, empty], out.schema.names)

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        """(key, values that others retain too, by how many, up to HEAVY) of a range."""
        told = pdf["shard"] < 0
        rows = [(int(np.frombuffer(r.keys, np.int64)[0]), r.tokens, np.full(len(r.tokens) // 8, HEAVY, np.uint8).tobytes()) for r in pdf[told].itertuples(index=False)]
        if not told.all():
            token, key, df = gather(pdf[~told])
            keep = (df > 1) & (key != 0)
            order = np.argsort(key[keep], kind="stable")
            token, key, df = token[keep][order], key[keep][order], df[keep][order].astype(np.uint8)
            rows += [(int(key[a]), token[a : a + b].tobytes(), df[a : a + b].tobytes()) for a, b in zip(*runs(key), strict=True)]
        return pd.DataFrame(rows, columns=["key", "values", "counts"])

    def rarest_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, musts = [], bound(batch.column(2).to_numpy(), size, num, den).tolist()
            for key, id_, n, values, counts, must in zip(*[c.to_pylist() for c in batch.columns], musts, strict=True):
                value, count = np.frombuffer(b"".join(values), np.uint64), np.frombuffer(b"".join(counts), np.uint8)
                value, at = np.unique(value, return_index=True)
                retained = min(n, size)
                room = retained - must + 1 - (retained - len(value))
                if room > 0:
                    out.append((key, id_, n, value[np.lexsort((value, count[at]))[:room]].astype(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), arrow_id, pa.int64(), pa.list_(pa.int64())), strict=True)], ["key", "id", "n", "rarest"])

    posted = classes.select("key", "sketch").mapInArrow(post_sketches, POSTED)
    posted = posted.withColumn("part", F.when(F.col("shard") < 0, F.rand(2) * 1000 + 1e6).otherwise(F.col("shard")).cast("int"))
    by_class = posted.groupBy("part").applyInPandas(lambda pdf: held(pdf), "key long, values binary, counts binary")
    by_class = by_class.groupBy("key").agg(F.collect_list("values").alias("values"), F.collect_list("counts").alias("counts"))  # at most `size` values a class
    able = by_class.join(classes.select("key", "id", "n"), "key").select("key", "id", "n", "values", "counts")
    able = staged(able.mapInArrow(rarest_held, f"key long, id {id_type}, n long, rarest array<long>"), "able")
    rarest = able.select("key", F.explode("rarest").alias("value"))
    least = rarest.groupBy("value").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    least = staged(least.select("value", "least", "n"), "least")
    blocks = components(join_by_key(rarest, least, "value").select(F.col("key").alias("a"), F.col("least").alias("b")))
    blocks = staged(blocks.select(F.col("node").alias("key"), F.col("label").alias("block")).join(able.select("key", "id", "n"), "key"), "blocks")

    # full sets of one row of each class that has a possible partner
    n_blocks = blocks.count()
    ids = blocks.select("id")
    chosen = source.join(F.broadcast(ids) if n_blocks <= BROADCAST_CLASSES else ids, F.equal_null(source["id"], ids["id"]), "left_semi") if n_blocks else source.limit(0)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = set()
            for _, _, token, edges, key in all_sets(batch, 1, k):
                new = [r for r, x in enumerate(key.tolist()) if x and x not in done and not done.add(x)]
                yield pa.RecordBatch.from_arrays([pa.array(key[new], pa.int64()), pa.array([token[edges[r] : edges[r + 1]].tobytes() for r in new], pa.binary())], ["key", "tokens"])

    sets = chosen.mapInArrow(full, "key long, tokens binary")
    weight = staged(blocks.groupBy("block").agg(F.sum(F.col("n") + size).alias("weight"), F.count(F.lit(1)).alias("n")), "weights")
    total = int(weight.agg(F.sum("weight")).first()[0] or 0)
    packs = n_packs(spark, total)
    small = F.col("weight") <= SHARD_VALUES
    tasks = blocks.join(weight.where(small).select("block"), "block", "left_semi").select("key", F.struct(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("p"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")).alias("task"))
    big = weight.where(~small)
    if not big.isEmpty():
        # chunks by size class (a factor of den / num apart, so links stay in one or two classes that follow) and by hash
        placed = blocks.join(big.select("block"), "block").withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))))
        levels = staged(placed.groupBy("block", "level").agg(F.ceil(F.sum(F.col("n") + size) / (SHARD_VALUES / 2)).cast("long").alias("parts")), "levels")
        placed = placed.join(levels, ["block", "level"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")))
        near = levels.select("block", F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)])).alias("level"), F.col("level").alias("other"), F.col("parts").alias("others"))
        pairs = placed.join(near, ["block", "level"]).withColumn("opposite", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        own = lambda level, part: F.col(level) * 1_000_000 + F.col(part)
        i, j = own("level", "part"), own("other", "opposite")
        tasks = tasks.unionByName(pairs.select("key", F.struct(F.col("block").alias("p"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).alias("task")))
    tasks = staged(tasks, "tasks")
    # rows that repeat an id and a text bring a set once a batch, so search() drops what comes again
    work = sets.join(F.broadcast(tasks) if tasks.count() <= BROADCAST_CLASSES else tasks, "key")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        pdf = pdf.assign(n=pdf["tokens"].str.len()).sort_values(["n", "key"])
        keys = pdf["key"].to_numpy(np.int64)
        found = np.array(sketch_links([np.frombuffer(t, np.uint64) for t in pdf["tokens"]], size, num, den), np.int64).reshape(-1, 2)
        return pd.DataFrame(stars(keys[found].tolist()), columns=["a", "b"], dtype=np.int64)

    links = work.groupBy("task").applyInPandas(lambda pdf: search(pdf), "a long, b long")
    labels = staged(components(links).select(F.col("node").alias("key"), "label"), "labels")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_CLASSES else labels
    groups = about.select("id", "n", "key", "th").join(labels, "key", "left").withColumn("g", F.coalesce("label", "key"))
    least_id = groups.where("key <> 0").groupBy("g").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    shared_ids = staged(least_id.where("rows > 1").select("g", "component_id"), "components")
    shared_ids = F.broadcast(shared_ids) if shared_ids.count() <= BROADCAST_CLASSES else shared_ids
    joined = groups.join(shared_ids, "g", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.equal_null("id", "component_id").alias("kept"), F.col("th").alias("text_hash"))


#: DuckDB SQL for sketch_join with its default parameters over {docs}: all pairs that share a shingle, counted, and their closure.
SKETCH_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
