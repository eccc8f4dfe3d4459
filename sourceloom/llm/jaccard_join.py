"""N-gram Jaccard self-join by T-occurrence search.

Two sets of sizes a and b have a Jaccard similarity of p/q or more exactly if they share T = ceil(p (a + b) / (p + q))
shingles, so a document searches its shingles' inverted lists for documents that occur T times. The search (DivideSkip)
merges all but the L longest lists, keeps what reaches T - L there, and probes the long lists by bisection. L follows from T and
the longest list. The merge is done for all short lists at once by sorting their concatenation, which gives what a heap over
their heads gives, in compiled code; a test holds it against the heap.

Around that search, three steps keep lists short and in memory, and lose no link:

1. Sets that are equal become one class. A class's shingles below a hash bound are posted; who shares fewer of them with any
   other class than a partner would have to, has none.
2. The others' shingles are all counted. Shingles of one class can't match. Of the rest, the rarest
   size - ceil(size p / q) + 1 of two linked sets (the ones counted as unique included) overlap: who shares one of those
   is connected, and the connected components of that relation are searched apart.
3. Components are packed into shards of a bounded number of shingles; a larger component is cut into chunks by size,
   and every pair of chunks whose sizes allow a link is a shard.

Shingles travel as packed arrays by ranges of their hash. A shingle met in many classes of one batch is posted once for the
batch, so no list grows with a hot passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, staged
from .components import components
from .textbytes import FOLD, IS_SPACE, buffers, chunks, mix, sliced, word_hashes

CHUNK_BYTES = 1 << 21
#: Shingles of one class count up to this; beyond, a shingle is heavy.
HEAVY = 16
#: Packed shingles that one task holds at a time, and so few that a pack of their own is not worth it.
SHARD_SHINGLES, LEAST_SHINGLES = 1_500_000, 50_000
#: Cost of merging a list against probing it, the constant of DivideSkip's choice of L.
MERGE_COST = 0.0085
#: Classes that a broadcast may hold; beyond, texts are joined by a shuffle with Spark's own runtime filter.
BROADCAST_CLASSES = 1_000_000
NO_DOC = np.uint32(0xFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds of len + 1): each text's distinct shingles of k words as sorted 64-bit hashes."""
    n = len(offsets) - 1
    base = offsets[0]
    part = FOLD[data[base : offsets[-1]]]
    starts, _, words = word_hashes(part, ~IS_SPACE[part], offsets[1:-1] - base)
    of = np.searchsorted(offsets - base, starts, "right") - 1
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    tokens, owners = [], []
    for width in range(1, k + 1):
        if width == k:
            at = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)
        else:
            at = first[count == width]
        if len(at):
            h = np.full(len(at), width, np.uint64)
            for j in range(width):
                h = h + words[at + j] * factor[j]
            tokens.append(mix(h))
            owners.append(of[at])
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(token)
    order = order[np.argsort(owner[order], kind="stable")]
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(n + 1))


def set_keys(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; 0 for the empty one."""
    n = np.diff(bounds)
    key = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        sums = np.add.reduceat(mix(token ^ np.uint64(0xD6E8FEB86659FD93)), bounds[:-1][full])
        key[full] = (mix(sums + n[full].astype(np.uint64)) >> np.uint64(1)) | np.uint64(1)
    return key.astype(np.int64)


def all_sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, bounds, keys) by chunks of a batch."""
    data, offsets = buffers(batch.column(column))
    for i, j in chunks(offsets, CHUNK_BYTES):
        token, bounds = shingle_sets(data, offsets[i : j + 1], k)
        yield i, j, token, bounds, set_keys(token, bounds)


def distinct_sets(batch: pa.RecordBatch, column: int, k: int, below: np.uint64 | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, tokens, index into keys of each token) of a batch's different non-empty sets; only tokens below a bound."""
    keys, tokens, owners, seen, n = [], [], [], set(), 0
    for _, _, token, bounds, key in all_sets(batch, column, k):
        sizes = np.diff(bounds)
        fresh = np.zeros(len(key), bool)
        for r, x in enumerate(key.tolist()):
            if x and x not in seen:
                seen.add(x)
                fresh[r] = True
        row = np.repeat(np.arange(len(key)), sizes)
        new = fresh[row] if below is None else fresh[row] & (token < below)
        place = np.cumsum(fresh) - 1 + n
        keys.append(key[fresh])
        tokens.append(token[new])
        owners.append(place[row[new]].astype(np.uint32))
        n += int(fresh.sum())
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(keys, np.int64), cat(tokens, np.uint64), cat(owners, np.uint32)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


POSTED = "shard int, keys binary, tokens binary, owners binary, counts binary"


def post(keys: np.ndarray, tokens: np.ndarray, owners: np.ndarray, shards: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(postings by shard, tokens, owners of what is heavy in this batch and so posted only once, without an owner)."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    start, length = runs(tokens)
    heavy = np.repeat(length >= HEAVY, length)
    keep = ~heavy
    t = np.concatenate([tokens[keep], tokens[start[length >= HEAVY]]])
    o = np.concatenate([owners[keep], np.full(int((length >= HEAVY).sum()), NO_DOC)])
    c = np.concatenate([np.ones(int(keep.sum()), np.uint8), np.full(int((length >= HEAVY).sum()), HEAVY, np.uint8)])
    # multiply-shift of the upper bits; what is posted below a bound is spread too, as the token is mixed again
    shard = ((mix(t) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((t, shard))
    t, o, c, shard = t[order], o[order], c[order], shard[order]
    rows = []
    for s, n in zip(*runs(shard), strict=True):
        own = o[s : s + n]
        used, inverse = np.unique(own[own != NO_DOC], return_inverse=True)
        local = np.full(n, NO_DOC)
        local[own != NO_DOC] = inverse.astype(np.uint32)
        rows.append((int(shard[s]), keys[used].tobytes(), t[s : s + n].tobytes(), local.tobytes(), c[s : s + n].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["shard", "keys", "tokens", "owners", "counts"])
    return out, tokens[heavy], owners[heavy]


def gather(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, keys - 0 without an owner, how many classes hold the token, up to HEAVY), by token, of a shard's postings."""
    tokens, keys, counts = [], [], []
    for row in pdf.itertuples(index=False):
        own, at = np.frombuffer(row.keys, np.int64), np.frombuffer(row.owners, np.uint32)
        key = np.zeros(len(at), np.int64)
        key[at != NO_DOC] = own[at[at != NO_DOC]]
        tokens.append(np.frombuffer(row.tokens, np.uint64))
        keys.append(key)
        counts.append(np.frombuffer(row.counts, np.uint8))
    token, key, count = np.concatenate(tokens), np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort((key, token))
    token, key, count = token[order], key[order], count[order]
    again = np.zeros(len(token), bool)  # the same class posted by two batches
    again[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1]) & (key[1:] != 0)
    token, key, count = token[~again], key[~again], count[~again]
    start, length = runs(token)
    total = np.minimum(np.add.reduceat(count.astype(np.int64), start), HEAVY) if len(start) else np.zeros(0, np.int64)
    return token, key, np.repeat(total, length)


def n_long(least: int, longest: int) -> int:
    """How many of the longest lists are probed: fewer than the occurrences sought, the fewer the longer the longest one."""
    return max(0, min(least - 1, int(least / (MERGE_COST * math.log2(max(longest, 2)) + 1))))


def divide_skip(sizes: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, num: int, den: int, every: bool = False) -> list[tuple[int, int, int]]:
    """(i, j, overlap) among sets given in order of size: links that connect exactly what all links of num/den or more connect.

    tokens[bounds[i]:bounds[i + 1]] are the shingles of set i that some other set may share. Each set searches the lists
    of its shingles, up to itself; sets that are already connected to it are left out before long lists are probed, unless
    `every` link is wanted.
    """
    n = len(sizes)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    order = np.argsort(tokens, kind="stable")  # by token, then by set
    lists = of[order]
    start, length = runs(tokens[order])
    list_of = np.empty(len(tokens), np.int64)
    list_of[order] = np.repeat(start, length)
    place = np.empty(len(tokens), np.int64)
    place[order] = np.arange(len(tokens))
    label, members, links = np.arange(n), {}, []
    for x in range(n):
        mine = slice(bounds[x], bounds[x + 1])
        lo, hi = list_of[mine], place[mine]
        earlier = hi - lo
        lo, hi = lo[earlier > 0], hi[earlier > 0]
        smallest = -(-int(sizes[x]) * num // den)
        least = -(-num * (int(sizes[x]) + smallest) // (num + den))  # T for the smallest partner
        if len(lo) < least:
            continue
        by_length = np.argsort(hi - lo, kind="stable")
        lo, hi = lo[by_length], hi[by_length]
        n_short = len(lo) - n_long(least, int(hi[-1] - lo[-1]))  # a partner is in one short list at least
        merged = np.concatenate([lists[a:b] for a, b in zip(lo[:n_short].tolist(), hi[:n_short].tolist(), strict=True)])
        able = sizes[merged] >= smallest
        merged = merged[able if every else able & (label[merged] != label[x])]
        if not len(merged):
            continue
        merged.sort(kind="stable")  # the merge of sorted lists
        s, occurs = runs(merged)
        found = merged[s]
        need = -(-num * (int(sizes[x]) + sizes[found]) // (num + den))
        longs = list(zip(lo[n_short:].tolist(), hi[n_short:].tolist(), strict=True))
        for done, (a, b) in enumerate(longs):
            alive = occurs + (len(longs) - done) >= need
            found, occurs, need = found[alive], occurs[alive], need[alive]
            if not len(found):
                break
            at = np.searchsorted(lists[a:b], found)
            occurs = occurs + (lists[a:b][np.minimum(at, b - a - 1)] == found)
        good = occurs >= need
        for y, overlap in zip(found[good].tolist(), occurs[good].tolist(), strict=True):
            if every:
                links.append((x, y, overlap))
                continue
            p, q = int(label[x]), int(label[y])
            if p != q:
                links.append((x, y, overlap))
                mp, mq = members.pop(p, [p]), members.pop(q, [q])
                if len(mp) < len(mq):
                    mp, mq, p = mq, mp, q
                label[mq] = p
                members[p] = mp + mq
    return links


def n_packs(spark: SparkSession, shingles: int) -> int:
    """Packs of whole components of bounded size, and more of them where tasks would be left without one."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-shingles // SHARD_SHINGLES), min(parts, -(-shingles // LEAST_SHINGLES)))


def linked_classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, sample: float, every: bool) -> tuple[DataFrame, DataFrame]:
    """(about: id, n, key, low, th of every row; links: a, b, overlap between keys of different sets, as divide_skip gives them)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    arrow_id = source.limit(0).toArrow().schema.field("id").type
    below = np.uint64(int(sample * 2**64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, token, bounds, key in all_sets(batch, 1, k):
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                low = np.bincount(row[token < below], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(arrow_id), pa.array(np.diff(bounds)), pa.array(key), pa.array(low.astype(np.int64)), batch.column(2).slice(i, j - i)], ["id", "n", "key", "low", "th"])

    hashed = source.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    about = staged(hashed.mapInArrow(describe, f"id {id_type}, n long, key long, low long, th long"), "sets")
    classes = about.where("key <> 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("low").alias("low"))
    total = classes.agg(F.sum("n"), F.sum("low")).first()
    n_low = int(total[1] or 0)

    # 1. who shares enough of the sampled shingles
    shards = max(1, -(-n_low // SHARD_SHINGLES))

    def post_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys, tokens, owners = distinct_sets(batch, 1, k, below)
            out, _, heavy = post(keys, tokens, owners, shards)
            count = np.bincount(heavy, minlength=len(keys))
            hot = pa.RecordBatch.from_arrays([pa.array(np.full(1, -1, np.int32)), *[pa.array([x.tobytes()], pa.binary()) for x in (keys[count > 0], count[count > 0].astype(np.int64))], *[pa.array([b""], pa.binary())] * 2], out.schema.names)
            yield out
            yield hot

    posted = source.mapInArrow(post_low, POSTED)
    posted = posted.withColumn("part", F.when(F.col("shard") < 0, F.rand(1) * 1000 + 1e6).otherwise(F.col("shard")).cast("int"))

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        hot = pdf["shard"] < 0
        keys, counts = [], []
        for row in pdf[hot].itertuples(index=False):
            keys.append(np.frombuffer(row.keys, np.int64))
            counts.append(np.frombuffer(row.tokens, np.int64))
        if not hot.all():
            _, key, df = gather(pdf[~hot])
            key, c = np.unique(key[(df > 1) & (key != 0)], return_counts=True)
            keys.append(key)
            counts.append(c)
        return pd.DataFrame({"key": np.concatenate(keys), "c": np.concatenate(counts)}) if keys else pd.DataFrame({"key": [], "c": []}).astype("int64")

    # a class posted by several batches may have its heavy shingles counted more than once: it is kept at worst
    n_shared = posted.groupBy("part").applyInPandas(shared, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    missing = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("long")
    plausible = classes.join(n_shared, "key", "left").where(F.coalesce("c", F.lit(0)) >= F.col("low") - missing).select("key", "id", "n")
    plausible = staged(plausible.where(F.col("n") > 0), "plausible")
    size = plausible.agg(F.count(F.lit(1)), F.sum("n")).first()

    # 2. all shingles of those, and how many classes hold each
    ids = plausible.select("id")
    ids = F.broadcast(ids) if size[0] <= BROADCAST_CLASSES else ids
    chosen = source.join(ids, F.equal_null(source["id"], ids["id"]), "left_semi") if size[0] else source.limit(0)
    shards = max(1, -(-int(size[1] or 0) // SHARD_SHINGLES))
    packed = "key long, tokens binary, counts binary"

    def post_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys, tokens, owners = distinct_sets(batch, 1, k, None)
            out, token, owner = post(keys, tokens, owners, shards)
            yield out
            order = np.argsort(owner, kind="stable")
            token, owner = token[order], owner[order]
            s, n = runs(owner)
            if len(s):
                blob = [[keys[owner[a : a + b]].tobytes() for a, b in zip(s, n, strict=True)], [token[a : a + b].tobytes() for a, b in zip(s, n, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), -1, np.int32)), *[pa.array(x, pa.binary()) for x in blob], *[pa.array([b""] * len(s), pa.binary())] * 2], out.schema.names)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        hot = pdf["shard"] < 0
        rows = [(int(np.frombuffer(r.keys[:8], np.int64)[0]), r.tokens, np.full(len(r.tokens) // 8, HEAVY, np.uint8).tobytes()) for r in pdf[hot].itertuples(index=False)]
        if not hot.all():
            token, key, df = gather(pdf[~hot])
            keep = (df > 1) & (key != 0)
            order = np.argsort(key[keep], kind="stable")
            token, key, df = token[keep][order], key[keep][order], df[keep][order].astype(np.uint8)
            rows += [(int(key[a]), token[a : a + b].tobytes(), df[a : a + b].tobytes()) for a, b in zip(*runs(key), strict=True)]
        return pd.DataFrame(rows, columns=["key", "tokens", "counts"])

    posted = chosen.mapInArrow(post_all, POSTED)
    posted = posted.withColumn("part", F.when(F.col("shard") < 0, F.rand(2) * 1000 + 1e6).otherwise(F.col("shard")).cast("int"))
    by_class = posted.groupBy("part").applyInPandas(counted, packed).groupBy("key").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("counts").alias("counts"))
    by_class = by_class.join(plausible.select("key", "n"), "key")

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge a class's arrays; its rarest shingles are those that the prefix still has room for after the unique ones."""
        for batch in batches:
            out = []
            for key, tokens, counts, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                token, count = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(counts), np.uint8)
                token, at = np.unique(token, return_index=True)
                room = n - -(-n * num // den) + 1 - (n - len(token))
                if room > 0:
                    out.append((key, n, token.tobytes(), token[np.lexsort((token, count[at]))[:room]].astype(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["key", "n", "tokens", "prefix"])

    able = staged(by_class.select("key", "tokens", "counts", "n").mapInArrow(first_ones, "key long, n long, tokens binary, prefix array<long>"), "able")
    prefix = able.select("key", F.explode("prefix").alias("token"))
    least = prefix.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    least = staged(least.select("token", "least", "n"), "least")
    blocks = components(join_by_key(prefix, least, "token").select(F.col("key").alias("a"), F.col("least").alias("b")))
    blocks = staged(blocks, "blocks")

    # 3. search by shards
    members = able.drop("prefix").join(blocks.select(F.col("node").alias("key"), F.col("label").alias("block")), "key")
    weight = members.groupBy("block").agg(F.sum(F.length("tokens") / 8).cast("long").alias("weight"))
    n_packed = int(weight.agg(F.sum("weight")).first()[0] or 0)
    packs = n_packs(docs.sparkSession, n_packed)
    members = members.join(weight, "block")
    small = F.col("weight") <= SHARD_SHINGLES
    alone = members.where(small).select(F.struct(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("p"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")).alias("task"), "key", "n", "tokens")
    tasks = alone
    big = members.where(~small)
    if not big.isEmpty():
        # chunks by size class (a factor of den / num apart, so links stay in one or two classes that follow) and by hash
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
        per_level = big.withColumn("level", level).groupBy("block", "level").agg(F.ceil(F.sum(F.length("tokens") / 8) / (SHARD_SHINGLES / 2)).cast("long").alias("parts"))
        placed = big.withColumn("level", level).join(per_level, ["block", "level"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")))
        span = per_level.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("level", "parts"))).alias("all"))
        placed = placed.join(span, "block")
        own = lambda lv, pt: lv * 1_000_000 + pt
        mine = own(F.col("level"), F.col("part"))
        near = F.flatten(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda d: F.transform(
            F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at("all", F.col("level") + d), F.lit(1)).cast("long") - 1), lambda q: own(F.col("level") + d, q))))
        pairs = placed.select("block", "key", "n", "tokens", mine.alias("mine"), F.explode(near).alias("other"))
        pairs = pairs.select(F.struct(F.col("block").alias("p"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("task"), "key", "n", "tokens")
        tasks = alone.unionByName(pairs)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "key"])
        keys, sizes = pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) // 8 for t in pdf["tokens"]])])
        links = divide_skip(sizes, np.frombuffer(b"".join(pdf["tokens"]), np.uint64), bounds, num, den, every)
        at = np.array(links, np.int64).reshape(-1, 3)
        a, b = keys[at[:, 0]], keys[at[:, 1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "overlap": at[:, 2]})

    return about, tasks.groupBy("task").applyInPandas(lambda pdf: search(pdf), "a long, b long, overlap long")


def jaccard_links(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(membership, links): every link between different sets, none lost.

    membership: id, class, n_shingles, rows (of the class), n_links of every row; links: a, b (classes, a < b), overlap. A class is all rows of
    one set, null without shingles. n_links counts the other rows that a row is linked with: those of its class and those of linked
    classes. A group of m different near copies has up to m (m - 1) / 2 links: jaccard_join gives components without them.
    """
    about, links = linked_classes(docs, k, num, den, id_col, text_col, sample, True)
    links = staged(links.distinct(), "links")  # chunks of one component meet more than once
    classes = staged(about.where("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "classes")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(classes.select(F.col("key").alias("b"), "rows"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("rows").alias("beyond"))
    per_class = classes.join(beyond, "key", "left").select("key", "rows", (F.col("rows") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.col("rows").alias("n"))
    rows = about.where("key <> 0").select("id", "key", F.col("n").alias("n_shingles"))
    own = join_by_key(rows, staged(per_class, "per-class"), "key").select(F.col("id").alias(id_col), F.col("key").alias("class"), "n_shingles", "rows", "n_links")
    none = about.where("key = 0").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class"), F.lit(0).cast("long").alias("n_shingles"), F.lit(1).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_links"))
    return own.unionByName(none), links


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample: float = 0.25) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, component_key (null without shingles), text_hash (xxhash64).

    Words are runs of non-space characters with A-Z lowered; a set holds a text's distinct shingles of k words, or its
    whole sequence if it has fewer. Two rows link if den * |intersection| >= num * |union|; component_id is the least id that links
    lead to. A null, empty or blank text has no shingles, links with nothing and is its own component. Rows with the same
    text are one class whatever their number; rows that repeat an id with different texts are judged by text, and a null
    id never names a component unless all its ids are null. An empty table gives no rows; other columns are not read.
    `sample` only moves work between steps; the result doesn't depend on it.
    """
    about, links = linked_classes(docs, k, num, den, id_col, text_col, sample, False)
    labels = components(links.select("a", "b"))
    # a hot class or component never meets in a task: both tables are broadcast up to a checked number of rows
    labels = staged(labels.select(F.col("node").alias("key"), "label"), "labels")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_CLASSES else labels
    groups = about.join(labels, "key", "left").withColumn("g", F.coalesce("label", "key"))
    least_id = groups.where("key <> 0").groupBy("g").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    shared_ids = staged(least_id.where("rows > 1").select("g", "component_id"), "components")
    shared_ids = F.broadcast(shared_ids) if shared_ids.count() <= BROADCAST_CLASSES else shared_ids
    joined = groups.join(shared_ids, "g", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.when(F.col("key") != 0, F.col("g")).alias("component_key"), F.col("th").alias("text_hash"))


#: DuckDB SQL for jaccard_join with its default parameters over {docs}: pairs that share a shingle, counted, and their closure.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
