"""Removal of repeated passages by sharded suffix arrays.

A byte goes if it lies in a `window`-byte string that also starts elsewhere. Sorting every suffix together isn't
needed: equal windows hold equal anchors (the least hash of a k-gram in the window, the last of equals) at equal
offsets. So

1. every text's anchors are found, and hashes of the stretch left of each, right of each, and of the whole piece that its
   windows can reach are posted by hash range. A window that repeats makes the left or the right stretch repeat;
2. where the whole piece repeats, all its windows do, and one copy stays to stand for it. Pieces where only a stretch
   repeats, and those that stand for others, go to the shard of their anchor;
3. a shard's pieces become one text with separators. Windows whose hash no other has are left out, and equal runs of the
   others count once; the suffixes of what remains are sorted by external induced sorting. Neighbours with a common prefix of
   a window or more are repeats.

Texts that are equal as a whole are one class; the rows of a class of several copies lose everything, if long enough.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of
from .suffix_sort import SEP, repeated_starts
from .textbytes import BASE, BYTE, buffers, chunks, give_back, mix, powers, sliced

GRAM = 32
CHUNK_BYTES = 1 << 20
#: A longer text is scanned by segments with margins.
SEGMENT_BYTES = 1 << 22
#: A hash met so often in one batch is posted once for the batch.
HEAVY = 16
SHARD_POSTINGS = 1_000_000
SHARD_BYTES = 1_000_000
#: Classes whose keys may be broadcast to filter texts before they are shuffled.
BROADCAST_CLASSES = 1_000_000
LEFT, RIGHT, PIECE, MEMBER = 0, 1, 2, 3
_inverse = np.uint64(pow(int(BASE), -1, 2**64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        step = np.full(max(n, 2 * len(_inverses), 64), _inverse, np.uint64)
        step[0] = 1
        _inverses = np.multiply.accumulate(step)
    return _inverses


class Hashes:
    """Hashes of any stretch of a buffer, by sums of bytes times powers."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(len(data))[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * inverses(len(self.sums))[start])


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, hashes: Hashes) -> np.ndarray:
    """Positions of the anchors of every window inside the texts that bounds (len + 1) cut data into."""
    width = window - GRAM + 1
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    at = np.arange(n - GRAM + 1)
    key = (hashes.of(at, at + GRAM) & ~low) | (low - at.astype(np.uint64))
    n_blocks = -(-len(key) // width)
    key = np.concatenate([key, np.full(n_blocks * width - len(key), ~np.uint64(0))]).reshape(n_blocks, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    start = np.flatnonzero(room >= window)
    least = np.minimum(back[start], ahead[start + width - 1])
    return np.unique((low - (least & low)).astype(np.int64))


def stretches(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position in its text, kind, hash) of what is posted for every anchor."""
    hashes = Hashes(data)
    at = anchors(data, bounds, window, hashes)
    of = np.searchsorted(bounds, at, "right") - 1
    lo, hi = bounds[of], bounds[of + 1]
    half = (window - GRAM) // 2
    out = []
    left = at - half >= lo
    out.append((left, LEFT, hashes.of(at[left] - half, at[left] + GRAM)))
    right = at + window - half <= hi
    out.append((right, RIGHT, hashes.of(at[right], at[right] + window - half)))
    start, end = np.maximum(lo, at - (window - GRAM)), np.minimum(hi, at + window)
    whole = end - start >= window
    where = ((at - start << 24) + (end - start)).astype(np.uint64)
    out.append((whole, PIECE, mix(hashes.of(start[whole], end[whole]) + where[whole])))
    pick = [np.flatnonzero(ok) for ok, _, _ in out]
    kind = np.concatenate([np.full(len(p), k, np.int64) for p, (_, k, _) in zip(pick, out, strict=True)])
    salt = mix(kind.astype(np.uint64) + np.uint64(77))
    pick = np.concatenate(pick)
    return of[pick], (at - lo)[pick], kind, mix(np.concatenate([h for _, _, h in out]) ^ salt)


def scanned(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """stretches() of all texts, by chunks; a text beyond SEGMENT_BYTES by segments whose margins hold all that an anchor sees."""
    for i, j in chunks(offsets, CHUNK_BYTES):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= SEGMENT_BYTES or j - i > 1:
            of, at, kind, token = stretches(data[a:b], offsets[i : j + 1] - a, window)
            yield of + i, at, kind, token
            continue
        margin = 2 * window
        for s in range(a, b, SEGMENT_BYTES):
            e = min(s + SEGMENT_BYTES, b)
            x, y = max(a, s - margin), min(b, e + margin)
            _, at, kind, token = stretches(data[x:y], np.array([0, y - x]), window)
            own = (at + x >= s) & (at + x < e)
            yield np.full(int(own.sum()), i), (at + x - a)[own], kind[own], token[own]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def by_key(keys: np.ndarray, codes: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(keys, kind="stable")
    keys, codes = keys[order], codes[order]
    return [(int(keys[a]), codes[a : a + n].tobytes()) for a, n in zip(*runs(keys), strict=True)]


def cover(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, those that touch merged, as sorted starts and ends."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def zeros(folder: str, n: int, memory: int) -> np.ndarray:
    """n booleans, on disk if they don't fit memory."""
    return np.zeros(n, bool) if n <= memory else np.memmap(f"{folder}/{uuid.uuid4().hex}", bool, "w+", shape=(n,))


def true_runs(mask: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of True, read in steps."""
    starts, ends, before = [], [], False
    for a in range(0, len(mask), step):
        part = np.asarray(mask[a : a + step])
        edge = np.flatnonzero(part[1:] != part[:-1]) + 1
        if len(part) and bool(part[0]) != before:
            edge = np.concatenate([[0], edge])
        rises = np.asarray(part[edge]) if len(edge) else np.zeros(0, bool)
        starts.append(edge[rises] + a)
        ends.append(edge[~rises] + a)
        before = bool(part[-1])
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(starts), cat([*ends, [len(mask)]] if before else ends)


def candidates(text: np.ndarray, window: int, folder: str, memory: int) -> np.ndarray:
    """True at each position of a text with separators whose window has the hash of another one.

    What is left out repeats nowhere, so a passage that many pieces hold costs its sorting once, not once a piece. Beyond
    memory, hashes go to files by their low bits, and one file is sorted at a time.
    """
    n, step, low = len(text), 1 << 18, np.uint64(0xFFFFFFFF)
    out = zeros(folder, n, memory)
    n_files = -(-n * 8 // memory) if n * 8 > memory else 0
    files = [open(f"{folder}/hashes-{i}", "wb") for i in range(n_files)]  # noqa: SIM115
    keys = []

    def mark(key: np.ndarray) -> None:
        key.sort()
        for a in range(0, len(key) - 1, step):
            part = key[a : a + step + 1]
            same = np.flatnonzero(part[1:] >> np.uint64(32) == part[:-1] >> np.uint64(32))
            out[(part[same] & low).astype(np.int64)] = True
            out[(part[same + 1] & low).astype(np.int64)] = True

    for a in range(0, n - window + 1, step):
        b = min(a + step, n - window + 1)
        piece = np.asarray(text[a : b + window - 1])
        ends = np.append(np.flatnonzero(piece == SEP), len(piece))
        p = np.arange(b - a)
        p = p[ends[np.searchsorted(ends, p)] - p >= window]
        h = Hashes(piece).of(p, p + window)
        key = (h & ~low) | (p + a).astype(np.uint64)  # half a hash and the position in one number, sorted in place
        if not files:
            keys.append(key)
            continue
        of = (h & low) % np.uint64(n_files)
        order = np.argsort(of, kind="stable")
        for s, m in zip(*runs(of[order]), strict=True):
            files[int(of[order[s]])].write(key[order[s : s + m]].tobytes())
    for f in files:
        f.close()
        mark(np.fromfile(f.name, np.uint64))
        os.unlink(f.name)
    if keys:
        mark(np.concatenate(keys))
    return out


def repeats(text: np.ndarray, window: int, memory: int) -> np.ndarray:
    """(start, end) of the runs of positions at which repeated_starts() of a text of any size holds: only runs of candidates are sorted,
    and of runs that are equal, by hash and length, one. Returned as an array of two rows."""
    with tempfile.TemporaryDirectory(prefix="repeats-") as folder:
        starts, ends = true_runs(candidates(text, window, folder, memory))
        ends = ends + window - 1
        names = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):  # neighbouring runs that lie in a stretch of bounded size, or one longer run
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
            names[i:j] = Hashes(np.asarray(text[starts[i] : ends[j - 1]])).of(starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j
        names = mix(names + (ends - starts).astype(np.uint64))
        _, one, count = np.unique(names, return_index=True, return_counts=True)
        twice = np.isin(names, names[one[count > 1]])  # two places hold the whole run
        found = [np.stack([starts[twice], ends[twice] - window + 1])]
        one.sort()
        starts, ends = starts[one], ends[one]
        if not len(one):
            return found[0]
        length = ends - starts
        at = np.cumsum(length + 1) - length - 1
        joint = np.zeros(int((length + 1).sum()), np.uint8)
        for s, e, x in zip(starts.tolist(), ends.tolist(), at.tolist(), strict=True):
            joint[x : x + e - s] = text[s:e]
        s, e = true_runs(repeated_starts(joint, window, memory))
        of = np.searchsorted(at, s, "right") - 1
        found.append(np.stack([s, e]) + (starts - at)[of])
        s, e = np.concatenate(found, axis=1)
        return np.stack(cover(s, e))


class Pieces:
    """One shard: pieces, each closed by a separator, as one text in memory or, beyond a bound, on disk."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.size, self.file = folder, memory, 0, None
        self.held: list[bytes] = []
        self.keys: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.seen: set[int] = set()

    def add(self, key: int, starts: bytes, ends: bytes, data: np.ndarray) -> None:
        if key in self.seen:  # rows of one class may repeat
            return
        self.seen.add(key)
        start = np.frombuffer(starts, np.int64)
        length = np.frombuffer(ends, np.int64) - start
        text = np.zeros(int((length + 1).sum()), np.uint8)
        edge = np.cumsum(length + 1)
        inside = np.ones(len(text), bool)
        inside[edge - 1] = False
        text[inside] = data + 1
        self.keys.append(np.full(len(start), key, np.int64))
        self.starts.append(start)
        self.lengths.append(length)
        self.size += len(text)
        self.held.append(text.tobytes())
        if self.file or self.size > self.memory:
            self.file = self.file or open(f"{self.folder}/{uuid.uuid4().hex}", "wb")  # noqa: SIM115
            self.file.write(b"".join(self.held))
            self.held.clear()

    def spans(self, window: int) -> list[tuple[int, bytes, bytes]]:
        """(key, starts, ends) of what repeats."""
        if not self.keys:
            return []
        if self.file:
            self.file.close()
            text = np.memmap(self.file.name, np.uint8, "r")
        else:
            text = np.frombuffer(b"".join(self.held), np.uint8)
            self.held.clear()
        s, e = repeats(text, window, self.memory)
        if self.file:
            os.unlink(self.file.name)
        owner, start, length = (np.concatenate(x) for x in (self.keys, self.starts, self.lengths))
        at = np.cumsum(length + 1) - length - 1
        piece = np.searchsorted(at, s, "right") - 1
        moved = start[piece] - at[piece]
        of, s, e = owner[piece], s + moved, e + moved + window - 1
        order = np.argsort(of, kind="stable")
        return [(int(of[order[a]]), s[order[a : a + n]].tobytes(), e[order[a : a + n]].tobytes()) for a, n in zip(*runs(of[order]), strict=True)]


POSTED = "part int, keys binary, tokens binary, owners binary, codes binary, counts binary"
MOVED = "part int, key long, starts binary, ends binary, bytes binary"


def repeat_removal(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", memory: int = 1 << 26) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the bytes that stay, as binary), removed (array of [start, end) in bytes).

    Texts are UTF-8 bytes, a null one is empty; matches never cross texts and may overlap, inside one text too. What repeats is
    judged on the input. Rows with equal texts count as separate places, so each loses all if it has `window` bytes. An empty
    table gives no rows; other columns are not read. Classes of equal texts are told apart by a 64-bit hash of the whole text;
    repeats inside are found by comparing bytes but for pieces equal as a whole, which go by a 64-bit hash too.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col).cast("string")).alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    about = source.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    classes = about.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
    classes = staged(classes, "classes")
    long_enough = F.octet_length("text") >= window
    n_bytes = classes.where(F.col("n_bytes") >= window).agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-int(n_bytes * 3 * 2 // (window - GRAM + 2)) // SHARD_POSTINGS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in POSTED.split(", ")]
        for batch in sliced(batches, 1):
            keys, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            data, offsets = buffers(batch.column(1).take(pa.array(first)))
            parts = list(scanned(data, offsets, window))
            if not parts:
                continue
            of, at, kind, token = (np.concatenate(x) for x in zip(*parts, strict=True))
            code = at * 4 + kind
            order = np.argsort(token, kind="stable")
            token, of, code = token[order], of[order], code[order]
            start, length = runs(token)
            heavy = np.repeat(length >= HEAVY, length)
            keep = ~heavy
            keep[start] = True
            count = np.where(heavy, HEAVY, 1).astype(np.uint8)[keep]
            known = code[~keep]
            known[known % 4 == PIECE] += MEMBER - PIECE
            rows = [(-1, np.int64(k).tobytes(), b"", b"", c, b"") for k, c in by_key(keys[of[~keep]], known)]
            token, of, code = token[keep], of[keep], code[keep]
            part = ((token >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)  # in order, as tokens are
            for s, n in zip(*runs(part), strict=True):
                used, local = np.unique(of[s : s + n], return_inverse=True)
                rows.append((int(part[s]), keys[used].tobytes(), token[s : s + n].tobytes(), local.astype(np.uint32).tobytes(), code[s : s + n].tobytes(), count[s : s + n].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)
            give_back()

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["part"] < 0
        rows = [(int(np.frombuffer(r.keys, np.int64)[0]), r.codes) for r in pdf[known].itertuples(index=False)]
        tokens, keys, codes, counts = [], [], [], []
        for r in pdf[~known].itertuples(index=False):
            tokens.append(np.frombuffer(r.tokens, np.uint64))
            keys.append(np.frombuffer(r.keys, np.int64)[np.frombuffer(r.owners, np.uint32)])
            codes.append(np.frombuffer(r.codes, np.int64))
            counts.append(np.frombuffer(r.counts, np.uint8))
        if tokens:
            token, key, code, count = (np.concatenate(x) for x in (tokens, keys, codes, counts))
            order = np.lexsort((code, key, token))
            token, key, code, count = token[order], key[order], code[order], count[order]
            new = np.ones(len(token), bool)  # a class whose copies lie in several batches
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (code[1:] != code[:-1])
            token, key, code, count = token[new], key[new], code[new], count[new]
            start, length = runs(token)
            repeated = np.repeat(np.add.reduceat(count.astype(np.int64), start) > 1, length)
            later = np.ones(len(token), bool)
            later[start] = False
            code = code + (MEMBER - PIECE) * ((code % 4 == PIECE) & later)
            rows += by_key(key[repeated], code[repeated])
        give_back()
        return pd.DataFrame(rows, columns=["key", "codes"])

    scatter = lambda seed: F.when(F.col("part") < 0, F.rand(seed) * 1000 + 1e6).otherwise(F.col("part")).cast("int")
    posted = source.where(long_enough).select("key", "text").mapInArrow(post, POSTED).withColumn("task", scatter(1))
    found = posted.groupBy("task").applyInPandas(lambda pdf: judge(pdf), "key long, codes binary")
    found = staged(found.groupBy("key").agg(F.collect_list("codes").alias("codes")), "anchors")
    size = found.agg(F.count(F.lit(1)), F.sum(F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / 8)).first()
    shards = max(1, -(-int((size[1] or 0) / 2.5 * 2 * window) // SHARD_BYTES))
    chosen = found.join(classes.select("key", "id"), "key")

    def texts_of(keys: DataFrame, n: int) -> DataFrame:
        """(key, text) of one row, or equal ones, of each class in keys (key, id)."""
        wanted = keys.select(F.col("key").alias("wk"), F.col("id").alias("wi"))
        wanted = F.broadcast(wanted) if n <= BROADCAST_CLASSES else wanted
        return source.join(wanted, (F.col("key") == F.col("wk")) & F.equal_null("id", "wi"), "left_semi").select("key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MOVED.split(", ")]
        half = (window - GRAM) // 2
        for batch in sliced(batches, 1):
            rows = []
            for key, text, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                code = np.unique(np.frombuffer(b"".join(blobs), np.int64))
                at, inverse = np.unique(code >> 2, return_inverse=True)
                has = np.zeros((len(at), 4), bool)
                has[inverse, code & 3] = True
                whole = has[:, PIECE] | has[:, MEMBER]
                lo, hi = np.maximum(at - (window - GRAM), 0), np.minimum(at + window, len(data))
                s, e = cover(lo[whole], hi[whole])
                if len(s):
                    rows.append((-1, key, s.tobytes(), e.tobytes(), b""))
                go = ~whole & (has[:, LEFT] | has[:, RIGHT]) | has[:, PIECE]
                s = np.where(has[:, LEFT] | whole, lo, np.maximum(at - half, 0))[go]
                e = np.where(has[:, RIGHT] | whole, hi, np.minimum(at + window - half, len(data)))[go]
                at = at[go]
                ok = e - s >= window
                s, e, at = s[ok], e[ok], at[ok]
                if not len(at):
                    continue
                # one hash of each anchor's gram: its own bytes, so every text sends it to the same shard
                grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]
                token = mix((BYTE[grams] * powers(GRAM)[:GRAM]).sum(axis=1, dtype=np.uint64))
                part = ((token >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for a, n in zip(*runs(part[order]), strict=True):
                    ps, pe = cover(s[order[a : a + n]], e[order[a : a + n]])
                    rows.append((int(part[order[a]]), key, ps.tobytes(), pe.tobytes(), b"".join(data[x:y].tobytes() for x, y in zip(ps, pe, strict=True))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            give_back()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after another, as rows come in order of shards; marks pass through."""

        def batch_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "starts", "ends"])

        with tempfile.TemporaryDirectory(prefix="shards-") as folder:
            shard, pieces = -1, None
            for batch in batches:
                passed = []
                for part, key, starts, ends, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                    part, row = part.as_py(), (key.as_py(), starts.as_py(), ends.as_py())
                    if part < 0:
                        passed.append(row)
                        continue
                    if part != shard:
                        if pieces:
                            yield batch_of(pieces.spans(window))
                            give_back()
                        shard, pieces = part, Pieces(folder, memory)
                    pieces.add(*row, np.frombuffer(data.as_buffer(), np.uint8))
                yield batch_of(passed)
            if pieces:
                yield batch_of(pieces.spans(window))
                give_back()

    moved = texts_of(chosen, size[0]).join(chosen.select("key", "codes"), "key").select("key", "text", "codes").mapInArrow(cut, MOVED)
    dealt = moved.withColumn("task", scatter(2)).repartition("task").sortWithinPartitions("task", "part").drop("task")
    spans = dealt.mapInArrow(sort, "key long, starts binary, ends binary")
    spans = spans.groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    partial = spans.join(classes.where(F.col("copies") == 1).select("key", "id"), "key")
    partial = staged(partial, "spans")

    span_type = "array<struct<s:long,e:long>>"
    done = f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, kept binary, removed {span_type}"
    n_partial = partial.count()
    rest = source.join(F.broadcast(partial.select("key")) if n_partial <= BROADCAST_CLASSES else partial.select("key"), "key", "left_anti")
    copied = classes.where(F.col("copies") > 1).where(F.col("n_bytes") >= window).select("key", F.lit(True).alias("gone"))
    copied = staged(copied, "copied")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_CLASSES else copied
    rest = rest.join(copied, "key", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    size_of = F.octet_length("text").cast("long")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("s"), size_of.alias("e")))
    rest = rest.select(
        "id", size_of.alias("n_bytes"), F.when(F.col("gone"), F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"),
        F.when(F.col("gone"), all_of_it).otherwise(F.array().cast(span_type)).alias("removed"),
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in sliced(batches, 1):
            kept, removed, n = [], [], []
            for text, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                s, e = cover(np.frombuffer(b"".join(starts), np.int64), np.frombuffer(b"".join(ends), np.int64))
                cuts = np.stack([np.append(0, e), np.append(s, len(data))], axis=1)
                kept.append(b"".join(data[a:b].tobytes() for a, b in cuts))
                removed.append([{"s": int(a), "e": int(b)} for a, b in zip(s, e, strict=True)])
                n.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], ["id", "n_bytes", "kept", "removed"])

    own = source.join(F.broadcast(partial.select("key")) if n_partial <= BROADCAST_CLASSES else partial.select("key"), "key", "left_semi")
    stripped = own.join(partial.drop("id"), "key").select("id", "text", "starts", "ends").mapInArrow(strip, done)
    both = rest.unionByName(stripped)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return both.select(F.col("id").alias(id_col), "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept", "removed")


#: DuckDB SQL for the digest of repeat_removal with a window of 200 over {docs}: every window is hashed and counted.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM {docs}),
w AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS p FROM d)),
s AS (SELECT rid, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT rid, p, sum(CASE WHEN p - o <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS g FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS o FROM s)),
r AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY rid, g),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f FROM r),
t AS (SELECT rid, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kept, max(b) AS z FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (rid)
"""
