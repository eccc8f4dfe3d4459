"""External induced suffix sorting with common-prefix values.

The text is a concatenation of pieces, each closed by a separator. Suffixes that start a rising run (the LMS suffixes)
are named by their substrings and sorted through the names - by recursion on the string of names while that is larger
than memory, by doubling ranks when it fits. From them all other suffixes are induced: a priority queue, ordered by first
symbol and arrival, takes tuples (suffix, common prefix with the one before), is emptied bucket by bucket in bulk, and
spills its buckets to disk beyond a bound. A suffix's common prefix is one more than the least common prefix met between
the two suffixes that induce it and its neighbour.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

PAD, SEP = 255, 0
#: Lengths (n,) of bytes to masks that turn what lies beyond into PAD, in a big-endian word of eight.
_MASK = np.array([(1 << (8 * (8 - n))) - 1 if n < 8 else 0 for n in range(9)], np.uint64)


class Queue:
    """Buckets of (suffix, common prefix) pairs in order of arrival; the oldest part of a large bucket lies on disk."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held = folder, limit, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list[str]] = {}
        self.n_files = 0

    def push(self, bucket: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        part = np.empty((2, len(suffixes)), np.int32)
        part[0], part[1] = suffixes, common
        self.parts.setdefault(bucket, []).append(part)
        self.held += part.nbytes
        while self.held > self.limit and self.parts:
            self.spill(max(self.parts, key=lambda b: sum(p.nbytes for p in self.parts[b])))

    def spill(self, bucket: int) -> None:
        path = f"{self.folder}/{id(self)}-{self.n_files}.npy"
        self.n_files += 1
        part = np.concatenate(self.parts.pop(bucket), axis=1)
        np.save(path, part)
        self.held -= part.nbytes
        self.files.setdefault(bucket, []).append(path)

    def pop(self, bucket: int) -> Iterator[np.ndarray]:
        """Empty a bucket; what is pushed into it meanwhile comes too."""
        while self.files.get(bucket) or self.parts.get(bucket):
            if self.files.get(bucket):
                path = self.files[bucket].pop(0)
                part = np.load(path)
                os.unlink(path)
            else:
                part = np.concatenate(self.parts.pop(bucket), axis=1)
                self.held -= part.nbytes
            yield part


def words(text: np.ndarray) -> np.ndarray:
    """A view of text with the eight symbols from every position as one big-endian number."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes a[i] and b[i], up to `most`; it ends before a separator. text is padded by most + 8."""
    out = np.zeros(len(a), np.int64)
    eight = words(text)
    live, ended = np.arange(len(a)), []
    for k in range(0, most, 8):
        x = eight[a[live] + k].astype(np.uint64)
        same = (x == eight[b[live] + k]) & ((x - _ONES) & ~x & _TOPS == 0)  # equal, and no separator among them
        ended.append(live[~same])
        live = live[same]
        out[live] += 8
        if not len(live):
            break
    rest = np.concatenate(ended) if ended else live
    for _ in range(8):
        x = text[a[rest] + out[rest]]
        rest = rest[(x == text[b[rest] + out[rest]]) & (x != SEP)]
        if not len(rest):
            break
        out[rest] += 1
    return np.minimum(out, most)


def regroup(group: np.ndarray, second: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each member's group, its name, whether it starts a new name) in `order`, which sorts by group, then second.

    Names are places in the whole order: a group's first member keeps the group's name, others take the place they start at.
    """
    g, s = group[order], second[order]
    first = np.ones(len(order), bool)
    first[1:] = g[1:] != g[:-1]
    new = first.copy()
    new[1:] |= s[1:] != s[:-1]
    del s
    where = np.arange(len(order), dtype=np.int32)
    base = g - np.maximum.accumulate(np.where(first, where, 0))
    return base, base + np.maximum.accumulate(np.where(new, where, 0)), new


def lms_names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names, in order, of the substrings from each LMS position to the next, both included; a longer one precedes its prefix.

    A substring that ends in a separator is unlike any other: later separators are smaller.
    """
    group = np.zeros(len(starts), np.int32)
    length = ends - starts + 1
    eight = words(text)
    live, offset = np.arange(len(starts), dtype=np.int32), 0
    while len(live):
        key = eight[starts[live] + offset].astype(np.uint64)
        key |= _MASK[np.minimum(length[live] - offset, 8)]
        own = group[live]
        order = np.lexsort((key, own)) if offset else np.argsort(key)
        order = order.astype(np.int32)
        _, name, _ = regroup(own, key, order)
        live = live[order]
        group[live] = name
        offset += 8
        live = live[length[live] > offset]
    marks = np.flatnonzero(text[starts] == SEP)  # the least of all, and in their own order
    group[marks[::-1]] = np.arange(len(marks))
    closed = np.flatnonzero((text[ends] == SEP) & (text[starts] != SEP))
    order = np.lexsort((-ends[closed], group[closed]))
    _, name, _ = regroup(group[closed], ends[closed], order)
    group[closed[order]] = name
    return group


def sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names, by doubling ranks; ranks are places in the order, as the names are."""
    n = len(names)
    rank, order = names.astype(np.int32), np.argsort(names, kind="stable").astype(np.int32)
    step = 1
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(np.int32)
    while len(live):
        ahead = live + np.int32(step)
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], np.int32(-1))
        del ahead
        own = rank[live]
        by = np.argsort(own.astype(np.int64) << 32 | (second + 1)).astype(np.int32)
        base, fresh, new = regroup(own, second, by)
        live = live[by]
        order[base + np.arange(len(by), dtype=np.int32)] = live
        rank[live] = fresh
        length = np.diff(np.append(np.flatnonzero(new), len(by)))
        live = live[np.repeat(length > 1, length)]
        step *= 2
    return order


def induce(
    symbol: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, folder: str, limit: int,
    common_of: Callable[[int, int], int],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, in parts (suffixes, common prefix with the one before), from the sorted LMS suffixes.

    common_of(i, j) compares two suffixes, once or twice a bucket, where rising and falling suffixes of one symbol meet.
    """
    rising = symbol[seeds]
    bounds = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]])) if len(seeds) else np.zeros(0, np.int64)
    seed_slices = {int(rising[a]): (int(a), int(b)) for a, b in zip(bounds, np.append(bounds[1:], len(seeds)), strict=True)}
    symbols = np.unique(symbol).tolist()
    queue, falling = Queue(folder, limit), Queue(folder, limit)
    last: dict[int, int] = {}

    def spread(out: Queue, suffixes: np.ndarray, common: np.ndarray, carry: dict[int, int], want_s: bool) -> None:
        """Push what the suffixes induce: their predecessors, if these are of the wanted type."""
        before = suffixes - 1
        ok = (before >= 0) & (is_s[before] == want_s)
        of = symbol[before]
        least = int(common.min())
        if want_s:
            ok &= of != SEP
        at = np.flatnonzero(ok)
        order = at[np.argsort(of[at], kind="stable")]
        keys = of[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        seen = set()
        for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True) if len(keys) else ():
            c, mine = int(keys[a]), order[a:b]
            seen.add(c)
            edges = np.concatenate([[0], mine[:-1] + 1])
            low = np.minimum.reduceat(common[: mine[-1] + 1], edges)
            low[0] = min(low[0], carry.get(c, 0))
            got = low + 1
            if c not in last:
                got[0] = 0
            last[c] = 1
            rest = common[mine[-1] + 1 :]
            carry[c] = int(rest.min()) if len(rest) else 1 << 30
            out.push(c, before[mine], got)
        for c in carry:
            if c not in seen:
                carry[c] = min(carry[c], least)

    for c in symbols:
        carry: dict[int, int] = {}
        tail = -1
        for part in queue.pop(c):
            falling.push(c, part[0], part[1])
            spread(queue, part[0], part[1], carry, False)
            tail = int(part[0][-1])
        if c in seed_slices:
            a, b = seed_slices[c]
            common = seed_common[a:b].copy()
            common[0] = common_of(tail, int(seeds[a])) if tail >= 0 else 0
            spread(queue, seeds[a:b], common, carry, False)
    last = {}
    rising_queue = Queue(folder, limit)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for c in reversed(symbols):
        carry = {}
        parts, tail = [], -1
        for part in rising_queue.pop(c):  # from the largest down
            parts.append(part)
            spread(rising_queue, part[0], part[1], carry, True)
            tail = int(part[0][-1])
        if c == SEP:
            break
        low = list(falling.pop(c))
        if low:
            part = np.concatenate(low, axis=1)[:, ::-1]
            common = np.concatenate([[common_of(tail, int(part[0][0])) if tail >= 0 else 0], part[1][:-1]])
            part = np.stack([part[0], common])
            parts.append(part)
            spread(rising_queue, part[0], part[1], carry, True)
        if parts:
            whole = np.concatenate(parts, axis=1)
            # common[i] belongs to the pair (i - 1, i) counted from above; turned round it belongs to (i, i + 1)
            yield whole[0], whole[1]


def types(symbol: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one behind it. Separators are, and so is a rising run's every symbol."""
    n = len(symbol)
    rise = np.full(n, -1, np.int8)  # 1 rises, 0 falls; -1 as the next different symbol tells
    rise[:-1][symbol[:-1] < symbol[1:]] = 1
    rise[:-1][symbol[:-1] > symbol[1:]] = 0
    rise[symbol == SEP] = 1
    known = np.flatnonzero(rise >= 0)
    return np.repeat(rise[known], np.diff(known, prepend=-1)).astype(bool)


def suffix_pairs(text: np.ndarray, most: int, memory: int = 1 << 26) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts (suffixes from the largest down, common prefix with the suffix before in this order, up to about `most`).

    text: symbols 1..254, pieces closed by SEP, the last symbol a SEP. `memory` bounds what queues and
    the string of names hold; beyond, queues spill to a temporary folder and names are sorted by recursion.
    """
    n = len(text)
    if not n:
        return
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    is_s = types(text)
    lms = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]])).astype(np.int32)
    if not len(lms):
        return
    ends = np.append(lms[1:], lms[-1])
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        names = lms_names(padded, lms, ends)
        if names.nbytes <= memory or len(names) < 64:
            order = sort_names(names)
        else:
            order = sort_by_recursion(names, folder, memory)
        seeds = lms[order]
        del names, order, lms, ends
        common = np.zeros(len(seeds), np.int32)
        step = 1 << 18
        for i in range(1, len(seeds), step):
            j = min(i + step, len(seeds))
            common[i:j] = common_prefixes(padded, seeds[i - 1 : j - 1], seeds[i:j], most)

        def common_of(i: int, j: int) -> int:
            return int(common_prefixes(padded, np.array([i]), np.array([j]), most)[0])

        yield from induce(text, is_s, seeds, common, folder, memory // 4, common_of)


def sort_by_recursion(names: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """Suffix array of a long string of names by induction on it, its own LMS suffixes first."""
    symbol = np.append(names.astype(np.int64) + 1, SEP)
    is_s = types(symbol)
    lms = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]]))
    ends = np.append(lms[1:], lms[-1])
    # substrings of names are named by rank doubling inside each, as names don't fit a byte
    length = ends - lms + 1
    group, live, offset = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(live):
        key = symbol[lms[live] + offset]
        order = np.lexsort((key, group[live]))
        g, k = group[live][order], key[order]
        first, new = np.ones(len(order), bool), np.ones(len(order), bool)
        first[1:] = g[1:] != g[:-1]
        new[1:] = first[1:] | (k[1:] != k[:-1])
        where = np.arange(len(order))
        group[live[order]] = g - np.maximum.accumulate(np.where(first, where, 0)) + np.maximum.accumulate(np.where(new, where, 0))
        offset += 1
        # one that ends stays behind those that go on: they are smaller
        size = np.bincount(group, minlength=len(lms))
        ended = live[length[live] == offset]
        on = live[length[live] > offset]
        n_on = np.bincount(group[on], minlength=len(lms))
        group[ended] += n_on[group[ended]]
        live = on[size[group[on]] > 1]
    order = sort_names(group) if group.nbytes <= memory * 2 or len(group) < 64 else sort_by_recursion(group, folder, memory)
    seeds = lms[order].astype(np.int32)
    parts = [p[0] for p in induce(symbol, is_s, seeds, np.zeros(len(seeds), np.int64), folder, memory // 4, lambda i, j: 0)]
    return np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int64)


def repeated_starts(text: np.ndarray, window: int, memory: int = 1 << 26) -> np.ndarray:
    """True at each position whose next `window` symbols, without a separator, also start elsewhere in text."""
    out = np.zeros(len(text), bool)
    for suffixes, common in suffix_pairs(text, window, memory):
        hit = np.flatnonzero(common >= window)
        out[suffixes[hit]] = True
        inner = hit[hit > 0]
        out[suffixes[inner - 1]] = True
    return out
