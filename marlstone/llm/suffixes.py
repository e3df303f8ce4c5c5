"""Suffix sorting with common-prefix lengths by induced sorting, in batches over disk-backed bucket queues.

Suffixes are L or S by whether the next suffix is smaller or larger. Sorted LMS suffixes (S after L) induce the order of all L
suffixes in one pass over the buckets upwards, and those induce the S suffixes in one pass downwards. Buckets form
a monotone priority queue: a suffix taken from the front pushes its predecessor to the back of the bucket of its
first character, so whole runs move at once. With every suffix goes the length it shares with its neighbour; a pushed
suffix shares one more than the least length met since the last push to its bucket.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from .common import mix, powers

#: Bytes that the queues of one sort hold in memory; more goes to files in Spark's own local folder, gone when closed.
QUEUE_BYTES = 64 << 20
_VALUES = mix(np.arange(258, dtype=np.uint64) + np.uint64(99))


def _local_dir() -> str | None:
    """Where Spark's own spills of this worker go."""
    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return dirs[0] if dirs else None


class Queues:
    """One FIFO of (position, shared length) per first character, spilling to a nameless file beyond a bound."""

    def __init__(self, n: int, bound: int | None = None):
        self.parts: list[list] = [[] for _ in range(n)]
        self.held, self.bound, self.file = 0, QUEUE_BYTES if bound is None else bound, None

    def push(self, c: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.held += at.nbytes + shared.nbytes
        if self.held > self.bound:
            self._spill()
        self.parts[c].append((at, shared))

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=_local_dir())
        for queue in self.parts:
            for k, part in enumerate(queue):
                if not isinstance(part[0], int):
                    place = self.file.seek(0, 2)
                    self.file.write(part[0].tobytes()), self.file.write(part[1].tobytes())
                    queue[k] = (place, len(part[0]))
        self.held = 0

    def part(self, c: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.parts[c][k]
        if not isinstance(part[0], int):
            return part
        self.file.seek(part[0])
        n = part[1]
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.uint16)

    def all(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        got = [self.part(c, k) for k in range(len(self.parts[c]))]
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint16))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """Characters 1 to 256, 0 between pieces; kinds of suffixes; and span hashes."""

    def __init__(self, chars: np.ndarray, cap: int):
        self.t, self.n, self.cap = chars, len(chars), cap
        step = np.sign(np.diff(chars.astype(np.int32), append=-1)).astype(np.int8)  # 1: the next character is larger
        known = np.flatnonzero(step)
        self.s = step[known[np.searchsorted(known, np.arange(self.n))]] > 0  # runs of equal characters follow what ends them
        self.lms = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.h = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUES[chars] * powers(self.n)[0], out=self.h[1:])

    def span(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.h[at + n] - self.h[at]) * powers(self.n)[1][np.minimum(at, self.n - 1)]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths that suffix pairs share, up to the cap."""
        lo = np.zeros(len(a), np.int64)
        top = np.minimum(self.cap, self.n - np.maximum(a, b))
        step = 1 << self.cap.bit_length()
        while step:
            more = np.minimum(lo + step, top)
            lo = np.where(self.span(a, more) == self.span(b, more), more, lo)
            step >>= 1
        return lo


def _pass(text: Text, seeds: list[tuple[np.ndarray, np.ndarray]], up: bool, lengths: bool) -> Queues:
    """Induces L suffixes upwards from the sorted LMS suffixes, or S suffixes downwards from the sorted L suffixes."""
    t, top = text.t, 258
    out = Queues(top)
    since = np.full(top, 0, np.uint16)  # least shared length since the last push to each bucket
    last = np.full(top, -1, np.int64)  # last suffix taken, to bridge seams

    def feed(at: np.ndarray, shared: np.ndarray) -> None:
        before = at - 1
        fits = np.flatnonzero((at > 0) & (text.s[before] != up))
        if lengths:
            np.minimum(since, shared.min() if len(shared) else text.cap, out=since)
        if not len(fits):
            return
        c = t[before[fits]]
        order = np.argsort(c, kind="stable")
        c, where = c[order], fits[order]
        edge = np.flatnonzero(np.diff(c, prepend=-1))
        for k, lo in enumerate(edge.tolist()):
            hi = int(edge[k + 1]) if k + 1 < len(edge) else len(c)
            i, d = where[lo:hi], int(c[lo])
            if lengths:
                least = np.empty(len(i), np.uint16)
                head = shared[: i[0] + 1].min()
                least[0] = min(int(head), int(kept[d]))
                if len(i) > 1:
                    least[1:] = np.minimum.reduceat(shared[: i[-1] + 1], i[:-1] + 1)
                tail = shared[i[-1] + 1 :]
                since[d] = tail.min() if len(tail) else text.cap
                least = np.minimum(least + np.uint16(1), text.cap)
                if not out.parts[d]:
                    least[0] = 0
            else:
                least = np.zeros(len(i), np.uint16)
            out.push(d, before[i], least)

    def seam(c: int, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The first of a run shares with the last suffix taken from the bucket what the text says."""
        if lengths and len(at):
            shared = shared.copy()
            shared[0] = text.shared(last[c : c + 1], at[:1])[0] if last[c] >= 0 else 0
        return shared

    if up:  # the empty suffix comes before all and induces the last one, which is L
        out.push(int(t[-1]), np.array([text.n - 1]), np.zeros(1, np.uint16))
    for c in range(top) if up else range(top - 1, -1, -1):
        k = 0
        while k < len(out.parts[c]):
            at, shared = out.part(c, k)
            kept = since.copy()
            feed(at, shared)
            last[c] = at[-1]
            k += 1
        at, shared = seeds[c]
        if len(at):
            kept = since.copy()
            feed(at, seam(c, at, shared))
            last[c] = at[-1]
    return out


def _by_first(text: Text, at: np.ndarray, shared: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    cut = np.searchsorted(text.t[at], np.arange(259))
    return [(at[cut[c] : cut[c + 1]], shared[cut[c] : cut[c + 1]]) for c in range(258)]


def _reversed(q: Queues, c: int) -> tuple[np.ndarray, np.ndarray]:
    at, shared = q.all(c)
    return at[::-1], np.concatenate([shared[:0], [0], shared[:0:-1]]).astype(np.uint16) if len(at) else shared


def _sorted_lms(text: Text) -> np.ndarray:
    """LMS suffixes in order of their first cap characters at least."""
    lms = text.lms
    none = np.zeros(len(lms), np.uint16)
    up = _pass(text, _by_first(text, lms[np.argsort(text.t[lms], kind="stable")], none), True, False)
    down = _pass(text, [_reversed(up, c) for c in range(258)], False, False)
    is_lms = np.zeros(text.n, bool)
    is_lms[lms] = True
    order = [x[is_lms[x]] for x in (down.all(c)[0][::-1] for c in range(258))]
    up.close(), down.close()
    order = np.concatenate(order)
    # names of LMS substrings: neighbours in order are equal if their spans are
    end = np.append(lms[1:] + 1, text.n)
    of = np.zeros(text.n, np.int64)
    of[lms] = np.arange(len(lms))
    n = (end - lms)[of[order]]
    n = np.minimum(n, text.n - order)
    span = text.span(order, n)
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (span[1:] != span[:-1])
    rank = np.zeros(len(lms) + 1, np.int64)
    rank[of[order]] = np.cumsum(new)
    # the reduced string is short of repeats longer than the cap after few doublings
    step = 1
    while rank.max() < len(lms) and step < text.cap:
        after = np.zeros(len(lms), np.int64)
        after[: len(lms) - step] = rank[step:-1]
        key = rank[:-1] * (len(lms) + 2) + after
        rank[:-1] = np.unique(key, return_inverse=True)[1] + 1
        step *= 2
    return lms[np.argsort(rank[:-1], kind="stable")]


def repeated_starts(chars: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next length characters, free of separators, also start at another position."""
    out = np.zeros(len(chars), bool)
    if len(chars) < length:
        return out
    text = Text(chars, length)
    mark = lambda a, b: (out.__setitem__(a, True), out.__setitem__(b, True))
    order = _sorted_lms(text) if len(text.lms) else text.lms
    shared = np.zeros(len(order), np.uint16)
    shared[1:] = text.shared(order[:-1], order[1:]) if len(order) > 1 else 0
    seeds = _by_first(text, order, shared)
    up = _pass(text, seeds, True, True)
    down = _pass(text, [_reversed(up, c) for c in range(258)], False, True)
    for c in range(258):
        a, la = up.all(c)
        b, lb = down.all(c)
        for x, l in ((a, la), (b, lb)):
            k = np.flatnonzero(l[1:] >= length) + 1
            mark(x[k], x[k - 1])
        if len(a) and len(b) and text.shared(a[-1:], b[-1:])[0] >= length:
            mark(a[-1:], b[-1:])
    up.close(), down.close()
    ends = np.append(np.flatnonzero(chars == 0), len(chars))
    room = ends[np.searchsorted(ends, np.arange(len(chars)))] - np.arange(len(chars))
    return out & (room >= length)
