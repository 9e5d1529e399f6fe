"""Substring dedup by compact windows.

The shingles of a text (five words each) get HASHES random orders. For one order
the Cartesian tree over a text's hashes splits all its passages of MIN_WORDS words
or more into few compact windows (l, c, r): every passage that starts in [l, c] and
ends in [c, r] has its least hash at c. Windows of two texts with the same least
hash mean that all their passages agree under that order. Windows that meet this
way are joined as intervals of passage starts: where windows of ENOUGH orders
overlap on one diagonal, the texts hold a likely near-duplicate passage. It is
extended over the words around that agree, and verified: the shingles themselves
must have a Jaccard similarity of at least 0.8 over MIN_WORDS words or more.

Within one hash's group each window first meets the window of the text with the most company in all its groups. What that
verifies joins passages to classes. Then all windows of a group that aren't of one class meet each other; so the only pairs
never compared are those whose passages are joined already. Before each meeting windows are joined as intervals within
their own text: a passage can only be a candidate where windows of ENOUGH orders are shared, so that texts which have no
more than a line or a phrase in common drop out and groups stay small. Before the second one, a prefix is taken of each least
passage: as many of its rarest shingles as a similar one can't all be without. Only the windows of texts that hold one of these
meet its windows, those of none are left out; where very many hold it, those whose words around it are common meet it first,
and the others only what isn't joined to their class by then.

Recall: what a pair of texts shares is sought by halving what isn't similar yet, and, where their windows lie on more
than DIAGONALS diagonals, in the region around all of them by the same halving; this can miss a passage. Of pairs of texts
with one to three edits in 60 words, a comparison of all windows by their words finds about two in a hundred that this
doesn't. What is reported is verified by words, and always a repeat.

Edge cases: null texts and texts of fewer than MIN_WORDS words have no passages;
identical texts are one text for the search, and each of its copies is reported
as a repeat from end to end, besides its passages; rows without an id take no part;
the texts of a repeated id are each searched by themselves and their passages
reported under it; repeated rows are one; repeats within one text alone are not
reported; very long texts are read whole; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, shared_dir, small_batches, with_columns_of, words, worker_cache
from .near_dup import few_or_shuffled, with_nodes, with_texts
from .shingles import WIDTH, Shingler, components, mixed

MIN_WORDS = 50
HASHES, ENOUGH = 8, 4
#: Meetings with chosen others before all that is still apart meets; a second one found little more.
ROUNDS = 1
#: Diagonals of two texts that are verified one by one.
DIAGONALS = 32
#: Shingles of which windows are made at once; longer texts are split one by one.
SLICE_SHINGLES = 1 << 15
#: Words that a worker numbers before it starts anew.
NUMBERED = 400_000
#: Diagonals of one passage's windows differ by its insertions and deletions: by no more than this from one to the next.
DRIFT = 12
#: A window is one long: order, place, and the reach to either side, clipped to what passages this long need.
_HASH_BITS, _REACH_BITS = 4, 16
#: Shingles of a least passage that a similar one, which is no shorter, must have as well: r + s shingles with a Jaccard
#: similarity of 0.8 have 4 / 9 of them in common.
NEEDED = -(-8 * (MIN_WORDS - WIDTH + 1) // 9)
#: Passages of so few distinct shingles are only similar to those of the same ones, at 0.8: they are linked by these, without pairs.
FEW = 3
#: Holders of a shingle that all meet at once; of more, first those that stand for the others.
MANY = 16
#: Of each class so many stand for it, the words around the shingle being different ones.
TYPICAL = 8
#: The order of windows that are such passages.
RUN = HASHES
_REACH = (1 << _REACH_BITS) - 1
_SPAN = MIN_WORDS - WIDTH + 1
#: Classes of starts outside all known passages, and of windows themselves.
ALONE, NO_ISLAND = -1, -2
_ORDERS = mixed(np.arange(HASHES, dtype=np.uint64), 77)[:, None]


def compact_windows(h: np.ndarray, least: int = _SPAN) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree over h, as far down as passages of least places fit."""
    out, todo = [], [(0, len(h))]
    while todo:
        l, end = todo.pop()
        if end - l < least:
            continue
        c = l + int(h[l:end].argmin())
        out.append((l, c, end - 1))
        todo.append((l, c))
        todo.append((c + 1, end))
    return out


def text_windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (order and least hash) and packed windows of a sequence of shingles."""
    hashes = mixed(x ^ _ORDERS, 5000)  # a row for each order
    ranked = hashes
    if len(x) - len(np.unique(x)) > len(x) // 16:  # among equal hashes a random place is the least, or the tree would be a chain
        ranked = np.empty(hashes.shape, np.int64)
        for order in range(HASHES):
            ranked[order, np.lexsort((mixed(np.arange(len(x), dtype=np.uint64), order), hashes[order]))] = np.arange(len(x))
    found, counts = [], []
    for order in range(HASHES):
        own = compact_windows(ranked[order])
        counts.append(len(own))
        found += own
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    l, c, r = np.array(found, np.int64).T
    order = np.repeat(np.arange(HASHES), counts)
    packed = order << 58 | c << 2 * _REACH_BITS | np.minimum(c - l, _REACH) << _REACH_BITS | np.minimum(r - c, _REACH)
    return hashes[order, c].view(np.int64), packed


def _repeats(x: np.ndarray) -> int:
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] == x[:-1]))


def back(x: np.ndarray) -> np.ndarray:
    """How far before each place the same shingle stands, within a passage's length; else 0."""
    order = np.argsort(x, kind="stable")
    near = np.flatnonzero((x[order][1:] == x[order][:-1]) & (np.diff(order) < _SPAN))
    out = np.zeros(len(x), np.int64)
    out[order[near + 1]] = np.diff(order)[near]
    return out


def text_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and packed windows of order RUN: where least passages have FEW distinct shingles or fewer, the starts, from place to
    place plus reach, of those that have fewest; the key is made of their shingles."""
    places = np.flatnonzero(gap := back(x))
    marks = np.zeros(len(x) + 1, np.int64)  # a repeat within the passages of these starts
    np.add.at(marks, np.maximum(places - _SPAN + 1, 0), 1)
    np.add.at(marks, places - gap[places] + 1, -1)
    distinct = _SPAN - np.cumsum(marks)[: len(x) - _SPAN + 1]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], distinct <= FEW, [False])).astype(np.int8)))
    keys, spots = [], []
    for begin, end in edges.reshape(-1, 2).tolist():
        least = begin + np.flatnonzero(distinct[begin:end] == distinct[begin:end].min())
        own, key = np.unique(x[least[0] : least[0] + _SPAN]), np.uint64(0)
        for shingle in own:
            key = mixed(shingle[None] ^ key, RUN)[0]
        keys.append(key)
        spots.append(RUN << 58 | int(least[0]) << 2 * _REACH_BITS | min(int(least[-1] - least[0]), _REACH))
    return np.array(keys, np.uint64).view(np.int64), np.array(spots, np.int64)


def many_windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text, key and packed window, as text_windows gives them for each text, in another order. All trees go down level by
    level together: a level's segments are reduced at once, each to its least hash with its place behind it."""
    which = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    first = np.cumsum([0, *(len(x) for x in texts)])
    hashes = mixed(np.concatenate(texts) ^ _ORDERS, 5000)
    bits = np.uint64(len(which).bit_length())
    places = np.arange(len(which), dtype=np.uint64)
    ranked = hashes >> bits << bits | places
    for i, x in enumerate(texts):
        if _repeats(x) > len(x) // 16:  # as in text_windows
            own = slice(first[i], first[i + 1])
            for order in range(HASHES):
                ranked[order, np.lexsort((mixed(np.arange(len(x), dtype=np.uint64), order), hashes[order, own])) + first[i]] = np.arange(len(x), dtype=np.uint64) << bits
            ranked[:, own] |= places[own]
    flat = np.append(ranked.ravel(), np.uint64(0))
    # segments: order, first place, number of places, and where they begin in flat
    order, l = np.repeat(np.arange(HASHES), len(texts)), np.tile(first[:-1], HASHES)
    n, at = np.tile(np.diff(first), HASHES), np.repeat(np.arange(HASHES) * len(which), len(texts)) + l
    found = []
    while (keep := n >= _SPAN).any():
        order, l, n, at = order[keep], l[keep], n[keep], at[keep]
        if 2 * (size := int(n.sum())) < len(flat):  # only what goes on
            begin = np.cumsum(n) - n
            flat, at = np.append(flat[np.arange(size) + np.repeat(at - begin, n)], np.uint64(0)), begin
        least = np.minimum.reduceat(flat, np.stack((at, at + n), 1).ravel())[::2]
        c = (least & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        found.append((order, l, c, l + n - 1))
        left = c - l
        order, l, n, at = (np.stack(x, 1).ravel() for x in ((order, order), (l, c + 1), (left, n - left - 1), (at, at + left + 1)))
    if not found:
        return (np.empty(0, np.int64),) * 3
    order, l, c, r = (np.concatenate(x) for x in zip(*found, strict=True))
    packed = order << 58 | c - first[which[c]] << 2 * _REACH_BITS | np.minimum(c - l, _REACH) << _REACH_BITS | np.minimum(r - c, _REACH)
    return which[c], hashes[order, c].view(np.int64), packed


def unpacked(window: int) -> tuple[int, int, int, int]:
    """order, l, c, r."""
    c = window >> 2 * _REACH_BITS & (1 << 58 - 2 * _REACH_BITS) - 1
    return window >> 58, c - (window >> _REACH_BITS & _REACH), c, c + (window & _REACH)


def candidate_passages(pair: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Interval join of the windows (of a, of b) in which the texts of each pair meet, pairs given by numbers in order: rows of
    the pair, first and last start in b, and the diagonals there, for runs of starts that intervals of ENOUGH orders cover."""
    order, place = of_a >> 58, (1 << 58 - 2 * _REACH_BITS) - 1
    ca, cb = of_a >> 2 * _REACH_BITS & place, of_b >> 2 * _REACH_BITS & place
    # starts in b of passages of the least length that both windows hold, along the diagonal
    d = cb - ca
    first = np.maximum(np.maximum(cb - (of_b >> _REACH_BITS & _REACH), cb - _SPAN + 1), cb - (of_a >> _REACH_BITS & _REACH))
    last = np.minimum(np.minimum(cb, cb + (of_b & _REACH) - _SPAN + 1), cb + (of_a & _REACH) - _SPAN + 1)
    keep = np.flatnonzero(first <= last)
    keep = keep[np.lexsort((d[keep], pair[keep]))]
    pair, d, first, last, order = pair[keep], d[keep], first[keep], last[keep], order[keep]
    if not len(pair):
        return np.empty((0, 5), np.int64)
    group = np.cumsum(np.concatenate(([0], (np.diff(pair) > 0) | (np.diff(d) > DRIFT))))  # of diagonals that are near
    top = int(last.max()) + 2
    # the starts that each order covers in a group
    own = group * HASHES + order
    merged, low, high = _merged(own, first, last, top)
    # where intervals of ENOUGH orders lie over each other
    at, change = np.concatenate((merged // HASHES * top + low, merged // HASHES * top + high + 1)), np.repeat([1, -1], len(merged))
    at, where = np.unique(at, return_inverse=True)
    enough = np.cumsum(np.bincount(where, change, len(at)).astype(np.int64)) >= ENOUGH
    edges = np.diff(np.concatenate(([False], enough, [False])).astype(np.int8))
    opened, closed = at[edges[:-1] == 1], at[np.flatnonzero(edges == -1)]
    if not len(opened):
        return np.empty((0, 5), np.int64)
    events = np.unique(np.concatenate((group * top + first, group * top + last + 1)))
    latest = events[np.searchsorted(events, closed) - 1]
    begins, ends = (np.searchsorted(group, opened // top, side) for side in ("left", "right"))
    out = np.empty((len(opened), 5), np.int64)
    out[:, 0], out[:, 1], out[:, 2] = pair[begins], opened % top, closed % top - 1
    for k, (i, j, start, end) in enumerate(zip(begins.tolist(), ends.tolist(), (opened % top).tolist(), (latest % top).tolist(), strict=True)):
        f, t, own = first[i:j], last[i:j], d[i:j]  # in order of diagonals
        for column, x in ((3, start), (4, end)):
            now = own[(f <= x) & (x <= t)]
            out[k, column] = now[len(now) // 2]
    return out


def _merged(own: np.ndarray, first: np.ndarray, last: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same owner that overlap or touch, as one: owner, first, last."""
    at = np.concatenate((own * top + first, own * top + last + 1))
    at, where = np.unique(at, return_inverse=True)
    open_ = np.cumsum(np.bincount(where, np.repeat([1, -1], len(own)), len(at)).astype(np.int64)) > 0
    edges = np.diff(np.concatenate(([False], open_, [False])).astype(np.int8))
    low, high = at[edges[:-1] == 1], at[np.flatnonzero(edges == -1)]
    return low // top, low % top, high % top - 1


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two runs of shingles."""
    x, y = set(x.tolist()), set(y.tolist())
    if not x or not y:
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


class Texts:
    """Two texts as word numbers and as shingles: numbers are equal where the words are, without any hashing."""

    def __init__(self, words_a: np.ndarray, words_b: np.ndarray):
        self.words = words_a, words_b
        x = np.unique(np.concatenate(self.words), return_inverse=True)[1].astype(np.uint64)
        if len(x) < WIDTH:
            self.shingles = x[:0], x[:0]
            return
        bits = int(x.max()).bit_length()
        if WIDTH * bits <= 64:
            s = x[: len(x) - WIDTH + 1]
            for i in range(1, WIDTH):
                s = s << np.uint64(bits) | x[i : len(x) - WIDTH + 1 + i]
        else:
            numbered = lambda left, right: np.unique(left << np.uint64(32) | right, return_inverse=True)[1].astype(np.uint64)
            two = numbered(x[:-1], x[1:])
            s = numbered(two[:-2], two[2:])[:-1] << np.uint64(32) | x[4:]
        self.shingles = s[: max(0, len(words_a) - WIDTH + 1)], s[len(words_a) :]

    def similarity(self, a1: int, a2: int, b1: int, b2: int) -> float:
        return _similarity(self.shingles[0][a1 : max(a1, a2 - WIDTH + 1)], self.shingles[1][b1 : max(b1, b2 - WIDTH + 1)])

    def extended(self, a1: int, a2: int, b1: int, b2: int, found: float) -> tuple[int, int, int, int, float]:
        """The passages with the words on both sides that agree."""

        def agree(x: np.ndarray, y: np.ndarray) -> int:
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            return int(differ[0]) if len(differ) else n

        a, b = self.words
        before, after = agree(a[:a1][::-1], b[:b1][::-1]), agree(a[a2:], b[b2:])
        if before or after:
            a1, a2, b1, b2 = a1 - before, a2 + after, b1 - before, b2 + after
            found = max(found, self.similarity(a1, a2, b1, b2))
        return a1, a2, b1, b2, found

    def parts(self, a1: int, a2: int, b1: int, b2: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
        """Passages within two regions that aren't similar as a whole: runs of starts in b whose least passages are
        similar to a part of a, each taken whole if it is similar, else its halves, and so on."""
        x, y = self.shingles[0][a1 : max(a1, a2 - WIDTH + 1)], self.shingles[1][b1 : max(b1, b2 - WIDTH + 1)]
        if len(y) < _SPAN or not len(x):
            return []
        own, place = np.unique(x, return_index=True)
        near = np.minimum(np.searchsorted(own, y), len(own) - 1)
        at = np.where(own[near] == y, a1 + place[near], -1)
        hits = np.concatenate(([0], np.cumsum(at >= 0)))
        counts = hits[_SPAN:] - hits[:-_SPAN]
        starts = np.flatnonzero(counts >= similarity * _SPAN)
        if len(starts):  # of these, where least passages are similar: the part of a that has the shared shingles has few others
            held = np.lib.stride_tricks.sliding_window_view(at, _SPAN)[starts]
            counts = counts[starts]
            middle = np.sort(held, axis=1)[np.arange(len(starts)), _SPAN - counts + counts // 2][:, None]
            near = (held >= 0) & (np.abs(held - middle) <= _SPAN + 2 * DRIFT)  # not where a shingle stands elsewhere once more
            low, high = np.where(near, held, a2).min(axis=1) - a1, np.where(near, held, a1).max(axis=1) - a1
            others = np.unique(y)
            missing = np.concatenate(([0], np.cumsum(others[np.minimum(np.searchsorted(others, x), len(others) - 1)] != x)))
            starts = starts[near.sum(axis=1) >= similarity * (_SPAN + missing[high + 1] - missing[low])]
        out = []

        def settled(first: int, last: int) -> bool:
            """Whether starts from first to last make a passage, or are too short to, as all their parts are."""
            held = at[first : last + _SPAN]
            shared = np.flatnonzero(held >= 0)
            held = held[shared]
            middle = np.sort(held)[len(held) // 2]
            held = held[np.abs(held - middle) <= last - first + _SPAN + 2 * DRIFT]  # not where a shingle stands elsewhere once more
            low, high = int(held.min()), int(held.max()) + WIDTH
            begin, end = b1 + first + int(shared[0]), b1 + first + int(shared[-1]) + WIDTH
            if (short := MIN_WORDS - min(high - low, end - begin)) > 0:
                if short <= _SPAN - NEEDED:  # with words beside them that differ, they can still be similar
                    for before in range(short + 1):
                        begins = low - before, begin - before
                        ends = high + short - before, end + short - before
                        if min(begins) >= 0 and ends[0] <= len(self.words[0]) and ends[1] <= len(self.words[1]) and (found := self.similarity(begins[0], ends[0], begins[1], ends[1])) >= similarity:
                            out.append((begins[0], ends[0], begins[1], ends[1], found))
                            break
                return True
            if (found := self.similarity(low, high, begin, end)) >= similarity:
                out.append(self.extended(low, high, begin, end, found))
                return True
            return False

        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
            todo = [(int(run[0]), int(run[-1]))]
            while todo:  # halves of what isn't similar, down to the least length
                first, last = todo.pop()
                if not settled(first, last) and last > first:
                    middle = (first + last) // 2
                    todo += [(first, middle), (middle + 1, last)]
        return out

    def verified(self, first: int, last: int, d1: int, d2: int, similarity: float = 0.8) -> list[tuple[int, int, int, int, float]]:
        """The similar passages around a candidate, as words [begin, end) of a and of b and their similarity."""
        n, m = map(len, self.words)
        b1, b2 = first, min(m, last + MIN_WORDS)
        a1, a2 = max(0, first - d1), min(n, last - d2 + MIN_WORDS)
        if min(a2 - a1, b2 - b1) >= MIN_WORDS and (found := self.similarity(a1, a2, b1, b2)) >= similarity:
            return [self.extended(a1, a2, b1, b2, found)]
        return self.parts(max(0, a1 - MIN_WORDS), min(n, a2 + MIN_WORDS), max(0, b1 - MIN_WORDS), min(m, b2 + MIN_WORDS), similarity)


class _Numbers(dict):
    def __missing__(self, word) -> int:
        value = self[word] = len(self)
        return value

    def of(self, found: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def verified(wa: list, wb: list, first: int, last: int, d1: int, d2: int, similarity: float = 0.8) -> list[tuple[int, int, int, int, float]]:
    numbers = _Numbers()
    return Texts(numbers.of(wa), numbers.of(wb)).verified(first, last, d1, d2, similarity)


def verified_places(left: np.ndarray, right: np.ndarray, places: list[tuple[int, int, int, int]], similarity: float = 0.8) -> set[tuple[int, int, int, int, float]]:
    """The similar passages around the candidates of two texts, given as word numbers. Texts that repeat themselves meet
    on many diagonals: their regions are then searched as a whole, either text in the other."""
    merged: list[list[int]] = []
    for first, last, d1, d2 in sorted(places):
        near = next((m for m in merged[-4:] if first <= m[1] + 1 and max(abs(d1 - m[3]), abs(d1 - m[2])) <= DRIFT), None)
        if near:
            near[1], near[3] = max(near[1], last), d2
        else:
            merged.append([first, last, d1, d2])
    pair = Texts(left, right)
    if len(merged) <= DIAGONALS:
        found: set = set()
        for first, last, d1, d2 in merged:
            if not any(b1 <= first and last + MIN_WORDS <= b2 and max(abs(b1 - a1 - d1), abs(b1 - a1 - d2)) <= DRIFT for a1, _, b1, b2, _ in found):
                found.update(pair.verified(first, last, d1, d2, similarity))
        return found
    a1, a2 = min(m[0] - max(m[2:]) for m in merged), max(m[1] - min(m[2:]) for m in merged) + MIN_WORDS
    b1, b2 = min(m[0] for m in merged), max(m[1] for m in merged) + MIN_WORDS
    a1, a2, b1, b2 = max(0, a1), min(len(left), a2), max(0, b1), min(len(right), b2)
    back = Texts(right, left).parts(b1, b2, a1, a2, similarity)
    return {*pair.parts(a1, a2, b1, b2, similarity), *((c1, c2, d1, d2, found) for d1, d2, c1, c2, found in back)}


def _windows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_cache(("shingler",), Shingler)
        for batch in batches:
            ids, texts, size = [], [], 0

            def held() -> pa.RecordBatch:
                which, key, spot = many_windows(texts)
                runs = [(i, *text_runs(x)) for i, x in enumerate(texts) if _repeats(x) >= _SPAN - FEW]
                if runs:
                    which = np.concatenate((which, *(np.full(len(k), i) for i, k, _ in runs)))
                    key, spot = np.concatenate((key, *(k for _, k, _ in runs))), np.concatenate((spot, *(w for *_, w in runs)))
                return pa.RecordBatch.from_pydict({"key": pa.array(key), "id": pa.array(np.array(ids, np.int64)[which]), "spot": pa.array(spot)})

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingler.sequence(text)
                if len(x) > SLICE_SHINGLES:
                    key, spot = (np.concatenate(c) for c in zip(text_windows(x), text_runs(x), strict=True))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key), "id": pa.array(np.full(len(key), doc_id, np.int64)), "spot": pa.array(spot)})
                elif len(x) >= _SPAN:
                    if size + len(x) > SLICE_SHINGLES:
                        yield held()
                        ids, texts, size = [], [], 0
                    ids.append(doc_id)
                    texts.append(x)
                    size += len(x)
            if ids:
                yield held()

    return docs.mapInArrow(run, "key bigint, id bigint, spot bigint")


def starts(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, place of the least hash and last start of windows, for passages of the least length."""
    c = spots >> 2 * _REACH_BITS & (1 << 58 - 2 * _REACH_BITS) - 1
    return np.maximum(c - (spots >> _REACH_BITS & _REACH), c - _SPAN + 1), c, np.minimum(c, c + (spots & _REACH) - _SPAN + 1)


def covered(ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which windows, in order of ids, hold a start that windows of ENOUGH orders of the same text hold. Windows
    of one order hold no start twice, so the orders of a start are as many as its windows."""
    first, _, last = starts(spots)
    text = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1]))) * (int(last.max(initial=0)) + 2)
    at, place = np.unique(np.concatenate((text + first, text + last + 1)), return_inverse=True)
    n = len(ids)
    held = np.cumsum(np.bincount(place[:n], minlength=len(at)) - np.bincount(place[n:], minlength=len(at)))
    enough = np.concatenate(([0], np.cumsum(held >= ENOUGH)))
    return enough[place[n:]] > enough[place[:n]]


def pieces(ids: np.ndarray, spots: np.ndarray, island_ids: np.ndarray, begin: np.ndarray, end: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts windows where passages of known class begin and end: which window, the cut window, and the class at its starts
    or ALONE. A start is of a class if its least passage has a shingle in a passage of that class: what is found
    there overlaps that passage and is of its class already.
    ids and island_ids are in order; islands of one text don't overlap."""
    first, c, last = starts(spots)
    top = int(max(last.max(initial=0), end.max(initial=0))) + MIN_WORDS
    number = np.unique(np.concatenate((ids, island_ids)), return_inverse=True)[1] * (2 * top)
    text, island = number[: len(ids)], number[len(ids) :]
    low, high = island + np.maximum(begin - _SPAN + 1, 0), island + end - WIDTH + 1
    order = np.argsort(low, kind="stable")
    low, high, own = low[order], high[order], classes[order]
    low[1:] = np.maximum(low[1:], high[:-1])
    cuts = np.stack((low, high), 1).ravel()
    of_cut = np.stack((own, np.full(len(own), ALONE)), 1).ravel()  # the class from each cut on
    cuts, of_cut = np.concatenate(([-1], cuts)), np.concatenate(([ALONE], of_cut))
    begins, ends = np.searchsorted(cuts, text + first, "right") - 1, np.searchsorted(cuts, text + last, "right") - 1
    many = ends - begins + 1
    window = np.repeat(np.arange(len(ids)), many)
    at = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + begins[window]
    left = np.maximum(first[window], cuts[at] - text[window])
    right = np.minimum(last[window], np.append(cuts[1:], np.iinfo(np.int64).max)[at] - 1 - text[window])
    cut = spots[window] >> 2 * _REACH_BITS << 2 * _REACH_BITS | c[window] - left << _REACH_BITS | right + _SPAN - 1 - c[window]
    keep = left <= right
    return window[keep], cut[keep], of_cut[at][keep]


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by their second column, an id, so that the rows of an id come together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        part = [c.to_numpy() for c in batch.columns]
        if not len(part[1]):
            continue
        cut = int(np.searchsorted(part[1], part[1][-1]))  # the last text may go on
        if cut or held and held[-1][1][-1] != part[1][0]:
            held.append([x[:cut] for x in part])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[cut:] for x in part])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _where_covered(windows: DataFrame) -> DataFrame:
    """The interval join within each text: windows that lie where windows of ENOUGH orders do, and runs. A text whose windows
    are shared by chance, or over fewer words than a passage has, keeps none of them."""
    names = windows.columns

    def run(batches):
        for columns in _whole_texts(batches):
            keep = columns[2] >> 58 == RUN
            keep[~keep] = covered(*(x[~keep] for x in columns[1:3]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=names)

    return windows.repartition("id").sortWithinPartitions("id").mapInArrow(run, windows.schema)


def _in_classes(windows: DataFrame, classes: DataFrame) -> DataFrame:
    """windows (key, id, spot), cut where passages (id, begin, end, class) begin and end, with class; pieces outside
    stay only where they alone are of ENOUGH orders."""
    islands = classes.select(F.col("begin").alias("key"), "id", F.col("end").alias("spot"), "class")
    rows = windows.withColumn("class", F.lit(NO_ISLAND).cast("long")).union(islands).repartition("id").sortWithinPartitions("id")

    def run(batches):
        for key, ids, spots, own in _whole_texts(batches):
            w = own == NO_ISLAND
            if not w.any():
                continue
            which, cut, of = pieces(ids[w], spots[w], ids[~w], key[~w], spots[~w], own[~w])
            key, ids = key[w][which], ids[w][which]
            keep = (of != ALONE) | covered(ids, cut)  # at one start all pieces are of one class
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, cut, of)], names=["key", "id", "spot", "class"])

    return rows.mapInArrow(run, "key bigint, id bigint, spot bigint, class bigint")


def _shingles_in(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """shingle, id, place, class, minor, near of the places that windows (id, spot, class, minor) reach: the class of the windows
    there, ALONE if they are of several; whether minor ones are among them; and a hash of the shingles around the place."""
    reached = windows.groupBy("id").agg(F.collect_list(F.struct("spot", "class", "minor")).alias("windows"))

    def run(batches):
        shingler = worker_cache(("shingler",), Shingler)
        for batch in batches:
            out = []
            held = batch.column(2)
            ends = held.offsets.to_numpy()
            spots, classes, minor = (held.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for own, text, begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x = shingler.sequence(text)
                first, _, last = starts(spots[begin:end])
                last = np.minimum(last + _SPAN, len(x))
                of, marks = np.full((2, len(x)), NO_ISLAND), np.zeros(len(x) + 1, np.int32)
                order = np.argsort(classes[begin:end], kind="stable")
                for f, l, c in zip(first[order].tolist(), last[order].tolist(), classes[begin:end][order].tolist(), strict=True):
                    of[1, f:l] = c
                for f, l, c in zip(first[order[::-1]].tolist(), last[order[::-1]].tolist(), classes[begin:end][order[::-1]].tolist(), strict=True):
                    of[0, f:l] = c
                np.add.at(marks, first, minor[begin:end].astype(np.int32))
                np.add.at(marks, last, -minor[begin:end].astype(np.int32))
                place = np.flatnonzero(of[1] != NO_ISLAND)
                label = np.where(of[0] == of[1], of[1], ALONE)[place]
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(x, 9))))
                near = sums[np.minimum(place + _SPAN, len(x))] - sums[np.maximum(place - _SPAN + 1, 0)]
                out.append((x[place].view(np.int64), np.full(len(place), own), place, label, np.cumsum(marks)[place] > 0, near.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shingle", "id", "place", "class", "minor", "near"])

    return texts.join(reached, "id").select("id", "text", "windows").mapInArrow(run, "shingle bigint, id bigint, place bigint, class bigint, minor boolean, near bigint")


def rarest(shingles: np.ndarray, others: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of least passages that begin at these places: which of them can be similar to another, and the places of the shingles of which
    another has to have one. A similar one has all but so few of the distinct shingles that, of any one more than these, it has
    one; taken are those that the fewest others have. Passages with that many which no other has (others: 0) are like none.
    A place that isn't known has a shingle of its own."""
    order = np.lexsort((shingles, others))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (np.diff(shingles[order]) != 0) | (np.diff(others[order]) != 0))))
    live = int(rank[others > 0].min(initial=len(order)))
    rank = np.append(rank, np.full(_SPAN, len(order)))
    alive, taken = np.zeros(len(begins), bool), np.zeros(len(rank), bool)
    for i in range(0, len(begins), 1 << 14):
        begin = begins[i : i + (1 << 14)]
        held = np.lib.stride_tricks.sliding_window_view(rank, _SPAN)[begin]
        in_order = np.sort(held, axis=1)
        number = np.cumsum(np.concatenate((np.ones((len(begin), 1), np.int64), np.diff(in_order, axis=1) > 0), axis=1), axis=1)
        distinct = number[:, -1]
        needed = np.where(distinct == _SPAN, _SPAN - NEEDED, distinct // 5) + 1
        last = in_order[np.arange(len(begin)), (number < needed[:, None]).sum(axis=1)]
        alive[i : i + len(begin)] = on = last >= live
        chosen = (held >= live) & (held <= last[:, None]) & on[:, None]
        taken[(begin[:, None] + np.arange(_SPAN))[chosen]] = True
    return alive, np.flatnonzero(taken[: len(order)])


def _with_rarest(windows: DataFrame, held: DataFrame) -> DataFrame:
    """The windows (key, id, spot, class, minor) without the minor ones at whose starts too few shingles are in another text that
    windows of another class or of none reach; and rows of kind 2, (shingle, id, place, class): of those of which a similar passage has to
    have one, with the number of their holders in n. Every start of a minor window that stays has all of these."""
    per = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("all"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("class").alias("least"), F.max("class").alias("most"))
    nobody = (F.col("low") == F.col("high")) | (F.col("least") == F.col("most")) & (F.col("least") != ALONE)
    per = per.select("shingle", F.when(nobody, 0).otherwise(F.col("all") - 1).alias("n"))
    marks = held.where("minor").select("shingle", "id", "place", "class").join(per, "shingle")
    marks = marks.select(F.col("shingle").alias("key"), "id", F.col("place").alias("spot"), "class", F.lit(2).alias("kind"), "n")
    rows = windows.select("key", "id", "spot", "class", F.col("minor").cast("int").alias("kind"), F.lit(0).cast("long").alias("n"))
    rows = rows.union(marks).repartition("id").sortWithinPartitions("id")

    def run(batches):
        for key, ids, spots, own, kind, n in _whole_texts(batches):
            mark, minor = kind == 2, kind == 1
            keep = kind == 0
            if minor.any():
                first, _, last = starts(spots[minor])
                text = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
                size = np.zeros(int(text[-1]) + 1, np.int64)
                np.maximum.at(size, text[mark], spots[mark] + 1)
                np.maximum.at(size, text[minor], last + _SPAN)
                base = np.concatenate(([0], np.cumsum(size)))
                at = base[text[mark]] + spots[mark]
                shingles, others, row = np.arange(base[-1]), np.zeros(base[-1], np.int64), np.full(base[-1], -1)
                shingles[at], others[at], row[at] = key[mark], n[mark], np.flatnonzero(mark)
                many = last - first + 1
                window = np.repeat(np.arange(len(first)), many)
                start = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + (first + base[text[minor]])[window]
                begins, which = np.unique(start, return_inverse=True)
                alive, taken = rarest(shingles, others, begins)
                keep[np.flatnonzero(minor)[np.bincount(window[alive[which]], minlength=len(first)) > 0]] = True
                keep[row[taken]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, spots, own, kind, n)], names=["key", "id", "spot", "class", "kind", "n"])

    return rows.mapInArrow(run, rows.schema)


def _in_several(windows: DataFrame) -> DataFrame:
    """The windows whose least hash two texts have or more, and not all of them in one class."""
    same, limits = Window.partitionBy("key"), {"low": F.min("id"), "high": F.max("id")}
    if "class" in windows.columns:
        limits |= {"least": F.min("class"), "most": F.max("class")}
    told = windows.withColumns({k: v.over(same) for k, v in limits.items()}).where("low < high")
    return (told.where(f"least < most or least = {ALONE}") if "class" in windows.columns else told).select(windows.columns)


def _linked_runs(runs: DataFrame) -> DataFrame:
    """Candidates of runs with the same few shingles: each with the first of its key, that of the first text also with the last."""
    same, low, high = Window.partitionBy("key"), F.min(F.struct("id", "spot")), F.max(F.struct("id", "spot"))
    told = runs.withColumns({"low": low.over(same), "high": high.over(same)})
    other = F.when(F.col("id") != F.col("low.id"), F.col("low")).when(F.col("spot") != F.col("low.spot"), F.col("high"))
    pairs = told.select("id", "spot", other.alias("other")).where("other is not null")
    first, last = (lambda s: F.shiftright(s, 2 * _REACH_BITS).bitwiseAND((1 << 58 - 2 * _REACH_BITS) - 1)), (lambda s: s.bitwiseAND(_REACH))
    begin, reach, a = first(F.col("spot")), last(F.col("spot")), F.col("other.spot")
    d = begin - first(a)
    columns = F.col("other.id").alias("a"), F.col("id").alias("b"), begin, begin + reach, d, d + reach - last(a)
    return pairs.select(*columns[:2], *(c.cast("int").alias(n) for c, n in zip(columns[2:], ("first", "last", "d1", "d2"), strict=True)))


_CANDIDATE = "a bigint, b bigint, first int, last int, d1 int, d2 int"


def _join_intervals(meetings: DataFrame) -> DataFrame:
    """meetings (a, b, spots) -> candidate passages. A pair's windows are no more than its texts have."""

    def run(batches):
        for batch in batches:
            a, b, spots = batch.columns
            met = spots.flatten()
            pair, *found = candidate_passages(pc.list_parent_indices(spots).to_numpy().astype(np.int64), *(met.field(x).to_numpy() for x in ("of_a", "of_b"))).T
            pair = pa.array(np.ascontiguousarray(pair))
            yield pa.RecordBatch.from_arrays([a.take(pair), b.take(pair), *(pa.array(x.astype(np.int32)) for x in found)], names=["a", "b", "first", "last", "d1", "d2"])

    return meetings.where(_orders("spots") >= ENOUGH).mapInArrow(run, _CANDIDATE)


def _verify(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """a, a_start, a_words, b, b_start, b_words, similarity of the candidates that hold, by their words."""
    pairs = candidates.groupBy("a", "b").agg(F.collect_list(F.struct("first", "last", "d1", "d2")).alias("places"))
    joined = with_texts(pairs, texts).select("a", "b", "places", "text_a", "text_b")

    def run(batches):
        at, left, numbers = None, None, _Numbers()
        for batch in batches:
            rows = set()
            for a, b, places, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != at:
                    if len(numbers) > NUMBERED:
                        numbers = _Numbers()
                    at, left = a, numbers.of(words(text_a))
                found = verified_places(left, numbers.of(words(text_b)), [(p["first"], p["last"], p["d1"], p["d2"]) for p in places])
                rows.update((a, a1, a2 - a1, b, b1, b2 - b1, similarity) for a1, a2, b1, b2, similarity in found)
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=["a", "a_start", "a_words", "b", "b_start", "b_words", "similarity"])

    return joined.mapInArrow(run, "a bigint, a_start bigint, a_words bigint, b bigint, b_start bigint, b_words bigint, similarity double")


def _orders(spots):
    return F.size(F.array_distinct(F.transform(spots, lambda s: F.shiftright(s["of_b"], 58))))


def _texts(rows: DataFrame, candidates: DataFrame, folder: str) -> DataFrame:
    """id and text of the documents that the candidates name."""
    ids = materialize(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), f"{folder}-ids")
    return materialize(rows.join(few_or_shuffled(ids), "id", "left_semi").dropDuplicates(["id"]), folder)


def _sides(found: DataFrame) -> DataFrame:
    sides = found.select(F.col("a").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_words").alias("n_words"), F.col("b").alias("match_doc_id"), "similarity")
    return sides.union(found.select("b", "b_start", "b_words", "a", "similarity"))


def _in_islands(spans: DataFrame) -> DataFrame:
    """spans (doc_id, start_word, n_words), with island: a number within the document, one for those that overlap."""
    in_order = Window.partitionBy("doc_id").orderBy("start_word", "n_words")
    ends = F.max(F.col("start_word") + F.col("n_words")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new", F.when(F.col("start_word") < ends, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))


def _classes(found: DataFrame, folder: str) -> DataFrame:
    """id, begin, end, class of the passages that overlapping finds make up: one class for those that finds join."""
    spans = _in_islands(_sides(found).select("doc_id", "start_word", "n_words").distinct())
    islands = spans.groupBy("doc_id", "island").agg(F.min("start_word").alias("begin"), F.max(F.col("start_word") + F.col("n_words")).alias("end"))
    islands = materialize(islands.select(F.col("doc_id").alias("id"), "begin", "end", F.monotonically_increasing_id().alias("node")), f"{folder}/islands")
    side = lambda s: islands.select(F.col("id").alias(s), F.col("begin").alias("begin_" + s), F.col("end").alias("end_" + s), F.col("node").alias("node_" + s))
    links = found
    for s in "ab":
        links = links.join(side(s), s).where(F.col(f"{s}_start").between(F.col("begin_" + s), F.col("end_" + s) - 1))
    parts = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), folder)
    return materialize(islands.join(parts, "node", "left").select("id", "begin", "end", F.coalesce("component", "node").alias("class")), f"{folder}/classes")


def _sides_apart(told: DataFrame, rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The windows of groups of several classes, with minor: all but those of the class with most windows in a group, which isn't
    joined with itself; the rarest shingles of minor ones (shingle, id, place, class, n); who holds these; and the texts. Minor
    windows at whose starts too few orders or too few shingles are shared are left out first."""
    major = told.where(F.col("class") != ALONE).groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("most"))
    sides = told.join(major.select("key", F.col("most.class").alias("major")), "key", "left")
    sides = materialize(sides.withColumn("minor", F.coalesce(F.col("class") != F.col("major"), F.lit(True))).drop("major"), f"{folder}/sides")
    ids = materialize(sides.select("id").distinct(), f"{folder}/told-ids")
    texts = materialize(rows.join(few_or_shuffled(ids), "id", "left_semi").dropDuplicates(["id"]), f"{folder}/told-texts")
    held = materialize(_shingles_in(sides, texts), f"{folder}/shingles")
    kept = materialize(_with_rarest(sides, held), f"{folder}/rarest")
    rare = kept.where("kind = 2").select(F.col("key").alias("shingle"), "id", F.col("spot").alias("place"), "class", "n")
    holders = materialize(held.join(few_or_shuffled(rare.select("shingle").distinct()), "shingle", "left_semi").drop("minor"), f"{folder}/holders-of-rarest")
    return kept.where("kind < 2").select("key", "id", "spot", "class", (F.col("kind") == 1).alias("minor")), rare, holders, texts


def _first_pairs(rare: DataFrame, holders: DataFrame) -> DataFrame:
    """id, other: the texts with minor windows and those that hold one of their rarest shingles; of very many holders of a shingle
    only a few of two classes, around which the words are those that most have."""
    other = holders.select("shingle", F.col("id").alias("other"), F.col("class").alias("other_class"))
    alike = holders.groupBy("shingle", "class", "near").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    alike = alike.withColumn("i", F.row_number().over(Window.partitionBy("shingle", "class").orderBy(F.desc("n"), F.desc("id")))).where(f"i <= {TYPICAL}")
    alike = alike.withColumn("best", F.max("n").over(Window.partitionBy("shingle", "class")))
    alike = alike.withColumn("i", F.dense_rank().over(Window.partitionBy("shingle").orderBy(F.desc("best"), "class"))).where("i <= 2")
    typical = alike.select("shingle", F.col("id").alias("other"), F.col("class").alias("other_class"))
    met = rare.where(F.col("n") <= MANY).join(other, "shingle").unionByName(rare.where(F.col("n") > MANY).join(typical, "shingle"))
    return met.where(f"id <> other and (class = {ALONE} or class <> other_class)").select("id", "other").distinct()


def _further_pairs(rare: DataFrame, holders: DataFrame, classes: DataFrame) -> DataFrame:
    """id, other: all holders of the rarest shingles that very many hold, but for places within passages of one class."""
    rare = rare.where(F.col("n") > MANY)
    inside = (F.col("p.id") == F.col("c.id")) & F.col("p.place").between(F.col("c.begin"), F.col("c.end") - WIDTH)

    def told(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("shingle", "id", "place").alias("p").join(classes.alias("c"), inside, "left")
        return rows.select("p.shingle", F.col("p.id").alias(name), F.coalesce("c.class", F.lit(ALONE)).alias(f"{name}_class"))

    mine = told(rare, "id").distinct()
    # of the holders of a shingle, those of the one class that all of its minor ones are of take no part
    limits = mine.groupBy("shingle").agg(F.min("id_class").alias("least"), F.max("id_class").alias("most"))
    other = told(holders, "other").distinct().join(limits, "shingle").where(f"least < most or least = {ALONE} or other_class <> least")
    return mine.join(other, "shingle").where(f"id <> other and (id_class = {ALONE} or id_class <> other_class)").select("id", "other").distinct()


def _between(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Candidates among the windows of pairs (id, other) of texts that share a key and aren't of one class."""

    def parts(s: str):
        c = F.shiftright(f"{s}.spot", 2 * _REACH_BITS).bitwiseAND((1 << 58 - 2 * _REACH_BITS) - 1)
        return c - F.shiftright(f"{s}.spot", _REACH_BITS).bitwiseAND(_REACH), c, c + F.col(f"{s}.spot").bitwiseAND(_REACH)

    (la, ca, ra), (lb, cb, rb) = parts("l"), parts("r")
    d = cb - ca  # as in candidate_passages
    aligned = F.greatest(lb, cb - _SPAN + 1, la + d) <= F.least(cb, rb - _SPAN + 1, ra + d - _SPAN + 1)
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.other") == F.col("r.id")) & ((F.col("l.class") != F.col("r.class")) | (F.col("l.class") == ALONE))
    met = sides.where("minor").join(pairs, "id").alias("l").join(sides.alias("r"), meet & aligned)
    of_a, of_b = (F.when(F.col("l.id") < F.col("r.id"), F.col(x)).otherwise(F.col(y)) for x, y in (("l.spot", "r.spot"), ("r.spot", "l.spot")))
    pairs = met.groupBy(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
    return _join_intervals(pairs.agg(F.collect_set(F.struct(of_a.alias("of_a"), of_b.alias("of_b"))).alias("spots")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that another document repeats: doc_id, start_word, n_words, match_doc_id
    (the smallest found), n_matches (documents whose likeness to it was verified one by one; as members of one class aren't all
    compared, class_docs is the number of documents that have it), similarity, class_id (first document and place of
    the passages that links join), class_docs (the documents of that class). Passages of a document that overlap are one.

    Shuffles: a record per document; the windows, (hash, id, place), about a third as many as words; those that two
    texts share, by text and by hash; texts of documents with candidates, to verify them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    rows = with_columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")

    prints = materialize(rows.select("doc", F.xxhash64("text").alias("print"), F.sha2("text", 256).alias("digest")), f"{folder}/prints")
    rows, prints, _ = with_nodes(rows, prints, "doc", f"{folder}/several")
    texts = prints.groupBy("digest", "doc").agg(F.min("node").alias("node"))
    same = texts.groupBy("digest").agg(F.min(F.struct("doc", "node")).alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    owners = texts.join(same, "digest", "left").select("doc", F.col("node").alias("own"), F.coalesce("least.node", "node").alias("id"), F.coalesce("least.doc", "doc").alias("least"), F.coalesce("most", "doc").alias("most"), F.coalesce("copies", F.lit(1)).alias("copies"))
    owners = materialize(owners, f"{folder}/owners")
    drop = owners.where("own <> id").select(F.col("own").alias("node")).distinct()
    rows = rows.join(few_or_shuffled(drop), "node", "left_anti").select(F.col("node").alias("id"), "text")

    met = materialize(_where_covered(_in_several(_windows(rows))), f"{folder}/met")
    run = F.shiftright("spot", 58) == RUN
    runs, met = met.where(run), met.where(~run)
    told, tried, found = met.withColumn("class", F.lit(ALONE).cast("long")), None, None
    for i in range(ROUNDS):
        candidates = _meetings(told, f"{folder}/{i}")
        candidates = materialize(candidates if i else candidates.union(_linked_runs(runs)), f"{folder}/{i}/candidates")
        linked = materialize(_verify(candidates, _texts(rows, candidates, f"{folder}/{i}/texts")), f"{folder}/{i}/found")
        tried, found = (candidates, linked) if not i else (tried.union(candidates), found.union(linked))
        told = materialize(_in_several(_in_classes(met, _classes(found, f"{folder}/{i}"))), f"{folder}/{i}/told")
    sides, rare, holders, texts = _sides_apart(told, rows, folder)
    first = materialize(_first_pairs(rare, holders), f"{folder}/first-pairs")
    candidates = materialize(_between(first, sides).join(tried, candidates.columns, "left_anti"), f"{folder}/candidates")
    found = materialize(found.union(_verify(candidates, texts)).distinct(), f"{folder}/found")
    further = _further_pairs(rare, holders, _classes(found, f"{folder}/between")).join(first, ["id", "other"], "left_anti")
    further = materialize(_between(materialize(further, f"{folder}/further-pairs"), sides).join(tried, candidates.columns, "left_anti"), f"{folder}/further")
    found = materialize(found.union(_verify(further, texts)).distinct(), f"{folder}/all")
    return _reported(found, _classes(found, f"{folder}/last"), owners, rows, folder)


def _meetings(told: DataFrame, folder: str) -> DataFrame:
    """Candidates among windows (key, id, spot, class) and one other of their group: that of the text with the most company over
    all its windows, such as the one that others are edits of."""
    same = Window.partitionBy("key")
    company = told.withColumn("members", F.count(F.lit(1)).over(same)).groupBy("id").agg(F.sum("members").alias("company"))
    told = told.join(materialize(company, f"{folder}/company"), "id")
    told = told.withColumn("other", F.max(F.struct("company", F.xxhash64("id").alias("by"), "id", "spot", "class")).over(same))
    meet = told.where(f"other.id <> id and (other.class <> class or class = {ALONE})")
    pairs = meet.groupBy(F.col("other.id").alias("a"), F.col("id").alias("b"))
    return _join_intervals(pairs.agg(F.collect_set(F.struct(F.col("other.spot").alias("of_a"), F.col("spot").alias("of_b"))).alias("spots")))


def _reported(found: DataFrame, classes: DataFrame, owners: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """The rows of the result: passages of texts become passages of all documents that hold the text, and a text that
    several documents hold is one more passage, from end to end."""
    holders = materialize(owners.select("id", "least", "copies").distinct().join(classes.select("id").distinct(), "id", "left_semi"), f"{folder}/holders")
    sides = _sides(found).withColumnsRenamed({"doc_id": "id", "match_doc_id": "match"})
    inside = (sides["id"] == classes["id"]) & sides["start_word"].between(classes["begin"], classes["end"] - 1)
    linked = sides.join(classes, inside).groupBy(classes["id"], "begin", "end", "class", "match").agg(F.max("similarity").alias("similarity"))
    matches = holders.select(F.col("id").alias("match"), F.col("least").alias("match_least"), F.col("copies").alias("match_copies"))
    islands = linked.join(matches, "match").groupBy("id", "begin", "end", "class").agg(F.min("match_least").alias("match"), F.sum("match_copies").alias("matches"), F.max("similarity").alias("similarity"))
    islands = materialize(islands, f"{folder}/linked")
    sizes = classes.join(holders, "id").groupBy("class", "id").agg(F.min(F.struct("least", "begin")).alias("first"), F.first("copies").alias("copies"))
    sizes = sizes.groupBy("class").agg(F.min("first").alias("first"), F.sum("copies").alias("class_docs"))
    own = islands.join(sizes, "class").join(owners, "id")
    match = F.when(F.col("doc") != F.col("least"), F.least("match", "least")).otherwise(F.col("match"))
    inner = own.select(F.col("doc").alias("doc_id"), F.col("begin").alias("start_word"), (F.col("end") - F.col("begin")).alias("n_words"), match.alias("match_doc_id"), (F.col("matches") + F.col("copies") - 1).alias("n_matches"), "similarity", F.concat_ws(":", "first.least", "first.begin").alias("class_id"), "class_docs")

    held = owners.where("copies > 1")
    lengths = rows.join(few_or_shuffled(held.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"]).select("id", F.regexp_count("text", F.lit(f"[^{SPACE}]+")).cast("long").alias("n_words"))
    other = F.when(F.col("doc") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    whole = held.join(lengths.where(F.col("n_words") >= MIN_WORDS), "id").select("doc", F.lit(0).cast("long"), "n_words", other, F.col("copies") - 1, F.lit(1.0), F.concat(F.lit("text:"), "least"), "copies")
    return inner.union(whole)
