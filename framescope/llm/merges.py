"""Byte-pair merges of many segments at once, over flat numpy arrays."""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1) << 40


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then the same of the next, end to end."""
    if not sizes.size:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class MergeTable:
    """Pairs of symbols, the rank of each (lower merges first) and the symbol it becomes, in a hash table that looks many up at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], width: int = 1 << 21):
        self.width = width
        keys = np.array([a * width + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[by]
        self.ids = np.array([i for _, i in pairs.values()], np.int64)[by]
        self._bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._slots = np.full(1 << self._bits, -1, np.int64)
        for k, slot in enumerate(self._slot(self.keys).tolist()):
            while self._slots[slot] >= 0:
                slot = (slot + 1) & ((1 << self._bits) - 1)
            self._slots[slot] = k
        # where some pair with the joined symbol ranks before the pair that makes it, one merge can call for another at once, and so on: as far as the
        # longest symbol reaches. Such places are joined together only where they are farther apart than two of these can stretch
        left, right = np.divmod(self.keys, width)
        first = np.full(int(max(left.max(initial=0), right.max(initial=0), self.ids.max(initial=0))) + 1, _NONE)
        np.minimum.at(first, left, self.ranks)
        np.minimum.at(first, right, self.ranks)
        self.single = np.zeros(int(self.ranks.max(initial=0)) + 1, bool)
        self.single[self.ranks[first[self.ids] < self.ranks]] = True
        length, before = np.ones(first.size, np.int64), None
        while before is None or (length != before).any():
            before = length.copy()
            np.maximum.at(length, self.ids, before[left] + before[right])
        self.apart = 2 * int(length.max())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair; the rank of a pair that doesn't join is _NONE."""
        if not self.keys.size:
            return np.full(left.size, _NONE), np.zeros(left.size, np.int64)
        keys = left * self.width + right
        slot = self._slot(keys)
        at = self._slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
            at[open_] = self._slots[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return np.where(at >= 0, self.ranks[at], _NONE), self.ids[at]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges segments (their symbols end to end, and their sizes) until no pair joins: symbols end to end, and the new sizes.

        Each round takes every segment's least rank and joins all its places there at once, the leftmost of those that overlap first; where the joined
        symbol may merge on before the others (see `single`), only places with none close to their left. Segments with none are done and leave.
        """
        sizes = sizes.astype(np.int64)
        segment, total = np.flatnonzero(sizes > 0), sizes.size
        sizes = sizes[segment]
        done: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        if symbols.size:
            rank, joined = self.find(symbols[:-1], symbols[1:])
            rank, joined = np.append(rank, _NONE), np.append(joined, 0)
            rank[np.cumsum(sizes) - 1] = _NONE
        while symbols.size:
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            live = least < _NONE
            if not live.all():
                over = np.repeat(~live, sizes)
                done.append(symbols[over])
                owner.append(np.repeat(segment[~live], sizes[~live]))
                symbols, rank, joined = symbols[~over], rank[~over], joined[~over]
                segment, sizes, least = segment[live], sizes[live], least[live]
                if not symbols.size:
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            gap = np.diff(at, prepend=-self.apart)
            place = np.arange(at.size)  # of neighbouring places every second one, from the first
            head = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
            free = (place - head) % 2 == 0
            of = np.searchsorted(np.cumsum(sizes), at, side="right")
            free &= ~self.single[least][of] | (gap >= self.apart) | (np.diff(of, prepend=-1) != 0)
            at, of = at[free], of[free]
            symbols[at] = joined[at]
            keep = np.ones(symbols.size, bool)
            keep[at + 1] = False
            symbols, rank, joined = symbols[keep], rank[keep], joined[keep]
            sizes = sizes - np.bincount(of, minlength=sizes.size)
            at = at - np.arange(at.size)  # each place before it has lost one symbol
            ends = np.cumsum(sizes)
            rank[at] = _NONE
            stale = np.concatenate([at[at < ends[of] - 1], at[at > (ends - sizes)[of]] - 1])
            rank[stale], joined[stale] = self.find(symbols[stale], symbols[stale + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(total, np.int64)
        ids, of = np.concatenate(done), np.concatenate(owner)
        by = np.argsort(of, kind="stable")
        return ids[by], np.bincount(of, minlength=total)


class SegmentStore:
    """Ids of segments encoded before: a row of a flat array for each key. Starts anew beyond `most` segments."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.rows)
        self.rows.update(zip(keys, range(n, n + len(keys))))
        ends = self.at[n] + np.cumsum(sizes)
        self.flat = _room(self.flat, int(ends[-1]) if ends.size else 0)
        self.at = _room(self.at, n + len(keys) + 1)
        self.flat[self.at[n] : self.at[n] + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(keys)] = ends

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows end to end, and the rows' sizes."""
        sizes = self.at[rows + 1] - self.at[rows]
        return self.flat[ranges(self.at[rows], sizes)], sizes


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """x, or a copy of twice the size (or more) that has room for `size` values."""
    return x if size <= x.size else np.concatenate([x, np.zeros(max(x.size, size - x.size), x.dtype)])
