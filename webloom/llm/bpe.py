"""Byte-pair merging of many sequences at once, on ragged numpy arrays.

All sequences of a batch lie in one flat array of symbols with the number of the sequence beside each. A round finds each
sequence's lowest rank and merges every occurrence of that pair in it (of overlapping ones the leftmost, the third and
so on); sequences with no pair left go out. This gives what merging one occurrence at a time gives as long as a merged
symbol's pairs rank after the pair it came from. `Merges` sees whether some pairs break this rule; then the sequences in
which a merged symbol and its neighbour do so, and very long ones in any case, are merged one occurrence at a time with a heap.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longer sequences take the heap: rounds cost length times the number of distinct ranks.
LONG = 400


class Merges:
    """left, right, rank, made: arrays; merging left and right gives made, lowest rank first. Pairs can share a rank: then the leftmost goes first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.base = np.int64(max(left.max(), right.max(), made.max()) + 1) if len(left) else np.int64(1)
        keys = left.astype(np.int64) * self.base + right
        self._hash(keys, rank, made)
        first = np.full(int(self.base) + 1, -1, np.int64)  # the first rank at which a symbol can be made
        if len(made):
            by = np.argsort(-rank, kind="stable")
            first[made[by]] = rank[by]
        self.early = bool((rank <= np.maximum(first[left], first[right])).any()) if len(rank) else False
        self.table = dict(zip(zip(left.tolist(), right.tolist(), strict=True), zip(rank.tolist(), made.tolist(), strict=True), strict=True))

    def _hash(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Open addressing with as many probes as the longest run needs."""
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -2, np.int64)
        self.ranks, self.made = np.full(size, NONE, np.int32), np.full(size, -1, np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = (self._spot(keys[left]) + self.probes) & (size - 1)
            free = np.flatnonzero(self.keys[at] == -2)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]], self.made[at[put]] = keys[left[put]], rank[left[put]], made[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or one without a rank."""
        keys = left * self.base + right
        keys[(left >= self.base) | (right >= self.base)] = -1
        at = self._spot(keys)
        look = np.flatnonzero(self.keys[at] != keys)
        for _ in range(self.probes - 1):
            if not len(look):
                break
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            look = look[(self.keys[at[look]] != keys[look]) & (self.keys[at[look]] != -2)]
        at[look] = -1
        return np.where(self.keys[at] == keys, at, -1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self._find(left, right)
        return np.where(at >= 0, self.ranks[at], NONE)

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, then leftmost, with a heap: n log n."""
        sym, n, table = list(symbols), len(symbols), self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(x[0], i, sym[i], sym[i + 1], x[1]) for i in range(n - 1) if (x := table.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := table.get((made, sym[k])):
                    heapq.heappush(heap, (x[0], i, made, sym[k], x[1]))
            h = before[i]
            if h >= 0 and (x := table.get((sym[h], made))):
                heapq.heappush(heap, (x[0], h, sym[h], made, x[1]))
        return [x for x in sym if x >= 0]

    def merge(self, sym: np.ndarray, lens: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all sequences, one after the other, and their lengths. lens: of each sequence, 0 included."""
        n_seq = len(lens)
        sym, seq = sym.astype(np.int64), np.repeat(np.arange(n_seq, dtype=np.int64), lens)
        slow = np.flatnonzero(lens > long)
        out_sym: list[np.ndarray] = []
        out_seq: list[np.ndarray] = []
        start, by_hand = np.concatenate([[0], np.cumsum(lens)]), sym
        is_slow = np.zeros(n_seq, bool)
        is_slow[slow] = True
        if len(slow):
            stay = ~is_slow[seq]
            sym, seq = sym[stay], seq[stay]
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            i = np.flatnonzero(seq[:-1] == seq[1:])
            rank[i] = self.rank(sym[i], sym[i + 1])
        while len(sym):
            new = np.concatenate([[True], seq[1:] != seq[:-1]])
            starts = np.flatnonzero(new)
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            over = low == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                out_sym.append(sym[gone])
                out_seq.append(seq[gone])
                stay = ~gone
                sym, seq, rank, low, sizes = sym[stay], seq[stay], rank[stay], low[~over], sizes[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, sizes)
            if (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                run = hit & ~np.concatenate([[False], hit[:-1]])
                hit &= (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
            where = np.flatnonzero(hit)
            made = self.made[self._find(sym[where], sym[where + 1])]
            if self.early:  # would a pair with what stands beside it come first?
                left, right = np.maximum(where - 1, 0), np.minimum(where + 2, len(sym) - 1)
                bad = (seq[left] == seq[where]) & (left < where) & (self.rank(sym[left], made) <= rank[where])
                bad |= (seq[right] == seq[where]) & (right == where + 2) & (self.rank(made, sym[right]) <= rank[where])
                if bad.any():  # such sequences are done anew with the heap
                    is_slow[seq[where[bad]]] = True
                    stay = ~is_slow[seq]
                    sym, seq, rank = sym[stay], seq[stay], rank[stay]
                    continue
            sym[where] = made
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            where = where - np.arange(len(where))
            again = np.concatenate([where, where[where > 0] - 1])
            inner = again[again + 1 < len(sym)]
            rank[again] = NONE
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        for i in np.flatnonzero(is_slow).tolist():
            done = np.array(self.one_by_one(by_hand[start[i] : start[i + 1]].tolist()), np.int64)
            out_sym.append(done)
            out_seq.append(np.full(len(done), i, np.int64))
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(n_seq, np.int64)
        sym, seq = np.concatenate(out_sym), np.concatenate(out_seq)
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=n_seq)
