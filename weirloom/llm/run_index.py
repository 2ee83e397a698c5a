"""A run-length compressed Burrows-Wheeler index over many short texts, and matching statistics against it.

The texts are laid end to end, each followed by a separator of its own that sorts before
every byte, so no match crosses a text. Suffixes are sorted by prefix doubling; the
transform is kept as runs (symbol, first row) with the suffix positions at both ends of
each run. Matching statistics stream patterns from right to left, all patterns of a call
side by side: where the row's symbol is the pattern's next one, the match grows by a step
of the LF mapping; else it moves to the end of the nearest run of that symbol above or
below, whichever sampled suffix agrees for longer.
"""

from __future__ import annotations

import numpy as np


def _group_ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each place) by key."""
    order = np.argsort(key)
    new = np.empty(len(key), bool)
    new[:1] = False
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class RunIndex:
    """texts: (bytes, offsets) as in common.buffer; depth: the length of the windows that `window_class` tells apart.

    No text may be longer than 2 * depth - 1.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int = 100):
        count, sizes = len(offsets) - 1, np.diff(offsets)
        self.starts = offsets[:-1] + np.arange(count)  # of each text, with the separators before it
        n = len(data) + count
        self.symbols = np.zeros(n, np.int64)  # 0: a separator
        keep = np.ones(n, bool)
        ends = self.starts + sizes
        keep[ends] = False
        self.symbols[keep] = data.astype(np.int64) + 1
        left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes up to the separator
        # ranks by the first 7 symbols; a suffix that meets its separator there is told apart by its place
        key = np.zeros(n, np.int64)
        padded = np.concatenate([self.symbols, np.zeros(7, np.int64)])
        for j in range(7):
            key = (key << 9) | np.where(j < left, padded[j : j + n], 0)
        _, rank = _group_ranks(key)
        bound = np.int64(n + 1)

        def refine(rank: np.ndarray, have: int, to: int) -> np.ndarray:
            """Ranks by `to` symbols from ranks by `have`, to <= 2 * have; equal ones that end before differ by place."""
            step = to - have
            next_ = np.zeros(n, np.int64)
            next_[: n - step] = rank[step:] + 1
            next_[left < step] = 0
            return _group_ranks(rank * bound + next_)[1]

        # windows of exactly `depth` symbols get equal ranks only if they are equal; suffixes that end before are not asked for
        have = 7
        while have < depth:
            to = min(2 * have, depth)
            rank = refine(rank, have, to)
            have = to
        self.window_class = rank
        rank = refine(rank, depth, 2 * depth)
        # by now only suffixes that end in the same way are equal: their separators, so their places, decide
        order = np.argsort(rank * bound + np.arange(n))
        before = self.symbols[order - 1]
        before[order == 0] = 0
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        length = np.diff(np.append(heads, n))
        self.run_start, self.run_symbol, self.run_length = heads.astype(np.int32), before[heads].astype(np.int16), length.astype(np.int32)
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), length)
        self.first_sample, self.last_sample = order[heads].astype(np.int32), order[heads + length - 1].astype(np.int32)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=257))])  # suffixes of smaller symbols
        by = np.lexsort((heads, before[heads]))
        self.by = by.astype(np.int32)
        symbol = before[heads][by]
        self.key = (symbol << 40) | heads[by]
        total = np.cumsum(length[by]) - length[by]
        self.first_of = np.searchsorted(symbol, np.arange(258))
        base = np.append(total, length.sum())[np.minimum(self.first_of, len(by))]
        self.ahead = np.empty(len(by), np.int32)  # equal symbols in the runs above each run
        self.ahead[by] = total - base[symbol]
        self.text = np.concatenate([np.where(self.symbols > 0, self.symbols - 1, 0).astype(np.uint8), np.zeros(16, np.uint8)])
        self.words = np.ndarray((n + 8,), np.dtype("<u8"), self.text.data, 0, (1,))
        self.left = left.astype(np.int32)
        del self.symbols
        self.rows = n

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For how many bytes, up to `most`, the suffixes at a and b agree within their texts."""
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        out = np.zeros(len(a), np.int64)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            at = out[todo]
            diff = self.words[a[todo] + at] ^ self.words[b[todo] + at]
            low = diff & (~diff + np.uint64(1))
            step = np.where(diff == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) / 8).astype(np.int64))
            out[todo] = np.minimum(at + step, most[todo])
            todo = todo[(diff == 0) & (out[todo] < most[todo])]
        return out

    def matching_statistics(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 30, least: int = 0) -> np.ndarray:
        """For each byte of the patterns, the length, up to `most`, of the longest prefix of the rest of its pattern that the texts hold.

        A pattern is given up, its statistics left at 0, where none to the left can reach `least` any more.
        """
        sizes = np.diff(offsets)
        out = np.zeros(len(data), np.int64)
        live = np.arange(len(sizes))
        row = np.zeros(len(sizes), np.int64)
        pos = np.full(len(sizes), self.first_sample[0], np.int64)
        size = np.zeros(len(sizes), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= back]
            if not len(live):
                break
            at = offsets[live + 1] - back
            c = data[at].astype(np.int64) + 1
            r, p, s = row[live], pos[live], size[live]
            run = self.run_of[r]
            new_row = self.below[c] + self.ahead[run] + (r - self.run_start[run])
            new_pos, new_size = p - 1, s + 1
            m = np.flatnonzero(self.run_symbol[run] != c)
            if len(m):
                cm = c[m]
                j = np.searchsorted(self.key, (cm << 40) | r[m], "right") - 1  # the last run of the symbol above the row
                up, down = j >= self.first_of[cm], j + 1 < self.first_of[cm + 1]
                ru, rd = self.by[np.maximum(j, 0)], self.by[np.minimum(j + 1, len(self.by) - 1)]
                pu, pd = self.last_sample[ru], self.first_sample[rd]
                au = np.where(up, self._agree(p[m], pu, s[m]), -1)
                ad = np.where(down, self._agree(p[m], pd, s[m]), -1)
                above = au >= ad
                new_size[m] = np.maximum(au, ad) + 1  # 0 if the symbol does not occur
                new_row[m] = self.below[cm] + np.where(above, self.ahead[ru] + self.run_length[ru] - 1, self.ahead[rd])
                new_pos[m] = np.where(above, pu, pd) - 1
                none = ~up & ~down
                new_row[m[none]], new_pos[m[none]] = 0, self.first_sample[0]
            new_size = np.minimum(new_size, most)
            row[live], pos[live], size[live] = new_row, new_pos, new_size
            out[at] = new_size
            if least:
                live = live[(sizes[live] - back + new_size >= least) | (new_size >= least)]
        return out
