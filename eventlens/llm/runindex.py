"""Run-length index of a collection of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

The transform is kept as runs of equal symbols, with the text position of the first and last suffix of each run.
Matching statistics of many queries are streamed from right to left at once: a step either follows the run that the
row is in, or jumps to the nearest run of the wanted symbol above or below, whichever end continues the longer match.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, snippet: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of strings that each end in symbol 0, by content up to there, then by string.

    ``snippet`` is the number of each position's string, ``end`` the position of its final 0.
    """
    n, depth = len(symbols), 6
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(depth, dtype=np.uint64)])
    key, open_ = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(depth):
        symbol = np.where(open_, padded[i : i + n], np.uint64(0))
        key = (key << np.uint64(9)) | symbol
        open_ &= symbol > 0
    position = np.arange(n)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        if new.all():
            return order
        inside = position + depth <= end
        second = np.where(inside, rank[np.minimum(position + depth, n - 1)], snippet.astype(np.uint64))
        key = (rank << np.uint64(32)) | second
        depth *= 2


class RunLengthIndex:
    """Index of ``texts`` (bytes each)."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        n = len(data)
        snippet = np.repeat(np.arange(len(texts)), lengths + 1)
        self.end = (self.first + lengths)[snippet]
        symbols = data.astype(np.int16) + 1
        symbols[self.first + lengths] = 0
        order = suffix_array(symbols, snippet, self.end)
        starts_text = np.zeros(n, dtype=bool)
        starts_text[self.first] = True
        last_column = np.where(starts_text[order], 0, symbols[order - 1])
        head = np.empty(n, dtype=bool)
        head[0] = True
        np.not_equal(last_column[1:], last_column[:-1], out=head[1:])
        self.run_start = np.flatnonzero(head)
        self.run_char = last_column[self.run_start].astype(np.int64)
        self.run_last = np.append(self.run_start[1:], n) - 1
        self.sample_first, self.sample_last = order[self.run_start], order[self.run_last]
        size = self.run_last - self.run_start + 1
        runs = len(size)
        by_char = np.argsort(self.run_char, kind="stable")
        before = np.cumsum(size[by_char]) - size[by_char]
        total = np.bincount(self.run_char, weights=size, minlength=258).astype(np.int64)
        # rows are in order of their first symbol, so the runs' symbols, sorted, say where each run's rows go;
        # symbol 0 has as many rows as there are texts either way
        self.goes_to = np.empty(runs, dtype=np.int64)
        self.goes_to[by_char] = before
        assert total[0] == len(texts)
        self.key = self.run_char[by_char] * runs + by_char
        self.runs = runs
        self.start_row = order[0]
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.words = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))

    def _common(self, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Length of the common prefix at text positions a and b, at most cap."""
        cap = np.minimum(cap, self.end[b] - b)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(cap > 0)
        done = 0
        while len(live):
            x = self.words[a[live] + done] ^ self.words[b[live] + done]
            equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            out[live] = np.minimum(done + equal, cap[live])
            done += 8
            live = live[(equal == 8) & (cap[live] > done)]
        return out

    def matching_statistics(self, queries: list[bytes]) -> np.ndarray:
        """For each query (row) and position, the length of the longest prefix from there that occurs in the texts.

        Rows are as wide as the longest query; positions beyond a query's end are 0.
        """
        width = max(map(len, queries), default=0)
        length = np.array([len(q) for q in queries], dtype=np.int64)
        grid = np.zeros((len(queries), width), dtype=np.uint8)
        for i, q in enumerate(queries):
            grid[i, : len(q)] = np.frombuffer(q, dtype=np.uint8)
        out = np.zeros((len(queries), width), dtype=np.int32)
        row = np.zeros(len(queries), dtype=np.int64)
        at = np.full(len(queries), self.start_row, dtype=np.int64)
        matched = np.zeros(len(queries), dtype=np.int64)
        for i in range(width - 1, -1, -1):
            who = np.flatnonzero(length > i)
            c = grid[who, i].astype(np.int64) + 1
            q, p, m = row[who], at[who], matched[who]
            run = np.searchsorted(self.run_start, q, side="right") - 1
            known = np.ones(len(who), dtype=bool)
            other = np.flatnonzero(self.run_char[run] != c)
            if len(other):
                oc, op, om = c[other], p[other], m[other]
                j = np.searchsorted(self.key, oc * self.runs + run[other])
                below, above = np.minimum(j, self.runs - 1), np.maximum(j - 1, 0)
                has_below = (j < self.runs) & (self.key[below] // self.runs == oc)
                has_above = (j > 0) & (self.key[above] // self.runs == oc)
                below, above = self.key[below] % self.runs, self.key[above] % self.runs
                down = np.where(has_below, self._common(op, self.sample_first[below], np.where(has_below, om, 0)), -1)
                up = np.where(has_above, self._common(op, self.sample_last[above], np.where(has_above, om, 0)), -1)
                lower = down > up
                run[other] = np.where(lower, below, above)
                q[other] = np.where(lower, self.run_start[below], self.run_last[above])
                p[other] = np.where(lower, self.sample_first[below], self.sample_last[above])
                m[other] = np.maximum(down, up)
                known[other] = has_below | has_above
            row[who] = np.where(known, self.goes_to[run] + (q - self.run_start[run]), 0)
            at[who] = np.where(known, p - 1, self.start_row)
            matched[who] = np.where(known, m + 1, 0)
            out[who, i] = matched[who]
        return out
