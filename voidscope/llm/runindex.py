"""Run-length index over a list of byte strings.

The index holds the runs of the Burrows-Wheeler transform of the collection, the text positions at both ends of every
run, and the repeated contexts of ``length`` bytes with the least owner of each. Suffixes end with their string; equal
ones stand in text order. Patterns are streamed from right to left, all of them one symbol at a time: inside a run of
the wanted symbol the match grows by one, else it moves to the end of the run above or below that keeps most of it.
"""

from __future__ import annotations

import numpy as np

_SYMBOL_BITS = 9  # bytes count from 1, 0 parts the strings
_WORD = 7  # symbols in one machine word


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every run."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, each followed by a separator, and where each string starts."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int(sizes.sum()) + len(strings), np.uint16)
    symbols[_places(starts, sizes)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return symbols, starts


class RunIndex:
    """Index of ``strings`` with one owner each."""

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int):
        self.length = length
        self.owners = np.asarray(owners, np.int64)
        symbols, self.starts = joined(strings)
        self.size = n = len(symbols)
        self.words = self._words(symbols)
        order, context = self._order(n)
        before = symbols[order - 1].astype(np.int64)  # the symbol before position 0 is the last separator
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(new)
        sizes = np.diff(np.append(self.run, n))
        self.head = before[self.run]
        self.last = self.run + sizes - 1
        self.at_first, self.at_last = order[self.run], order[self.last]
        # runs by symbol: where the rows of each run go under the last-to-first map, and how to find the runs around
        self.by_symbol = np.argsort(self.head, kind="stable")
        self.to = np.empty(len(self.run), np.int64)
        moved = sizes[self.by_symbol]
        self.to[self.by_symbol] = np.cumsum(moved) - moved
        self.keys = self.head[self.by_symbol] * len(self.run) + self.by_symbol
        self._contexts(order, context)

    @property
    def runs(self) -> int:
        return len(self.run)

    @staticmethod
    def _words(symbols: np.ndarray) -> np.ndarray:
        """Seven symbols from every position on, none beyond the end of the string."""
        padded = np.concatenate([symbols, np.zeros(_WORD, np.uint16)]).astype(np.uint64)
        words = np.zeros(len(symbols) + 1, np.uint64)
        inside = np.ones(len(words), bool)
        for j in range(_WORD):
            part = padded[j:j + len(words)]
            inside &= part > 0
            words = (words << np.uint64(_SYMBOL_BITS)) | np.where(inside, part, np.uint64(0))
        return words

    def _order(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions in suffix order, and the number of the context (first ``length`` symbols) of each row.

        Ranks by 7 symbols double, by way of ``length``; only tied rows whose strings go on are sorted again.
        """
        end = np.append(self.starts[1:], n) - 1
        rest = np.repeat(end, np.diff(np.append(self.starts, n))) - np.arange(n)  # symbols before the separator
        known = min(_WORD, self.length)
        shown = self.words[:n] >> np.uint64(_SYMBOL_BITS * (_WORD - known))
        order = np.argsort(shown, kind="stable")
        key = shown[order]
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        context = group if known == self.length else None
        rank = np.zeros(n, np.int64)
        while True:
            goes_on = np.bincount(group, minlength=n)[group] > 1
            tied = np.flatnonzero(goes_on & (rest[order] >= known))
            if not len(tied):
                return order, group if context is None else context
            step = known if context is not None else min(known, self.length - known)
            rank[order] = group
            places = order[tied]
            composed = (group[tied] << 32) | rank[places + step]
            again = np.argsort(composed, kind="stable")
            order[tied] = places[again]
            composed = composed[again]
            start = np.concatenate([[True], group[1:] != group[:-1]])
            start[tied[1:]] |= composed[1:] != composed[:-1]
            group = np.cumsum(start) - 1
            known += step
            if known == self.length:
                context = group

    def _contexts(self, order: np.ndarray, group: np.ndarray) -> None:
        """Rows and least owner of every context of more than one row."""
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, self.size))
        some = sizes > 1
        self.context, self.context_end = first[some], (first + sizes)[some]
        tied = np.repeat(some, sizes)
        least = self.owner_at(order[tied])
        inner = np.cumsum(sizes[some]) - sizes[some]
        self.context_owner = np.minimum.reduceat(least, inner) if len(inner) else least

    def owner_at(self, place: np.ndarray) -> np.ndarray:
        """Owner of the string around a text position."""
        return self.owners[np.searchsorted(self.starts, place, side="right") - 1]

    def least_owner(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Least owner of the context of ``row``; ``place`` is the text position of one of its rows."""
        out = self.owner_at(place)
        if len(self.context):
            at = np.maximum(np.searchsorted(self.context, row, side="right") - 1, 0)
            inside = (row >= self.context[at]) & (row < self.context_end[at])
            out[inside] = self.context_owner[at[inside]]
        return out

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common part from two text positions on, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        done = 0
        while len(open_) and done < self.length:
            x = self.words[np.minimum(a[open_] + done, self.size)] ^ self.words[np.minimum(b[open_] + done, self.size)]
            for j in range(_WORD):
                out[open_] += (x >> np.uint64(_SYMBOL_BITS * (_WORD - 1 - j))) == 0
            done += _WORD
            open_ = open_[(x == 0) & (most[open_] > done)]
        return np.minimum(out, most)

    def matching_statistics(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every position of every pattern (one after the other): length of the longest match from there on, up
        to ``length``, the least owner of such a match where the length is reached, and where each pattern starts."""
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        lengths, owners = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        if not self.size:
            return lengths, owners, starts
        longest = np.argsort(-sizes, kind="stable")
        ends, left = (starts + sizes)[longest], sizes[longest]
        row = np.zeros(len(patterns), np.int64)
        place = np.full(len(patterns), self.at_first[0])
        match = np.zeros(len(patterns), np.int64)
        for t in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -t, side="left"))  # patterns longer than t
            at = ends[:n] - 1 - t
            row[:n], place[:n], match[:n] = self._extend(symbols[at], row[:n], place[:n], match[:n])
            lengths[at] = match[:n]
            full = np.flatnonzero(match[:n] >= self.length)
            owners[at[full]] = self.least_owner(row[full], place[full])
        return lengths, owners, starts

    def _extend(self, symbol, row, place, match):
        """One more symbol to the left."""
        run = np.searchsorted(self.run, row, side="right") - 1
        found = self.to[run] + row - self.run[run]
        came, grown = place - 1, np.minimum(match + 1, self.length)
        other = np.flatnonzero(self.head[run] != symbol)
        if len(other):
            wanted, here, have = symbol[other], place[other], match[other]
            after = np.searchsorted(self.keys, wanted * self.runs + run[other])
            kept = np.full(len(other), -1)
            new_row, new_place = row[other].copy(), here.copy()
            for up in (True, False):
                around = after - 1 if up else after
                real = (around >= 0) & (around < self.runs)
                j = self.by_symbol[np.where(real, around, 0)]
                real &= self.head[j] == wanted
                some = np.flatnonzero(real)
                j = j[some]
                sample = (self.at_last if up else self.at_first)[j]
                shared = self.common(here[some], sample, have[some])
                better = shared > kept[some]
                some, j, sample = some[better], j[better], sample[better]
                kept[some] = shared[better]
                new_row[some] = self.to[j] + ((self.last[j] - self.run[j]) if up else 0)
                new_place[some] = sample - 1
            found[other], came[other] = new_row, new_place
            grown[other] = np.minimum(kept + 1, self.length)
        return found, came, grown
