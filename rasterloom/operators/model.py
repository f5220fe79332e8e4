"""Adaptive models: from the symbols so far to the interval of the next one, in 4096ths.

A model is asked for its ``table`` (cumulative frequencies, or None where the
next symbol is passed raw) and then told the symbol. Coder and decoder run the
same code, so they cannot disagree.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

from rasterloom.operators.grouped import by_key

#: Probability scale; steps of small, middle, large and fixed models; list limits.
SCALE = 4096
SMALL_STEP, MIDDLE_STEP, LARGE_STEP, FIXED_STEP = 50, 25, 16, 16
FIRST_LIST, SECOND_LIST, FOUR, SIXTEEN, FORTY = 14, 64, 4, 16, 40
#: Weight of a symbol that enters the middle model from a list: version 4 (version 3 has 64).
LIST_WEIGHT = 32


def doubling(total: int) -> int:
    """How often ``total`` is doubled to exceed half the scale."""
    shift = 0
    while total << shift <= SCALE // 2:
        shift += 1
    return shift


def half_up(n):
    return n - (n >> 1)


class Singles:
    """Symbols met once each; nothing is predicted, so every symbol is raw."""

    kind = 0

    def __init__(self):
        self.seen: list[int] = []

    @property
    def table(self):
        return None

    def tell(self, sym: int):
        seen = self.seen
        at = bisect_left(seen, sym)
        d = len(seen)
        if at < d and seen[at] == sym:
            if d <= FIRST_LIST:
                return Small(seen, {s: SMALL_STEP * (2 if s == sym else 1) for s in seen}, sym)
            return Middle.of_list(seen, sym) if d <= SECOND_LIST else Large.of_list(seen, sym)
        insort(seen, sym)
        self.kind = 1 if d < FIRST_LIST else 2 if d < SECOND_LIST else 3
        return self


class Small:
    """Up to 16 counted symbols; all others keep weight 1; spare code space goes to one favourite."""

    def __init__(self, seen: list[int], count: dict[int, int], favourite: int):
        self.seen, self.count, self.favourite = list(seen), count, favourite
        self.kind = 4 if len(seen) <= FOUR else 5
        self.total = self._exact()

    def _exact(self) -> int:
        return sum(self.count.values()) + 256 - len(self.seen)

    def _weights(self) -> tuple[np.ndarray, int]:
        shift = doubling(self.total)
        w = np.ones(256, dtype=np.int64)
        for s, n in self.count.items():
            w[s] = n
        w[self.favourite] += (SCALE - (self.total << shift)) >> shift
        return w, shift

    @property
    def table(self) -> np.ndarray:
        w, shift = self._weights()
        return np.concatenate([[0], np.cumsum(w << shift)])

    def tell(self, sym: int):
        if sym in self.count:
            self.count[sym] += SMALL_STEP
            self.total += SMALL_STEP
            if self.count[sym] > self.count[self.favourite]:
                self.favourite = sym
        else:
            if len(self.seen) == SIXTEEN:
                return Middle.of_small(self, sym)
            insort(self.seen, sym)
            self.count[sym] = SMALL_STEP
            if self.kind == 4 and len(self.seen) > FOUR:
                # The larger form starts its favourite anew, at the smallest symbol.
                self.kind, self.favourite = 5, self.seen[0]
                if sum(self.count.values()) > SCALE:
                    self._halve()
                self.total = self._exact()
                return self
            self.total += SMALL_STEP
        if self.total + SMALL_STEP > SCALE:
            self._halve()
        if self.kind == 4:
            self.total = self._exact()  # the smallest form keeps no running total
        return self

    def _halve(self) -> None:
        self.count = {s: half_up(n) for s, n in self.count.items()}
        self.total = self._exact()


class Middle:
    """Up to 40 counted symbols over intervals that stay frozen while counts grow."""

    kind = 6

    def __init__(self, freq: np.ndarray, shift: int, count: dict[int, int]):
        self.freq, self.shift, self.count = freq, shift, count
        self.table = np.concatenate([[0], np.cumsum(freq)])
        self._sum()

    def _sum(self) -> None:
        self.total = ((256 - len(self.count)) << max(self.shift - 1, 0)) + sum(self.count.values())

    @classmethod
    def _start(cls, weight: dict[int, int], total: int) -> Middle:
        shift = doubling(total)
        freq = np.full(256, 1 << shift, dtype=np.int64)
        for s, n in weight.items():
            freq[s] = n << shift
        return cls(freq, shift, {s: half_up(n << shift) for s, n in weight.items()})

    @classmethod
    def of_list(cls, seen: list[int], sym: int) -> Middle:
        weight = {s: LIST_WEIGHT * (2 if s == sym else 1) for s in seen}
        return cls._start(weight, 256 - len(seen) + sum(weight.values()))

    @classmethod
    def of_small(cls, small: Small, sym: int) -> Middle:
        m = cls._start(small.count, small._exact())
        m.count[sym] = half_up(1 << m.shift) + (MIDDLE_STEP << m.shift)
        m._sum()
        return m

    def tell(self, sym: int):
        if sym not in self.count:
            if len(self.count) >= FORTY:
                return Large.of_middle(self)
            self.count[sym] = half_up(1 << self.shift)
        step = MIDDLE_STEP << self.shift
        self.count[sym] += step
        self.total += step
        if self.total + step > SCALE:
            self.freq = np.full(256, 1 << max(self.shift - 1, 0), dtype=np.int64)
            for s, n in self.count.items():
                self.freq[s] = n
            self.table = np.concatenate([[0], np.cumsum(self.freq)])
            self.shift = max(self.shift - 1, 0)
            self.count = {s: half_up(n) for s, n in self.count.items()}
            self._sum()
        return self


class Large:
    """All symbols counted; intervals are taken from the counts when these overflow, then counts halve."""

    kind = 7

    def __init__(self, freq: np.ndarray, count: np.ndarray, total: int, step: int = LARGE_STEP):
        self.count, self.total, self.step = count, total, step
        self.table = np.concatenate([[0], np.cumsum(freq)])

    @classmethod
    def of_middle(cls, m: Middle) -> Large:
        count = np.full(256, half_up(1 << m.shift), dtype=np.int64)
        for s, n in m.count.items():
            count[s] = n
        return cls(m.freq, count, m.total)

    @classmethod
    def of_list(cls, seen: list[int], sym: int) -> Large:
        share = (SCALE - (256 - len(seen))) // (len(seen) + 1)
        freq, count = np.ones(256, dtype=np.int64), np.ones(256, dtype=np.int64)
        freq[seen], count[seen] = share, half_up(share)
        freq[sym] += share
        count[sym] += LARGE_STEP
        return cls(freq, count, int(count.sum()))

    @classmethod
    def even(cls, n: int) -> Large:
        """The model of a fixed alphabet of ``n``: equal shares at first."""
        freq = np.full(n, SCALE // n, dtype=np.int64)
        count = half_up(freq)
        return cls(freq, count, int(count.sum()), FIXED_STEP)

    def tell(self, sym: int):
        self.count[sym] += self.step
        self.total += self.step
        if self.total + self.step > SCALE:
            self.table = np.concatenate([[0], np.cumsum(self.count)])
            self.count = half_up(self.count)
            self.total = int(self.count.sum())
        return self


class Models:
    """A model per (channel, context): adaptive bytes for channels without a fixed alphabet."""

    def __init__(self, alphabets: dict[str, int]):
        self.alphabets = alphabets
        self.held: dict[tuple, object] = {}

    def of(self, channel: str, ctx: int):
        key = channel, ctx
        m = self.held.get(key)
        if m is None:
            n = self.alphabets.get(channel)
            m = self.held[key] = Singles() if n is None else Large.even(n)
        return m

    def tell(self, channel: str, ctx: int, sym: int) -> None:
        self.held[channel, ctx] = self.held[channel, ctx].tell(sym)

    def interval(self, channel: str, ctx: int, sym: int) -> tuple[int, int]:
        """(start, frequency) of ``sym``, frequency 0 where it is raw; then counts it."""
        table = self.of(channel, ctx).table
        out = (sym, 0) if table is None else (int(table[sym]), int(table[sym + 1] - table[sym]))
        self.tell(channel, ctx, sym)
        return out


def fold(symbols: list[int], alphabet: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """(start, freq, kind) of each of the symbols of one context, in order; freq 0 where the symbol is raw."""
    model, start, freq, kind = Singles() if alphabet is None else Large.even(alphabet), [], [], []
    for s in symbols:
        table = model.table
        start.append(s if table is None else int(table[s]))
        freq.append(0 if table is None else int(table[s + 1] - table[s]))
        kind.append(model.kind)
        model = model.tell(s)
    return start, freq, kind


def adaptive_intervals(symbols, keys: list[str], alphabet: int | None = None):
    """Intervals of symbols in their contexts: rows (keys..., seq, sym, start, freq, kind).

    Contexts never interact when encoding, so each folds on its own, in order of
    seq; ``symbols`` has keys, seq and sym (0..255, or below ``alphabet`` where
    that is fixed). Sorted contexts stream
    through each task, one at a time; let ``keys`` hold the segment, since
    statistics start anew at each keyframe.
    """
    import pyarrow as pa

    types, names = dict(symbols.dtypes), [*keys, "seq", "sym"]

    def run(batches):
        for _, t in by_key(batches, keys):
            told = fold(t.column("sym").to_pylist(), alphabet)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names), *(pa.array(v, pa.int32()) for v in told)], names=[*names, "start", "freq", "kind"])

    ddl = ", ".join(f"{k} {types[k]}" for k in names) + ", start int, freq int, kind int"
    return symbols.select(*names).repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, ddl)
