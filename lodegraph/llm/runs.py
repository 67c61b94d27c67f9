"""Periodic runs of words, found from the Lyndon words that start at each position under an order and under its reverse."""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts_of

#: A run counts if it has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are compared one by one before hashes are asked.
DIRECT = 8
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245


class Extensions:
    """Longest common extensions of two places in a list of word numbers.

    The first words are compared one by one. Beyond them a binary search over rolling hashes proposes a length and the words
    themselves are compared, so an answer never rests on a hash. What was compared at a distance is remembered: as callers go
    from right to left, the same words are not compared again at the same distance.
    """

    def __init__(self, w: list[int]):
        self.w, self.n = w, len(w)
        self.array = np.array(w, np.int64)
        self.known: dict[int, tuple[int, int]] = {}
        self.prefix: list[int] | None = None

    def _hashes(self) -> None:
        """Prefix sums of value * base ** place modulo a prime, and the powers."""
        powers = np.ones(max(self.n, 1), np.int64)
        at = 1
        while at < len(powers):
            more = min(at, len(powers) - at)
            powers[at : at + more] = powers[:more] * (powers[at - 1] * _BASE % _PRIME) % _PRIME
            at += more
        values = (self.array * 2_654_435_761 + 97) % _PRIME
        self.prefix = [0, *(np.cumsum(values * powers[: self.n] % _PRIME) % _PRIME).tolist()]
        self.powers = powers.tolist()

    def _alike(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of w[i : i + length] and w[j : j + length] are equal, i < j."""
        h = self.prefix
        return (h[i + length] - h[i]) * self.powers[j - i] % _PRIME == (h[j + length] - h[j]) % _PRIME

    def _proposed(self, low: int, most: int, alike) -> int:
        """The largest length in low..most that ``alike`` accepts, if lengths are accepted up to some bound."""
        return low + bisect_left(range(low + 1, most + 1), True, key=lambda length: not alike(length))

    def right(self, i: int, j: int) -> int:
        """The largest k with w[i : i + k] == w[j : j + k], i < j."""
        w, n, k = self.w, self.n, 0
        low, high = self.known.get(j - i, (n + 1, n + 1))
        if low <= i <= high:
            return high - i
        while k < DIRECT:
            if i + k == low:
                self.known[j - i] = (i, high)
                return high - i
            if j + k >= n or w[i + k] != w[j + k]:
                return k
            k += 1
        if self.prefix is None:
            self._hashes()
        k = self._proposed(k, n - j, lambda length: self._alike(i, j, length))
        # Words up to the place from which this distance is known; all of them, and the one after, if there is none.
        reach = min(k, low - i) if i < low else k
        if not np.array_equal(self.array[i : i + reach], self.array[j : j + reach]) or (reach == k and j + k < n and w[i + k] == w[j + k]):
            k = self._compared(i, j)
        elif reach == low - i:
            k = high - i
        self.known[j - i] = (i, i + k)
        return k

    def _compared(self, i: int, j: int) -> int:
        """The same without hashes, in growing pieces."""
        k, piece = 0, 64
        while j + k < self.n:
            a, b = self.array[i + k : i + k + piece], self.array[j + k : j + k + piece]
            differ = np.flatnonzero(a[: len(b)] != b)
            if len(differ):
                return k + int(differ[0])
            k, piece = k + len(b), piece * 2
        return self.n - j

    def left(self, i: int, j: int) -> int:
        """The largest k with w[i - k : i] == w[j - k : j], i < j."""
        w, k = self.w, 0
        while k < DIRECT:
            if k >= i or w[i - 1 - k] != w[j - 1 - k]:
                return k
            k += 1
        if self.prefix is None:
            self._hashes()
        k = self._proposed(k, i, lambda length: self._alike(i - length, j - length, length))
        if np.array_equal(self.array[i - k : i], self.array[j - k : j]) and (k == i or w[i - k - 1] != w[j - k - 1]):
            return k
        differ = np.flatnonzero(self.array[:i] != self.array[j - i : j])
        return i - 1 - int(differ[-1]) if len(differ) else i


def lyndon_ends(w: list[int], extensions: Extensions) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, under the order of the numbers in ``w``.

    From right to left: the ends link the Lyndon words to the right into a stack, and a word takes in those on top whose suffix is
    greater than its own. Each word is taken in once, so the comparisons are linear in the words.
    """
    n = len(w)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        own, j = w[i], i + 1
        while j < n:
            other = w[j]
            if other == own:
                k = 1 if j + 1 < n and w[j + 1] != w[i + 1] else extensions.right(i, j)
                # A suffix that ends first is the smaller one.
                if j + k == n or w[j + k] < w[i + k]:
                    break
            elif other < own:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(w: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) by start and period: maximal stretches of at least ``least_words`` words and ``least_periods`` periods (3 or more).

    Under one of the two orders each run holds, in its first period, the start of a longest Lyndon word as long as its period;
    that word is then repeated twice at least. Places for which neither this nor its ends hold are left out at once.
    """
    n, found = len(w), set()
    if n < least_words:
        return []
    extensions, at = Extensions(w), np.arange(n)
    a = extensions.array
    for order in (w, [-x for x in w]):
        period = np.array(lyndon_ends(order, extensions)) - at
        i = np.flatnonzero(at + 3 * period <= n)
        for offset in (0, -1):
            for step in (1, 2):
                p = period[i]
                place = i + (p - 1 if offset else 0)
                i = i[a[place] == a[place + step * p]]
        p = period[i]
        last = (0, 0, 0)
        for k in np.lexsort((i, p)).tolist():
            s, q = int(i[k]), int(p[k])
            if last[2] == q and last[0] <= s and s + 2 * q <= last[1]:
                continue
            end = s + q + extensions.right(s, s + q)
            if end - s < 2 * q:
                continue
            start = s - extensions.left(s, s + q)
            last = (start, end, q)
            if end - start >= max(least_words, least_periods * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with ``runs`` (start, length and period of each, by start and period), ``strongest`` (the one of the greatest exact
    length / period, null if there is none) and ``collapsed`` (the text without what runs repeat, its words joined by one space).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Whole texts in one Arrow pass without a shuffle; a text takes about n log n
    steps and some hundred bytes a word. Null and empty texts have no words, no run and an empty collapsed text. Rows are
    independent: repeats come back as often, an empty table gives none. Columns of these three names are replaced, others stay.
    """
    struct = pa.struct([(f.name, pa.int64()) for f in _RUN.fields])

    def make():
        def step(batch):
            every, best, kept = [], [], []
            for text_ in texts_of(batch, text):
                # On bytes, split() cuts at 0x20 and 0x09-0x0D alone.
                words, numbers = text_.encode().split(), {}
                runs = runs_of([numbers.setdefault(x, len(numbers)) for x in words], least_words, least_periods)
                every.append([dict(zip(_RUN.names, r, strict=True)) for r in runs])
                top = strongest(runs)
                best.append(top and dict(zip(_RUN.names, top, strict=True)))
                kept.append(collapsed(words, runs))
            return [pa.array(every, pa.list_(struct)), pa.array(best, struct), pa.array(kept, pa.binary()).cast(pa.string())]

        return step

    fields = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())]
    return append_columns(docs, fields, make, rows=64)


def run_text(runs):
    """Column: a line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def with_repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which a tenth of the texts, chosen by the CRC-32 h of the decimal id, go on repeating a stretch of their own words.

    With g = h div 10, every word i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8); the words of
    such a text are joined by one space. A text whose id is null stays.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise("")

    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    # The words stand in a lambda's variable, so they are split once.
    return docs.withColumn(text, F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(F.col(text)))
