"""Token counts without encoding: a BPE tokenizer compiled into two deterministic transducers.

The first splits text as the byte-level pre-tokenizer does. It has 13 states over 12 character classes, so a chunk of text
is a map from entry to exit state; all chunks of a batch run side by side, their maps compose by a parallel prefix scan,
and a second run from the known entry states marks where pieces start.

The second reads the bytes of a piece; each transition is annotated with the change in the number of emitted tokens. It is
determinised as it goes, since the full table of a large vocabulary is far larger than what texts visit.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

CHUNK = 1024
#: Transitions and pieces that a task remembers before it starts afresh; forgetting costs time, never changes a count.
REMEMBERED = 400_000

# Character classes.
SPACE, WHITE, DIGIT, OTHER, QUOTE, LETTER, E, L, R, V, STMD, END = range(12)
# States: nothing open; one blank; one other white; more white ending in a blank, or not; in letters, digits, others;
# after an opening quote; after 'r, 'v, 'l; after a whole contraction.
START, BLANK, WHITE1, BLANKS, WHITES, WORD, NUMBER, SIGNS, QUOTED, Q_R, Q_V, Q_L, DONE = range(13)
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by class and state."""
    letters = {LETTER, E, L, R, V, STMD}
    opens = {SPACE: BLANK, WHITE: WHITE1, DIGIT: NUMBER, OTHER: SIGNS, QUOTE: QUOTED, END: START} | dict.fromkeys(letters, WORD)
    joins = {DIGIT: NUMBER, OTHER: SIGNS, QUOTE: SIGNS} | dict.fromkeys(letters, WORD)
    go, mark = np.zeros((12, 13), np.uint8), np.zeros((12, 13), np.uint8)
    for c in range(12):
        for s in range(13):
            to, m = opens[c], HERE
            white = c in (SPACE, WHITE)
            if s in (BLANK, WHITE1, BLANKS, WHITES) and white:
                to, m = BLANKS if c == SPACE else WHITES, 0
            elif s == BLANK and c in joins:
                to, m = joins[c], 0
            elif s == BLANKS and c in joins:
                to, m = joins[c], BEFORE
            elif s == WHITES and c in joins:
                m = HERE | BEFORE
            elif s == WORD and c in letters or s == NUMBER and c == DIGIT:
                m = 0
            elif s == SIGNS and c in (OTHER, QUOTE):
                to, m = SIGNS, 0
            elif s == QUOTED and c in (OTHER, QUOTE):
                to, m = SIGNS, 0
            elif s == QUOTED and c == STMD:
                to, m = DONE, 0
            elif s == QUOTED and c in (R, V, L):
                to, m = {R: Q_R, V: Q_V, L: Q_L}[c], 0
            elif s in (Q_R, Q_V) and c == E or s == Q_L and c == L:
                to, m = DONE, 0
            elif s in (Q_R, Q_V, Q_L):
                # No contraction after all: the quote stood alone and its letter opened a word.
                m = BEFORE if c in letters else BEFORE | HERE
            go[c, s], mark[c, s] = to, m
    return go, mark


GO, MARK = _rules()
_GO, _MARK = GO.ravel(), MARK.ravel()
_END_CHAR = 0x110000


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the library's own pre-tokenizer treats it: its tables of letters and numbers are
    those of its Unicode version, which the regex library is ahead of. So each letter, number and white space of the latter is
    shown to the former between "a" and "1", which tells letters and numbers, and before "!", which joins all but white space."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = np.full(0x110001, OTHER, np.uint8)
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    points = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}\p{White_Space}]", everything) if c != " "])
    for at in range(0, len(points), 2_000):
        some = points[at : at + 2_000]
        cut = np.zeros(3 * len(some) + 1, bool)
        cut[[b for _, (b, _) in split("".join(f"a{chr(i)}1" for i in some))]] = True
        cut = cut[:-1].reshape(-1, 3)
        out[some[~cut[:, 1]]] = LETTER
        out[some[cut[:, 1] & ~cut[:, 2]]] = DIGIT
        rest = some[cut[:, 1] & cut[:, 2]]
        cut = np.zeros(3 * len(rest) + 1, bool)
        cut[[b for _, (b, _) in split("".join(f"a{chr(i)}!" for i in rest))]] = True
        out[rest[cut[:-1].reshape(-1, 3)[:, 2]]] = WHITE
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("e", E), ("l", L), ("r", R), ("v", V), ("stmd", STMD)):
        for x in chars:
            out[ord(x)] = c
    out[_END_CHAR] = END
    return out


def entry_states(chunks: np.ndarray) -> np.ndarray:
    """The state in which each chunk (a row of classes) is entered, the first in START.

    Every chunk runs from all 13 states at once; once they agree for a chunk, one state goes on. The maps then compose in
    a prefix scan of doubling reach.
    """
    n, size = chunks.shape
    states = np.tile(np.arange(13, dtype=np.uint8), (n, 1))
    warm = min(8, size)
    for k in range(warm):
        states = _GO[chunks[:, k, None].astype(np.int16) * 13 + states]
    split = np.flatnonzero((states != states[:, :1]).any(1))
    single = states[:, 0].copy()
    several = states[split]
    for k in range(warm, size):
        single = _GO[chunks[:, k].astype(np.int16) * 13 + single]
        if len(split):
            several = _GO[chunks[split, k, None].astype(np.int16) * 13 + several]
    maps = np.tile(single[:, None], (1, 13))
    maps[split] = several
    reach = 1
    while reach < n:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return np.concatenate(([START], maps[:-1, START])).astype(np.uint8)


def piece_starts(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pieces start in code points; texts are followed by _END_CHAR each, which is a piece of its own."""
    n = len(codes)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = table[codes]
    chunks = padded.reshape(rows, CHUNK)
    state = entry_states(chunks)
    by_step = np.ascontiguousarray(chunks.T).astype(np.int16) * 13
    marks = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        at = by_step[k] + state
        marks[k] = _MARK[at]
        state = _GO[at]
    flat = np.ascontiguousarray(marks.T).ravel()
    starts = flat & HERE == HERE
    starts[:-1] |= flat[1:] & BEFORE == BEFORE
    return np.flatnonzero(starts[:n])


class Counter:
    """The transducer from bytes to token counts for merges in the order of a tokenizers JSON file."""

    def __init__(self, path: str, table: np.ndarray | None = None):
        self.table = classes() if table is None else table
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", []) if x["content"]]
        model, plain = spec["model"], _byte_symbols()
        vocabulary = model["vocab"]
        self.single = [vocabulary[plain[b]] for b in range(256)]
        unplain = {c: b for b, c in plain.items()}
        self.bytes_of = {i: bytes(unplain[c] for c in token) for token, i in vocabulary.items() if all(c in unplain for c in token)}
        self.merges, self.parts, self.rank = {}, {}, dict.fromkeys(self.single, -1)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = vocabulary[a + b]
            self.merges[vocabulary[a], vocabulary[b]] = rank, new
            self.rank.setdefault(new, rank)
            self.parts.setdefault(new, (vocabulary[a], vocabulary[b]))
        # A tree of the tokens that merges can make: node -> {byte: node}, and the token that ends at a node.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for i in sorted({*self.single, *(new for _, new in self.merges.values())}):
            node = 0
            for b in self.bytes_of[i]:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        #: A state: for each place in the text where a token that is now being read could have begun, its node in the tree,
        #: the last token before that place (None at the start) and how many tokens fewer than now were emitted there.
        self.numbers: dict[tuple, int] = {((0, None, 0),): 0}
        self.states: list[tuple] = [((0, None, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    def follows(self, a: int | None, b: int) -> bool:
        """Whether token b stands after token a in an encoding; None: at the start, where every token can.

        The merges that made the two tokens are undone, the latest first. If the two symbols at the border could have merged
        before the merge just undone, they did, and the two tokens never came to stand there. Equal merges go from the left.
        """
        if a is None:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            known, first, second, before = None, a, b, 1 << 60
            while known is None:
                merge = self.merges.get((first, second))
                if merge is not None and merge[0] < before:
                    known = False
                elif self.rank[first] < 0 and self.rank[second] < 0:
                    known = True
                elif self.rank[first] > self.rank[second]:
                    before, first = self.rank[first], self.parts[first][1]
                else:
                    before, second = self.rank[second] + 1, self.parts[second][0]
            self.pairs[a, b] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the change in the count. Of all tokens that end here, one alone can follow what is before it."""
        grown, last, change = [], None, 0
        for node, before, less in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            grown.append((child, before, less))
            token = self.token[child]
            if last is None and token is not None and self.follows(before, token):
                last, change = token, less + 1
        key = tuple((child, before, less - change) for child, before, less in grown if self.children[child]) + ((0, last, 0),)
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = to, change
        return to, change

    def piece(self, text: str) -> int:
        state = count = 0
        for byte in text.encode():
            move = self.moves[state].get(byte)
            state, change = move if move is not None else self._move(state, byte)
            count += change
        return count

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them without added special tokens; special strings in a text are one token each."""
        segments, owner, totals = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.special:
                if special in text:
                    parts = [y for x in parts for y in x.split(special)]
            totals[i] += len(parts) - 1
            segments += parts
            owner += [i] * len(parts)
        joined = "".join(f"{x}\x00" for x in segments)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        codes[ends] = _END_CHAR
        starts = piece_starts(codes, self.table).tolist()
        starts.append(len(codes))
        known, at = self.known, 0
        if len(known) > REMEMBERED or len(self.states) > REMEMBERED or len(self.pairs) > 4 * REMEMBERED:
            self.pairs = {}
            self._fresh()
            known = self.known
        for i, end in zip(owner, ends.tolist(), strict=True):
            total = 0
            while (a := starts[at]) < end:
                at += 1
                word = joined[a : starts[at]]
                n = known.get(word)
                if n is None:
                    n = self.piece(word)
                    if len(word) < 64:
                        known[word] = n
                total += n
            at += 1
            totals[i] += total
        return totals


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, table: np.ndarray | None = None) -> Counter:
    """The compiled tokenizer of this process; its transitions are kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, table)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the token count of each whole text under the byte-level BPE of the tokenizers JSON file at ``path``.

    Null or empty: 0. One Arrow pass, no shuffle; repeated rows count again; a column ``out`` is replaced.
    """

    shared = df.sparkSession.sparkContext.broadcast(classes())  # 1.1 MB

    def make():
        count = counter(path, shared.value).count
        return lambda batch: [pa.array(count(texts_of(batch, text)), pa.int64())]

    return append_columns(df, [T.StructField(out, T.LongType())], make, rows=1024)
