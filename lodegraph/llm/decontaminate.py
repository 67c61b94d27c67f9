"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of document windows, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, materialize, texts_of

#: Bytes of benchmark text of a broadcast block, about, and bytes of its index, at most: a block whose measured index is larger is
#: split again. A larger benchmark is scanned in several blocks.
BLOCK_BYTES, INDEX_BYTES = 16 << 20, 192 << 20
#: Blocks that documents pass in one stage.
STAGE_BLOCKS = 4
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z become a-z; bytes of words stay, all others are blanks. Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_TABLE = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _chunks(data: bytes, size: int = 1 << 20):
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Vocabulary(dict):
    """Word numbers from 1; a word that no item has is 0 and isn't kept."""

    def __missing__(self, word):
        return 0


class Index:
    """The n-gram windows of some items in flat arrays: by length, the sorted hashes of distinct windows, where each stands in the
    items' words, and which items have it."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.vocabulary, self.items, words, at = Vocabulary(), [], [], 0
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)), np.int32)
            size = min(n, len(ids))
            if not size:
                continue
            hashes = self.rolling(ids.astype(np.uint64), size)
            # An item's repeated windows stand once.
            first = np.unique(np.lib.stride_tricks.sliding_window_view(ids, size), axis=0, return_index=True)[1]
            parts.setdefault(size, []).append((hashes[first], (first + at).astype(np.int64), np.full(len(first), len(self.items), np.int32)))
            self.items.append(item)
            words.append(ids)
            at += len(ids)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.lengths = {}
        for size, found in parts.items():
            hashes, places, owners = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, places, owners = hashes[order], places[order], owners[order]
            fresh = np.ones(len(hashes), bool)
            for k in range(0, len(hashes) - 1, 1 << 16):
                a, b = places[k : k + (1 << 16) + 1][:-1], places[k + 1 : k + (1 << 16) + 1]
                alike = hashes[k : k + len(b)] == hashes[k + 1 : k + 1 + len(b)]
                for j in range(size):
                    alike &= self.words[a[: len(b)] + j] == self.words[b + j]
                fresh[k + 1 : k + 1 + len(b)] = ~alike
            start = np.flatnonzero(fresh)
            self.lengths[size] = hashes[start], places[start], np.append(start, len(hashes)), owners

    def nbytes(self) -> int:
        """Bytes of the arrays and, about, of the vocabulary."""
        return self.words.nbytes + sum(x.nbytes for arrays in self.lengths.values() for x in arrays) + sum(len(w) + 130 for w in self.vocabulary)

    @staticmethod
    def rolling(ids: np.ndarray, n: int) -> np.ndarray:
        size = len(ids) - n + 1
        h = np.zeros(max(size, 0), np.uint64)
        for j in range(n if size > 0 else 0):
            h *= _PRIME
            h += ids[j : j + size]
        return h

    def scan(self, text: str | None) -> tuple[np.ndarray, set]:
        """For each word of a text, whether a window of an item covers it; the items found."""
        parts = [np.fromiter(map(self.vocabulary.__getitem__, w), np.int64, len(w)) for w in _chunks((text or "").encode().translate(_TABLE))]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hit, items = np.zeros(len(ids), bool), set()
        unsigned = ids.astype(np.uint64)
        for n, (hashes, places, start, owners) in self.lengths.items():
            h = self.rolling(unsigned, n)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == h).tolist():
                k = int(at[i])
                while k < len(hashes) and hashes[k] == h[i]:
                    if np.array_equal(self.words[places[k] : places[k] + n], ids[i : i + n]):
                        hit[i : i + n] = True
                        items.update(self.items[x] for x in owners[start[k] : start[k + 1]].tolist())
                    k += 1
        return hit, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_mask (a bit for each word, most significant first) and hit_items (sorted).

    The benchmark is collected in blocks of about ``block_bytes`` of text, as many as its measured size asks for; a block whose
    index comes out above ``index_bytes`` is split in two. Documents pass STAGE_BLOCKS blocks in a stage, after which they are written; masks and
    items of the blocks are united. Only equal items of the benchmark are shuffled, to count once.
    Null or empty text: no words, no hits. Items without words match nothing; items shorter than n words are one window.
    Items that share an id count once; an item whose id is null matches, but isn't listed. Columns with these names are replaced.
    """
    named = benchmark.select(col(item_id).alias("item"), col(item_text).alias("body")).where("body is not null").distinct()
    size = named.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    id_type = dict((f.name, f.dataType) for f in named.schema.fields)["item"]
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_mask", T.BinaryType()), T.StructField("hit_items", T.ArrayType(id_type))]
    out, sc, done = docs.drop(*[f.name for f in fields]), docs.sparkSession.sparkContext, 0
    waiting = [(blocks, k) for k in reversed(range(blocks))]
    while waiting:
        of, k = waiting.pop()
        part = named if of == 1 else named.where(F.pmod(F.xxhash64("item", "body"), F.lit(of)) == k)
        items = [tuple(r) for r in part.toLocalIterator()]
        index = Index(items, n)
        if index.nbytes() > index_bytes and len(items) > 1:
            waiting += [(2 * of, k + of), (2 * of, k)]
            continue
        # Each block has a worker of its own in every task; what some blocks found is written before the next ones.
        if done and done % STAGE_BLOCKS == 0:
            out = materialize(out)
        out = _scan_block(out, sc.broadcast(index), fields, text, id_type, not done)
        done += 1
    return out


def _free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it needs to be none of df's."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _scan_block(docs: DataFrame, shared, fields, text: str, id_type, first: bool) -> DataFrame:
    mask, items = (_free(docs, f"old_{x}") for x in ("mask", "items"))
    previous = docs if first else docs.withColumnsRenamed({"hit_mask": mask, "hit_items": items}).drop("n_words", "n_hit")

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        index, kind = shared.value, to_arrow_type(id_type)

        def step(batch):
            rows = []
            old = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (mask, items)]
            for i, body in enumerate(texts_of(batch, text)):
                hit, found = index.scan(body)
                found.discard(None)
                if old:
                    hit |= np.unpackbits(np.frombuffer(old[0][i], np.uint8))[: len(hit)].astype(bool)
                    found |= set(old[1][i])
                rows.append((len(hit), int(hit.sum()), np.packbits(hit).tobytes(), sorted(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(kind)), strict=True)]

        return step

    out = append_columns(previous, fields, make)
    return out if first else out.drop(mask, items)


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Scanned documents without the words that are hit; what stands between two hit words goes too."""

    def make():
        import re

        word = re.compile(rb"[0-9a-z\x80-\xff]+")

        def step(batch):
            masks = batch.column(batch.schema.get_field_index("hit_mask")).to_pylist()
            out = []
            for body, raw, mask in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), texts_of(batch, text), masks, strict=True):
                if body is None or not any(mask or b""):
                    out.append(body)
                    continue
                data, kept, at, inside = raw.encode(), [], 0, False
                hit = np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
                for i, m in enumerate(word.finditer(data.lower())):
                    if hit[i]:
                        if not inside:
                            kept.append(data[at : m.start()])
                        at, inside = m.end(), True
                    elif inside:
                        inside = False
                kept.append(data[at:])
                out.append(b"".join(kept).decode(errors="replace"))
            return [pa.array(out, pa.string())]

        return step

    order = scanned.columns
    old = _free(scanned, "old_text")
    renamed = lambda step: lambda batch: step(batch.rename_columns([text if c == old else c for c in batch.schema.names]))
    return append_columns(scanned.withColumnRenamed(text, old), [T.StructField(text, T.StringType())], lambda: renamed(make())).select(*[col(c) for c in order])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (mode "spans") without the contaminated spans of their texts.

    All columns stay, whatever their names.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    text = options.pop("text", "text")
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text).alias("text"))
    found = scan(packed, benchmark, **options)
    found = found.where("n_hit = 0") if mode == "documents" else remove_spans(found)
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
