"""Language identification by a byte convolutional network: filters of several widths, max pooling, softmax, all in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
EMBED = 8
#: Bounds of the training sample: windows a language, bytes of a text they are cut from.
SAMPLE_PER_LANGUAGE = 900
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The whole text's bytes in rows of ``size``: the last row is padded with zeros, which are no text's bytes but NUL's."""
    data = np.frombuffer(text.encode(), np.uint8)
    rows = -(-len(data) // size)
    out = np.zeros((rows, size), np.uint8)
    out.ravel()[: len(data)] = data
    return out


class ByteCNN:
    """Byte embedding, then for each width filters with ReLU and max over the window, then one softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.languages, self._tables = languages, None
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (n, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _unrolled(self, x: np.ndarray, w: int) -> np.ndarray:
        n, size = x.shape[0], x.shape[1]
        view = np.lib.stride_tricks.as_strided(x, (size - w + 1, n, w * EMBED), (x.strides[1], x.strides[0], x.strides[2]))
        return np.ascontiguousarray(view).reshape(-1, w * EMBED)

    def forward(self, bytes_: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = np.ascontiguousarray(self.p["emb"][bytes_])
        pooled = []
        for w in WIDTHS:
            cols = self._unrolled(x, w)
            act = (cols @ self.p[f"w{w}"]).reshape(-1, len(bytes_), FILTERS)
            best = act.max(0) + self.p[f"b{w}"]
            pooled.append(np.maximum(best, 0))
            if keep is not None:
                keep[w] = act.argmax(0), best
        h = np.concatenate(pooled, 1)
        logits = h @ self.p["out"] + self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        if keep is not None:
            keep["h"], keep["x"] = h, x
        return e / e.sum(1, keepdims=True)

    def train(self, data: np.ndarray, labels: np.ndarray, epochs: int = 3, batch: int = 48, rate: float = 0.005, seed: int = 11) -> ByteCNN:
        """Adam on the cross entropy. The order is drawn from ``seed``, so equal rows give equal weights."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                grads = self._gradients(data[rows], labels[rows])
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        d = self.forward(bytes_, keep)
        n = len(bytes_)
        d[np.arange(n), labels] -= 1
        d /= n
        grads = {"out": keep["h"].T @ d, "bias": d.sum(0)}
        dh = d @ self.p["out"].T
        dx = np.zeros_like(keep["x"])
        for k, w in enumerate(WIDTHS):
            at, best = keep[w]
            g = dh[:, k * FILTERS : (k + 1) * FILTERS] * (best > 0)
            grads[f"b{w}"] = g.sum(0)
            # Only the place of the maximum has a gradient: rows x filters x (w * EMBED) of input.
            place = at[:, :, None] + np.arange(w)
            seen = keep["x"][np.arange(n)[:, None, None], place].reshape(n, FILTERS, -1)
            grads[f"w{w}"] = np.einsum("nfe,nf->ef", seen, g)
            back = (g[:, :, None] * self.p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(dx, (np.arange(n)[:, None, None], place), back)
        demb = np.zeros_like(self.p["emb"])
        np.add.at(demb, bytes_.ravel(), dx.reshape(-1, EMBED))
        grads["emb"] = demb
        return grads

    def tables(self) -> dict[int, list[np.ndarray]]:
        """The filters' shares by byte pair (or byte, for the last of an odd width): with them a response is a few sums."""
        emb, out = self.p["emb"], {}
        for w in WIDTHS:
            share = [emb @ self.p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            out[w] = [(share[k][:, None] + share[k + 1][None]).reshape(-1, FILTERS) if k + 1 < w else share[k] for k in range(0, w, 2)]
        return out

    def apply(self, bytes_: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """What forward() gives, by table. Positions come first, so the maximum runs over whole blocks."""
        single = np.ascontiguousarray(bytes_.T).astype(np.int32)
        pair = single[:-1] * 256 + single[1:]
        pooled = []
        for w in WIDTHS:
            n = len(single) - w + 1
            act = None
            for k, t in enumerate(tables[w]):
                at = pair[2 * k : 2 * k + n] if 2 * k + 1 < w else single[2 * k : 2 * k + n]
                part = t.take(at.ravel(), axis=0, mode="clip")
                act = part if act is None else np.add(act, part, out=act)
            pooled.append(np.maximum(act.reshape(n, -1).max(0).reshape(-1, FILTERS) + self.p[f"b{w}"], 0))
        logits = np.concatenate(pooled, 1) @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str], rows: int = 128) -> list[tuple[str, float]]:
        """Language and probability of each text: the mean of its windows' log probabilities, by their bytes, made a softmax again."""
        cut = [windows(x) if _LETTER.search(x) else np.zeros((0, WINDOW), np.uint8) for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        every = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8)
        if self._tables is None:
            self._tables = self.tables()
        tables = self._tables
        sums, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(every), rows):
            part = every[at : at + rows]
            bytes_in = (part != 0).sum(1).astype(float)
            np.add.at(sums, owner[at : at + rows], np.log(self.apply(part, tables) + 1e-6) * bytes_in[:, None])
            np.add.at(weight, owner[at : at + rows], bytes_in)
        out = []
        for s, w in zip(sums, weight, strict=True):
            if not w:
                out.append((UNKNOWN, 0.0))
                continue
            e = np.exp(s / w - (s / w).max())
            out.append((self.languages[int(e.argmax())], float(e.max() / e.sum())))
        return out


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _smallest(pieces: DataFrame, most: int) -> dict[str, list]:
    """Of each language's (lang, h, piece) the ``most`` with the smallest hashes, in order of hash.

    The count of a language says under which hash about twice as many lie; only those are fetched, so no task ranks a language.
    Where equal rows leave too few under it, the share is raised until there are enough or all are there.
    """
    counts = {r["lang"]: r["count"] for r in pieces.groupBy("lang").count().collect()}
    share, found = {x: min(1.0, 2 * most / n) for x, n in counts.items()}, []
    while share:
        limit = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int((2 * s - 1) * (1 << 63)) if s < 1 else (1 << 63) - 1)) for x, s in share.items()])
        got = pieces.where(F.col("lang").isin(list(share)) & (F.col("h") <= limit)).distinct().select("lang", "h", "piece").toArrow().to_pylist()
        kept = {x: sorted((r["h"], r["piece"]) for r in got if r["lang"] == x) for x in share}
        found += [(h, p, x) for x, rows in kept.items() if len(rows) >= most or share[x] >= 1 for h, p in rows[:most]]
        share = {x: min(1.0, 4 * s) for x, s in share.items() if len(kept[x]) < most and s < 1}
    found.sort()
    return {"h": [r[0] for r in found], "piece": [r[1] for r in found], "lang": [r[2] for r in found]}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, unclear: bool = False) -> ByteCNN | None:
    """The network, trained on at most ``per_language`` windows of each language from labelled documents that aren't held out.

    A document gives one piece from a place that a hash of its id sets anywhere in the text; of these, those with the smallest
    hashes are taken. That bound keeps the driver's share constant; everything is predicted from whole texts.
    Equal rows count once. None if there is no labelled text. With ``unclear``, the network also learns "und" from letter
    junk made of the sample.
    """
    labelled = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - WINDOW, F.lit(1))).cast("int") + 1
    piece = labelled.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.substring("text", start, F.lit(WINDOW)).alias("piece"))
    rows = _smallest(piece, per_language)
    names = sorted(set(rows["lang"]))
    if not names:
        return None
    data = np.zeros((len(rows["h"]), WINDOW), np.uint8)
    for i, x in enumerate(rows["piece"]):
        raw = np.frombuffer(x.encode()[:WINDOW], np.uint8)
        data[i, : len(raw)] = raw
    number = {x: i for i, x in enumerate(names)}
    labels = np.array([number[x] for x in rows["lang"]])
    # Short texts too: a third of the pieces are cut to lengths drawn from a fixed seed.
    rng = np.random.default_rng(3)
    short = rng.random(len(data)) < 0.33
    length = rng.integers(12, WINDOW, len(data))
    data[short[:, None] & (np.arange(WINDOW)[None, :] >= length[:, None])] = 0
    # Every language weighs alike: rare ones are repeated.
    counts = np.bincount(labels, minlength=len(names))
    rows_of = [np.flatnonzero(labels == i) for i in range(len(names))]
    balanced = np.concatenate([np.resize(r, counts.max()) for r in rows_of])
    if unclear:
        junk = _junk(rows["piece"], counts.max())
        names = [*names, UNKNOWN]
        data, labels = np.concatenate((data[balanced], junk)), np.concatenate((labels[balanced], np.full(len(junk), len(names) - 1)))
        return ByteCNN(names).train(data, labels)
    return ByteCNN(names).train(data[balanced], labels[balanced])


def _junk(pieces: list[str], n: int) -> np.ndarray:
    """``n`` windows of letters in no language: pieces with their characters shuffled, random Latin letters, and letters of other
    scripts drawn at random, of lengths from a fixed seed."""
    rng = np.random.default_rng(5)
    scripts = [(0x41, 0x5A), (0x61, 0x7A), (0x61, 0x7A), (0xC0, 0x24F), (0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    out = np.zeros((n, WINDOW), np.uint8)
    for i in range(n):
        if i % 3 == 0:
            chars = list(pieces[int(rng.integers(len(pieces)))])
            rng.shuffle(chars)
        else:
            low, high = scripts[int(rng.integers(1, 3))] if i % 3 == 1 else scripts[int(rng.integers(len(scripts)))]
            chars = [" " if rng.random() < 0.15 else chr(int(c)) for c in rng.integers(low, high + 1, WINDOW)]
        raw = np.frombuffer("".join(chars).encode()[: WINDOW if rng.random() < 0.67 else int(rng.integers(12, WINDOW))], np.uint8)
        out[i, : len(raw)] = raw
    return out


def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. Null text, text without letters (\\p{L}), or no model: "und" with score 0. Columns so named are
    replaced. Languages of equal probability: the first in their order. Repeated rows come back repeated, an empty table empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = shared.value

        def step(batch):
            texts = texts_of(batch, text)
            found = net.predict(texts) if net else [(UNKNOWN, 0.0)] * len(texts)
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return step

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score of a network fitted on the same table's labelled rows that aren't held out."""
    return predict(docs, fit(docs, doc_id, text, lang), text).withColumn("held_out", held_out(col(doc_id)))


def keep_known(docs: DataFrame, min_score: float = 0.2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs whose language is found; what has no letters, or no clear language, goes.

    The network knows letter junk as a class of its own, and what it takes for that goes. A score must also be ``min_score``
    of the way from chance (one over the number of classes) to 1, so that it can be missed whatever the number of languages.
    """
    model = fit(docs, doc_id, text, lang, unclear=True)
    chance = 1 / len(model.languages) if model else 0.0
    clear = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= chance + min_score * (1 - chance))
    return predict(docs, model, text).where(clear).select(*[col(c) for c in docs.columns])
