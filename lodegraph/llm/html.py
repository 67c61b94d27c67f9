"""Main text of web pages: markup zones, then host suffix arrays that find what pages of a host repeat."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, materialize, texts_of

#: Tokens of a repeated substring, at least, and different pages of a host that must hold it.
MIN_TOKENS, MIN_PAGES = 6, 3
#: A block of which this share is covered by repeated substrings is boilerplate.
COVERED = 0.8
#: Tokens that one suffix array holds at most; more of a host go to further arrays, whose pages are counted together.
ARRAY_TOKENS = 1 << 18
#: Pages of a batch.
PAGES = 64
#: Windows of all pages (4 bytes each) that may be broadcast to the pages; beyond it that join shuffles.
BROADCAST_WINDOWS = 1 << 22

#: In the article; outside it, or nowhere clear; marked weakly, for the host's repeats to decide; never the article.
MAIN, MAYBE, SOFT, OUT = "main", "maybe", "soft", "out"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# Elements that end a block, elements that never hold the article, void elements; words of class, id or role that
# mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments; those of them that hold inside an article
# too; words of layout that may stand beside a mark; words that turn the one after them round.
_BLOCKS = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_NEVER = frozenset("nav footer aside form head button menu dialog title fieldset label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars widget widgets related recommended share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments reply replies respond disqus form login register search copyright pager pagination skip complementary contentinfo dialog".split())
_MARKS_INSIDE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored comment comments reply replies respond disqus form login nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination".split())
_LAYOUT = frozenset("area bar block body bottom box btn button buttons container content footer form group header holder inner item items left links list main outer panel right row section site slot text thread title top unit wrap wrapper".split())
_NEGATIONS = frozenset("no not has have with without".split())


def _marked(attributes: str) -> tuple[int, bool]:
    """How class, id or role mark boilerplate (0 not at all, 1 beside words of their own, 2 clearly, 3 clearly and inside an
    article too), and whether they say that the article is here."""
    mark, main = 0, False
    for name, value in _ATTRIBUTE.findall(attributes):
        for token in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
            marks = {w for i, w in enumerate(words) if w in _MARKS and (not i or words[i - 1] not in _NEGATIONS)}
            if marks:
                clear = all(w in _MARKS or w in _LAYOUT or w.isdigit() for w in words)
                mark = max(mark, 1 if not clear else 3 if marks & _MARKS_INSIDE else 2)
            main |= name.lower() == "itemprop" and "".join(words) == "articlebody" or name.lower() == "role" and words == ["main"]
    return mark, main


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block with text, in page order.

    The zone is OUT inside what never holds the article, MAIN inside an article or main element, else MAYBE; inside an article
    only menus, forms, sidebars, adverts and comments are OUT. SOFT is what other marks speak of, such as notices in an article,
    or classes that hold a mark among words of their own ("related-work"). A page without article elements takes its main
    elements instead. Tags that aren't closed end with what holds them.
    """
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    zone = MAYBE
    articles = 0

    def flush():
        words = "".join(text).split()
        text.clear()
        if words:
            found.append((zone, " ".join(words)))

    def plain(s: str):
        if s:
            text.append(entities.unescape(s))

    at = 0
    page = page or ""
    for m in _TAG.finditer(page):
        plain(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                text.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        elif name in _VOID:
            text.append(" ")
        if name in _VOID:
            continue
        if m[2]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None and (name in _BLOCKS or not any(x in _BLOCKS for x, _ in stack[k:])):
                if name not in _BLOCKS and stack[k][1] != zone:
                    flush()
                zone = stack[k][1]
                del stack[k:]
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
            # These close an open one of their kind without a tag.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    zone = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCKS and stack[i][0] not in ("p",):
                    break
        mark, main = _marked(m[4] or "")
        inner = zone
        if name in ("article", "main") and zone == OUT and not any(x in ("article", "main") for x, _ in stack) and not any(z == OUT and x in ("aside", "footer", "form", "section", "div") for x, z in _entered(stack, zone)):
            zone = inner = MAYBE  # a menu or header that was never closed doesn't hold the article
        if zone != OUT:
            if name in ("html", "body"):
                inner = zone
            elif name in _NEVER or mark == 3 or (mark == 2 or name == "header") and zone not in (MAIN, "in main", SOFT):
                inner = OUT
            elif mark:
                inner = SOFT
            elif name == "article" or main:
                inner, articles = MAIN, articles + 1
            elif name == "main" and zone == MAYBE:
                inner = "in main"
        if inner != zone and name not in _BLOCKS:
            flush()
        stack.append((name, zone))
        zone = inner
    plain(page[at:])
    flush()
    other = {"in main": MAYBE} if articles else {"in main": MAIN}
    return [(other.get(z, z), t) for z, t in found]


def _entered(stack: list[tuple[str, str]], zone: str):
    """(element, zone inside it) of all that is open."""
    inside = [z for _, z in stack[1:]] + [zone]
    return [(name, z) for (name, _), z in zip(stack, inside, strict=True)]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by prefix doubling, and the common prefix of each with the one before."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - reach, 0)] = rank[reach:]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        fresh = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1 or reach >= n:
            break
        reach *= 2
    common, h = np.zeros(n, np.int64), 0
    where, seq = order.tolist(), tokens.tolist()
    for i, r in enumerate(rank.tolist()):
        if r:
            j = where[r - 1]
            while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
                h += 1
            common[r] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return order, common


def repeated_windows(streams: list[np.ndarray], n: int = MIN_TOKENS) -> list[tuple[int, int, int, int]]:
    """(stream, place, pages, first of its kind) for every n-token window: how many of the streams hold it.

    The streams are concatenated with a separator of its own after each, so that no common prefix runs across. Runs of the
    suffix array with common prefixes of n or more are the substrings that long; a position belongs to a repeated substring of
    n or more tokens if and only if such a window covers it, so the windows' union gives the longest substrings.
    """
    if not streams:
        return []
    size = sum(len(s) + 1 for s in streams)
    joined, owner, place = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size, np.int64)
    at = 0
    for k, s in enumerate(streams):
        joined[at : at + len(s)] = s
        joined[at + len(s)] = -1 - k
        owner[at : at + len(s) + 1], place[at : at + len(s) + 1] = k, np.arange(len(s) + 1)
        at += len(s) + 1
    lengths = np.array([len(s) for s in streams])
    order, common = suffix_array(joined)
    whole = place[order] + n <= lengths[owner[order]]
    group = np.cumsum(common < n)
    group, suffixes = group[whole], order[whole]
    if not len(group):
        return []
    pairs = np.unique(np.stack((group, owner[suffixes]), 1), axis=0)
    ids, pages = np.unique(pairs[:, 0], return_counts=True)
    first = np.unique(group, return_index=True)[1]
    kind = np.searchsorted(ids, group)
    return list(zip(owner[suffixes].tolist(), place[suffixes].tolist(), pages[kind].tolist(), suffixes[first][kind].tolist(), strict=True))


def covered_positions(size: int, windows: list[int], n: int = MIN_TOKENS) -> np.ndarray:
    """Which of ``size`` tokens the n-token windows at these places cover."""
    hit = np.zeros(size, bool)
    for at in windows:
        hit[at : at + n] = True
    return hit


def _tokens(blocks: list[str]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the blocks' words, in page order, and where each block ends."""
    from xxhash import xxh64_intdigest

    out, ends = [], []
    for b in blocks:
        out += [xxh64_intdigest(w.encode(), 0) >> 2 for w in b.lower().split(" ")]
        ends.append(len(out))
    return np.array(out, np.int64), ends


def _word_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode(), 1) - (1 << 63)


def _hash(window: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(window.tobytes(), 0) - (1 << 63)


def parse(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, row_key, sketch, blocks) of every page; blocks: array of (zone, text), sketch: a hash of the longest one."""
    kind = T.ArrayType(T.StructType([T.StructField("zone", T.StringType()), T.StructField("text", T.StringType())]))
    base = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), col(html).alias("html"))

    def make():
        arrow = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))

        def step(batch):
            found = [blocks_of(x) for x in texts_of(batch, "html")]
            longest = [max((t for _, t in blocks), key=len, default="") for blocks in found]
            return [pa.array([[{"zone": z, "text": t} for z, t in blocks] for blocks in found], arrow), pa.array([_word_hash(x) for x in longest], pa.int64())]

        return step

    fields = [T.StructField("blocks", kind), T.StructField("sketch", T.LongType())]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return append_columns(base, fields, make, PAGES).select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("row_key"), "sketch", "blocks")


def host_boilerplate(parsed: DataFrame, n: int = MIN_TOKENS, least: int = MIN_PAGES) -> DataFrame:
    """(host, gram): n-token windows that ``least`` different pages of a host hold outside their articles, whatever the host's size.

    Pages are sorted by host within their partitions; a task builds a suffix array over the pages of one host at a time, at
    most ARRAY_TOKENS tokens in each, and passes on each distinct window once for each of up to ``least`` different pages. A hot
    host is thus many arrays in many tasks; its pages meet in one count by host and window. Copies of a page, known by their
    longest block, are one page: what only copies share stays.
    """

    def run(batches):
        held, sketches, here, size = [], [], None, 0

        def counted():
            seen: dict[int, tuple[int, set[int]]] = {}
            for k, at, _, kind in repeated_windows(held, n):
                if kind not in seen:
                    seen[kind] = _hash(held[k][at : at + n]), set()
                if len(seen[kind][1]) < least:
                    seen[kind][1].add(sketches[k])
            return [(here, gram, x) for gram, pages in seen.values() for x in pages]

        for batch in batches:
            out = []
            for host, blocks, sketch in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                stream = _tokens(blocks)[0]
                if host != here or size + len(stream) > ARRAY_TOKENS:
                    out += counted()
                    held, sketches, here, size = [], [], host, 0
                held.append(stream)
                sketches.append(sketch)
                size += len(stream) + 1
            if out:
                yield _grams(out)
        if held:
            yield _grams(counted())

    loose = parsed.select("host", F.transform(F.filter("blocks", lambda b: b.zone != MAIN), lambda b: b.text).alias("texts"), "sketch").where(F.size("texts") > 0)
    pages = loose.sortWithinPartitions("host").mapInArrow(run, "host string, gram long, page long").distinct()
    return pages.groupBy("host", "gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("host", "gram")


def _grams(rows) -> pa.RecordBatch:
    host, gram, page = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(gram, pa.int64()), pa.array(page, pa.int64())], names=["host", "gram", "page"])


def decide(blocks: list[tuple[str, str]], places: list[int], n: int = MIN_TOKENS) -> tuple[str, list[str], int, int, int]:
    """The text that stays of a page, its unique runs, and how many characters repeats dropped, markup dropped, and both left.

    ``places``: where repeated windows start among the tokens of all blocks that aren't MAIN. A block they cover by COVERED or
    more is boilerplate. Of what repeats leave, OUT blocks go by their markup; all else stays.
    """
    stream, ends = _tokens([t for z, t in blocks if z != MAIN])
    hit = covered_positions(len(stream), places, n)
    kept, runs, k, start, by_repeats, by_markup = [], [], 0, 0, 0, 0
    for zone, text in blocks:
        if zone == MAIN:
            kept.append(text)
            continue
        here = hit[start : ends[k]]
        start, k = ends[k], k + 1
        if here.mean() >= COVERED:
            by_repeats += len(text)
        elif zone == OUT:
            by_markup += len(text)
        else:
            kept.append(text)
        if zone != OUT:
            runs.append(" ".join(w for w, x in zip(text.split(" "), here, strict=True) if not x))
    return "\n".join(kept), [x for x in runs if x], by_repeats, by_markup, sum(map(len, kept))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", n: int = MIN_TOKENS, least: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, runs, by_repeats, by_markup, kept): the main text of each page, the unique runs of its blocks outside the
    article, and the characters that repeats dropped, that markup dropped, and that stay.

    All that isn't plainly in an article goes through the host's suffix arrays: a block that substrings of ``n`` or more tokens,
    held by ``least`` different pages of the host, cover by COVERED or more is boilerplate. Only what is left of menus, headers,
    footers, forms, adverts, comments and the like (on hosts of few pages, or unlike everywhere) goes by its markup. Weak marks
    drop nothing without repeats, and unmarked blocks of an article always stay. Text: the kept blocks in page order, joined by
    newlines, white space in a block being one blank; "" if there are none. Null or empty html: "". A page without a host shares
    its boilerplate with all such pages. Repeated rows come back repeated; other columns go. An empty table gives an empty one.
    """
    parsed = materialize(parse(pages, page_id, url, html))
    common = host_boilerplate(parsed, n, least)
    fields = [T.StructField("grams", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("gram", T.LongType())])))]

    def windows():
        def step(batch):
            out = []
            for blocks in batch.column(batch.schema.get_field_index("blocks")).to_pylist():
                stream = _tokens([b["text"] for b in blocks if b["zone"] != MAIN])[0]
                out.append([{"at": at, "gram": _hash(stream[at : at + n])} for at in range(len(stream) - n + 1)])
            return [pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())])))]

        return step

    # A window's hot key is asked for once by each place that holds it, which adaptive execution splits.
    asked = append_columns(parsed.select("row_key", "host", "blocks"), fields, windows, PAGES).select("row_key", "host", F.explode("grams").alias("g")).select("row_key", "host", "g.at", "g.gram")
    covered = materialize(asked.join(common, ["host", "gram"]).groupBy("row_key").agg(F.sort_array(F.collect_set("at")).alias("covered")))
    windows_held = covered.agg(F.sum(F.size("covered"))).first()[0] or 0
    decided = parsed.join(F.broadcast(covered) if windows_held <= BROADCAST_WINDOWS else covered, "row_key", "left")

    def make():
        def step(batch):
            names = batch.schema.names
            blocks, places = (batch.column(names.index(x)).to_pylist() for x in ("blocks", "covered"))
            rows = [decide([(b["zone"], b["text"]) for b in x], y or [], n) for x, y in zip(blocks, places, strict=True)]
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64())
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return step

    out = [T.StructField("text", T.StringType()), T.StructField("runs", T.ArrayType(T.StringType())), *[T.StructField(x, T.LongType()) for x in ("by_repeats", "by_markup", "kept")]]
    return append_columns(decided, out, make, PAGES).select("page_id", "url", "text", "runs", "by_repeats", "by_markup", "kept")
