"""Projection, predicates and scalar derivation (P1-P22, scalar functions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null, empty or only white space: text that came back as "" is null."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def clean_text(c: Column) -> Column:
    """Trimmed, "" being null; the text "nan" stays what it is."""
    return F.nullif(F.trim(c), F.lit(""))


def first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds (P6, P7); a null condition doesn't."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def orient(x_type: str, kind: str, x: str, y: str) -> tuple[Column, Column]:
    """(the end of the kind, the other end) row by row."""
    is_x = F.col(x_type) == kind
    return F.when(is_x, F.col(x)).otherwise(F.col(y)), F.when(is_x, F.col(y)).otherwise(F.col(x))


def label_map(c: Column, labels: dict[str, str]) -> Column:
    """Mapped labels, others kept."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], c)


def bare_id(c: Column, prefix: str) -> Column:
    """A CURIE's number as text without leading zeros: MONDO:0002816 is 2816; null if it isn't one."""
    digits = F.regexp_extract(c, f"^{prefix}[:_]0*([0-9]+)$", 1)
    return F.nullif(digits, F.lit(""))


def numeric_id(*columns: Column) -> Column:
    """The first that isn't null as a number, null if it is none."""
    return F.coalesce(*columns).try_cast("bigint")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def token_count(c: Column, sep: str = "+") -> Column:
    """Members of a joined set: separators plus one; null for null."""
    return (F.regexp_count(c, F.lit(f"\\{sep}")) + 1).cast("long")


def top_by_magnitude(c: Column, n: int = 2) -> Column:
    """The n entries of a JSON object of numbers with the largest absolute values, ties by name, as array<(name, value)> (E28). Invalid or empty: no entries."""
    parsed = F.map_entries(F.coalesce(F.from_json(c, "map<string,double>"), F.from_json(F.lit("{}"), "map<string,double>")))
    kept = F.filter(parsed, lambda e: e["value"].isNotNull())
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("name"), e["value"].alias("value"))))
    return F.slice(F.transform(ordered, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))), 1, n)


def capped_list(values: Column, cap: int = 5, sep: str = "; ") -> Column:
    """The first ``cap`` values in order, and how many more there are. Null stays null: never assessed isn't none."""
    ordered = F.array_sort(F.array_distinct(values))
    more = F.size(ordered) - cap
    return F.when(values.isNotNull(), F.concat(F.array_join(F.slice(ordered, 1, cap), sep), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")))


def row_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint): an order-independent hash of all rows: the first 60 bits of each row's SHA-256, joined by exclusive or.

    A row is its columns in the given order as text, joined by "|"; whoever has doubles rounds them to whole numbers first.
    """
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("fingerprint"))


def month_path(at: Column) -> Column:
    """The folder of a month, "2026/01"."""
    return F.date_format(at, "yyyy/MM")


def normalise_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quote stands verbatim in a text, but for case and white space."""
    return F.lower(normalise_space(text)).contains(F.lower(normalise_space(quote)))


def alias_pattern(alias: str) -> str:
    """A pattern for an alias as a token of its own: no letter, digit or hyphen beside it."""
    import re

    return rf"(?<![A-Za-z0-9-]){re.escape(alias)}(?![A-Za-z0-9-])"


def mention_windows(text: str, alias: str, reach: int = 120) -> Column:
    """array<string>: the merged windows of ``reach`` characters around each mention; none for null.

    Mentions cut the text into pieces, so their places are sums of lengths. A fold over the pieces carries one open window,
    which a mention either widens or closes.
    """
    t, length = F.col(text), len(alias)
    pieces = F.split(t, alias_pattern(alias), -1)
    before = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.length)
    window = "struct<a:int,b:int>"
    start = F.struct(F.lit(0).alias("at"), F.length(t).alias("n"), F.lit(None).cast(window).alias("open"), F.array().cast(f"array<{window}>").alias("closed"))

    def step(s, gap):
        a, b = F.greatest(s["at"] + gap - reach, F.lit(0)), F.least(s["at"] + gap + length + reach, s["n"])
        new = F.struct(a.alias("a"), b.alias("b"))
        touches = s["open"].isNotNull() & (a <= s["open"]["b"])
        wider = F.struct(s["open"]["a"].alias("a"), b.alias("b"))
        closed = F.when(s["open"].isNull() | touches, s["closed"]).otherwise(F.concat(s["closed"], F.array(s["open"])))
        return F.struct((s["at"] + gap + length).alias("at"), s["n"].alias("n"), F.when(touches, wider).otherwise(new).alias("open"), closed.alias("closed"))

    spans = F.aggregate(before, start, step, lambda s: F.when(s["open"].isNull(), s["closed"]).otherwise(F.concat(s["closed"], F.array(s["open"]))))
    return F.coalesce(F.transform(spans, lambda w: F.substring(t, w["a"] + 1, w["b"] - w["a"])), F.array().cast("array<string>"))


#: A string of a JSON text, with the colon after it if it is a name. No step of the pattern goes back.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def json_leaves(column: str) -> Column:
    """array<string>: the text leaves of a JSON document in its order, at any depth; none if it isn't valid.

    Strings of a valid document are its leaves and its names, and only names have a colon after them.
    """
    c = F.col(column)
    strings = F.filter(F.regexp_extract_all(c, F.lit(_JSON_STRING), F.lit(0)), lambda s: s.endswith('"'))
    leaves = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(c).isNotNull(), leaves).otherwise(F.array().cast("array<string>"))
