"""Personal data by weak supervision, in Spark's own functions: pattern, gazetteer and context labelers vote on spans,
expectation-maximisation estimates how reliable they are, and a classifier of spans is fitted to its posteriors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

#: The kinds with fixed base patterns, and all kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The fixed base patterns, written so that a match costs no more than its length: what can only be the middle of a run isn't
# tried as a start (unless a match ended there), and repeats that nothing follows give nothing back. The matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text can have a match at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}

# Wider forms than the base. They are only candidates, right ones and wrong ones: the classifier decides.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,6}(?:\.[0-9]{1,6}){3})(?![0-9A-Fa-f:]|\.[0-9])",
    "card": r"(?<![A-Z0-9a-z+])(?:[0-9](?:[ -]?[0-9]){11,18}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:00[1-9](?:[ ().-]?[0-9]){7,14}|\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4})(?![0-9A-Za-z-]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,60}[0-9])[A-Za-z0-9+/_=-]{16,}+",
}
LOOSE_HINT = {"email": r"[\(\[]at[\)\]]|@", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]|[A-Z]{2}[0-9]{2} ", "phone": r"[0-9]{3}", "secret": r"[0-9][A-Za-z0-9+/_=-]{4}|[A-Za-z0-9+/_=-]{4}[0-9]"}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Common top-level domains; country calling codes; country codes of bank account numbers; issuer prefixes of
# payment cards; prefixes and lengths of well-known keys and digests.
_DOMAINS = "com net org edu gov mil int info biz io ai app dev co me tv name pro de fr es uk it nl eu ch at be se no dk fi pl pt cz sk hu ro bg gr ie us ca mx br ar cl au nz jp cn kr in ru ua tr il za sg hk"
_CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 234 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 387 389 420 421 423 852 853 880 886 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998"
_ACCOUNTS = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK"
_ISSUERS = r"4(?:[ -]?[0-9]){12,18}|(?:5[1-5]|2[2-7])(?:[ -]?[0-9]){14}|3[47](?:[ -]?[0-9]){13}|(?:6011|65|64[4-9]|35)(?:[ -]?[0-9]){12,17}|3(?:0|6|8)(?:[ -]?[0-9]){12}"
_KEYS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]+|sk-[A-Za-z0-9_-]+|xox[abp]-[A-Za-z0-9-]+|AIza[A-Za-z0-9_-]+|eyJ[A-Za-z0-9_=-]+|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


#: Each labeler: what it looks at (the match, or the text before or after it), and for each kind the patterns of a vote for and
#: of a vote against; a labeler that finds neither abstains. ``check`` also runs the checksum of card numbers.
LABELERS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "form": ("m", {
        "email": (r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|[\(\[]at[\)\]])", r"^[._%+-]|\.\.|\s@|@\s"),
        "ip": (rf"^{_OCTET}(?:\.{_OCTET}){{3}}$|^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$", r"(?:^|\.)0[0-9]|(?:^|\.)[0-9]{4}|(?:^|\.)(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?:\.|$)"),
        "card": (r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{13,19}$|^[A-Z]{2}[0-9]{2} ", r"^(?=.*[ -])(?![0-9]{4}[ -][0-9]{4})|^[0-9]{12}$"),
        "phone": (r"^\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^00[1-9]", r"^[0-9]{4}-[0-9]{2}-|\.[0-9]+\.[0-9]+\.[0-9]+\.|\(\)"),
        "secret": (r"^[0-9a-f]{20,}$|^[0-9A-F]{20,}$|^(?=(?:[^0-9]*[0-9]){4})(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/_=-]{20,}$", r"^[0-9]+$|^[A-Za-z]+[-_]?[0-9]{1,3}$|/.*/|^[=_-]|--"),
    }),
    "list": ("m", {
        "email": (rf"(?i)(?:\.|dot\)|dot\]) ?{_any(_DOMAINS)}$", r"(?i)(?:\.|dot\)|dot\]) ?(?:[0-9-]+|[a-z]|[a-z]*[0-9-][a-z0-9-]*)$|@ ?[A-Za-z0-9-]+$"),
        "ip": (r"^(?:10|127)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?:[23][0-9A-Fa-f]{3}|[Ff][CDcd][0-9A-Fa-f]{2}|[Ff][Ee]80):", r"^0+\.|^(?:24[0-9]|25[0-5])\."),
        "card": (rf"^(?:{_ISSUERS})$|^{_any(_ACCOUNTS)}[0-9]{{2}} ", r"^[01789]"),
        "phone": (rf"^(?:\+|00){_any(_CALLING)}[ (.-]|^\(?[2-9][0-9]{{2}}\)?[ .-][2-9][0-9]{{2}}[ .-][0-9]{{4}}$|^\(?0[1-9]", r"^\+(?:0|21[0-1]|83|89)|^\(?1[0-9]{2}\)?[ .-]"),
        "secret": (rf"^(?:{_KEYS})$", r"(?i)^https?|^www|(?:19|20)[0-9]{2}[-_][01][0-9]|[aeiou][a-z]{2,}[aeiou][a-z]{2,}[aeiou]"),
    }),
    "before": ("before", {
        "email": (r"(?i)(?:e-?mail|contact|write|reach|mailto|correo|courriel|kontakt)[^\n]{0,24}$", r"(?i)(?:^|\s)(?:git|ssh|via|handle|twitter)\W{0,3}$"),
        "ip": (r"(?i)(?:\bip|address|host|server|client|login|from|adresse)[^\n]{0,24}$", r"(?i)(?:version|release|licen[cs]e|section|chapter|\bv|§)\W{0,3}$"),
        "card": (r"(?i)(?:card|visa|master|amex|credit|debit|account|iban|karte|carte|tarjeta)[^\n]{0,24}$", r"(?i)(?:isbn|issn|order|invoice|serial|tracking|doi|page|no\.?|nr\.?|\$|€|£)\W{0,3}$"),
        "phone": (r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)[^\n]{0,24}$", r"(?i)(?:isbn|issn|order|invoice|version|page|pp\.?|score|\$|€|£)\W{0,3}$"),
        "secret": (r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth\w*|bearer|credential)s?[\"']?\s?(?:=|:|\bis\b)?\s?[\"']?$", r"(?i)(?:https?:/{0,2}|www\.|id|sha(?:256|1)?|md5|commit|checksum|isbn|doi|/)\W{0,3}$"),
    }),
    "after": ("after", {
        "email": (r"^(?:[\s>)\],;]|[.!?](?:\s|$)|$)", r"^[A-Za-z0-9_:/@]"),
        "ip": (r"^(?::[0-9]{2,5}\b|/[0-9]{1,2}\b|[\s)\],;]|[.!?](?:\s|$)|$)", r"^(?:%|[A-Za-z_]|-[0-9A-Za-z])"),
        "card": (r"^(?:[\s)\],;]|[.!?](?:\s|$)|$)", r"^(?:%|[A-Za-z_@]|\.[0-9]|[ ]?(?:kg|km|usd|eur|bytes)\b)"),
        "phone": (r"^(?:[\s)\],;]|[.!?](?:\s|$)|$)", r"^(?:%|[A-Za-z_@]|\.[0-9]|[ ]?(?:kg|km|usd|eur|bytes)\b)"),
        "secret": (r"^[\"'`;]", r"^(?:\.[A-Za-z]|://|@)"),
    }),
    "check": ("m", {
        "email": (r"(?:\.|\)|\]) ?[A-Za-z]{2,}$", r"[0-9-]$|@ ?[^.]*$"),
        "ip": (rf"^{_OCTET}(?:\.{_OCTET}){{3}}$|:", r"^(?:[0-9]+\.)*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})(?:\.[0-9]+)*$"),
        "card": (r"^[A-Z]{2}[0-9]{2} ", r"^$"),
        "phone": (r"^(?:[^0-9]*[0-9]){8,15}[^0-9]*$", r"^(?:[^0-9]*[0-9]){0,7}[^0-9]*$|^(?:[^0-9]*[0-9]){16}"),
        "secret": (r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){2})", r"^[^0-9]*(?:[0-9][^0-9]*){1,3}$"),
    }),
    "shape": ("m", {k: (r"^(?!.*(.)\1{4})", r"(.)\1{5,}|0123456|1234567|abcdef") for k in KINDS}),
}
BEFORE, AFTER, THRESHOLD, ROUNDS = 40, 24, 0.9, 50
#: How often a labeler that votes is taken to be right before any span is seen: a checksum or a range says most, lists and context
#: much, form little.
RIGHT = {"form": 0.6, "list": 0.75, "before": 0.75, "after": 0.55, "check": 0.97, "shape": 0.52}
#: Labelers whose reliability is known and not estimated: a number that fails its checksum or range is wrong by definition, however
#: many such numbers there are.
ANCHORED = ("check",)
#: Spans of all kinds that speak along with those of one kind, whatever its size.
POOLED = 25.0
#: Matches of a chunk in which places are added up.
CHUNK = 256

_SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"


def _with(f, *bound):
    """f of one variable: Spark takes every parameter of a lambda for its own."""
    return lambda x: f(x, *bound)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(total, i):
        x = F.substring(d, i + 1, 1).cast("int") * (i % 2 + 1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda t, i: add(t, i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # More than three digits after leading zeros is over 255, whatever the number's size.
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)) <= 3, part(p)).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before, after) of all matches, in code points: what stands between matches tells where they are.

    Lengths are added up within chunks of CHUNK matches, then over chunks, so that a text of very many matches costs no square.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    spans = F.zip_with(found, F.arrays_zip(F.slice(between, F.lit(1), n).alias("b"), F.slice(between, F.lit(2), n).alias("a")), lambda m, x: F.struct(m.alias("m"), x["b"].alias("b"), F.substring(x["a"], 1, AFTER).alias("after")))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["b"], F.lit(BEFORE)).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(spans, k * CHUNK + 1, F.lit(CHUNK)), start, step))
    before = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
    )
    moved = F.zip_with(chunks, before, lambda c, at: F.transform(c["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))))
    return F.when(n > 0, F.flatten(moved)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    sign = text.contains(hint) if len(hint) == 1 else text.rlike(hint)
    return F.when(sign, _located(text, pattern)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _masked(text: Column, kind: str) -> Column:
    """The text with the valid base matches of a kind made into control characters: as long, and nothing matches in them."""
    found, between = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), F.split(text, BASE[kind], -1)
    hidden = F.transform(found, _with(lambda m, k: F.when(_valid(k, m), F.repeat(F.lit("\x01"), F.char_length(m))).otherwise(m), kind))
    return F.array_join(F.zip_with(between, hidden, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")


def spans_of(docs: DataFrame) -> DataFrame:
    """docs (text and others) with base_<kind> and loose_<kind>, arrays of (start, end, m, before, after), instead of the text.

    Loose spans are looked for where no base span is.
    """
    out = docs
    for kind in BASE_KINDS:
        base = _matches(F.col("text"), BASE[kind], HINT[kind])
        out = out.withColumn(f"base_{kind}", F.filter(base, _with(lambda x, k: _valid(k, x["m"]), kind)))
    out = out.withColumn("base_secret", F.array().cast(f"array<{_SPAN}>"))
    for kind in BASE_KINDS:
        out = out.withColumn("text", F.when(F.size(f"base_{kind}") > 0, _masked(F.col("text"), kind)).otherwise(F.col("text")))
    for kind in KINDS:
        out = out.withColumn(f"loose_{kind}", _matches(F.col("text"), LOOSE[kind], LOOSE_HINT[kind]))
    return out.drop("text")


def votes_on(x: Column, kind: str) -> list[Column]:
    """The labelers' votes on one span of a kind: 2 for, 1 against, 0 if it abstains."""
    out = []
    for name, (field, rules) in LABELERS.items():
        yes, no = (x[field].rlike(p) for p in rules[kind])
        if name == "check" and kind == "card":
            numeric = x["m"].rlike(r"^[0-9 -]+$")
            yes, no = yes | F.when(numeric, _luhn(x["m"])).otherwise(False), F.when(numeric, ~_luhn(x["m"])).otherwise(False)
        out.append(F.when(no, 1).when(yes, 2).otherwise(0).alias(name))
    return out


Patterns = list[tuple[tuple[int, ...], int]]


class Reliabilities:
    """Prior of a true span, and for each labeler the shares of its votes (abstain, against, for) on true and on false spans."""

    def __init__(self, prior: float, true: np.ndarray, false: np.ndarray):
        self.prior, self.true, self.false = prior, true, false

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.true[at, votes] / self.false[at, votes]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def first_guess() -> Reliabilities:
    """Reliabilities before any span is seen: three of ten votes abstain, the others are right as RIGHT says."""
    right = np.array([RIGHT[x] for x in LABELERS])
    rates = lambda yes: np.stack([np.full(len(right), 0.3), 0.7 * (1 - yes), 0.7 * yes], 1)
    return Reliabilities(0.5, rates(right), rates(1 - right))


def em(patterns: Patterns, pooled: Reliabilities | None = None, rounds: int = ROUNDS) -> Reliabilities:
    """The reliabilities that explain vote patterns (with their counts) best.

    ``pooled`` counts like POOLED further spans of its rates, and so does the first guess without it. ANCHORED labelers keep the
    rates of the first guess.
    """
    n = len(LABELERS)
    base, weight, fixed = pooled or first_guess(), POOLED, [list(LABELERS).index(x) for x in ANCHORED]
    if not patterns:
        return base
    votes, counts = np.array([v for v, _ in patterns]), np.array([c for _, c in patterns], float)
    model = base
    for _ in range(rounds):
        post = model.posterior(votes)
        shares = []
        for p, old in ((post * counts, base.true), ((1 - post) * counts, base.false)):
            rate = np.stack([np.bincount(votes[:, i], weights=p, minlength=3) for i in range(n)])
            new = (rate + weight * old) / (p.sum() + weight)
            new[fixed] = old[fixed]
            shares.append(new)
        prior = ((post * counts).sum() + weight * base.prior) / (counts.sum() + weight)
        model = Reliabilities(float(np.clip(prior, 0.001, 0.999)), *shares)
    return model


def features(votes: np.ndarray) -> np.ndarray:
    """A constant, each labeler's votes for and against, and pairs of votes for."""
    yes, no = (votes == 2).astype(float), (votes == 1).astype(float)
    pairs = [yes[:, i] * yes[:, j] for i in range(votes.shape[1]) for j in range(i)]
    return np.column_stack([np.ones(len(votes)), yes, no, *pairs])


def fit_classifier(patterns: Patterns, model: Reliabilities, steps: int = 500, rate: float = 1.0) -> np.ndarray:
    """Logistic regression on the votes, fitted to the posteriors that ``model`` gives; weighted by counts, with POOLED spans
    spread over all patterns so that it is told what the model says of patterns that never came."""
    n = len(LABELERS)
    drawn = np.random.default_rng(1).integers(0, 3, (400, n))
    votes = np.concatenate([np.array([v for v, _ in patterns], int).reshape(-1, n), drawn])
    counts = np.concatenate([np.array([c for _, c in patterns], float), np.full(len(drawn), POOLED / len(drawn))])
    x, target, share = features(votes), model.posterior(votes), counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        weights -= rate * (x.T @ ((p - target) * share) + 1e-4 * weights)
    return weights


def train(patterns: dict[str, Patterns]) -> dict[str, np.ndarray]:
    """The weights of each kind's classifier: reliabilities of all kinds together, then of each kind with those behind it."""
    every: dict[tuple[int, ...], int] = {}
    for rows in patterns.values():
        for v, c in rows:
            every[v] = every.get(v, 0) + c
    pooled = em(sorted(every.items()))
    return {k: fit_classifier(rows, em(rows, pooled)) for k, rows in patterns.items()}


def vote_table(spans: DataFrame) -> dict[str, Patterns]:
    """For each kind, the patterns of votes on all its spans, base and loose, and their counts: at most 3**6 rows a kind."""
    labelled = lambda x, k: F.struct(F.lit(k).alias("kind"), *votes_on(x, k))
    rows = spans.select(F.explode(F.concat(*[F.transform(F.concat(f"base_{k}", f"loose_{k}"), _with(labelled, k)) for k in KINDS])).alias("s")).select("s.*")
    out: dict[str, Patterns] = {k: [] for k in KINDS}
    for r in rows.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect():
        out[r["kind"]].append((tuple(r[x] for x in LABELERS), r["count"]))
    return out


def accepted(kind: str, weights: np.ndarray, threshold: float) -> Callable[[Column], Column]:
    """Whether the classifier gives a span of a kind ``threshold`` or more."""
    n = len(LABELERS)

    def test(x: Column) -> Column:
        votes = votes_on(x, kind)
        yes, no = [(v == 2).cast("double") for v in votes], [(v == 1).cast("double") for v in votes]
        terms = [*yes, *no, *(yes[i] * yes[j] for i in range(n) for j in range(i))]
        z = sum((F.lit(float(w)) * t for w, t in zip(weights[1:], terms, strict=True)), F.lit(float(weights[0])))
        return z >= float(np.log(threshold / (1 - threshold)))

    return test


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans, n_rejected): for each row the personal data in its whole text, an array of (kind, start, end, base) in code
    points, by kind as listed in KINDS and then start; and how many loose spans the classifier rejected.

    Base spans are all valid matches of the fixed patterns. Looser matches outside them, and secrets (keys and tokens, which have
    no base pattern), are added if the classifier gives ``threshold`` or more. All spans vote: the table of vote patterns has at
    most kinds * 3**6 rows, whatever the input, so it alone comes to the driver. One rule holds at every size. Null or empty
    text: no spans. Repeated rows come back repeated, an empty table gives an empty one. Other columns go.
    """
    base = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    spans = materialize(spans_of(base).select("doc_id", *[f"{form}_{k}" for k in KINDS for form in ("base", "loose")]))
    weights = train(vote_table(spans))

    def tagged(kind: str, form: Column | str, is_base: bool):
        return F.transform(form, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(is_base).alias("base")))

    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    none = F.array().cast("array<struct<start:int,end:int,yes:boolean>>")
    judged = lambda x, test: F.struct(x["start"].alias("start"), x["end"].alias("end"), test(x).alias("yes"))
    decided = {k: F.transform(f"loose_{k}", _with(judged, accepted(k, weights[k], threshold))) for k in KINDS}
    added = spans.withColumns({f"loose_{k}": F.when(F.size(f"loose_{k}") > 0, decided[k]).otherwise(none) for k in KINDS})
    parts = []
    for k in KINDS:
        loose = tagged(k, F.filter(f"loose_{k}", lambda x: x["yes"]), False)
        both = F.array_sort(F.concat(tagged(k, f"base_{k}", True), loose), by_start)
        parts.append(F.when(F.size(f"loose_{k}") > 0, both).otherwise(tagged(k, f"base_{k}", True)))
    rejected = sum((F.size(F.filter(f"loose_{k}", lambda x: ~x["yes"])) for k in KINDS), F.lit(0))
    return added.select("doc_id", F.concat(*parts).alias("spans"), rejected.cast("long").alias("n_rejected"))


def span_text(spans: Column) -> Column:
    """"kind:start:end", joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span that find() gives replaced by "[KIND]"; overlapping spans become one mark. Rows go by a number of
    their own, so repeated ids and rows each keep theirs. Null text stays null."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[col(c) for c in docs.columns]).alias("all")))
    found = find(numbered.select("row", F.col("all").getField(text).alias("text")), "row", "text", threshold)
    marks = found.select(F.col("doc_id").alias("row"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.upper(s["kind"]).alias("k")))).alias("marks"))
    joined = numbered.join(marks, "row")
    body = F.col("all").getField(text)

    def step(acc, x):
        apart = x["s"] >= acc["at"]
        piece = F.when(apart, F.concat(F.substring(body, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["k"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    new = F.when(F.size("marks") > 0, done).otherwise(body)
    return joined.select(*[new.alias(c) if c == text else F.col("all").getField(c).alias(c) for c in docs.columns])
