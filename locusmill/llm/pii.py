"""Personal data by candidate gradient boosting, as DataFrame expressions only.

Base kinds (e-mail, IPv4, card, phone) follow fixed patterns.  Beyond them, high-recall generators
propose possibly overlapping spans - assigned or bare secrets, grouped identity numbers, bare phone
numbers, spelled-out addresses - and gradient-boosted trees over format and context features score
each; a threshold calibrated on held-out examples selects what is marked.  The trees are trained in
numpy on generated examples whose features come from the same Spark expressions that run on the
corpus, then compiled into CASE expressions: no Python touches a document.

Spans are found by marking every match with a private-use character, splitting at the marks and
adding up lengths, which gives the positions of leftmost non-overlapping matches in code points.

Edge cases: null and empty texts have no spans; a text's own mark characters are replaced by a line
break for the search, which matches nothing and keeps positions; repeated rows are searched row by
row; an empty table gives an empty result; extra columns are ignored, whatever their names.  Texts of
any length and with any number of matches are searched whole; spans that start together are listed in
the order of their kinds.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import compile_trees, train_trees, tree_values

MARK = "\ue000"
# fixed values: kinds and their patterns.  Possessive quantifiers and the start conditions keep the
# search linear; they accept the same leftmost matches as the plain patterns.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(PATTERNS)
GENERATORS = {
    "secret": r"(?i)(?<![a-z])(?:api[_-]?key|token|secret|password|passwd|pwd)\s{0,3}+[=:]\s{0,3}+[\"']?[A-Za-z0-9_./+=-]{8,}+|(?<![0-9a-z])[0-9a-f]{32,}+(?![0-9a-z])",
    "identity": r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})(?![0-9A-Za-z-])",
    "contact": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?i)[a-z0-9._-]{2,64}+ ?[(\[]at[)\]] ?[a-z0-9-]{2,64}+ ?[(\[]dot[)\]] ?[a-z]{2,10}",
}
KINDS = BASE + list(GENERATORS)
NEEDS = {"email": ["@"], "phone": ["+"]}  # a text without these characters cannot match
LEFT, RIGHT = 24, 8
PART = 256  # numbers of an array scanned at once
CHUNK = 4096  # characters of a text cut from at once
TARGET_PRECISION = 0.99
N_FEATURES = 12 + len(GENERATORS)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Pieces of the text: matches at odd places; null if nothing can match."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    if kind in NEEDS:
        return F.when(F.contains(text, F.lit(NEEDS[kind][0])), pieces)
    return pieces


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, kind: str) -> Column:
    """For each number of an array the sum, or the largest, of those before it; 0 for the first.  Lambdas
    can only grow an array by copying it, so long arrays are scanned in parts of PART, whose totals are
    scanned first: the work grows with n * sqrt(n) at worst instead of n * n."""
    join = (lambda a, x: a + x) if kind == "sum" else (lambda a, x: F.greatest(a, x))
    empty = F.array().cast("array<int>")

    def scan(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / PART).cast("int"), F.lit(1)) - 1)
        return bound(F.transform(places, lambda i: F.slice(v, i * PART + 1, F.lit(PART))), chained)

    def chained(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), join))
        return bound(scan(totals, F.lit(0)), lambda carried: F.flatten(F.transform(parts, lambda p, i: scan(p, F.get(carried, i)))))

    return bound(values, whole)


def _spans(pieces: Column, kind: str) -> Column:
    """start, stop, match and its surroundings for each match."""
    empty = F.array().cast("array<struct<start:int,stop:int,match:string,left:string,right:string>>")

    def listed(starts: Column) -> Column:
        def span(k: Column) -> Column:
            piece = F.get(pieces, k)
            return F.struct(
                F.get(starts, k).alias("start"),
                (F.get(starts, k) + F.char_length(piece)).alias("stop"),
                piece.alias("match"),
                F.right(F.get(pieces, k - 1), F.lit(LEFT)).alias("left"),
                F.left(F.get(pieces, k + 1), F.lit(RIGHT)).alias("right"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), span)

    return F.when(F.size(pieces) > 1, bound(before(F.transform(pieces, lambda p: F.char_length(p)), "sum"), listed)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check on a string of digits."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        value = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(value(p)) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(match)
        return F.char_length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


# ----------------------------------------------------------------------------- the trees

# fixed values: context words for and against
FOR_WORDS = "(?i)(ssn|social|tax|passport|account|iban|token|secret|password|passwd|pwd|key|phone|call|tel|mail|contact)"
AGAINST_WORDS = "(?i)(order|invoice|version|isbn|page|year|sha|commit|checksum|hash|serial|color|build|ticket|ref)"


def features(kind: Column, span: Column) -> list[Column]:
    """Numeric format and context features of a candidate, in a fixed order."""
    m, n = span["match"], F.char_length(span["match"])
    share = lambda chars: (n - F.char_length(F.regexp_replace(m, chars, ""))) / n
    return [
        n.cast("double"),
        share("[0-9]"),
        share("[a-zA-Z]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(m, ""))) / n,
        (F.char_length(m) - F.char_length(F.regexp_replace(m, "[0-9][a-zA-Z]|[a-zA-Z][0-9]", "")) + 0.0) / n,
        m.rlike("[=:]").cast("double"),
        m.rlike("(?i)^(token|secret|password|passwd|pwd|api[_-]?key)").cast("double"),
        span["left"].rlike(FOR_WORDS).cast("double"),
        span["left"].rlike(AGAINST_WORDS).cast("double"),
        span["left"].rlike("[=:] ?[\"']?$").cast("double"),
        span["right"].rlike("^[\"']").cast("double"),
        *(F.when(kind == k, 1.0).otherwise(0.0) for k in GENERATORS),
    ]


def _examples(seed: int = 5) -> list[tuple[str, int]]:
    """Generated texts with one candidate each, and whether it is personal data or a secret."""
    r = random.Random(seed)
    pick, hexa = r.choice, "0123456789abcdef"
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda chars, n: "".join(pick(chars) for _ in range(n))
    word = lambda: make("abcdefghilmnoprstuvy", r.randint(3, 9))
    d = lambda n: make("0123456789", n)
    out = []
    for _ in range(220):
        q = pick(['"', "'", ""])
        name = pick(["token", "secret", "password", "api_key", "passwd", "pwd"])
        out += [
            (f"{word()} {name} {pick('=:')} {q}{make(pick([hexa, mixed]), r.randint(12, 48))}{q} {word()}", 1),
            (f"{pick(['key', 'token', 'secret', word()])} {make(hexa, pick([32, 40, 48, 64]))} {word()}", 1),
            (f"{pick(['commit', 'sha', 'checksum', 'hash', 'build'])} {make(hexa, pick([32, 40, 64]))} {word()}", 0),
            (f"{word()} {name}{pick(': ', )}{word()}{word()} {word()}", 0),
            (f"{word()} {make('0', pick([32, 40]))} {word()}", 0),
            (f"{word()} {pick(['ssn', 'social security', 'tax number', word()])} {d(3)}-{d(2)}-{d(4)} {word()}", 1),
            (f"{pick(['order', 'invoice', 'ticket', 'ref', 'serial'])} {d(3)}-{d(2)}-{d(4)} {word()}", 0),
            (f"{pick(['iban', 'account', word()])} {make('ABCDEFGHILMNOP', 2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {word()}", 1),
            (f"{pick(['call', 'phone', 'tel', word()])} ({d(3)}) {d(3)}-{d(4)} {word()}", 1),
            (f"{pick(['version', 'order', 'page', 'isbn'])} {d(3)}.{d(3)}.{d(4)} {word()}", 0),
            (f"{pick(['mail', 'contact', word()])} {word()} (at) {word()} (dot) {pick(['com', 'org', 'net'])} {word()}", 1),
        ]
    return out


def _candidates(text: Column, pieces: dict[str, Column]) -> Column:
    empty = F.array().cast("array<struct<kind:string,span:struct<start:int,stop:int,match:string,left:string,right:string>>>")
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("span"))
    return F.concat(empty, *(F.transform(_spans(pieces[k], k), named(k)) for k in GENERATORS))


class Model:
    """Trained trees and their calibrated thresholds, one a kind."""

    def __init__(self, spark: SparkSession, seed: int = 5):
        rows = _examples(seed)
        d = spark.createDataFrame(rows, "text string, label int").coalesce(1)
        d = d.select("text", "label", *(_matches(F.col("text"), k, p).alias(f"p_{k}") for k, p in GENERATORS.items()))
        d = d.withColumn("c", F.explode(_candidates(F.col("text"), {k: F.col(f"p_{k}") for k in GENERATORS})))
        d = d.select("label", F.col("c.kind").alias("kind"), F.array(*features(F.col("c.kind"), F.col("c.span"))).alias("x"))
        found = d.collect()
        x = np.array([r["x"] for r in found], float)
        y = np.array([r["label"] for r in found], float)
        kind = np.array([r["kind"] for r in found])
        held = np.arange(len(y)) % 4 == 3
        self.base, self.trees = train_trees(x[~held], y[~held])
        score = self.base + sum(tree_values(t, x[held]) for t in self.trees)
        self.thresholds = {k: self._threshold(score[kind[held] == k], y[held][kind[held] == k]) for k in GENERATORS}

    @staticmethod
    def _threshold(score: np.ndarray, y: np.ndarray) -> float:
        """The lowest one whose held-out precision reaches the target."""
        for t in np.sort(score):
            if y[score >= t].mean() >= TARGET_PRECISION:
                return float(t) - 1e-9
        return float("inf")

    def selects(self, kind: str, span: Column) -> Column:
        """Features are bound once per candidate, then the trees read them."""
        made = F.array(*features(F.lit(kind), span))
        return bound(made, lambda v: compile_trees(self.base, self.trees, [F.get(v, F.lit(j)) for j in range(N_FEATURES)]) >= self.thresholds[kind])


def _overlaps(spans: Column, m: Column) -> Column:
    """Does the candidate overlap one of the spans, which come in parts with their bounds?"""
    return F.exists(spans, lambda p: (p["low"] < m["stop"]) & (m["start"] < p["high"]) & F.exists(p["spans"], lambda b: (m["start"] < b["stop"]) & (b["start"] < m["stop"])))


def _in_parts(spans: Column) -> Column:
    """Sorted spans in parts of PART with the least start and the greatest stop of each."""
    part = lambda i: F.slice(spans, i * PART + 1, F.lit(PART))
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(spans) / PART).cast("int"), F.lit(1)) - 1)
    made = F.filter(F.transform(places, part), lambda p: F.size(p) > 0)
    return F.transform(made, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("low"), F.array_max(F.transform(p, lambda b: b["stop"])).alias("high"), p.alias("spans")))


def find_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """row (the whole input row), text, `base` and `spans`: arrays of struct(start, rank, stop), in
    order; rank is the kind's place in KINDS."""
    model = model or Model(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.struct("*").alias("row"), "text")
    d = d.withColumn("_t", F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("\n"))).otherwise(text))
    pieces = {f"_p_{k}": _matches(F.col("_t"), k, p) for k, p in (PATTERNS | GENERATORS).items()}
    # the spans depend on _id, so no later filter is pushed below and the pieces, which are read
    # inside lambdas, are never inlined into its condition
    d = d.select("*", *(c.alias(n) for n, c in pieces.items()), F.monotonically_increasing_id().alias("_id"))
    piece = {k: F.col(f"_p_{k}") for k in KINDS}
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    brief = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"))
    holds = lambda kind: lambda s: _holds(kind, s["match"])
    selects = lambda kind: lambda s: model.selects(kind, s)
    base = [
        F.when(F.size(piece[k]) > 1, F.transform(F.filter(_spans(piece[k], k), holds(k)), brief(i))).otherwise(empty)
        for i, k in enumerate(BASE)
    ]
    d = d.withColumn("base", F.when(F.col("_id") >= 0, F.sort_array(F.concat(*base))))
    more = []
    for i, k in enumerate(GENERATORS, len(BASE)):
        chosen = F.filter(_spans(piece[k], k), selects(k))
        more.append(F.when(F.size(piece[k]) > 1, F.transform(chosen, brief(i))).otherwise(empty))
    d = d.withColumn("_more", F.concat(*more))
    free = bound(_in_parts(F.col("base")), lambda parts: F.filter("_more", lambda m: ~_overlaps(parts, m)))
    d = d.withColumn("spans", F.when(F.size("_more") > 0, F.sort_array(F.concat("base", free))).otherwise(F.col("base")))
    return d.drop("_t", "_id", "_more", *(f"_p_{k}" for k in KINDS))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row of docs(doc_id, text)."""
    d = find_spans(docs.select("doc_id", "text"), model)
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("bigint")
    return d.select(F.col("row.doc_id").alias("doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs with every span's text replaced by <KIND>; overlapping spans share one mark
    of the first kind."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    d = find_spans(docs, model)

    def stretch(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of a text cut into chunks; a substring is searched for from its string's start."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        inside = F.substring(F.get(chunks, i), a % CHUNK + 1, b - a)
        across = F.concat(F.substring(F.get(chunks, i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.coalesce(F.left(F.get(chunks, j), b % CHUNK), F.lit("")))
        return F.when(a >= b, "").when(i == j, inside).otherwise(across)

    def rewritten(chunks: Column) -> Column:
        # a span that starts behind the greatest stop before it opens a mark; what lies between that stop
        # and its start is kept
        ends = before(F.transform("spans", lambda s: s["stop"]), "max")
        made = bound(ends, lambda e: F.transform("spans", lambda s, i: F.when(s["start"] >= F.get(e, i), F.concat(stretch(chunks, F.get(e, i), s["start"]), F.get(names, s["rank"]))).otherwise("")))
        last = F.array_max(F.transform("spans", lambda s: s["stop"]))
        return F.concat(F.array_join(made, ""), stretch(chunks, last, F.char_length("text")))

    whole = bound(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), rewritten)
    d = d.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text").cast("bigint"), F.col("row.n_chars").cast("bigint")) if "n_chars" in docs.columns else None}
    return d.select(*((F.col("row")[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns))
