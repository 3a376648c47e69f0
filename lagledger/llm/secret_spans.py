"""Secrets in whole texts: fixed patterns, and sliding-window entropy over candidate strings. Native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.llm.common import text_of

# The three base kinds in the order in which equal starts are listed; (pattern, group, least length).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # as AKIA[A-Z0-9]+ of 16 characters: a run has one start
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ of 32 characters
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character classes of candidates, narrowest first, with the least bits per character of a suspicious window.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.8), ("^[A-Za-z0-9+/_=-]+$", 3.9))
# Candidates that are no secret: without a letter or a digit, UUIDs, paths of plain words.
ALLOWED = (
    r"^[^A-Za-z]*$",
    r"^[^0-9]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}$",
)
# Placeholders end a candidate: no window reaches into one, what stands before and after is judged on its own.
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxx")
SCALE = 1_000_000  # entropies are summed as integers, so every engine gets the same windows
CHUNK = 512


def _weights(window: int) -> list[int]:
    """c * log2(c) for each count c, scaled."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def most_weight(window: int, bits: float) -> int:
    """A window has ``bits`` or more when the weights of its counts sum to this at most."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _starts(gaps: Column, matches: Column) -> Column:
    """Start of each match: the lengths of all gaps up to it and of all matches before it.

    Sums run inside chunks on top of the chunks' own sums, so many matches cost far less than one pass per match.
    """
    n = F.size(matches)
    gap, match = F.transform(gaps, F.length), F.transform(matches, F.length)
    zero = F.lit(0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, b: a + b)
    before = F.transform(F.sequence(zero, F.floor((n - 1) / CHUNK).cast("int")), lambda c: total(F.slice(gap, 1, c * CHUNK)) + total(F.slice(match, 1, c * CHUNK)))

    def start(k: Column) -> Column:
        c = F.floor(k / CHUNK).cast("int")
        return F.get(before, c) + total(F.slice(gap, c * CHUNK + 1, k - c * CHUNK + 1)) + total(F.slice(match, c * CHUNK + 1, k - c * CHUNK))

    return F.transform(F.sequence(zero, n - 1), start)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _long_enough(parts: Column, order: int, length: int) -> Column:
    """Spans of the matches whose value is long enough."""
    good = F.filter(parts, lambda p: F.length(p["value"]) >= length)
    return F.transform(good, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("kind"), (p["start"] + F.length(p["text"])).alias("end")))


def _entropy_span(candidate: Column, window: int) -> Column:
    """(first, end) inside the candidate of its suspicious windows, null where there is none.

    One pass: a character enters and one leaves, their two counts change, and so does the sum of weights.
    """
    weights = F.array(*[F.lit(w).cast("long") for w in _weights(window)])
    least = F.lit(None).cast("long")
    for pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), F.lit(most_weight(window, bits))).otherwise(least)
    codes = F.transform(F.split(candidate, ""), F.ascii)
    n = F.length(candidate)

    def change(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, 1, code), F.array(F.get(counts, code) + by), F.slice(counts, code + 2, 128))

    def move(counts: Column, code: Column, by: int) -> Column:
        now = F.get(counts, code)
        return F.get(weights, now + by) - F.get(weights, now)

    def step(at: Column, i: Column) -> Column:
        leaves = F.get(codes, i - window)
        out_counts = F.when(i >= window, change(at["counts"], leaves, -1)).otherwise(at["counts"])
        out_sum = at["sum"] + F.when(i >= window, move(at["counts"], leaves, -1)).otherwise(F.lit(0).cast("long"))
        mid = F.struct(out_counts.alias("counts"), out_sum.alias("sum"))
        # a one-element list binds the state between the two changes, so it is computed once
        return F.get(F.transform(F.array(mid), lambda m: _entered(at, m, i)), F.lit(0))

    def _entered(at: Column, m: Column, i: Column) -> Column:
        enters = F.get(codes, i)
        total = m["sum"] + move(m["counts"], enters, 1)
        hit = (i >= window - 1) & (total <= least)
        return F.struct(
            change(m["counts"], enters, 1).alias("counts"), total.alias("sum"),
            F.when(hit, F.coalesce(at["first"], i - (window - 1))).otherwise(at["first"]).alias("first"),
            F.when(hit, i + 1).otherwise(at["end"]).alias("end"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("end"),
    )
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then by kind (assign, access, hex, entropy),
    comma-joined; base_sha256 is over those of the three fixed kinds. An entropy span reaches from the first to the last
    suspicious window of a candidate string: one whose Shannon entropy reaches the bits of the candidate's character
    class. Candidates on the allow-list have none; a placeholder (in either case) parts a candidate in two.

    Work is per row and without a shuffle. A pattern is searched once; only texts that have a match pay for positions.

    Edge cases: a null text is empty, has no spans and the digest of an empty text; rows that repeat are scanned each;
    any length is scanned whole; other columns are ignored.
    """
    text = F.col("__text")
    out = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    blank = text
    for word in PLACEHOLDERS:
        blank = F.regexp_replace(blank, f"(?i){word}", " " * len(word))  # as long, so positions stay
    out = out.withColumn("__blank", F.when(text.rlike(f"(?i){'|'.join(PLACEHOLDERS)}"), blank).otherwise(text))
    for kind, (pattern, _, _) in BASE.items():
        out = out.withColumn(f"__gaps_{kind}", F.split(text, pattern, -1))
    out = out.withColumn("__gaps_entropy", F.split("__blank", CANDIDATE, -1))
    for order, (kind, (pattern, group, length)) in enumerate(BASE.items()):
        gaps, found = F.col(f"__gaps_{kind}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(_starts(gaps, found).alias("start"), found.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        out = out.withColumn(f"__{kind}", F.when(F.size(gaps) > 1, _long_enough(parts, order, length)).otherwise(_no_spans()))
    gaps, found = F.col("__gaps_entropy"), F.regexp_extract_all("__blank", F.lit(CANDIDATE), F.lit(0))
    allowed = lambda c: F.exists(F.array(*[c.rlike(p) for p in ALLOWED]), lambda x: x)
    parts = F.filter(F.arrays_zip(_starts(gaps, found).alias("start"), found.alias("text")), lambda p: ~allowed(p["text"]))
    out = out.withColumn("__parts", F.when(F.size(gaps) > 1, parts).otherwise(F.array().cast("array<struct<start:int,text:string>>")))
    seen = F.transform("__parts", lambda p: F.struct(p["start"].alias("start"), _entropy_span(p["text"], window).alias("at")))
    seen = F.filter(seen, lambda s: s["at"]["first"].isNotNull())
    seen = F.transform(seen, lambda s: F.struct((s["start"] + s["at"]["first"]).alias("start"), F.lit(len(BASE)).alias("kind"), (s["start"] + s["at"]["end"]).alias("end")))
    out = out.withColumn("__entropy", F.when(F.size("__parts") > 0, seen).otherwise(_no_spans()))
    names = F.array(*[F.lit(k) for k in (*BASE, "entropy")])

    def listed(*kinds: str) -> Column:
        ordered = F.array_sort(F.concat(*[F.col(f"__{k}") for k in kinds]))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select(
        F.col("__id").alias(id_col),
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(*BASE), 256).alias("base_sha256"),
        listed(*BASE, "entropy").alias("spans"),
    )
