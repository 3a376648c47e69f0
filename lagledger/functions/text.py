"""Text expressions: names, aliases, categories, target letters, anchors."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from lagledger.functions.numeric import col

# Name patterns.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"
COLOR_PATTERN = r"^#[0-9A-Fa-f]{6}$"
SHA256_PATTERN = r"^[0-9a-fA-F]{64}$"

# Target letters and characters that do not count for position.
P_LETTERS = "パピプペポぱぴぷぺぽ"
B_LETTERS = "バビブベボばびぶべぼ"
IGNORED = " \t\r\n、。,.!?！？「」『』（）()[]【】"

# Spellings of a yes/no/ambiguous review answer.
CONTACT_SPELLINGS = {
    "yes": "yes", "contact": "yes", "no": "no", "no_contact": "no", "ambiguous": "ambiguous",
}

# Category spellings.
MISSING_WORDS = (
    "missing", "absence", "absent", "no_contact", "no_visible_contact", "closure_missing", "closure_absence",
    "閉鎖欠如", "閉鎖なし", "欠如",
)
REFERENCE_WORDS = (
    "reference", "contact_reference", "contact", "contact_present", "strong_contact", "閉鎖あり参照", "参照",
)
SYNC_WORDS = ("sync_reference", "sync", "synchronized", "同期参照", "同期")
MISSING_PARTS = ("missing", "absence", "absent", "欠如")
REFERENCE_PARTS = ("reference", "sync", "参照", "同期")

# Spellings of an include flag.
TRUE_WORDS = ("1", "true", "yes", "y", "include")
FALSE_WORDS = ("0", "false", "no", "n", "exclude")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC (Spark has no built-in); Arrow batches."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def valid_id(value) -> Column:
    return col(value).rlike(ID_PATTERN)


def valid_color(value) -> Column:
    """Upper-cased colour, NULL if malformed."""
    return F.when(col(value).rlike(COLOR_PATTERN), F.upper(col(value)))


def valid_sha(value) -> Column:
    return col(value).rlike(SHA256_PATTERN)


def first_alias(*values: Column) -> Column:
    """Struct (value, conflict): first non-blank value, lower and trimmed; conflict if two differ."""
    clean = F.array_compact(F.array(*[F.nullif(F.lower(F.trim(v)), F.lit("")) for v in values]))
    return F.struct(F.get(clean, 0).alias("value"), (F.size(F.array_distinct(clean)) > 1).alias("conflict"))


def contact_alias(value) -> Column:
    """yes / no / ambiguous, NULL for anything else."""
    spelled = F.create_map(*[F.lit(x) for pair in CONTACT_SPELLINGS.items() for x in pair])
    return spelled[F.lower(F.trim(col(value)))]


def normalize_category(value) -> Column:
    """missing or reference, NULL if unrecognised; missing is tested first."""
    text = F.regexp_replace(F.lower(F.trim(col(value))), "[- ]", "_")
    has = lambda parts: text.rlike("|".join(parts))
    return F.when(text.isin(*MISSING_WORDS) | has(MISSING_PARTS), "missing").when(
        text.isin(*REFERENCE_WORDS, *SYNC_WORDS) | has(REFERENCE_PARTS), "reference"
    )


def include_flag(value) -> Column:
    """Blank is true; a spelling outside both lists fails the query."""
    text = F.lower(F.trim(F.coalesce(col(value), F.lit(""))))
    return (
        F.when((text == "") | text.isin(*TRUE_WORDS), F.lit(True)).when(text.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.lit("invalid include value")).cast("boolean"))
    )


def target_class(character, p_letters: str = P_LETTERS, b_letters: str = B_LETTERS) -> Column:
    c = col(character)
    return F.when(c.isin(*p_letters), "p").when(c.isin(*b_letters), "b")


def target_positions(reading, letters: str = P_LETTERS + B_LETTERS) -> Column:
    """0-based positions of target letters, in order."""
    chars = F.split(col(reading), "")
    marked = F.transform(chars, lambda c, i: F.when(c.isin(*letters), i))
    return F.array_compact(marked)


def proportional_anchor(reading, position, start, end, ignored: str = IGNORED) -> Column:
    """Middle of the character's share of the word span; ignored characters take no share.

    The start for an empty reading or an empty span.
    """
    text, at, start, end = col(reading), col(position), col(start), col(end)
    blank = "[" + "".join("\\" + c if c in "[]()\\^-.?" else c for c in ignored) + "]"
    before = F.length(F.regexp_replace(F.substring(text, F.lit(1), at.cast("int")), blank, ""))
    kept = F.length(F.regexp_replace(text, blank, ""))
    return F.when((kept == 0) | (end <= start), start).otherwise(
        start + (end - start) * (before + F.lit(0.5)) / kept
    )


def dice(a, b) -> Column:
    """2|A ∩ B| / (|A| + |B|) of two arrays as sets, 0 if both are empty."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def sorted_fields(column: Column, kind: DataType) -> Column:
    """The column with struct fields in the order of their names and maps by key, at every depth."""
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(column, lambda _, v: sorted_fields(v, kind.valueType)))))
    if isinstance(kind, StructType):
        made = F.struct(*[sorted_fields(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(column.isNotNull(), made)
    return column


def canonical_sha256(fields: Sequence[str], schema: StructType | None = None) -> Column:
    """SHA-256 of compact JSON with sorted keys; NULL fields are written as ``null``.

    With ``schema``, nested structs and maps are sorted as well.
    """
    kinds = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    parts = [sorted_fields(F.col(n), kinds[n]).alias(n) if n in kinds else F.col(n) for n in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
