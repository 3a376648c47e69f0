"""Leak scan of text tables, file rules, allow lists and artifact checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagledger.functions import text as tx
from lagledger.operators.rules import passes, reasons
from lagledger.session import cut_lineage

# Text patterns (Java regular expressions) and their names.
TEXT_PATTERNS = {
    "local user path": r"/(?:Users|home)/[A-Za-z0-9._-]+(?:/|\b)",
    "private key": r"BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    "OpenAI-style secret": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "Google API key": r"\bAIza[0-9A-Za-z_-]{30,}\b",
    "email address": r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\b",
    "Japanese mobile number": r"(?<![0-9])0[789]0(?:[- ]?[0-9]{4}){2}(?![0-9])",
    "Google Drive URL": r"https?://drive\.google\.com/",
    "signed URL credential": r"(?i)(?:X-Amz-(?:Credential|Signature)|[?&](?:api[_-]?key|signature|token)=)",
}

# File rules.
MAX_FILE_SIZE = 5 * 1024 * 1024
REGULAR_MODES = ("100644", "100755")
MEDIA_SUFFIXES = (
    ".aac", ".avi", ".bmp", ".flac", ".gif", ".jpeg", ".jpg", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".png",
    ".srt", ".tif", ".tiff", ".vtt", ".wav", ".webm", ".webp",
)
SECRET_SUFFIXES = (".key", ".p12", ".pem", ".pfx")
FORBIDDEN_NAMES = (".env", "blind_key.json", "credentials.json", "face_landmarker.task", "secrets.json")
FORBIDDEN_PARTS = (
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "artifacts", "case-data", "cases", "inputs",
    "media", "outputs", "private", "recordings", "reports", "transcripts",
)

# Hexadecimal heads of approved media: signature, length and name of the first PNG chunk; mark of an MP4.
PNG_HEAD = "89504E470D0A1A0A0000000D49484452"
MP4_MARK = "66747970"

# Result keys that would break the evidence boundary.
FORBIDDEN_KEYS = (
    "aggregate_score", "composite_score", "overall_score", "aggregate_rank", "overall_rank", "speaker_similarity",
    "same_speaker_probability", "speaker_identity_score", "voiceprint",
)
# Field names, and parts of field names, that a result must not have.
FORBIDDEN_FIELDS = (
    "biometric_match", "closest_speaker", "composite_score", "distance", "identity_inference", "identity_probability", "identity_score", "match_probability",
    "ranking", "same_speaker_probability", "similarity", "similarity_score", "speaker_embedding", "speaker_identity_score", "speaker_similarity",
    "speaker_similarity_score", "voiceprint", "winner",
)
FORBIDDEN_FRAGMENTS = (
    "same_speaker", "speaker_similarity", "speaker_embedding", "voiceprint", "identity_probability", "match_probability", "biometric_match",
    "closest_speaker", "composite_score",
)


def leak_scan(documents: DataFrame, ident: str, text: str, patterns: Mapping[str, str] = TEXT_PATTERNS) -> DataFrame:
    """One row per (document, pattern that occurs), all patterns in one pass over the whole text."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return documents.select(ident, F.explode(found).alias("pattern"))


def path_findings(files: DataFrame) -> DataFrame:
    """Rules each file breaks: path, mode, size and content columns.

    A bad path or file mode ends the check of that file; the other rules are
    all listed.
    """
    path = F.lower("path")
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    first = (
        F.when(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."), "unsafe path")
        .when(F.col("mode") == "120000", "symlink")
        .when(~F.col("mode").isin(*REGULAR_MODES), "unsupported file mode")
    )
    more = reasons(
        (name.isin(*FORBIDDEN_NAMES) | (name.startswith(".env") & (name != ".env.example")), "forbidden filename"),
        (F.arrays_overlap(parts, F.array(*[F.lit(p) for p in FORBIDDEN_PARTS])), "private or generated directory"),
        (F.col("size") > MAX_FILE_SIZE, "file larger than 5 MiB"),
        (suffix.isin(*MEDIA_SUFFIXES, *SECRET_SUFFIXES), "forbidden file type"),
        (F.col("content").isNotNull() & ~F.is_valid_utf8(F.col("content").cast("string")), "non-text file"),
    )
    return files.withColumn("findings", F.when(first.isNotNull(), F.array(first)).otherwise(more))


def allowlist(files: DataFrame, approved: DataFrame) -> DataFrame:
    """Files against approved ones; other media are refused.

    ``files`` has path, mode, size, content; ``approved`` has path, kind (``mp4`` or ``png``), mode, sha256, size (mp4),
    width and height (png). An approved mp4 is bound to its own size and not to the limit; it has ``ftyp`` in bytes 5 to
    8. An approved png starts with the signature and a 13-byte IHDR chunk of the approved width and height.
    """
    a = approved.select("path", *[F.col(c).alias(f"_{c}") for c in ("kind", "mode", "size", "sha256", "width", "height")])
    out = files.join(a, "path", "left")
    known, mp4, png = F.col("_kind").isNotNull(), F.col("_kind").eqNullSafe("mp4"), F.col("_kind").eqNullSafe("png")
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    part = lambda start, n: F.hex(F.substring("content", start, n))
    number = lambda start: F.conv(part(start, 4), 16, 10).cast("long")
    is_png = F.coalesce((part(1, 16) == PNG_HEAD) & (F.octet_length("content") >= 24), F.lit(False))
    differs = lambda x, y: ~F.coalesce(x == y, F.lit(False))
    return out.withColumn(
        "allow_reasons",
        reasons(
            (~known & suffix.isin(*MEDIA_SUFFIXES), "media not on the list"),
            (~mp4 & (F.col("size") > MAX_FILE_SIZE), "file too large"),
            (known & differs(F.col("mode"), F.col("_mode")), "mode differs"),
            (mp4 & differs(F.col("size"), F.col("_size")), "size differs"),
            (mp4 & F.col("content").isNotNull() & differs(F.octet_length("content"), F.col("_size")), "data length differs"),
            (known & F.col("content").isNull(), "cannot be validated"),
            (known & (F.sha2("content", 256) != F.lower("_sha256")), "hash differs"),
            (mp4 & F.col("content").isNotNull() & differs(part(5, 4), F.lit(MP4_MARK)), "unexpected file type"),
            (png & F.col("content").isNotNull() & ~is_png, "unexpected file type"),
            (png & is_png & ((number(17) != F.col("_width")) | (number(21) != F.col("_height"))), "dimensions differ"),
        ),
    ).drop(*[f"_{c}" for c in ("kind", "mode", "size", "sha256", "width", "height")])


def forbidden_columns(df: DataFrame) -> list[str]:
    """Paths of forbidden names in a typed table's schema, at any depth."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path):
        if isinstance(kind, StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}" if path else f.name
                if _is_forbidden(f.name):
                    yield here
                yield from walk(f.dataType, here)
        elif isinstance(kind, ArrayType):
            yield from walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            yield from walk(kind.valueType, f"{path}{{}}")

    return list(walk(df.schema, ""))


def _is_forbidden(name: str) -> bool:
    plain = name.strip().lower().replace("-", "_")
    return plain in (*FORBIDDEN_KEYS, *FORBIDDEN_FIELDS) or any(f in plain for f in FORBIDDEN_FRAGMENTS)


def _is_forbidden_column(name: Column) -> Column:
    plain = F.translate(F.lower(F.trim(name)), "-", "_")
    return plain.isin(*FORBIDDEN_KEYS, *FORBIDDEN_FIELDS) | plain.rlike("|".join(FORBIDDEN_FRAGMENTS))


def forbidden_keys(documents: DataFrame, ident: str, raw: str) -> DataFrame:
    """Forbidden keys at any depth of raw JSON text, with their paths: exact names and names that hold a forbidden part.

    Each pass opens one nesting level of the rows that still hold objects or arrays and ends when none does, so there are
    as many passes as the deepest text has levels. The open level is written out between passes: it shrinks each time.
    """
    level = documents.select(ident, F.lit("").alias("path"), F.try_parse_json(raw).alias("v"))
    out = level.filter(F.col("v").isNull()).select(ident, F.lit("").alias("path"), F.lit("not_json").alias("problem"))
    level = level.filter(F.col("v").isNotNull())
    while True:
        opened = cut_lineage(_open_level(level, ident))
        out = out.unionByName(opened.filter(_is_forbidden_column(F.col("key"))).select(ident, "path", F.lit("forbidden_key").alias("problem")))
        level = opened.select(ident, "path", "v").filter(F.col("v").isNotNull() & F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if level.isEmpty():
            return out


def _open_level(level: DataFrame, ident: str) -> DataFrame:
    exploded = level.filter(F.col("v").isNotNull() & F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).selectExpr(
        f"`{ident}`", "path AS parent", "v AS whole"
    )
    exploded = exploded.select(ident, "parent", F.explode(_children("whole")).alias("c"))
    child = F.concat(
        F.col("parent"),
        F.when(F.col("c.key").isNull(), F.concat(F.lit("["), F.col("c.pos").cast("string"), F.lit("]")))
        .when(F.col("parent") == "", F.col("c.key")).otherwise(F.concat(F.lit("."), F.col("c.key"))),
    )
    return exploded.select(ident, child.alias("path"), F.col("c.key").alias("key"), F.col("c.v").alias("v"))


def _children(column: str) -> Column:
    """Children of a variant as an array of (pos, key, v)."""
    as_map = F.expr(f"try_variant_get({column}, '$', 'map<string,variant>')")
    as_list = F.expr(f"try_variant_get({column}, '$', 'array<variant>')")
    pairs = F.transform(
        F.map_entries(as_map), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("key"), e["value"].alias("v"))
    )
    items = F.transform(
        as_list, lambda e, i: F.struct(i.alias("pos"), F.lit(None).cast("string").alias("key"), e.alias("v"))
    )
    return F.coalesce(pairs, items)


def boundary_flags(df: DataFrame, raw: str, flags: Sequence[str]) -> DataFrame:
    """Flags of a raw JSON boundary object that are absent, not boolean, or not false."""
    v = F.try_parse_json(raw)
    missing = F.try_variant_get(v, "$", "map<string,variant>").isNull()
    wrong = lambda n: F.coalesce(
        (F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) != "BOOLEAN")
        | F.try_variant_get(v, f"$.{n}", "boolean"),
        F.lit(True),
    )
    return df.withColumn(
        "boundary_reasons",
        reasons((missing, "boundary_missing"), *[(~missing & wrong(n), f"boundary:{n}") for n in flags]),
    )


def artifact_problems(manifest: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Manifest entries (name, sha256) against actual files (name, sha256), with reasons; required names too."""
    spark = manifest.sparkSession
    f = files.select("name", F.lower("sha256").alias("_actual"))
    listed = manifest.join(f, "name", "left").select(
        "name",
        reasons(
            (~tx.valid_id("name"), "unsafe name"),
            (~tx.valid_sha("sha256"), "malformed hash"),
            (F.col("_actual").isNull(), "file missing"),
            (F.col("_actual") != F.lower("sha256"), "hash differs"),
        ).alias("problems"),
    ).filter(~passes("problems"))
    need = spark.createDataFrame([(n,) for n in required], "name string")
    absent = need.join(manifest.select("name"), "name", "left_anti").select(
        "name", F.array(F.lit("required name not listed")).alias("problems")
    )
    return listed.unionByName(absent)


def input_binding(annotations: DataFrame, recorded: str, files: DataFrame, name: str) -> DataFrame:
    """Recorded input hash against the actual one: bound, stale, missing file or ``legacy_missing``."""
    f = files.select(F.col("name").alias(name), F.lower("sha256").alias("_actual"))
    r = F.lower(F.nullif(F.trim(recorded), F.lit("")))
    return annotations.join(f, name, "left").withColumn(
        "binding",
        F.when(r.isNull(), "legacy_missing").when(F.col("_actual").isNull(), "input_missing")
        .when(r == F.col("_actual"), "bound").otherwise("stale"),
    ).drop("_actual")
