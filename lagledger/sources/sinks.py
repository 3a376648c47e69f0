"""Writers: flat CSV, strict JSON, result grains. None overwrites unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from lagledger.functions.numeric import finite


def _clean(column, kind):
    """The column with NaN and infinities replaced by NULL at every depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, StructType):
        made = F.struct(*[_clean(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), made)
    return column


def strict_values(df: DataFrame) -> DataFrame:
    """No NaN or infinity at any depth."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def flat_columns(df: DataFrame) -> DataFrame:
    """Scalars as they are, arrays, maps and structs as compact JSON; non-finite numbers are NULL."""
    clean = strict_values(df)
    nested = (ArrayType, MapType, StructType)
    return clean.select(
        *[(F.to_json(f"`{f.name}`", {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in clean.schema.fields]
    )


def flatten_event(df: DataFrame, prefix: str = "", schema: StructType | None = None) -> list:
    """Columns for ``select``: struct fields become ``outer_inner``, arrays stay arrays."""
    out = []
    for f in (schema or df.schema).fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            out += flatten_event(df, f"{path}.", f.dataType)
        else:
            out.append(F.col(path).alias(path.replace(".", "_")))
    return out


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_flat_csv(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """CSV with header; NULL is an empty cell. An empty table still gets its header."""
    flat_columns(df).write.mode(_mode(overwrite)).option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "escape", '"'
    ).csv(path)


def write_strict_json(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON lines without NaN or Infinity; NULL fields are kept."""
    strict_values(df).write.mode(_mode(overwrite)).option("ignoreNullFields", False).json(path)


def write_new(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Parquet; a non-empty target is refused unless ``overwrite``."""
    df.write.mode(_mode(overwrite)).parquet(path)


def write_frame_table(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Frame grain, split by group and ordered by clip so clip reads skip files."""
    df.sortWithinPartitions("clip_id", "frame_index").write.mode(_mode(overwrite)).partitionBy("group_id").parquet(path)


def write_clip_table(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Clip grain: one row per clip, 16 metric columns."""
    df.write.mode(_mode(overwrite)).partitionBy("group_id").parquet(path)


def write_group_table(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Group grain: one row per group and metric."""
    df.write.mode(_mode(overwrite)).parquet(path)
