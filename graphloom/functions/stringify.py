"""Text forms of values, nodes and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stringify(value: Column, kind: T.DataType | None = None) -> Column:
    """Doubles with six digits, null as NULL, arrays as ``[ a b ]``, times in ISO form, nodes and relationships with their properties."""
    if isinstance(kind, T.StructType):
        rel = "src" in kind.names
        inner = [f for f in kind.fields if f.name not in ("id", "label", "src", "dst")]
        shown = [F.when(value.getField(f.name).isNotNull(), F.concat(F.lit(f"{f.name}: "), quoted(value.getField(f.name), f.dataType))) for f in inner]
        props = F.concat_ws(", ", *shown) if shown else F.lit("")
        text = F.concat(F.lit(":") if rel else F.lit(""), value.getField("label"), F.lit("["), value.getField("id").cast("string"), F.lit("]{"), props, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("[ "), F.array_join(value.cast("array<string>"), " "), F.lit(" ]"))
    elif isinstance(kind, T.DoubleType):
        text = F.format_string("%.6f", value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = F.regexp_replace(text, r"\.000000$", "")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def quoted(value: Column, kind: T.DataType) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"')) if isinstance(kind, T.StringType) else stringify(value, kind)


def stringified(df: DataFrame) -> DataFrame:
    """All columns in their text form."""
    return df.select(*(stringify(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
