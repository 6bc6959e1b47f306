"""Keys of the index: one canonical string for each value of a supported type, and row ids in one long."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that can be keys; anything else is refused.
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.FloatType, T.DoubleType, T.StringType)
_INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
#: A row id is file ordinal, row of the file, and one: ordinals begin at this bit.
ORDINAL_BIT = 40


class UnsupportedKey(TypeError):
    """A column of this type can't be a key."""


def check_key(field: T.StructField) -> None:
    if not isinstance(field.dataType, KEY_TYPES):
        raise UnsupportedKey(f"column {field.name} of type {field.dataType.simpleString()} can't be a key")


def canonical(column: Column, kind: str) -> Column:
    """The key of a value: equal for equal values, and for no others. Signed zeros are one value, and so are all NaN."""
    if kind in ("float", "double"):
        return F.when(F.isnan(column), "NaN").when(column == 0, "0.0").otherwise(column.cast("string"))
    return column.cast("string")


#: Casts of a key column that a comparison may ask for and that keep different values apart. Fixed values.
LOSSLESS = {
    "tinyint": ("smallint", "int", "bigint", "float", "double", "decimal"), "smallint": ("int", "bigint", "float", "double", "decimal"),
    "int": ("bigint", "double", "decimal"), "bigint": ("decimal",), "float": ("double",), "date": ("timestamp", "timestamp_ntz"),
}


def plain_key(value: object, kind: str) -> tuple[bool, str | None]:
    """Whether a literal is of the column's own family, and if so its key; None if the column can't hold it."""
    if isinstance(value, bool) or kind == "boolean":
        return (True, str(value).lower()) if isinstance(value, bool) and kind == "boolean" else (False, None)
    if kind in _INTEGERS and isinstance(value, int):
        bits = _INTEGERS[kind]
        return True, str(value) if -(1 << bits - 1) <= value < 1 << bits - 1 else None
    if kind == "date" and isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return True, value.isoformat()
    return (True, value) if kind == "string" and isinstance(value, str) else (False, None)


def literal_keys(spark: SparkSession, values: list, kind: str) -> list[str] | None:
    """Keys of literals that a column of this type is compared with, without repeats; nulls and what can't occur drop out.

    None: the comparison, as Spark types it, casts the column in a way that folds values together (or isn't possible at
    all), so only a scan gives its answer.
    """
    values = [v for v in values if v is not None]
    plain = [plain_key(v, kind) for v in values]
    if all(ok for ok, _ in plain):
        return sorted({k for _, k in plain if k is not None})
    frame, column = spark.createDataFrame([], f"c {kind}"), F.col("c")
    try:
        condition = frame.filter(column == F.lit(values[0]) if len(values) == 1 else column.isin(values))._jdf.queryExecution().analyzed().condition()
        side = {"EqualTo": lambda e: e.left(), "In": lambda e: e.value()}[condition.getClass().getSimpleName()](condition)
        met = side.dataType().catalogString()
        cast = side.getClass().getSimpleName() == "Cast"
        held = side.child() if cast else side
        if held.getClass().getSimpleName() != "AttributeReference" or (cast and met.split("(")[0] not in LOSSLESS.get(kind, ())):
            return None
        asked = [F.lit(v).cast(met) for v in values]
        own = [a.try_cast(kind) for a in asked]
        keys = [F.when(o.cast(met).eqNullSafe(a), canonical(o, kind)) for o, a in zip(own, asked)]
        return sorted({k for k in spark.range(1).select(F.array(*keys).alias("k")).first()["k"] if k is not None})
    except (PySparkException, KeyError):  # the comparison has no type, or a literal no value: a scan says so
        return None


def row_id(ordinal: Column, row_index: Column) -> Column:
    """Row ids begin at one, as the positions of Spark's bitmap functions do."""
    return F.shiftleft(ordinal.cast("long"), ORDINAL_BIT) + row_index + 1


def bucket(rid: Column) -> Column:
    return F.bitmap_bucket_number(rid)


def position(rid: Column) -> Column:
    return F.bitmap_bit_position(rid)
