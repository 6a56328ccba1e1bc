"""The document model: a fixed envelope with dynamically typed metadata, and its validation rules.

Metadata is MAP<STRING, META>, META = STRUCT<kind, keys, nums>. ``keys`` holds a tagged equality
key for every scalar a value expands to, ``nums`` the orderable ones on one double axis. So each
filter leaf is one built-in expression, whatever the kinds of a field in different documents.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone
from uuid import UUID

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("null", "text", "boolean", "integral", "number", "datetime", "identifier", "text_array", "boolean_array", "integral_array", "number_array")
META = T.StructType().add("kind", T.ByteType()).add("keys", T.ArrayType(T.StringType())).add("nums", T.ArrayType(T.DoubleType()))
DOCUMENT = (
    T.StructType().add("id", T.StringType()).add("text", T.StringType()).add("vector", T.ArrayType(T.FloatType())).add("metadata", T.MapType(T.StringType(), META)).add("version", T.LongType()).add("updated_at", T.TimestampType())
)
#: 100 ns ticks from the year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000


class DomainError(ValueError):
    """A rule of the model is broken; ``code`` says which."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def check(ok: bool, code: str, message: str = "") -> None:
    if not ok:
        raise DomainError(code, message)


def check_collection_name(name: str) -> None:
    check(bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", name or "")), "invalid_collection_name", name)


def check_document_id(id_: str | None) -> None:
    check(bool(id_ and id_.strip()) and len(id_) <= 512, "invalid_document_id")


def check_metadata_key(key: str | None) -> None:
    check(bool(key and key.strip()) and len(key) <= 256, "invalid_metadata")


def check_vector(vector: list[float] | None, dimension: int) -> None:
    check(vector is not None and len(vector) == dimension, "dimension_mismatch")
    check(all(math.isfinite(x) for x in vector), "invalid_vector")


def invalid_rows(docs: DataFrame, dimension: int) -> DataFrame:
    """(id, error_code), and seq where there is one, of every document that breaks a rule; one job, nothing collected."""
    v = F.col("vector")
    code = (
        F.when(F.col("id").isNull() | (F.trim("id") == "") | (F.length("id") > 512), "invalid_document_id")
        .when(v.isNull() | (F.size(v) != dimension), "dimension_mismatch")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "invalid_vector")
        .when(F.exists(F.map_keys(F.coalesce("metadata", F.create_map().cast(T.MapType(T.StringType(), META)))), lambda k: (F.trim(k) == "") | (F.length(k) > 256)), "invalid_metadata")
    )
    return docs.select(*[c for c in ("seq", "id") if c in docs.columns], code.alias("error_code")).filter("error_code is not null")


def _keys(value: Column, kind: str) -> Column:
    """Equality key of one scalar."""
    if kind == "text":
        return F.concat(F.lit("s:"), value)
    if kind == "boolean":
        return F.concat(F.lit("b:"), F.when(value, "1").otherwise("0"))
    if kind == "integral":
        return F.concat(F.lit("i:"), value.cast("bigint").cast("string"))
    if kind == "number":
        return F.concat(F.lit("d:"), value.cast("double").cast("string"))
    if kind == "datetime":
        return F.concat(F.lit("t:"), ticks(value).cast("string"))
    if kind == "identifier":
        return F.concat(F.lit("g:"), F.lower(value))
    raise DomainError("invalid_metadata", kind)


def ticks(value: Column) -> Column:
    return F.unix_micros(value) * F.lit(10) + F.lit(EPOCH_TICKS)


def _num(value: Column, kind: str) -> Column | None:
    if kind in ("integral", "number"):
        return value.cast("double")
    return ticks(value).cast("double") if kind == "datetime" else None


def meta(value: Column, kind: str) -> Column:
    """META of a column that is never null; see :func:`metadata` for absent fields."""
    number = F.lit(KINDS.index(kind)).cast("tinyint")
    if kind == "null":
        keys, nums = F.array(F.lit("n:")), F.array().cast("array<double>")
    elif kind.endswith("_array"):
        one = kind.removesuffix("_array")
        keys = F.transform(value, lambda x: _keys(x, one))
        nums = F.transform(value, lambda x: _num(x, one)) if one in ("integral", "number") else F.array().cast("array<double>")
    else:
        keys = F.array(_keys(value, kind))
        nums = F.array(_num(value, kind)) if kind in ("integral", "number", "datetime") else F.array().cast("array<double>")
    return F.struct(number.alias("kind"), keys.alias("keys"), nums.alias("nums"))


def metadata(**fields: tuple[str, Column | str]) -> Column:
    """MAP<STRING, META> of name=(kind, column); a field whose column is null is absent."""
    entries = []
    for name, (kind, c) in fields.items():
        c = F.col(c) if isinstance(c, str) else c
        entries.append(F.when(c.isNotNull(), F.struct(F.lit(name).alias("key"), meta(c, kind).alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def kind_of(value: object) -> str:
    """Kind of a Python scalar or list, by the rules of the wire format."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integral" if -(1 << 63) <= value < 1 << 63 else "number"
    if isinstance(value, float):
        check(math.isfinite(value), "invalid_metadata", "numbers are finite")
        return "number"
    if isinstance(value, datetime):
        return "datetime"
    if isinstance(value, UUID):
        return "identifier"
    if isinstance(value, str):
        return "text"
    if isinstance(value, (list, tuple)):
        kinds = {kind_of(x) for x in value}
        if not kinds:
            return "text_array"
        if kinds == {"integral", "number"}:
            return "number_array"
        check(len(kinds) == 1 and kinds <= {"text", "boolean", "integral", "number"}, "invalid_metadata", "arrays are of one kind")
        return kinds.pop() + "_array"
    raise DomainError("invalid_metadata", type(value).__name__)


def literal(value: object) -> Column:
    """Column of a Python scalar, by its kind."""
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        micros = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // __import__("datetime").timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(micros))
    return F.lit(str(value) if isinstance(value, UUID) else value)


def scalar_key(value: object) -> Column:
    kind = kind_of(value)
    return F.lit("n:") if kind == "null" else _keys(literal(value), kind)


def scalar_num(value: object) -> Column | None:
    kind = kind_of(value)
    return _num(literal(value), kind) if kind in ("integral", "number", "datetime") else None
