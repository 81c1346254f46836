"""Values on their way in: types from text, empty values, separators, and identifiers made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as datetimes: ISO 8601 with a zone, with Z or without (then in the session's zone), or a date alone.
#: Fixed by the format that users rely on.
DATETIME = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:?\d{2})?)?$"


def is_datetime(text: Column) -> Column:
    return text.rlike(DATETIME) & F.try_to_timestamp(text).isNotNull()


def to_number(text: Column) -> Column:
    """A finite number in a text, else null."""
    n = F.trim(text).try_cast("double")
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (F.abs(n) < float("inf")), n)


def to_boolean(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def inferred_type(text: Column) -> Column:
    """number, boolean, datetime or string for a text as a CSV file has it; null for null."""
    kind = F.when(to_number(text).isNotNull(), "number").when(to_boolean(text).isNotNull(), "boolean").when(is_datetime(text), "datetime")
    return F.when(text.isNotNull(), F.coalesce(kind, F.lit("string")))


def skip_empty(value: Column) -> Column:
    """Null for an empty text."""
    return F.when(value != "", value)


def skip_empty_array(values: Column) -> Column:
    """Without nulls and empty texts; null if nothing is left."""
    left = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(left) > 0, left)


def split_values(text: Column, separator: str) -> Column:
    """The trimmed, non-empty parts of a text."""
    parts = F.transform(F.split(text, "\\Q" + separator + "\\E", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def event_id(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the JSON object of fields in order of their names; null fields are left out."""
    ordered = [c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def scope_hash(salt: str, *parts: Column) -> Column:
    """SHA-256 of a salt and the parts of a scope, each with a separator that texts don't have."""
    return F.sha2(F.concat_ws("\u001e", F.lit(salt), F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts])), 256)


def id_time(uuid7: Column) -> Column:
    """When a time-ordered id was made."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(uuid7, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))
