"""Labels inside free-text replies, and stable splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall import values as V

from .numbers import as_column

# Items stay raw JSON text at first: one badly typed field must not void the whole reply.
_REPLY = T.StructType([T.StructField("labels", T.ArrayType(T.StringType()))])


def parse_labels(reply, valid=None) -> Column:
    """array<struct<id, label>> from the first "{" to the last "}" of a reply.

    Labels are trimmed, lower-cased and kept only where valid and where an id is
    given. Anything malformed yields an empty array.
    """
    body = F.regexp_extract(as_column(reply), r"(?s)\{.*\}", 0)
    items = F.coalesce(F.from_json(body, _REPLY)["labels"], F.array().cast("array<string>"))
    pairs = F.transform(
        items,
        lambda item: F.struct(
            F.get_json_object(item, "$.id").alias("id"),
            F.lower(F.trim(F.get_json_object(item, "$.label"))).alias("label"),
        ),
    )
    known = list(valid or V.MODEL_LABELS)
    return F.filter(pairs, lambda p: p["id"].isNotNull() & p["label"].isin(known))


def answer_or(label, default: str = V.NO_ANSWER) -> Column:
    """The label, or the stated default where there is none."""
    return F.coalesce(as_column(label), F.lit(default))


def hash_split(key, dev_pct: int = 30) -> Column:
    """dev or test, fixed by a hash of the id so that it never moves between runs."""
    bucket = F.conv(F.substring(F.md5(as_column(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < dev_pct, "dev").otherwise("test")
