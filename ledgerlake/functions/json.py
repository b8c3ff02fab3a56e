"""JSON column functions (F4, F5): typed extraction from agent messages, nested decoding."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Shape of one serialised agent message (the fields the telemetry reads).
MESSAGE_SCHEMA = StructType([
    StructField("__class__", StringType()),
    StructField("id", StringType()),
    StructField("name", StringType()),
    StructField("content", StringType()),
    StructField("tool_call_id", StringType()),
    StructField("response_metadata", StructType([
        StructField("finish_reason", StringType()),
        StructField("model_name", StringType()),
        StructField("token_usage", StructType([
            StructField("total_tokens", LongType()), StructField("completion_tokens", LongType()),
            StructField("prompt_tokens", LongType())])),
        StructField("prompt_filter_results", ArrayType(StructType([
            StructField("content_filter_results", StringType())]))),
    ])),
    StructField("additional_kwargs", StructType([
        StructField("tool_calls", ArrayType(StructType([
            StructField("id", StringType()),
            StructField("function", StructType([StructField("name", StringType()),
                                                StructField("arguments", StringType())]))])))])),
])


def message_fields(m: Column) -> Column:
    """the columns a message row needs, from a parsed message struct (missing -> NULL).

    ``m`` is ``from_json(text, MESSAGE_SCHEMA)``; the first tool call and the
    first prompt-filter result are taken with ``get(arr, 0)`` (NULL when empty).
    """
    meta = m["response_metadata"]
    usage = meta["token_usage"]
    call = F.get(m["additional_kwargs"]["tool_calls"], 0)
    pfr = F.get(meta["prompt_filter_results"], 0)
    return F.struct(
        m["__class__"].alias("message_class"), m["id"].alias("message_key"), m["content"].alias("content"),
        usage["total_tokens"].cast("int").alias("total_tokens"),
        usage["completion_tokens"].cast("int").alias("completion_tokens"),
        usage["prompt_tokens"].cast("int").alias("prompt_tokens"),
        meta["model_name"].alias("model_name"), meta["finish_reason"].alias("finish_reason"),
        pfr["content_filter_results"].alias("content_filter_results"),
        call["id"].alias("tool_call_id_out"), call["function"]["name"].alias("tool_name"),
        call["function"]["arguments"].alias("tool_input"),
        m["tool_call_id"].alias("tool_call_id_in"), m["name"].alias("tool_result_name"),
    )


def decode_json(text: Column) -> Column:
    """JSON text -> VARIANT; a JSON string that itself holds JSON is decoded once more.

    Text that is not JSON gives NULL (the caller keeps the original column).
    """
    v = F.try_parse_json(text)
    inner = F.try_variant_get(v, "$", "string")
    looks_json = F.trim(inner).startswith("{") | F.trim(inner).startswith("[")
    return F.when(looks_json, F.try_parse_json(inner)).otherwise(v)


def decode_at(v: Column, path: str) -> Column:
    """decode a JSON document held as a string at ``path`` inside a VARIANT."""
    return decode_json(F.try_variant_get(v, path, "string"))


def _decode_deep(text: str | None):
    """Parse JSON and keep parsing strings that hold JSON, at any depth (helper for decode_json_deep)."""
    import json

    def walk(v):
        if isinstance(v, str):
            try:
                return walk(json.loads(v))
            except (ValueError, TypeError):
                return v
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {str(k): walk(x) for k, x in v.items()}
        return v

    if text is None:
        return None
    out = walk(text)
    return json.dumps(out, separators=(",", ":"), sort_keys=False, ensure_ascii=False)


def decode_json_deep(text: Column) -> Column:
    """F5 (any depth): canonical JSON text with every JSON-in-a-string decoded, recursively.

    Arbitrary depth is not expressible with fixed SQL expressions, so this is a
    vectorised pandas UDF (one Arrow batch per call); ``decode_json`` is the
    JVM-side path for the common two-level case.
    """
    @F.pandas_udf("string")
    def deep(s: pd.Series) -> pd.Series:
        return s.map(_decode_deep)

    return deep(text)
