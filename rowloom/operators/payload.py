"""Binary payloads: triage of event values, base64."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, require, type_of

# Fixed values of the framed format: a zero byte, a four-byte big-endian schema id, the body.
FRAME_HEADER = 5
MAX_CONTROL_SHARE = 0.1


def triage_payload(df: DataFrame, column: str) -> DataFrame:
    """Adds ``payload_class, schema_id, payload_text, payload_body`` for a binary column.

    Classes: ``empty``; ``framed`` (schema id and body split off; the body goes to Spark's
    ``from_avro`` where that package is deployed); ``text`` (valid UTF-8 with at most 10 %
    control characters other than tab and line breaks); ``binary`` (base64 in ``payload_text``).
    """
    if not isinstance(type_of(df, column), T.BinaryType):
        raise ToolkitError(f"column {column!r} is not binary")
    raw = col(column)
    size = F.octet_length(raw)
    framed = (size >= FRAME_HEADER) & (F.substr(raw, F.lit(1), F.lit(1)) == F.lit(b"\x00"))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    printable = F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    readable = text.isNotNull() & (F.length(text) - printable <= F.length(text) * MAX_CONTROL_SHARE)
    kind = (
        F.when(raw.isNull() | (size == 0), "empty").when(framed, "framed").when(readable, "text").otherwise("binary")
    )
    state = F.col("payload_class")
    header = F.hex(F.substr(raw, F.lit(2), F.lit(4)))
    return df.withColumn("payload_class", kind).withColumns(
        {
            "schema_id": F.when(state == "framed", F.conv(header, 16, 10).cast("bigint")),
            "payload_text": F.when(state == "text", text).when(state == "binary", F.base64(raw)),
            "payload_body": F.when(state == "framed", F.substr(raw, F.lit(FRAME_HEADER + 1))),
        }
    )


def triage_counts(triaged: DataFrame) -> DataFrame:
    """(payload_class, schema_id, n)."""
    return triaged.groupBy("payload_class", "schema_id").agg(F.count(F.lit(1)).alias("n"))


def decode_framed(triaged: DataFrame, avro_schema: str, schema_id: int, output: str = "decoded") -> DataFrame:
    """Framed rows of one schema with their body decoded by Spark's Avro package, if deployed."""
    try:
        from pyspark.sql.avro.functions import from_avro
    except ImportError as error:  # pragma: no cover
        raise ToolkitError("the Spark Avro package is not available") from error
    chosen = triaged.filter((F.col("payload_class") == "framed") & (F.col("schema_id") == schema_id))
    return chosen.withColumn(output, from_avro("payload_body", avro_schema))


def base64_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Base64 text of a text or binary column, without line breaks."""
    require(df, column)
    return df.withColumn(output, F.replace(F.base64(col(column)), F.lit("\r\n"), F.lit("")))


def base64_decode(df: DataFrame, column: str, output: str, lenient: bool = False) -> DataFrame:
    """Bytes of a base64 text; bad text is an error, or null if ``lenient``."""
    require(df, column)
    convert = F.try_to_binary if lenient else F.to_binary
    return df.withColumn(output, convert(col(column), F.lit("base64")))
