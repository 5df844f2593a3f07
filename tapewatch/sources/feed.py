"""Feed messages: parse, validate, convert, build, and queue events.

A message body is JSON in one of two dialects: ``message_type`` with a nested bar
that names its symbol, or the older ``messageType`` with a bare bar.  Key
presence matters, not the value, so bodies are read as string maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapewatch.functions.expr import computed_once, filled, finite
from tapewatch.operators.series import lay_out
from tapewatch.schema import PRICE_COLUMNS

MAP = T.MapType(T.StringType(), T.StringType())

# Fixed values of the message format.
MESSAGE_TYPE = "MARKET_DATA"
SOURCE = "yahoo_finance"
GROUP_PREFIX = "market-data-"
BATCH_SIZE = 10
DEDUP_ID_LENGTH = 128

QUEUE_EVENT = T.StructType([
    T.StructField("Records", T.ArrayType(T.StructType([
        T.StructField("messageId", T.StringType()),
        T.StructField("receiptHandle", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("attributes", MAP),
        T.StructField("messageAttributes", T.MapType(T.StringType(), T.StructType([
            T.StructField("stringValue", T.StringType()),
            T.StructField("binaryValue", T.StringType()),
            T.StructField("dataType", T.StringType()),
        ]))),
        T.StructField("md5OfBody", T.StringType()),
        T.StructField("eventSource", T.StringType()),
        T.StructField("eventSourceARN", T.StringType()),
        T.StructField("awsRegion", T.StringType()),
    ]))),
])

PAYLOAD = T.ArrayType(T.StringType())  # elements as text, so that a bad one spoils no other


def parse_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``top`` and ``data`` key maps and ``parsed``; the raw body stays."""
    df = computed_once(df, top=F.from_json(body, MAP))
    df = computed_once(df, data=F.from_json(F.col("top")["data"], MAP))
    return df.withColumn(
        "parsed", F.coalesce(F.size("top") > 0, F.lit(False)) | F.coalesce(F.trim(body) == "{}", F.lit(False)))


def _has(source: str, key: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col(source), key), F.lit(False))


def validate_messages(parsed: DataFrame) -> DataFrame:
    """Add ``reasons``, the list of what is missing; empty means valid."""
    checks = {
        "no_type": _has("top", "messageType") | _has("top", "message_type"),
        "no_timestamp": _has("top", "timestamp") | _has("top", "ingestion_timestamp") | _has("data", "timestamp"),
        "no_symbol": _has("top", "symbol"),
        "no_data": _has("top", "data"),
        **{f"no_{c}": _has("data", c) for c in PRICE_COLUMNS},
    }
    missing = F.array_compact(F.array(*[F.when(~ok, reason) for reason, ok in checks.items()]))
    return parsed.withColumn(
        "reasons", F.when(~F.col("parsed"), F.array(F.lit("not_json"))).otherwise(missing))


def message_time() -> Column:
    """The message's time: own, ingestion, or the bar's; a nested bar's own wins."""
    top, data = F.col("top"), F.col("data")
    outer = F.coalesce(
        filled(top["timestamp"]), filled(top["ingestion_timestamp"]), filled(data["timestamp"]))
    nested = F.coalesce(filled(data["timestamp"]), outer)
    return F.try_to_timestamp(F.when(_has("data", "symbol"), nested).otherwise(outer))


def convert_messages(validated: DataFrame) -> DataFrame:
    """Add bar columns, and ``not_convertible`` to ``reasons`` where that fails."""
    data = F.col("data")

    def number(key: str) -> Column:
        return finite(data[key].try_cast("double"))

    nested = _has("data", "symbol")
    adjusted = F.when(nested, number("adj_close")).otherwise(number("adjClose"))
    bars = validated.select(
        "*",
        F.when(nested, data["symbol"]).otherwise(F.col("top")["symbol"]).alias("symbol"),
        message_time().alias("ts"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        number("volume").try_cast("long").alias("volume"),
        F.when(nested & number("adj_close").isNull(), number("previous_close")).alias("previous_close"),
        adjusted.alias("adj_close"))
    complete = F.col("ts").isNotNull()
    for c in PRICE_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    return bars.withColumn("reasons", F.when(
        (F.size("reasons") == 0) & ~complete, F.array(F.lit("not_convertible"))).otherwise(F.col("reasons")))


def read_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """Parse, validate and convert; ``reasons`` tells good rows from bad ones."""
    return convert_messages(validate_messages(parse_messages(df, body)))


def good_bars(messages: DataFrame, *keep: str) -> DataFrame:
    return messages.filter(F.size("reasons") == 0).select(
        *keep, "symbol", "ts", "open", "high", "low", "close", "volume", "previous_close", "adj_close")


def quarantine(messages: DataFrame, *keep: str) -> DataFrame:
    return messages.filter(F.size("reasons") > 0).select(*keep, "reasons")


def accounting(messages: DataFrame) -> DataFrame:
    """Processed, ok and failed counts in one row; zeros for no messages."""
    return messages.agg(
        F.count("*").alias("processed"),
        F.count_if(F.size("reasons") == 0).alias("ok"),
        F.count_if(F.size("reasons") > 0).alias("failed"))


def payload_records(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Records of a JSON array; each is a bar or holds one under ``data``.

    Keys that are not there get the format's defaults; a key that is there with something that
    is not a number, or a time that is none, makes the record ``not_convertible``.  A payload that is no
    array gives one row ``not_json``, an element that is no object one ``not_an_object``.  Nothing
    is dropped: ``reasons`` tells good rows from bad ones.
    """
    listed = df.select(*keep, F.from_json(payload, PAYLOAD).alias("_all"))
    nothing = F.array(F.lit(None).cast("string"))
    record = listed.select(
        *keep, F.col("_all").isNull().alias("_unread"), F.explode(F.coalesce("_all", nothing)).alias("_text"))
    record = computed_once(record, _top=F.from_json("_text", MAP))
    record = computed_once(record, _data=F.from_json(F.col("_top")["data"], MAP))
    record = computed_once(record, _r=F.coalesce("_data", "_top"))

    def has(key: str) -> Column:
        return F.coalesce(F.map_contains_key("_r", F.lit(key)), F.lit(False))

    def number(key: str) -> Column:
        return F.when(has(key), finite(F.col("_r")[key].try_cast("double"))).otherwise(0.0)

    volume, text = number("volume"), filled(F.col("_r")["timestamp"])
    time = F.when(text.isNull(), F.current_timestamp()).otherwise(F.try_to_timestamp(text))
    bars = record.select(
        "*",
        F.coalesce(F.col("_r")["symbol"], F.lit("UNKNOWN")).alias("symbol"),
        time.alias("ts"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        F.when(volume == F.floor(volume), volume.try_cast("long")).alias("volume"),
        number("previous_close").alias("previous_close"))
    complete = F.col("ts").isNotNull() & F.col("previous_close").isNotNull()
    for c in PRICE_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    reason = (
        F.when(F.col("_unread"), F.lit("not_json"))
        .when(~F.coalesce(F.startswith(F.ltrim("_text"), F.lit("{")), F.lit(False)), F.lit("not_an_object"))
        .when(~complete, F.lit("not_convertible")))
    return bars.withColumn("reasons", F.array_compact(F.array(reason))).drop("_unread", "_text", "_top", "_data", "_r")


def explode_payload(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """The good records of a JSON array."""
    return payload_records(df, payload, *keep).filter(F.size("reasons") == 0).drop("reasons")


def flatten_queue_events(df: DataFrame, event: str) -> DataFrame:
    """One row per queue record.

    An event that cannot be read, or has no list of records, goes on as a body of its own, so
    that validation counts and quarantines it.
    """
    records = F.from_json(event, QUEUE_EVENT)["Records"]
    kind = QUEUE_EVENT["Records"].dataType
    nothing = F.array(F.lit(None).cast(kind.elementType))
    record = df.select(
        F.when(records.isNull(), F.col(event)).alias("_event"), F.explode(F.coalesce(records, nothing)).alias("r"))
    return record.select(
        F.col("r.messageId").alias("message_id"),
        F.col("r.receiptHandle").alias("receipt_handle"),
        F.coalesce("_event", "r.body").alias("body"),
        F.col("r.attributes").alias("attributes"),
        F.col("r.messageAttributes").alias("message_attributes"))


def build_messages(bars: DataFrame, ingested: Column, batch_id: Column, source: str = SOURCE) -> DataFrame:
    """Key, body and attributes of the message that carries each bar."""
    def iso(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    named = bars.withColumns({"_ingested": ingested, "_batch": batch_id})
    data = F.struct(
        "symbol", iso(F.col("ts")).alias("timestamp"), "open", "high", "low", "close", "volume", "previous_close")
    body = F.to_json(F.struct(
        F.lit(MESSAGE_TYPE).alias("message_type"), "symbol", data.alias("data"),
        F.lit(source).alias("source"), iso(F.col("_ingested")).alias("ingestion_timestamp"),
        F.col("_batch").alias("batch_id")), {"ignoreNullFields": "false"})
    attributes = F.create_map(
        F.lit("Symbol"), F.col("symbol"), F.lit("Source"), F.lit(source),
        F.lit("MessageType"), F.lit(MESSAGE_TYPE), F.lit("BatchId"), F.col("_batch"),
        F.lit("Timestamp"), iso(F.col("_ingested")))
    return named.select(
        group_key(F.col("symbol")).alias("key"), body.alias("value"), attributes.alias("attributes"),
        message_dedup_id(F.col("symbol"), F.col("_ingested"), F.col("_batch")).alias("dedup_id"))


def group_key(symbol: Column) -> Column:
    return F.concat(F.lit(GROUP_PREFIX), F.upper(symbol))


def message_dedup_id(symbol: Column, ingested: Column, batch_id: Column) -> Column:
    """Id of one sent message."""
    return F.concat_ws("-", F.upper(symbol), F.unix_seconds(ingested).cast("string"), batch_id)


def content_dedup_id(body: Column, group: Column, sent: Column) -> Column:
    """Id shared by equal bodies of a group within a minute."""
    minute = F.floor(F.unix_seconds(sent) / 60) * 60
    digest = F.sha2(F.concat_ws("_", body, group, minute.cast("string")), 256)
    return F.substring(digest, 1, DEDUP_ID_LENGTH)


def typed_attributes(text: dict[str, Column], numbers: dict[str, Column], others: dict[str, Column]) -> Column:
    """Attribute map with its data types; structured values become JSON."""
    entries = []
    groups = [
        (text, "String", lambda c: c),
        (numbers, "Number", lambda c: c.cast("string")),
        (others, "String", lambda c: F.to_json(c)),
    ]
    for columns, kind, form in groups:
        for name, column in columns.items():
            value = F.struct(form(column).alias("StringValue"), F.lit(kind).alias("DataType"))
            entries += [F.lit(name), value]
    return F.create_map(*entries)


def chunk_messages(df: DataFrame, size: int = BATCH_SIZE, **layout) -> DataFrame:
    """Add ``batch_no``: consecutive runs of ``size`` messages per group key.

    Expects columns symbol (the group), ts and seq.
    """
    numbered = lay_out(df, only_priced=False, **layout).rows()
    return numbered.withColumn("batch_no", F.floor((F.col("rn") - 1) / size)).drop("rn")


def chunk_totals(chunked: DataFrame, ok: Column) -> DataFrame:
    return chunked.groupBy("symbol", "batch_no").agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def drop_repeats(df: DataFrame, key: str = "dedup_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The first row of each dedup id; copies collapse before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_row")).select(key, "_row.*")
