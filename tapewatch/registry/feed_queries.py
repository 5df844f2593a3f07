"""Messages, payloads and quotes synthesised from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.registry.base import answer, query, r, shown
from tapewatch.sources import bars as br
from tapewatch.sources import feed
from tapewatch.sources import quotes as qt
from tapewatch.sources.tables import bars_event, bars_priority, table

VARIANTS = 12


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def messages(spark, folder):
    """Every event as a message body; the id decides which flaw or dialect it has."""
    e = table(spark, folder, "events").withColumn("v", F.col("event_id") % VARIANTS)
    v = F.col("v")
    bar = [F.col("value").alias(c) for c in ("open", "high", "low", "close")]
    volume = (F.col("event_id") % 97 + 1).alias("volume")
    time = _iso(F.col("ts")).alias("timestamp")
    early = _iso(F.col("ts") - F.expr("interval 1 hour"))
    symbol = F.col("event_type").alias("symbol")
    kind = F.lit("MARKET_DATA").alias("message_type")
    previous = (F.col("value") / 2).alias("previous_close")
    no_previous = F.lit(None).cast("double").alias("previous_close")
    ingested = early.alias("ingestion_timestamp")

    def nested(*extra, at=time):
        return F.struct(symbol, at, *bar, volume, *extra).alias("data")

    def js(*cols):
        return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})

    plain = js(kind, symbol, nested(previous), ingested)
    body = (
        F.when(v == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string")))
        .when(v == 1, js(symbol, nested(previous), ingested))
        .when(v == 2, js(kind, nested(previous), ingested))
        .when(v == 3, js(kind, symbol, F.struct(symbol, time, *bar, previous).alias("data"), ingested))
        .when(v == 4, js(kind, symbol, nested(previous, at=F.lit("").alias("timestamp")), ingested))
        .when(v == 5, js(F.lit("MARKET_DATA").alias("messageType"), symbol, time,
                         F.struct(*bar, volume, (F.col("value") * 2).alias("adjClose")).alias("data")))
        .when(v == 6, js(kind, symbol, nested(no_previous), ingested))
        .when(v == 7, js(kind, symbol, F.struct(
            symbol, time, F.lit("n/a").alias("open"), *bar[1:], volume).alias("data"), ingested))
        .when(v == 8, js(kind, symbol, F.struct(*bar, volume).alias("data")))
        .when(v == 9, js(kind, symbol, ingested))
        .when(v == 10, js(kind, symbol, nested((F.col("value") * 3).alias("adj_close"), previous), ingested))
        .otherwise(plain))
    return e.select("event_id", "ts", "event_type", body.alias("body"))


def read(spark, folder):
    return feed.read_messages(messages(spark, folder).withColumnsRenamed({"ts": "event_ts"}))


_REASONS = """case event_id % 12 when 0 then 'not_json' when 1 then 'no_type' when 2 then 'no_symbol'
  when 3 then 'no_volume' when 7 then 'not_convertible' when 8 then 'no_timestamp'
  when 9 then 'no_data,no_open,no_high,no_low,no_close,no_volume' else '' end"""
_OK = "event_id % 12 in (4, 5, 6, 10, 11)"


@query("src_4_parse", "select event_id, event_id % 12 <> 0 as parsed from events")
def _(spark, folder):
    return feed.parse_messages(messages(spark, folder)).select("event_id", "parsed")


@query("src_5_validate", f"select event_id, case when event_id % 12 = 7 then '' else {_REASONS} end as reasons from events")
def _(spark, folder):
    checked = feed.validate_messages(feed.parse_messages(messages(spark, folder)))
    return checked.select("event_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("src_6_message_time", f"""
select event_id, strftime(case when event_id % 12 = 4 then ts - interval 1 hour else ts end, '%Y-%m-%d %H:%M:%S') as ts
from events where {_OK}""")
def _(spark, folder):
    return shown(feed.good_bars(read(spark, folder), "event_id"), "event_id", "ts")


@query("src_7_message_to_bar", f"""
select event_id, event_type as symbol, round(value + 3.1e-10, 6) + 0.0 as open, round(value + 3.1e-10, 6) + 0.0 as close, event_id % 97 + 1 as volume,
  round(case when event_id % 12 in (4, 11) then value / 2 end + 3.1e-10, 6) + 0.0 as previous_close,
  round(case event_id % 12 when 5 then value * 2 when 10 then value * 3 end + 3.1e-10, 6) + 0.0 as adj_close
from events where {_OK}""")
def _(spark, folder):
    return shown(feed.good_bars(read(spark, folder), "event_id"),
                 "event_id", "symbol", "open", "close", "volume", "previous_close", "adj_close")


@query("src_7_quarantine", f"select event_id, {_REASONS} as reasons from events where not ({_OK})")
def _(spark, folder):
    return feed.quarantine(read(spark, folder), "event_id").select(
        "event_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("src_10_accounting", f"""
select count(*) as processed, count(*) filter ({_OK}) as ok, count(*) filter (not ({_OK})) as failed from events""")
def _(spark, folder):
    return feed.accounting(read(spark, folder))


@query("src_8_payload", """
select event_id // 10 as batch, case when event_id % 7 = 0 then 'UNKNOWN' else event_type end as symbol,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value + 3.1e-10, 6) + 0.0 as close,
  case when event_id % 5 = 0 then 0 else event_id % 97 end as volume,
  round(case when event_id % 3 = 0 then 0 else value / 2 end + 3.1e-10, 6) + 0.0 as previous_close
from events""")
def _(spark, folder):
    """Ten events per JSON array, wrapped in ``data`` or bare, with fields left out."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    point = F.struct(
        F.when(i % 7 != 0, F.col("event_type")).alias("symbol"), _iso(F.col("ts")).alias("timestamp"),
        F.col("value").alias("close"), F.when(i % 5 != 0, i % 97).alias("volume"),
        F.when(i % 3 != 0, F.col("value") / 2).alias("previous_close"))
    record = F.when(i % 2 == 0, F.to_json(F.struct(point.alias("data")))).otherwise(F.to_json(point))
    batches = e.groupBy(F.floor(i / 10).alias("batch")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(record)), F.lit("]")).alias("payload"))
    return shown(feed.explode_payload(batches, "payload", "batch"),
                 "batch", "symbol", "ts", "close", "volume", "previous_close")


@query("src_8_quarantine", """
with e as (
  select event_id, event_id // 10 as batch, event_id // 10 % 10 = 3 as broken, case event_id % 8
    when 0 then 'not_convertible' when 1 then 'not_convertible' when 2 then 'not_convertible' when 6 then 'not_an_object'
    when 7 then 'not_convertible' else '' end as reasons from events)
select batch, reasons, count(*) as n from e where not broken group by 1, 2
union all select distinct batch, 'not_json', 1 from e where broken""")
def _(spark, folder):
    """Volumes NaN, 1e30, "abc", 5.0 and left out, elements that are numbers, and arrays cut off."""
    i = F.col("event_id")
    volume = (
        F.when(i % 8 == 0, '"NaN"').when(i % 8 == 1, "1e30").when(i % 8 == 2, '"abc"').when(i % 8 == 3, "5.0")
        .when(i % 8 == 7, "null"))
    close = F.concat(F.lit('"close":'), F.col("value").cast("string"))
    record = F.when(i % 8 == 6, i.cast("string")).otherwise(
        F.concat(F.lit("{"), F.concat_ws(",", close, F.concat(F.lit('"volume":'), volume)), F.lit("}")))
    batches = table(spark, folder, "events").groupBy(F.floor(i / 10).alias("batch")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(record)), F.lit("]")).alias("payload"))
    cut = F.when(F.col("batch") % 10 == 3, F.expr("substr(payload, 1, length(payload) - 3)")).otherwise(F.col("payload"))
    records = feed.payload_records(batches.withColumn("payload", cut), "payload", "batch")
    return records.groupBy("batch", F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


def queue_events(spark, folder):
    """At most ten messages per queue event, as the broker delivers them."""
    m = messages(spark, folder)
    record = F.struct(
        F.col("event_id").cast("string").alias("messageId"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("receiptHandle"),
        "body", F.create_map(F.lit("MessageGroupId"), feed.group_key(F.col("event_type"))).alias("attributes"),
        F.create_map(F.lit("Symbol"), F.struct(
            F.col("event_type").alias("stringValue"), F.lit("String").alias("dataType"))).alias("messageAttributes"))
    batches = m.groupBy(F.floor(F.col("event_id") / 10).alias("batch")).agg(F.collect_list(record).alias("Records"))
    return batches.select("batch", F.to_json(F.struct("Records")).alias("event"))


@query("src_9_queue_events", """
select event_id::varchar as message_id, 'r' || event_id as receipt_handle,
  'market-data-' || upper(event_type) as message_group, event_type as symbol, event_id % 12 <> 0 as parsed
from events""")
def _(spark, folder):
    flat = feed.parse_messages(feed.flatten_queue_events(queue_events(spark, folder), "event"))
    return flat.select(
        "message_id", "receipt_handle", F.col("attributes")["MessageGroupId"].alias("message_group"),
        F.col("message_attributes")["Symbol"]["stringValue"].alias("symbol"), "parsed")


@query("src_9_quarantine", f"""
with e as (
  select event_id, event_id // 10 as batch, event_id // 10 % 9 = 4 as broken, ({_OK}) as ok from events)
select (count(*) filter (not broken) + count(distinct batch) filter (broken))::bigint as processed,
  count(*) filter (ok and not broken) as ok, (count(*) filter (not ok and not broken) + count(distinct batch) filter (broken))::bigint as failed
from e""")
def _(spark, folder):
    """Events cut off halfway count as one failed message each."""
    events = queue_events(spark, folder)
    cut = F.when(F.col("batch") % 9 == 4, F.expr("substr(event, 1, length(event) div 2)")).otherwise(F.col("event"))
    return feed.accounting(feed.read_messages(feed.flatten_queue_events(events.withColumn("event", cut), "event")))


def event_messages(spark, folder):
    bars = bars_event(spark, folder).withColumn("previous_close", F.lit(None).cast("double"))
    batch = F.md5(F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string")))
    return feed.build_messages(bars, F.col("ts") + F.expr("interval 1 hour"), batch)


_SENT = "md5(symbol || '|' || epoch(ts)::bigint)"


@query("src_11_build_messages", answer("event", "bars", f"""
select 'market-data-' || upper(symbol) as key, 'MARKET_DATA' as message_type, symbol, 'yahoo_finance' as source,
  round(close + 3.1e-10, 6) + 0.0 as close, volume, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {_SENT} as batch_id,
  strftime(ts + interval 1 hour, '%Y-%m-%dT%H:%M:%S.%fZ') as sent from bars"""))
def _(spark, folder):
    """Build, then read back what was built."""
    back = feed.read_messages(event_messages(spark, folder), "value")
    named = back.filter(F.size("reasons") == 0).withColumns({
        "message_type": F.col("attributes")["MessageType"], "source": F.col("top")["source"],
        "batch_id": F.col("attributes")["BatchId"], "sent": F.col("attributes")["Timestamp"]})
    return shown(named, "key", "message_type", "symbol", "source", "close", "volume", "ts", "batch_id", "sent")


@query("src_12_message_dedup_id", answer("event", "bars", f"""
select upper(symbol) || '-' || (epoch(ts)::bigint + 3600) || '-' || {_SENT} as dedup_id from bars"""))
def _(spark, folder):
    return event_messages(spark, folder).select("dedup_id")


@query("src_13_content_dedup_id", """
select event_id, sha256(event_type || ':' || props || '_' || 'market-data-' || upper(event_type) || '_' || (epoch(date_trunc('minute', ts))::bigint)) as dedup_id
from events""")
def _(spark, folder):
    e = table(spark, folder, "events")
    body = F.concat_ws(":", "event_type", "props")
    return e.select("event_id", feed.content_dedup_id(body, feed.group_key(F.col("event_type")), F.col("ts")).alias("dedup_id"))


@query("src_14_typed_attributes", """
select event_id, unnest(['Symbol', 'User', 'Origin']) as name,
  unnest([event_type, user_id::varchar, '{"id":' || event_id || ',"kind":"' || event_type || '"}']) as value,
  unnest(['String', 'Number', 'String']) as data_type
from events""")
def _(spark, folder):
    e = table(spark, folder, "events")
    attributes = feed.typed_attributes(
        {"Symbol": F.col("event_type")}, {"User": F.col("user_id")},
        {"Origin": F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))})
    return e.select("event_id", F.explode(attributes).alias("name", "v")).select(
        "event_id", "name", F.col("v.StringValue").alias("value"), F.col("v.DataType").alias("data_type"))


@query("src_15_chunks", """
with numbered as (select event_type as symbol, value, (row_number() over (partition by event_type order by ts, event_id) - 1) // 10 as batch_no from events)
select symbol, batch_no, count(*) filter (value > 5) as successful, count(*) filter (value <= 5) as failed
from numbered group by 1, 2""")
def _(spark, folder):
    sent = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value")
    return feed.chunk_totals(feed.chunk_messages(sent), F.col("value") > 5)


@query("src_16_quote_snapshot", """
select o_orderkey as id, o_orderpriority as symbol, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts,
  round(case when o_orderkey % 4 = 0 then 0 else o_totalprice end + 3.1e-10, 6) + 0.0 as close,
  case when o_orderkey % 6 = 0 then 0 else o_custkey end as volume,
  round(case when o_orderkey % 3 <> 0 then o_totalprice / 2 end + 3.1e-10, 6) + 0.0 as previous_close
from orders""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    quotes = o.select(
        F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("symbol"),
        F.unix_seconds("o_orderdate").alias("regularMarketTime"),
        F.when(k % 4 != 0, F.col("o_totalprice")).alias("regularMarketPrice"),
        *[F.col("o_totalprice").alias(f"regularMarket{c}") for c in ("Open", "DayHigh", "DayLow")],
        F.when(k % 6 != 0, F.col("o_custkey")).alias("regularMarketVolume"),
        F.when(k % 3 != 0, F.col("o_totalprice") / 2).alias("regularMarketPreviousClose"))
    bars = qt.snapshot_to_bars(quotes).withColumns({
        "id": F.split("symbol", r"\|")[0].cast("long"), "symbol": F.split("symbol", r"\|")[1]})
    return shown(bars, "id", "symbol", "ts", "close", "volume", "previous_close")


@query("src_17_latest_quote", answer("event", "bars", f"""
select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {r("close", "previous_close")}
from (select *, coalesce(lag(close) over (partition by symbol order by ts, seq), close * 0.99) as previous_close,
        row_number() over (partition by symbol order by ts desc, seq desc) as back from bars) where back = 1"""))
def _(spark, folder):
    return shown(qt.latest_of_table(bars_event(spark, folder)), "symbol", "ts", "close", "previous_close")


_DAYS = """
days as (select symbol || ' ' || strftime(ts, '%Y-%m-%d') as symbol, list(open order by ts) as o, list(close order by ts) as c,
  list(volume order by ts) as v from bars group by 1)"""


def _day_lists(spark, folder):
    """The bars of a symbol's day as one provider answer (24 bars at most)."""
    hours = F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume")))
    name = F.concat_ws(" ", "symbol", F.date_format("ts", "yyyy-MM-dd"))
    return bars_event(spark, folder).groupBy(name.alias("symbol")).agg(hours.alias("quotes"))


@query("src_17_quote_list", answer("event", "bars", """
select symbol, round(c[-1] + 3.1e-10, 6) + 0.0 as close, v[-1] as volume,
  round(coalesce(c[-2], c[-1] * 0.99) + 3.1e-10, 6) + 0.0 as previous_close from days""", _DAYS))
def _(spark, folder):
    return shown(qt.latest_of_list(_day_lists(spark, folder)), "symbol", "close", "volume", "previous_close")


@query("src_18_chart_arrays", answer("event", "bars", """
select symbol, (unnest(range(len(c))))::int as position, round(unnest(o) + 3.1e-10, 6) + 0.0 as open,
  round(unnest(c) + 3.1e-10, 6) + 0.0 as close, unnest(v) as volume from days""", _DAYS))
def _(spark, folder):
    charts = _day_lists(spark, folder).select(
        "symbol", F.lit(None).cast("double").alias("previous_close"),
        *[F.col(f"quotes.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return shown(qt.chart_to_bars(charts), "symbol", "position", "open", "close", "volume")


@query("src_19_standardise", """
select o_orderkey as "Id", round(o_totalprice + 3.1e-10, 6) + 0.0 as "Close", o_custkey as "Volume" from orders""")
def _(spark, folder):
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Id"), F.col("o_totalprice").alias("cLOSE"),
        F.col("o_custkey").cast("double").alias("volume"))
    return shown(br.standardise_columns(raw), "Id", "Close", "Volume")


@query("src_20_clean_bars", answer("priority", "bars", """
select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(close + 3.1e-10, 6) + 0.0 as close, volume from bars
where epoch(ts)::bigint // 86400 % 5 <> 0 and epoch(ts)::bigint // 86400 % 7 <> 0"""))
def _(spark, folder):
    """Bars with prices and volumes knocked out by date are dropped whole."""
    day = F.floor(F.unix_seconds("ts") / 86400)
    raw = bars_priority(spark, folder).withColumns({
        "open": F.when(day % 5 != 0, F.col("open")),
        "volume": F.when(day % 7 != 0, F.col("volume").cast("double"))})
    return shown(br.clean_bars(raw.withColumnsRenamed({"ts": "Date", "open": "Open"})), "symbol", "ts", "close", "volume")


@query("src_21_symbol_list", """
with t as (select unnest(list_slice([upper(o_orderpriority), upper(o_orderstatus), 'C' || o_custkey], 1, 2 + (o_orderkey % 2)::int)) as symbol from orders)
select symbol, count(*) as n_requests from t group by 1""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    text = F.concat_ws(",", F.lower("o_orderpriority"), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")),
                       F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    listed = qt.symbol_list(text, (2 + F.col("o_orderkey") % 2).cast("int"))
    return o.select(F.explode(listed).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n_requests"))


@query("set_2_drop_repeats", """
with keyed as (select *, sha256(event_type || '_' || 'market-data-' || upper(event_type) || '_' || (epoch(date_trunc('minute', ts))::bigint)) as dedup_id from events)
select dedup_id, arg_min(event_id, {t: ts, e: event_id}) as event_id, event_type as symbol from keyed group by dedup_id, event_type""")
def _(spark, folder):
    e = table(spark, folder, "events")
    keyed = e.select(
        feed.content_dedup_id(F.col("event_type"), feed.group_key(F.col("event_type")), F.col("ts")).alias("dedup_id"),
        "event_id", F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"))
    return feed.drop_repeats(keyed).select("dedup_id", "event_id", "symbol")
