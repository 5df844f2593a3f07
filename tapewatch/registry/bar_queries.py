"""Bars, features, indicators, labels and single-point modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.functions.ema import Average, with_averages
from tapewatch.operators import features as ft
from tapewatch.operators import labels as lb
from tapewatch.operators import single_point as sp
from tapewatch.operators import summaries
from tapewatch.operators.lookups import attach
from tapewatch.operators.series import DAILY_ROWS, lay_out, number_by_sort, price_gaps
from tapewatch.registry.base import KEY, answer, nudge, query, r, shown
from tapewatch.schema import FEATURES
from tapewatch.session import scratch
from tapewatch.sources.bars import ticks_to_bars
from tapewatch.sources.tables import bars_brand, bars_event, bars_priority, event_ticks, table

INTS = ("Hour", "DayOfWeek", "IsMonday", "IsFriday")
DOUBLES = tuple(c for c in FEATURES if c not in INTS)


def daily(spark, folder):
    return lay_out(bars_brand(spark, folder), DAILY_ROWS)


def priority(spark, folder):
    return lay_out(bars_priority(spark, folder), DAILY_ROWS)


def hourly(spark, folder):
    return lay_out(bars_event(spark, folder))


VIEWS = {"brand": daily, "event": hourly, "priority": priority}


def _ints(columns):
    return "".join(f', "{c}"' for c in columns)


def _feature_query(name, view, need, step, ints=(), doubles=()):
    body = f"select {KEY}{_ints(ints)}" + (", " + r(*doubles) if doubles else "")

    @query(name, answer(view, need, f"{body} from {need}"))
    def run(spark, folder):
        rows = step(VIEWS[view](spark, folder)).rows()
        return shown(rows, "symbol", "ts", *ints, *doubles)


def _bands(series):
    return ft.bands(ft.lagged_features(series))


def _volatility(series):
    return ft.volatility(ft.lagged_features(series))


def _momentum(series):
    return ft.momentum(ft.lagged_features(series))


def _labelled(series):
    return series.on(lb.rule_labels(ft.history_features(series).frame))


# ------------------------------------------------------------------- features
_feature_query("fea_1_price_change", "brand", "plain", ft.lagged_features, doubles=["Price_Change"])
_feature_query("fea_2_price_range", "brand", "plain", ft.lagged_features, doubles=["Price_Range"])
_feature_query("fea_3_gap", "brand", "plain", ft.lagged_features, doubles=["Gap"])
_feature_query("fea_4_volume_change", "brand", "plain", ft.lagged_features, doubles=["Volume_Change"])
_feature_query("fea_5_volume_price_ratio", "brand", "plain", ft.lagged_features, doubles=["Volume_Price_Ratio"])
_feature_query("fea_6_volume_ratio", "brand", "plain", ft.lagged_features, doubles=["Volume_Ratio"])
_feature_query("fea_7_bb_width", "brand", "plain", _bands, doubles=["BB_Width"])
_feature_query("fea_8_bb_position", "brand", "plain", _bands, doubles=["BB_Position"])
_feature_query("fea_9_price_vs_sma", "brand", "plain", ft.lagged_features, doubles=["Price_vs_SMA10", "Price_vs_SMA20"])
_feature_query("fea_10_calendar", "event", "plain", ft.lagged_features, ints=INTS)
_feature_query("win_1_volume_ma", "brand", "plain", ft.lagged_features, doubles=["Volume_MA"])
_feature_query("win_2_sma", "brand", "plain", ft.lagged_features, doubles=["SMA_10", "SMA_20"])
_feature_query("win_3_volatility", "brand", "plain", _volatility, doubles=["Volatility_10d", "Volatility_20d"])
_feature_query("win_4_rsi", "brand", "feats", _momentum, doubles=["RSI"])
_feature_query("win_5_macd", "brand", "feats", _momentum, doubles=["MACD"])
_feature_query("win_6_macd_signal", "brand", "feats", _momentum, doubles=["MACD_Signal", "MACD_Histogram"])
_feature_query("win_7_bollinger", "brand", "plain", _bands, doubles=["BB_Middle", "BB_Upper", "BB_Lower"])
_feature_query("fea_all_hourly", "event", "feats", ft.history_features, ints=INTS, doubles=DOUBLES)

for _no, _label in enumerate((
        "Unusual_Volume", "Extreme_Price_Move", "Gap_Trading", "After_Hours_Activity",
        "Suspicious_Activity", "Potential_Manipulation", "Target"), 1):
    _feature_query(
        f"lab_{_no}_{_label.lower()}", "event" if _no == 4 else "brand", "labelled", _labelled, ints=[_label])


@query("flagship_unusual_symbols", answer("brand", "plain", """
select symbol, count(*) as n_bars, round(max(abs("Price_Change")) + 3.1e-10, 6) + 0.0 as largest_move,
  round(max("Volume_Ratio") + 3.1e-10, 6) + 0.0 as largest_volume_ratio
from plain where ("Volume_Ratio" > 3 or "Volume_Ratio" < 0.1) and abs("Price_Change") > 0.05 group by 1"""))
def _(spark, folder):
    rows = ft.lagged_features(daily(spark, folder)).rows()
    unusual = (F.col("Volume_Ratio") > 3) | (F.col("Volume_Ratio") < 0.1)
    found = rows.filter(unusual & (F.abs("Price_Change") > 0.05)).groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.max(F.abs("Price_Change")).alias("largest_move"),
        F.max("Volume_Ratio").alias("largest_volume_ratio"))
    return shown(found, "symbol", "n_bars", "largest_move", "largest_volume_ratio")


def _as_answer(columns):
    """Feature columns as doubles, 0 where unknown."""
    return ", ".join(
        f'round(coalesce("{c}", 0)::double + {nudge(3)}, 3) + 0.0 as v_{i:02d}' for i, c in enumerate(columns))


@query("fea_11_feature_vector", answer("priority", "feats", f"select {KEY}, {_as_answer(FEATURES)} from feats"))
def _(spark, folder):
    df = ft.feature_vector(ft.history_features(priority(spark, folder)).rows())
    names = [f"v_{i:02d}" for i in range(len(FEATURES))]
    df = df.withColumns({n: F.col("features")[i] for i, n in enumerate(names)})
    return shown(df, "symbol", "ts", *names, digits=3)


@query("fea_12_missing_features", """
select event_id, case when event_id % 4 = 0 then 'Gap' when event_id % 4 = 1 then 'Hour,RSI' else '' end as missing from events""")
def _(spark, folder):
    """Feature dictionaries checked against the stored feature list."""
    v = F.col("event_id") % 4
    names = F.filter(F.array(*[F.lit(c) for c in FEATURES]), lambda c: ~(
        ((v == 0) & (c == "Gap")) | ((v == 1) & c.isin("RSI", "Hour"))))
    given = table(spark, folder, "events").select(
        "event_id", F.map_from_arrays(names, F.transform(names, lambda c: F.col("value"))).alias("given"))
    return given.select("event_id", F.concat_ws(",", F.array_sort(sp.missing_features("given"))).alias("missing"))


@query("fea_13_finite", """
select event_id, case when event_id % 5 in (0, 1, 2) then null else round(value + 3.1e-10, 6) + 0.0 end as x from events""")
def _(spark, folder):
    v = F.col("event_id") % 5
    bad = table(spark, folder, "events").select("event_id", F.when(v == 0, float("inf")).when(
        v == 1, float("-inf")).when(v == 2, float("nan")).otherwise(F.col("value")).alias("x"))
    return shown(ft.finite_features(bad, ["x"]), "event_id", "x")


_KNOWN = " and ".join(f'"{c}" is not null' for c in FEATURES)


@query("fea_14_complete_rows", answer("brand", "feats", f"""
select symbol, count(*) filter ("RSI" is not null and "MACD" is not null and "BB_Position" is not null and "Price_Change" is not null) as key_complete,
  count(*) filter ({_KNOWN}) as all_complete from feats group by 1"""))
def _(spark, folder):
    kept = ft.complete_rows(ft.history_features(daily(spark, folder)).rows())
    known = F.lit(True)
    for c in FEATURES:
        known = known & F.col(c).isNotNull()
    return kept.groupBy("symbol").agg(
        F.count("*").alias("key_complete"), F.count_if(known).alias("all_complete"))


_MEANED = [c for c in FEATURES if ft.default_of(c) is None]
_FILLS = ", ".join(
    f'coalesce("{c}", avg("{c}") over (partition by symbol), 0)::double as "{c}"' if c in _MEANED
    else f'coalesce("{c}", {dict(RSI=50, BB_Position=0.5, Volume_Ratio=1).get(c, 0)})::double as "{c}"'
    for c in FEATURES)
_FILLED = f"""
filled as materialized (select symbol, ts, seq, open, high, low, close, volume, n_rows, {_FILLS} from feats)"""


@query("fea_15_default_fill", answer("brand", "feats", f"select {KEY}, {r(*FEATURES)} from filled", _FILLED))
def _(spark, folder):
    return shown(ft.fill_defaults(ft.history_features(daily(spark, folder))), "symbol", "ts", *FEATURES)


@query("fea_16_dataset", answer("brand", "labelled", f"""
select {KEY}, {r(*DOUBLES)}{_ints(INTS)}, "Target" from labelled where {_KNOWN}"""))
def _(spark, folder):
    return shown(dataset(spark, folder), "symbol", "ts", *FEATURES, "Target")


def with_gaps(bars):
    """Bars with closes, highs and volumes knocked out by date: NULL, NaN and infinite."""
    day = F.floor(F.unix_seconds("ts") / 86400)
    return bars.withColumns({
        "close": F.when(day % 11 == 3, None).when(day % 11 == 5, float("nan")).otherwise(F.col("close")),
        "high": F.when(day % 13 == 2, float("inf")).otherwise(F.col("high")),
        "volume": F.when(day % 17 != 1, F.col("volume"))})


@query("fea_16_dataset_with_gaps", answer("gaps", "labelled", f"""
select {KEY}, {r(*DOUBLES)}{_ints(INTS)}, "Target" from labelled where {_KNOWN}"""))
def _(spark, folder):
    """Spoiled bars leave the series as if they had not been there."""
    return shown(dataset(spark, folder, with_gaps), "symbol", "ts", *FEATURES, "Target")


@query("src_20_price_gaps", answer("gaps", "bars", """
select symbol, count(*) as n_bars, count(*) filter ((symbol, ts) not in (select (symbol, ts) from bars)) as n_left_out from whole group by 1"""))
def _(spark, folder):
    return price_gaps(with_gaps(bars_brand(spark, folder)))


def dataset(spark, folder, spoil=lambda bars: bars):
    """Complete training rows: key, features and label."""
    rows = ft.complete_rows(_labelled(lay_out(spoil(bars_brand(spark, folder)), DAILY_ROWS)).rows())
    return rows.select("symbol", "ts", "seq", "open", "high", "low", "close", "volume", *FEATURES, "Target").dropna(
        subset=list(FEATURES))


_LAST = "qualify row_number() over (partition by symbol order by ts desc, seq desc) = 1"


@query("fea_17_market_data", answer("brand", "feats", f"""
select symbol, {r("open", "high", "low", "close")}, volume, round("Price_Change" + 3.1e-10, 6) + 0.0 as price_change,
  round("Volume_Ratio" + 3.1e-10, 6) + 0.0 as volume_ratio, round("RSI" + 3.1e-10, 6) + 0.0 as rsi, round("MACD" + 3.1e-10, 6) + 0.0 as macd,
  round("BB_Position" + 3.1e-10, 6) + 0.0 as bb_position from filled {_LAST}""", _FILLED))
def _(spark, folder):
    df = ft.latest_features(ft.history_features(daily(spark, folder)))
    flat = df.select("symbol", ft.market_data().alias("m")).select("symbol", "m.*")
    return shown(flat, *flat.columns)


# --------------------------------------------------------- single-point modes
def bars_customer(spark, folder):
    """Daily bars per customer: short histories, many of one bar only."""
    ticks = table(spark, folder, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 50).alias("qty"), "o_orderkey")
    bars = ticks_to_bars(ticks, "day", "o_orderkey")
    return bars.withColumn("previous_close", F.when(F.col("volume") % 3 != 0, F.col("open") * 0.97))


_CUSTOMER = """
bars as materialized (
  select 'C' || o_custkey as symbol, date_trunc('day', o_orderdate)::timestamp as ts, arg_min(o_totalprice, o_orderkey) as open,
    max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close,
    sum(o_custkey % 50)::bigint as volume, 0::bigint as seq,
    case when sum(o_custkey % 50) % 3 <> 0 then arg_min(o_totalprice, o_orderkey) * 0.97 end as previous_close
  from orders group by 1, 2)"""


def single_columns(mode: str) -> dict[str, str]:
    """SQL of one-bar features over columns open..volume, previous_close, ts."""
    pc = "coalesce(case when previous_close > 0 then (close - previous_close) / previous_close end, 0)"
    gap = "coalesce(case when previous_close > 0 then (open - previous_close) / previous_close end, 0)"
    rng = "case when close > 0 then (high - low) / close else 0 end"
    vpr = "case when close > 0 then volume / close else 0 end"
    given = {"Price_Change": pc, "Gap": gap, "Price_Range": rng, "Volume_Price_Ratio": vpr}
    if mode == "simple":
        vol = f"case when {rng} <> 0 then abs({rng}) else 0.01 end"
        given |= {
            "RSI": "50", "BB_Width": "close * 0.04", "BB_Position": "0.5", "Volume_Ratio": "1",
            "Volatility_10d": vol, "Volatility_20d": vol, "Hour": "extract(hour from ts)",
            "DayOfWeek": "isodow(ts) - 1", "IsMonday": "(isodow(ts) = 1)::int", "IsFriday": "(isodow(ts) = 5)::int"}
    else:
        given |= {
            "RSI": f"case when {pc} > 0.02 then 70 when {pc} < -0.02 then 30 else greatest(0, least(100, 50 + 1000 * {pc})) end",
            "MACD": f"10 * {pc}", "MACD_Signal": f"8 * {pc}", "MACD_Histogram": f"2 * {pc}",
            "BB_Position": "0.5", "BB_Width": f"case when {rng} > 0 then 4 * {rng} else 0.04 end",
            "Volume_Ratio": "case when volume > 0 then 1.25 else 1 end"}
    return {c: f"({given.get(c, '0')})::double" for c in FEATURES}


def _single(mode: str) -> str:
    return ", ".join(f'round({value} + 3.1e-10, 6) + 0.0 as "{c}"' for c, value in single_columns(mode).items())


_PREVIOUS = """
pointed as (select *, lag(close) over (partition by symbol order by ts, seq) as previous_close from bars)"""


@query("fea_19_simple_mode", answer("event", "bars", f"select {KEY}, {_single('simple')} from pointed", _PREVIOUS))
def _(spark, folder):
    df = sp.simple_features(sp.with_previous_close(bars_event(spark, folder)))
    return shown(df, "symbol", "ts", *FEATURES)


@query("fea_20_enhanced_mode", answer("event", "bars", f"select {KEY}, {_single('enhanced')} from pointed", _PREVIOUS))
def _(spark, folder):
    df = sp.enhanced_features(sp.with_previous_close(bars_event(spark, folder)))
    return shown(df, "symbol", "ts", *FEATURES)


_PC = "coalesce(case when previous_close > 0 then (close - previous_close) / previous_close end, 0)"
_IN = "case when open > 0 then (close - open) / open else 0 end"


@query("fea_21_impact_momentum", answer("event", "bars", f"""
select {KEY}, {r(*sp.EXTRAS, digits=9)} from (
  select *, volume * abs({_PC}) / 1000000 as "Market_Impact", 1.0::double / greatest(volume, 1000) as "Liquidity_Risk",
    {_IN} as "Intraday_Return", {_PC} + 0.5 * {_IN} as "Momentum_Score" from pointed)""", _PREVIOUS))
def _(spark, folder):
    df = sp.enhanced_features(sp.with_previous_close(bars_event(spark, folder)))
    return shown(df, "symbol", "ts", *sp.EXTRAS, digits=9)


@query("fea_22_previous_close", answer("event", "bars", f"""
select {KEY}, round(coalesce(previous_close, close) + 3.1e-10, 6) + 0.0 as feature_rule, round(coalesce(previous_close, 0) + 3.1e-10, 6) + 0.0 as loader_rule
from pointed""", _PREVIOUS))
def _(spark, folder):
    bars = sp.with_previous_close(bars_event(spark, folder))
    rules = {"feature_rule": "close", "loader_rule": 0.0}
    both = bars.withColumns({name: sp.previous_close(other) for name, other in rules.items()})
    return shown(both, "symbol", "ts", *rules)


def _mode_answer(mode):
    steps = answer("event", "feats", "", _FILLED).replace(
        answer("event", "bars", "").split("with recursive", 1)[1].rstrip("\n"), _CUSTOMER, 1)
    return steps + f"""
select symbol, n_rows as points, 'full' as mode, {r(*FEATURES)} from filled where n_rows > 1 {_LAST}
union all
select symbol, 1 as points, '{mode}' as mode, {_single(mode)} from (select *, count(*) over (partition by symbol) as k from bars) where k = 1"""


for _batch, _mode in ((False, "simple"), (True, "enhanced")):
    def _by_mode(spark, folder, batch=_batch):
        df = sp.features_by_mode(bars_customer(spark, folder), batch, DAILY_ROWS)
        return shown(df, "symbol", "points", "mode", *FEATURES)

    query(f"fea_18_dispatch_{_mode}", _mode_answer(_mode))(_by_mode)


# -------------------------------------------------------------------- windows
def tick_series(spark, folder, rows_per_task=2048, halo=1024):
    """Single ticks per type and, as one hot symbol, of all types together.

    The small ``rows_per_task`` makes the hot one go through the chunked layout.
    """
    ticks = event_ticks(spark, folder).select(
        F.explode(F.array("symbol", F.lit("ALL"))).alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.col("price").alias("close"), F.col("qty").alias("volume"))
    return lay_out(ticks, rows_per_task=rows_per_task, halo=halo)


_TICKS = """
both_ways as (select event_type as symbol, ts, event_id, value from events union all select 'ALL', ts, event_id, value from events),
ticks as materialized (select symbol, event_id as seq, value as close, row_number() over (partition by symbol order by ts, event_id) as rn from both_ways),
walk as (
  select symbol, seq, rn, close, close as ema from ticks where rn = 1
  union all
  select t.symbol, t.seq, t.rn, t.close, w.ema * 11 / 13 + t.close * 2 / 13 from walk w join ticks t on t.symbol = w.symbol and t.rn = w.rn + 1)"""


@query("win_8_ema", "with recursive" + _TICKS + """
select symbol, seq, rn, round(ema + 3.1e-10, 6) + 0.0 as ema from walk""")
def _(spark, folder):
    """Over single ticks, with the long symbols laid out in chunks."""
    series = tick_series(spark, folder)
    df = series.on(with_averages(series, [Average.span("ema", "close", 12)])).rows()
    return shown(df, "symbol", "seq", "rn", "ema")


@query("win_8_ema_spans", "with recursive" + _TICKS.split("walk as (")[0] + ", ".join(f"""
walk{s} as (
  select symbol, seq, rn, close as ema from ticks where rn = 1
  union all
  select t.symbol, t.seq, t.rn, w.ema * {s - 1} / {s + 1}::double + t.close * 2 / {s + 1} from walk{s} w join ticks t on t.symbol = w.symbol and t.rn = w.rn + 1)"""
    for s in (2, 100, 200)) + """
select symbol, seq, rn, """ + ", ".join(f"round(walk{s}.ema + 3.1e-10, 6) + 0.0 as ema_{s}" for s in (2, 100, 200)) + """
from walk2 join walk100 using (symbol, seq, rn) join walk200 using (symbol, seq, rn)""")
def _(spark, folder):
    """Short and long memories, over chunks with a halo that suits the longest."""
    series = tick_series(spark, folder, 8192, 4096)
    df = series.on(with_averages(series, [Average.span(f"ema_{s}", "close", s) for s in (2, 100, 200)])).rows()
    return shown(df, "symbol", "seq", "rn", "ema_2", "ema_100", "ema_200")


def _adjusted(span, short):
    n = f"least({span}, n_rows)" if short else str(span)
    keep = f"(1 - 2.0::double / ({n} + 1))"
    # Weighted sum over all earlier rows; what is older than 800 rows weighs nothing.
    return f"""
e{span}{'s' if short else ''} as materialized (
  select a.symbol, a.rn, sum(b.close * pow({keep.replace('n_rows', 'a.n_rows')}, a.rn - b.rn)) / sum(pow({keep.replace('n_rows', 'a.n_rows')}, a.rn - b.rn)) as v
  from numbered a join numbered b on a.symbol = b.symbol and b.rn between a.rn - 800 and a.rn group by 1, 2)"""


for _short, _name in ((False, "win_9_ema_adjusted"), (True, "win_9_ema_adjusted_short")):
    def _smoothed(spark, folder, short=_short):
        rows = ft.smoothed_closes(hourly(spark, folder), short).rows()
        return shown(rows, "symbol", "ts", "EMA_12", "EMA_26")

    _s = "s" if _short else ""
    query(_name, answer("event", "numbered", f"""
select {KEY}, round(e12{_s}.v + 3.1e-10, 6) + 0.0 as "EMA_12", round(e26{_s}.v + 3.1e-10, 6) + 0.0 as "EMA_26"
from numbered join e12{_s} using (symbol, rn) join e26{_s} using (symbol, rn)""", _adjusted(12, _short), _adjusted(26, _short)))(_smoothed)


@query("win_10_lag", answer("brand", "numbered", f"""
select {KEY}, round(pc + 3.1e-10, 6) + 0.0 as prev_close, pv as prev_volume from numbered"""))
def _(spark, folder):
    rows = ft.lagged_features(daily(spark, folder)).rows()
    return shown(rows, "symbol", "ts", "prev_close", "prev_volume")


@query("win_11_latest_row", answer("brand", "bars", f"select {KEY}, {r('close')}, volume from bars {_LAST}"))
def _(spark, folder):
    return shown(ft.latest_row(bars_brand(spark, folder)), "symbol", "ts", "close", "volume")


# ------------------------------------------------------- sorts, sets, counting
@query("srt_1_sorted_position", answer("brand", "bars", f"""
select {KEY}, row_number() over (order by symbol, ts, seq) as position from bars"""))
def _(spark, folder):
    """Position in the (symbol, time) order, numbered range by range."""
    rows = number_by_sort(bars_brand(spark, folder).withColumn("all", F.lit(1)), ["all"], ["symbol", "ts", "seq"])
    return shown(rows.withColumnRenamed("rn", "position"), "symbol", "ts", "position")


@query("srt_2_first_symbols", answer("brand", "bars", """
select symbol, count(*) as n_bars from bars where symbol in (select distinct symbol from bars order by 1 limit 10) group by 1"""))
def _(spark, folder):
    bars = bars_brand(spark, folder)
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars")).orderBy("symbol").limit(10)


@query("srt_3_arg_max", answer("brand", "bars", f"""
select {KEY}, volume from bars qualify row_number() over (partition by symbol order by volume desc, ts) = 1"""))
def _(spark, folder):
    best = F.max_by(F.struct("ts", "volume"), F.struct(F.col("volume"), -F.unix_micros("ts")))
    return shown(bars_brand(spark, folder).groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*"), "symbol", "ts", "volume")


@query("set_1_union", """
select 'brand' as origin, symbol, count(*) as n_bars, sum(volume)::bigint as volume from (""" + answer("brand", "bars", "select * from bars") + """) group by 1, 2
union all select 'event', symbol, count(*), sum(volume)::bigint from (""" + answer("event", "bars", "select * from bars") + """) group by 1, 2
union all select 'priority', symbol, count(*), sum(volume)::bigint from (""" + answer("priority", "bars", "select * from bars") + """) group by 1, 2""")
def _(spark, folder):
    frames = [
        bars(spark, folder).withColumn("origin", F.lit(name))
        for name, bars in (("brand", bars_brand), ("event", bars_event), ("priority", bars_priority))]
    union = frames[0].unionByName(frames[1], allowMissingColumns=True).unionByName(frames[2], allowMissingColumns=True)
    return union.groupBy("origin", "symbol").agg(F.count("*").alias("n_bars"), F.sum("volume").alias("volume"))


@query("agg_1_points", answer("brand", "bars", """
select symbol, count(*) as points, sum(count(*)) over ()::bigint as total_points, count(*) over () as n_symbols from bars group by 1"""))
def _(spark, folder):
    points = bars_brand(spark, folder).groupBy("symbol").agg(F.count("*").alias("points"))
    return attach(points, points.agg(F.sum("points").alias("total_points"), F.count("*").alias("n_symbols")))


@query("agg_2_ranges", answer("brand", "bars", """
select symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
  round(min(close) + 3.1e-10, 6) + 0.0 as low_close, round(max(close) + 3.1e-10, 6) + 0.0 as high_close from bars group by 1"""))
def _(spark, folder):
    df = bars_brand(spark, folder).groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("close").alias("low_close"), F.max("close").alias("high_close"))
    return shown(df, *df.columns)


@query("agg_3_distinct_symbols", answer("brand", "bars", "select count(distinct symbol) as n_symbols from bars"))
def _(spark, folder):
    return bars_brand(spark, folder).agg(F.countDistinct("symbol").alias("n_symbols"))


@query("agg_3_distinct_users", """
select coalesce(strftime(ts, '%Y-%m-%d'), 'all') as day, count(distinct user_id) as n_users, true as is_near
from events group by grouping sets ((strftime(ts, '%Y-%m-%d')), ())""")
def _(spark, folder):
    """Sketches per day, stored, and their union: estimates against exact counts, per day and in all."""
    events = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = scratch(spark, "distinct")
    summaries.distinct_summaries(events, "user_id", ["day"]).write.parquet(path)
    kept = spark.read.parquet(path)
    estimates = summaries.merged_distinct(kept, ["day"]).unionByName(
        summaries.merged_distinct(kept).withColumn("day", F.lit("all")))
    exact = events.rollup("day").agg(F.countDistinct("user_id").alias("n_users")).withColumn("day", F.coalesce("day", F.lit("all")))
    return exact.join(estimates, "day").select(
        "day", "n_users", (F.abs(F.col("estimate") - F.col("n_users")) <= summaries.DISTINCT_ERROR * F.col("n_users")).alias("is_near"))
