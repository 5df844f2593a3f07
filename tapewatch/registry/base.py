"""Registration and the common pieces of the SQL answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.operators import scoring as sc
from tapewatch.schema import FEATURES, STORED_PARAMETERS as sp
from tapewatch.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns as answers: time as text, doubles rounded without negative zero.

    Prices are cents over small counts, so many values lie exactly between two
    rounded ones; ``nudge`` moves those to one side for both engines.
    """
    out = []
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        if kind == "timestamp":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        elif kind == "double":
            out.append((F.round(F.col(c) + nudge(digits), digits) + F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def nudge(digits: int) -> float:
    return float(f"3.1e-{digits + 4}")


def r(*columns: str, digits: int = 6) -> str:
    """The SQL twin of ``shown`` for double columns."""
    return ", ".join(f'round("{c}" + {nudge(digits)}, {digits}) + 0.0 as "{c}"' for c in columns)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"
KEY = f"symbol, {TS}"

_BRAND_KEY = "{k1: l_orderkey, k2: l_linenumber, k3: l_partkey, k4: l_suppkey, k5: l_extendedprice}"
BARS = {
    "brand": f"""
bars as materialized (
  select p_brand as symbol, date_trunc('day', l_shipdate)::timestamp as ts,
         arg_min(l_extendedprice / l_quantity, {_BRAND_KEY}) as open,
         max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
         arg_max(l_extendedprice / l_quantity, {_BRAND_KEY}) as close,
         sum(l_quantity)::bigint as volume, 0::bigint as seq
  from lineitem join part on l_partkey = p_partkey group by 1, 2)""",
    "event": """
bars as materialized (
  select event_type as symbol, date_trunc('hour', ts)::timestamp as ts,
         arg_min(value, event_id) as open, max(value) as high, min(value) as low,
         arg_max(value, event_id) as close, count(*)::bigint as volume, 0::bigint as seq
  from events group by 1, 2)""",
    "priority": """
bars as materialized (
  select o_orderpriority as symbol, date_trunc('day', o_orderdate)::timestamp as ts,
         arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
         arg_max(o_totalprice, o_orderkey) as close, count(*)::bigint as volume, 0::bigint as seq
  from orders group by 1, 2)""",
}

# Brand bars without those that ``bar_queries.with_gaps`` spoils.
_DAY = "(epoch(ts)::bigint // 86400)"
BARS["gaps"] = BARS["brand"].replace("bars as materialized", "whole as materialized", 1) + f""",
bars as materialized (select * from whole where {_DAY} % 11 not in (3, 5) and {_DAY} % 13 <> 2 and {_DAY} % 17 <> 1)"""

# Step-by-step recursion: not the block sums the engine uses.
_NUMBERED = """
numbered as materialized (
  select *, row_number() over w as rn, lag(close) over w as pc, lag(volume) over w as pv,
         count(*) over (partition by symbol) as n_rows,
         avg(volume) over (w rows between 19 preceding and current row) as "Volume_MA",
         avg(close) over (w rows between 9 preceding and current row) as "SMA_10",
         avg(close) over (w rows between 19 preceding and current row) as "SMA_20",
         stddev_pop(close) over (w rows between 19 preceding and current row) as sd
  from bars window w as (partition by symbol order by ts, seq))"""
_AVERAGES = """
averages as materialized (
  select symbol, rn, close, 0.0::double as up, 0.0::double as dn, close as fast, close as slow,
         null::double as sig
  from numbered where rn = 1
  union all
  select n.symbol, n.rn, n.close,
         a.up * 13 / 14 + greatest(n.close - a.close, 0) / 14,
         a.dn * 13 / 14 + greatest(a.close - n.close, 0) / 14,
         a.fast * 11 / 13 + n.close * 2 / 13,
         a.slow * 25 / 27 + n.close * 2 / 27,
         case when n.rn < 26 then null
              when n.rn = 26 then (a.fast * 11 / 13 + n.close * 2 / 13) - (a.slow * 25 / 27 + n.close * 2 / 27)
              else a.sig * 0.8 + 0.2 * ((a.fast * 11 / 13 + n.close * 2 / 13) - (a.slow * 25 / 27 + n.close * 2 / 27)) end
  from averages a join numbered n on n.symbol = a.symbol and n.rn = a.rn + 1)"""
_SIMPLE = """
lagged as materialized (
  select *, close / nullif(pc, 0) - 1 as "Price_Change", (high - low) / nullif(close, 0) as "Price_Range",
         (open - pc) / nullif(pc, 0) as "Gap", volume / nullif(pv, 0) - 1 as "Volume_Change",
         volume / nullif(close, 0) as "Volume_Price_Ratio", volume / nullif("Volume_MA", 0) as "Volume_Ratio",
         close / nullif("SMA_10", 0) - 1 as "Price_vs_SMA10", close / nullif("SMA_20", 0) - 1 as "Price_vs_SMA20",
         case when rn >= 20 then "SMA_20" end as "BB_Middle",
         case when rn >= 20 then "SMA_20" + 2 * sd end as "BB_Upper",
         case when rn >= 20 then "SMA_20" - 2 * sd end as "BB_Lower",
         extract(hour from ts)::int as "Hour", (isodow(ts) - 1)::int as "DayOfWeek",
         (isodow(ts) = 1)::int as "IsMonday", (isodow(ts) = 5)::int as "IsFriday"
  from numbered),
plain as materialized (
  select *, ("BB_Upper" - "BB_Lower") / nullif("BB_Middle", 0) as "BB_Width",
         (close - "BB_Lower") / nullif("BB_Upper" - "BB_Lower", 0) as "BB_Position",
         stddev_samp("Price_Change") over (w rows between 9 preceding and current row) as "Volatility_10d",
         stddev_samp("Price_Change") over (w rows between 19 preceding and current row) as "Volatility_20d"
  from lagged window w as (partition by symbol order by ts, seq))"""
_FULL = """
feats as materialized (
  select p.*, case when p.rn >= 14 then case when a.dn = 0 then 100 else 100 - 100 / (1 + a.up / a.dn) end end as "RSI",
         case when p.rn >= 26 then a.fast - a.slow end as "MACD",
         case when p.rn >= 34 then a.sig end as "MACD_Signal",
         case when p.rn >= 34 then a.fast - a.slow - a.sig end as "MACD_Histogram"
  from plain p join averages a using (symbol, rn))"""
_LABELS = """
rules as (
  select *, coalesce("Volume_Ratio" > 3 or "Volume_Ratio" < 0.1, false)::int as "Unusual_Volume",
         coalesce(abs("Price_Change") > 0.05, false)::int as "Extreme_Price_Move",
         coalesce(abs("Gap") > 0.02, false)::int as "Gap_Trading",
         coalesce("Hour" < 9 or "Hour" > 16, false)::int as "After_Hours_Activity",
         coalesce("Volume_Ratio" > 5 and abs("Price_Change") > 0.03 and "BB_Position" > 0.95, false)::int as "Potential_Manipulation"
  from feats),
labelled as materialized (
  select *, ("Unusual_Volume" = 1 and "Extreme_Price_Move" = 1)::int as "Suspicious_Activity",
         (("Unusual_Volume" = 1 and "Extreme_Price_Move" = 1) or "Potential_Manipulation" = 1)::int as "Target"
  from rules)"""
_COMPLETE = " and ".join(f'"{c}" is not null' for c in (
    "Price_Change", "Volume_Ratio", "RSI", "MACD", "BB_Position", "SMA_10", "SMA_20"))

_STEPS = {
    "bars": [],
    "numbered": [_NUMBERED],
    "plain": [_NUMBERED, _SIMPLE],
    "feats": [_NUMBERED, _SIMPLE, _AVERAGES, _FULL],
    "labelled": [_NUMBERED, _SIMPLE, _AVERAGES, _FULL, _LABELS],
}


def answer(view: str, upto: str, body: str, *more: str) -> str:
    """SQL over a bar view carried to the named step, then further CTEs and a body."""
    ctes = [BARS[view], *_STEPS[upto], *more]
    return "with recursive" + ",".join(ctes) + "\n" + body


# ------------------------------------------------------------- scoring answers
def scored_steps(view: str = "brand") -> tuple[str, ...]:
    """CTEs from labelled bars to error, probability and ensemble."""
    known = " and ".join(f'"{c}" is not null' for c in FEATURES)
    hashed = "(('0x' || substr(md5(symbol || '|' || epoch_us(ts) || '|42'), 1, 8))::bigint / 4294967296.0)"
    dataset = f"""
dataset as materialized (
  select *, case when {hashed} < 0.15 then 'test' when {hashed} < 0.15 + 0.85 * 0.176 then 'validation' else 'train' end as part
  from labelled where {known})"""
    stats = ", ".join(
        f'avg("{c}") as "m_{c}", case when stddev_pop("{c}") = 0 then 1 else stddev_pop("{c}") end as "s_{c}"'
        for c in FEATURES)
    scaler = f"""
scaler as (select {stats} from dataset where part = 'train')"""
    z = [f'(("{c}" - "m_{c}") / "s_{c}")' for c in FEATURES]
    named = ", ".join(f"{e} as z{i}" for i, e in enumerate(z))
    scaled = f"""
scaled as materialized (select dataset.*, {named} from dataset, scaler)"""
    flat = " + ".join(f"z{i}" for i in range(20))
    comb = " ".join(f"{'+' if i % 2 == 0 else '-'} z{i}" for i in range(20))
    squares = " + ".join(f"z{i} * z{i}" for i in range(20))
    logit = " + ".join(f"{w} * z{FEATURES.index(c)}" for c, w in sc.LOGIT_WEIGHTS.items())
    # Orthonormal directions: the residual is the norm less the two projections.
    modelled = f"""
modelled as materialized (
  select *, ({squares} - ({flat}) * ({flat}) / 20 - (0 {comb}) * (0 {comb}) / 20) / 20 as error,
    1 / (1 + exp(-({sc.LOGIT_INTERCEPT} + {logit}))) as prob from scaled)"""
    lo, hi = sp["reconstruction_error_min"], sp["reconstruction_error_max"]
    scored = f"""
scored as materialized (
  select *, {sp["best_ensemble_ae_weight"]} * greatest(0, least(1, (error - {lo}) / ({hi} - {lo})))
      + {sp["best_ensemble_clf_weight"]} * prob as ensemble,
    (error > {sp["autoencoder_f1_threshold"]})::int as anomaly from modelled)"""
    return dataset, scaler, scaled, modelled, scored


def scored_answer(body: str, *more: str, view: str = "brand") -> str:
    return answer(view, "labelled", body, *scored_steps(view), *more)
