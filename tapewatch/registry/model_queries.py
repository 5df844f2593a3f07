"""Joins, metrics, split, scaling, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.operators import labels as lb
from tapewatch.operators import lookups as lk
from tapewatch.operators import metrics as mt
from tapewatch.operators import scoring as sc
from tapewatch.operators import summaries as sm
from tapewatch.operators.features import latest_row
from tapewatch.operators.scaling import scaler_statistics, split
from tapewatch.operators.series import DAILY_ROWS
from tapewatch.plans import inference as inf
from tapewatch.plans import training as tr
from tapewatch.registry.bar_queries import _labelled, daily
from tapewatch.registry.base import answer, nudge, query, r, scored_answer, shown
from tapewatch.schema import FEATURES, STORED_PARAMETERS
from tapewatch.session import scratch
from tapewatch.sources.tables import bars_brand, brand_ticks, event_ticks, table


def data(spark, folder):
    return tr.dataset(bars_brand(spark, folder), DAILY_ROWS)


def scores(spark, folder):
    return tr.modelled(data(spark, folder))


def found(spark, folder):
    """Detections of every complete bar, by the closed-form scorer."""
    rows = data(spark, folder)
    return inf.score_features(rows, tr.train_scaler(rows))


def rd(expr: str, name: str, digits: int = 6) -> str:
    return f'round({expr} + {nudge(digits)}, {digits}) + 0.0 as {name}'


_BY_TIME = "symbol, epoch(ts)::bigint as timestamp"


# ----------------------------------------------------------- labels on scores
@query("lab_8_is_suspicious", scored_answer(f"select {_BY_TIME}, ensemble > 0.5 as is_suspicious from scored"))
def _(spark, folder):
    return found(spark, folder).select("symbol", "timestamp", "is_suspicious")


_RISK = "case when ensemble > 0.7 then 'HIGH' when ensemble > 0.3 then 'MEDIUM' else 'LOW' end"


@query("lab_9_risk_level", scored_answer(f"select {_BY_TIME}, {_RISK} as risk_level from scored"))
def _(spark, folder):
    return found(spark, folder).select("symbol", "timestamp", "risk_level")


_CODES = """
coded as materialized (
  select *, concat_ws(',',
    case when "Volume_Ratio" > 5 then 'VOLUME_EXTREME' when "Volume_Ratio" > 3 then 'VOLUME_HIGH' when "Volume_Ratio" < 0.1 then 'VOLUME_LOW' end,
    case when abs("Price_Change") > 0.05 then 'PRICE_MOVE' end,
    case when "RSI" > 80 then 'OVERBOUGHT' when "RSI" < 20 then 'OVERSOLD' end,
    case when "BB_Position" > 0.95 then 'BAND_UPPER' when "BB_Position" < 0.05 then 'BAND_LOWER' end,
    case when "Volatility_10d" > 0.05 then 'VOLATILE' end,
    case when abs("Gap") > 0.02 then 'GAP' end,
    case when ensemble > 0.8 then 'RISK_HIGH' when ensemble > 0.6 then 'RISK_MEDIUM' end,
    case when anomaly = 1 then 'ANOMALY' end,
    case when prob > 0.9 then 'CLASSIFIER' end) as codes
  from scored)"""


@query("lab_10_alerts", scored_answer(f"select {_BY_TIME}, codes from coded", _CODES))
def _(spark, folder):
    return found(spark, folder).select("symbol", "timestamp", F.concat_ws(",", "alert_codes").alias("codes"))


@query("lab_11_alert_counts", scored_answer(
    "select unnest(string_split(codes, ',')) as alert_code, count(*) as n_alerts from coded where codes <> '' group by 1", _CODES))
def _(spark, folder):
    return lb.alert_counts(found(spark, folder))


# --------------------------------------------------------------------- joins
def _brand_requests(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40 + 1).cast("string")).alias("symbol"))


@query("joi_1_latest_for_requests", answer("brand", "bars", """
select o_orderkey as request_id, 'Brand#' || (o_custkey % 40 + 1) as symbol, strftime(l.ts, '%Y-%m-%d %H:%M:%S') as ts, """ + rd("l.close", "close") + """,
  case when l.symbol is null then 'No market data available' end as error
from orders left join (select * from bars qualify row_number() over (partition by symbol order by ts desc) = 1) l on l.symbol = 'Brand#' || (o_custkey % 40 + 1)"""))
def _(spark, folder):
    joined = lk.latest_for_requests(_brand_requests(spark, folder), latest_row(bars_brand(spark, folder)))
    return shown(joined, "request_id", "symbol", "ts", "close", "error")


@query("joi_2_as_of", """
with asked as (select lower(event_type) || case when event_id % 11 = 0 then '?' else '' end as symbol, ts + to_seconds(event_id * 37 % 700) as request_ts from events),
seen as (select event_type as symbol, ts, arg_max(value, event_id) as value from events group by 1, 2)
select asked.symbol, strftime(request_ts, '%Y-%m-%d %H:%M:%S') as request_ts,
  case when epoch_us(request_ts) - epoch_us(seen.ts) < 300000000 then strftime(seen.ts, '%Y-%m-%d %H:%M:%S') end as observed_ts,
  """ + rd("case when epoch_us(request_ts) - epoch_us(seen.ts) < 300000000 then value end", "price") + """
from asked asof left join seen on asked.symbol = seen.symbol and asked.request_ts >= seen.ts""")
def _(spark, folder):
    """Requests up to 700 s after an event; some name an unknown symbol."""
    e = table(spark, folder, "events")
    unknown = F.when(F.col("event_id") % 11 == 0, "?").otherwise("")
    requests = e.select(
        F.concat(F.lower("event_type"), unknown).alias("symbol"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 37 % 700).cast("decimal(18,6)"))).alias("request_ts"))
    ticks = event_ticks(spark, folder).withColumn("seq", F.col("event_id"))
    return shown(lk.as_of(requests, ticks, ["price"]), "symbol", "request_ts", "observed_ts", "price")


@query("joi_2_as_of_hot_symbol", """
with asked as (select event_id as request_id, ts + to_seconds(event_id * 37 % 700) as request_ts from events),
seen as (select ts, arg_max(value, event_id) as value from events group by 1)
select strftime(request_ts, '%Y-%m-%d %H:%M:%S') as request_ts,
  case when epoch_us(request_ts) - epoch_us(seen.ts) < 30000000 then strftime(seen.ts, '%Y-%m-%d %H:%M:%S') end as observed_ts,
  """ + rd("case when epoch_us(request_ts) - epoch_us(seen.ts) < 30000000 then value end", "price") + """
from asked asof left join seen on asked.request_ts >= seen.ts""")
def _(spark, folder):
    """All ticks under one symbol, in pieces far smaller than it."""
    e = table(spark, folder, "events")
    requests = e.select(
        F.lit("all").alias("symbol"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 37 % 700).cast("decimal(18,6)"))).alias("request_ts"))
    ticks = event_ticks(spark, folder).withColumns({"symbol": F.lit("ALL"), "seq": F.col("event_id")})
    found = lk.as_of(requests, ticks, ["price"], max_age=30, rows_per_piece=1000)
    return shown(found, "request_ts", "observed_ts", "price")


def _user_latest(spark, folder, kinds=None):
    e = table(spark, folder, "events")
    if kinds:
        e = e.filter(F.col("event_type").isin(*kinds))
    return latest_row(e.select(
        F.col("user_id").cast("string").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("close")))


@query("joi_3_fallback", """
with a as (select user_id::varchar as symbol, arg_max(value, (ts, event_id)) as close from events where event_type = 'signup' group by 1),
b as (select user_id::varchar as symbol, arg_max(value, (ts, event_id)) as close from events group by 1)
select symbol, """ + rd("coalesce(a.close, b.close)", "close") + """, case when a.symbol is null then 'secondary' else 'primary' end as origin
from b left join a using (symbol)""")
def _(spark, folder):
    both = lk.with_fallback(_user_latest(spark, folder, ["signup"]), _user_latest(spark, folder))
    return shown(both, "symbol", "close", "origin")


@query("joi_4_valid_symbols", """
with last as (select max(ts) as now from events),
recent as (select distinct user_id from events, last where ts > now - interval 1 day)
select distinct e.user_id::varchar as symbol, r.user_id is not null as is_valid from events e left join recent r using (user_id)""")
def _(spark, folder):
    bars = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts")
    now = bars.agg(F.max("ts")).scalar()
    return lk.valid_symbols(bars.select("symbol").distinct(), bars, now)


@query("joi_5_attach_parameters", scored_answer(f"""
select {_BY_TIME}, {rd("(error - lo) / (hi - lo)", "share")} from modelled, (select min(error) as lo, max(error) as hi from modelled)"""))
def _(spark, folder):
    df = scores(spark, folder)
    df = lk.attach(df, mt.error_range(df, "error"))
    share = (F.col("error") - F.col("error_min")) / (F.col("error_max") - F.col("error_min"))
    return shown(df.select("symbol", F.unix_seconds("ts").alias("timestamp"), share.alias("share")), "symbol", "timestamp", "share")


# ------------------------------------------------------------------- metrics
def judged(spark, folder):
    """Labels with the document length as a score."""
    documents = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, folder, "labels").join(documents, "doc_id")


_JUDGED = "judged as (select l.*, n_chars::double as score from labels l join documents using (doc_id))"
_CURVE = """
curve as (
  select t.score as threshold, count(*) filter (j.quality = 1) / count(*) as precision,
    count(*) filter (j.quality = 1) / (select sum(quality) from judged) as recall
  from (select distinct score from judged) t join judged j on j.score >= t.score group by 1
  union all select null, 1, 0)"""
_F1 = "2 * precision * recall / (precision + recall + 1e-10)"


@query("agg_4_class_balance", answer("brand", "labelled", f"""
select count(*) as n_rows, sum("Target")::bigint as positives, {rd('avg("Target") * 100', "percent")} from labelled"""))
def _(spark, folder):
    return shown(mt.class_balance(_labelled(daily(spark, folder)).rows(), "Target"), "n_rows", "positives", "percent")


@query("agg_5_class_weight", f"""
select {rd("count(*) filter (toxic = 0) / count(*) filter (toxic = 1)", "weight")} from labels""")
def _(spark, folder):
    return shown(mt.class_weight(table(spark, folder, "labels"), "toxic"), "weight")


@query("agg_6_scaler", scored_answer(
    "select " + ", ".join(f'round("m_{c}" + {nudge(6)}, 6) + 0.0 as "{c}_mean", round("s_{c}" + {nudge(6)}, 6) + 0.0 as "{c}_scale"' for c in FEATURES) + " from scaler"))
def _(spark, folder):
    df = scaler_statistics(tr.train_rows(data(spark, folder)))
    return shown(df, *df.columns)


@query("agg_7_percentile", f"""
select {rd("quantile_cont(l_extendedprice, 0.85)", "percentile")} from lineitem where l_returnflag <> 'R'""")
def _(spark, folder):
    """Of the normal class only: returned lines stand for the suspicious rows, which the threshold leaves out.

    More values than one task may take, so ranges carry totals on.
    """
    prices = table(spark, folder, "lineitem").filter("l_returnflag <> 'R'")
    return shown(mt.exact_percentile(prices, "l_extendedprice", 85, values_per_task=10_000), "percentile")


@query("agg_7_approximate", """
select p_brand as symbol, count(*) as n, true as is_near from lineitem join part on l_partkey = p_partkey group by 1""")
def _(spark, folder):
    """Summaries per brand and day, stored, then one per brand from them."""
    ticks = brand_ticks(spark, folder).withColumn("day", F.to_date("ts"))
    path = scratch(spark, "quantiles")
    sm.quantile_summaries(ticks, "price", ["symbol", "day"]).write.parquet(path)
    at = sm.merged_quantile(spark.read.parquet(path), 85, ["symbol"])
    return sm.rank_is_near(ticks, "price", at, 85, ["symbol"])


@query("agg_8_report", f"""
with c as (select count(*) filter (score > 500 and quality = 1) as tp, count(*) filter (score > 500 and quality = 0) as fp,
    count(*) filter (score <= 500 and quality = 1) as fn, count(*) filter (score <= 500 and quality = 0) as tn from (select l.*, n_chars as score from labels l join documents using (doc_id))),
q as (select *, tn / (tn + fn) as p0, tn / (tn + fp) as r0, 2 * tn / (2 * tn + fn + fp) as f0, tn + fp as s0,
    tp / (tp + fp) as p1, tp / (tp + fn) as r1, 2 * tp / (2 * tp + fn + fp) as f1, tp + fn as s1 from c),
l as (
  select '0' as label, p0 as p, r0 as rc, f0 as f, s0 as support from q
  union all select '1', p1, r1, f1, s1 from q
  union all select 'accuracy', (tp + tn) / (s0 + s1), (tp + tn) / (s0 + s1), (tp + tn) / (s0 + s1), s0 + s1 from q
  union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 from q
  union all select 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 from q)
select label, {rd("p", "precision")}, {rd("rc", "recall")}, {rd("f", "f1")}, support from l""")
def _(spark, folder):
    called = judged(spark, folder).withColumn("called", (F.col("score") > 500).cast("int"))
    return shown(mt.classification_report(called, "called", "quality"), "label", "precision", "recall", "f1", "support")


@query("agg_8_confusion", """
select toxic as actual, (n_chars > 2000)::int as predicted, count(*) as n_rows from labels join documents using (doc_id) group by 1, 2""")
def _(spark, folder):
    called = judged(spark, folder).withColumn("called", (F.col("score") > 2000).cast("int"))
    return mt.confusion(called, "called", "toxic")


@query("agg_9_auc", f"""
with {_JUDGED}
select {rd("sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) / count(*)", "auc")}
from judged p join judged n on p.quality = 1 and n.quality = 0""")
def _(spark, folder):
    return shown(mt.roc_auc(judged(spark, folder), "score", "quality"), "auc")


@query("agg_10_pr_curve", f"with {_JUDGED}, {_CURVE} select {r('threshold', 'precision', 'recall')} from curve")
def _(spark, folder):
    """Through the range-partitioned running totals."""
    curve = mt.precision_recall(judged(spark, folder), "score", "quality", values_per_task=50)
    return shown(curve, "threshold", "precision", "recall")


@query("agg_10_binned_curve", f"with {_JUDGED}, {_CURVE} select {r('threshold', 'precision', 'recall')} from curve")
def _(spark, folder):
    """A bin per whole number, so the curve by bins is the exact one."""
    counts = sm.binned_counts(judged(spark, folder), "score", "quality", 0.0, float(sm.BLOCKS * sm.BINS_PER_BLOCK))
    return shown(sm.binned_curve(counts), "threshold", "precision", "recall")


@query("agg_10_binned_auc", f"""
with {_JUDGED}, b as (select floor(score / 64) as bin, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg from judged group by 1),
t as (select pos, neg, coalesce(sum(neg) over (order by bin rows between unbounded preceding and 1 preceding), 0) as below from b),
a as (select sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auc, sum(pos * neg / 2.0) / (sum(pos) * sum(neg)) as error_bound from t)
select {r("auc", "error_bound")}, true as holds from a""")
def _(spark, folder):
    """Bins of 64 characters, and whether the exact area lies within the bound."""
    df = judged(spark, folder)
    counts = sm.binned_counts(df, "score", "quality", 0.0, 64.0 * sm.BLOCKS * sm.BINS_PER_BLOCK)
    both = lk.attach(sm.binned_auc(counts), mt.roc_auc(df, "score", "quality").withColumnRenamed("auc", "exact"))
    holds = F.abs(F.col("auc") - F.col("exact")) <= F.col("error_bound") + 1e-12
    return shown(both.withColumn("holds", holds), "auc", "error_bound", "holds")


@query("agg_11_best_threshold", f"""
with {_JUDGED}, {_CURVE}, s as (select *, {_F1} as score from curve)
select {r('threshold', 'precision', 'recall', 'score')} from s order by s.score desc, threshold limit 1""")
def _(spark, folder):
    best = mt.best_threshold(mt.precision_recall(judged(spark, folder), "score", "quality"))
    return shown(best, "threshold", "precision", "recall", "score")


@query("agg_12_precision_threshold", f"""
with {_JUDGED}, {_CURVE}, t as (select coalesce(min(threshold) filter (precision >= 0.9), 0.5) as threshold from curve)
select {rd("threshold", "threshold")}, {rd("sum(quality) filter (score > threshold) / count(*) filter (score > threshold)", "precision")},
  {rd("sum(quality) filter (score > threshold) / sum(quality)", "recall")} from judged, t group by t.threshold""")
def _(spark, folder):
    rows = judged(spark, folder)
    threshold = mt.precision_threshold(mt.precision_recall(rows, "score", "quality"), 0.9)
    return shown(mt.strictly_above(rows, "score", "quality", threshold), "threshold", "precision", "recall")


_GRID = """
held as materialized (select "Target" as y, error, prob, (select min(error) from modelled where part = 'validation') as lo,
    (select max(error) from modelled where part = 'validation') as hi from modelled where part = 'validation'),
weights as (select * from (values (0, 0.3::double, 0.7::double), (1, 0.4, 0.6), (2, 0.5, 0.5), (3, 0.6, 0.4)) w(pair, ae_weight, clf_weight)),
hybrid as materialized (select weights.*, y, ae_weight * (error - lo) / (hi - lo) + clf_weight * prob as score from held, weights),
points as (
  select pair, ae_weight, clf_weight, score, sum(sum(y)) over w as tp, sum(count(*)) over w as called, sum(sum(y)) over (partition by pair) as positives
  from hybrid group by 1, 2, 3, 4 window w as (partition by pair order by score desc)),
graded as (select *, 2 * (tp / called) * (tp / positives) / (tp / called + tp / positives + 1e-10) as f1 from points)"""


@query("agg_13_best_weights", scored_answer(f"""
select {rd("ae_weight", "ae_weight")}, {rd("clf_weight", "clf_weight")}, {rd("score", "threshold")}, {rd("f1", "f1")}
from graded order by graded.f1 desc, pair, score limit 1""", _GRID))
def _(spark, folder):
    held = scores(spark, folder).filter(F.col("part") == "validation")
    best = mt.best_weights(held, "error", "classifier_probability", "Target")
    return shown(best, "ae_weight", "clf_weight", "threshold", "f1")


@query("agg_14_error_range", scored_answer(f"""
select part, {rd("min(error)", "error_min")}, {rd("max(error)", "error_max")} from modelled group by 1"""))
def _(spark, folder):
    df = scores(spark, folder).groupBy("part").agg(F.min("error").alias("error_min"), F.max("error").alias("error_max"))
    return shown(df, "part", "error_min", "error_max")


def _request_results(spark, folder):
    rows = data(spark, folder)
    last = latest_row(rows)
    detected = inf.score_features(last, tr.train_scaler(rows))
    return inf.score_requests(_brand_requests(spark, folder).select("symbol"), detected)


@query("agg_15_batch_summary", """
with b as (select distinct p_brand from part)
select count(b.p_brand) as processed_count, count(*) - count(b.p_brand) as failed_count
from orders left join b on p_brand = 'Brand#' || (o_custkey % 40 + 1)""")
def _(spark, folder):
    return inf.batch_summary(_request_results(spark, folder))


@query("agg_15_batch_errors", """
select 'Brand#' || (o_custkey % 40 + 1) as symbol, 'Error: No market data available' as message, count(*) as n_requests
from orders where 'Brand#' || (o_custkey % 40 + 1) not in (select p_brand from part) group by 1""")
def _(spark, folder):
    return inf.batch_errors(_request_results(spark, folder)).groupBy("symbol", "message").agg(
        F.count("*").alias("n_requests"))


@query("agg_16_feed_status", """
with now as (select max(ts) as now from events),
asked as (select distinct o_custkey % 400 as user_id from orders),
last as (select user_id, max(ts) as last_ts from events group by 1)
select a.user_id::varchar as symbol, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_update,
  """ + rd("(epoch_us(now) - epoch_us(last_ts)) / 60e6", "minutes_old") + """,
  case when last_ts is null then 'UNKNOWN' when (epoch_us(now) - epoch_us(last_ts)) / 60e6 > 30 then 'CLOSED' else 'OPEN' end as status
from asked a left join last using (user_id), now""")
def _(spark, folder):
    e = table(spark, folder, "events")
    asked = table(spark, folder, "orders").select((F.col("o_custkey") % 400).cast("string").alias("symbol")).distinct()
    last = e.groupBy(F.col("user_id").cast("string").alias("symbol")).agg(F.max("ts").alias("last_update"))
    df = asked.join(last, "symbol", "left")
    return shown(df.withColumns(lk.feed_status(F.col("last_update"), e.agg(F.max("ts")).scalar())),
                 "symbol", "last_update", "minutes_old", "status")


# -------------------------------------------------------------------- models
@query("mod_1_split", scored_answer(f"select {_BY_TIME}, part from dataset"))
def _(spark, folder):
    return data(spark, folder).select("symbol", F.unix_seconds("ts").alias("timestamp"), "part")


@query("mod_1_split_shares", """
with u as (select toxic, ('0x' || substr(md5(doc_id || '|42'), 1, 8))::bigint / 4294967296.0 as u from labels)
select toxic, case when u < 0.15 then 'test' when u < 0.15 + 0.85 * 0.176 then 'validation' else 'train' end as part, count(*) as n_rows
from u group by 1, 2""")
def _(spark, folder):
    return split(table(spark, folder, "labels"), F.col("doc_id")).groupBy("toxic", "part").agg(F.count("*").alias("n_rows"))


@query("mod_2_standardise", scored_answer(
    f"select {_BY_TIME}, part, " + ", ".join(rd(f"z{i}", f'"z_{c}"', 5) for i, c in enumerate(FEATURES)) + " from scaled"))
def _(spark, folder):
    df = tr.scaled(data(spark, folder)).withColumn("timestamp", F.unix_seconds("ts"))
    return shown(df, "symbol", "timestamp", "part", *[f"z_{c}" for c in FEATURES], digits=5)


@query("mod_5_reconstruction_error", scored_answer(f"select {_BY_TIME}, {rd('error', 'error')} from modelled"))
def _(spark, folder):
    df = scores(spark, folder).withColumn("timestamp", F.unix_seconds("ts"))
    return shown(df, "symbol", "timestamp", "error")


_THRESHOLD = """
cutoff as (select quantile_cont(error, 0.85) as percentile from modelled where part = 'validation' and "Target" = 0)"""


@query("mod_6_anomaly_threshold", scored_answer(f"select {r('percentile')} from cutoff", _THRESHOLD))
def _(spark, folder):
    return shown(tr.anomaly_threshold(scores(spark, folder)), "percentile")


@query("mod_7_training_ensemble", scored_answer(f"""
select {_BY_TIME}, {rd("0.4 * (error > percentile)::int + 0.6 * prob", "ensemble")} from modelled, cutoff""", _THRESHOLD))
def _(spark, folder):
    rows = scores(spark, folder)
    df = lk.attach(rows, tr.anomaly_threshold(rows))
    score = sc.training_ensemble(F.col("error"), F.col("classifier_probability"), F.col("percentile"))
    return shown(df.select("symbol", F.unix_seconds("ts").alias("timestamp"), score.alias("ensemble")),
                 "symbol", "timestamp", "ensemble")


@query("mod_8_scoring_ensemble", scored_answer(f"select {_BY_TIME}, {rd('ensemble', 'ensemble_score')}, anomaly as anomaly_score from scored"))
def _(spark, folder):
    return shown(found(spark, folder), "symbol", "timestamp", "ensemble_score", "anomaly_score")


@query("mod_9_hybrid_scores", scored_answer(f"""
select {rd("ae_weight", "ae_weight")}, y as target, count(*) as n_rows, {rd("sum(score)", "total", 4)}, {rd("max(score)", "highest")} from hybrid group by ae_weight, y""", _GRID))
def _(spark, folder):
    held = scores(spark, folder).filter(F.col("part") == "validation")
    grid = mt.hybrid_scores(held, "error", "classifier_probability").groupBy("ae_weight", F.col("Target").alias("target")).agg(
        F.count("*").alias("n_rows"), F.sum("hybrid").alias("total"), F.max("hybrid").alias("highest"))
    grid = shown(grid.withColumn("total", F.round(F.col("total") + nudge(4), 4)), "ae_weight", "target", "n_rows", "total", "highest")
    return grid.withColumn("total", F.round("total", 4))




@query("mod_10_detections", scored_answer(f"""
select {_BY_TIME}, {rd('ensemble', 'ensemble_score')}, {rd('prob', 'classifier_probability')}, anomaly as anomaly_score,
  ensemble > 0.5 as is_suspicious, {_RISK} as risk_level, codes, {rd('close', 'close')}, volume, {rd('"RSI"', 'rsi')}, {rd('"MACD"', 'macd')} from coded""", _CODES))
def _(spark, folder):
    df = found(spark, folder).select(
        "*", "market_data.close", "market_data.volume", "market_data.rsi", "market_data.macd",
        F.concat_ws(",", "alert_codes").alias("codes"))
    return shown(df, "symbol", "timestamp", "ensemble_score", "classifier_probability", "anomaly_score",
                 "is_suspicious", "risk_level", "codes", "close", "volume", "rsi", "macd")


_TESTED = _THRESHOLD + """,
tested as (
  select 'ensemble' as model, "Target" as y, 0.4 * (error > percentile)::int + 0.6 * prob as score, (0.4 * (error > percentile)::int + 0.6 * prob > 0.5)::int as called from modelled, cutoff where part = 'test'
  union all select 'classifier', "Target", prob, (prob > 0.5)::int from modelled where part = 'test'
  union all select 'autoencoder', "Target", error, (error > percentile)::int from modelled, cutoff where part = 'test'),
counted as (select model, count(*) as n_rows, sum(y)::bigint as positives, count(*) filter (y = 1 and called = 1) as tp,
    count(*) filter (y = 0 and called = 1) as fp, count(*) filter (y = called) as rt from tested group by 1),
ranked as (select model, sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) / count(*) as auc
  from tested p join tested n using (model) where p.y = 1 and n.y = 0 group by 1)"""


@query("mod_11_evaluation", scored_answer(f"""
select model, n_rows, positives, {rd("rt / n_rows", "accuracy")}, {rd("coalesce(tp / nullif(tp + fp, 0), 0)", "precision")}, {rd("tp / positives", "recall")},
  {rd("2 * tp / (tp + fp + positives)", "f1_score")}, {rd("auc", "auc_score")} from counted join ranked using (model)""", _TESTED))
def _(spark, folder):
    rows = scores(spark, folder)
    report = tr.evaluate(tr.predictions(rows, tr.anomaly_threshold(rows)))
    return shown(report, *report.columns)


@query("mod_13_model_metrics", scored_answer(f"""
select {rd("rt / n_rows", "accuracy")}, {rd("coalesce(tp / nullif(tp + fp, 0), 0)", "precision")}, {rd("tp / positives", "recall")},
  {rd("2 * tp / (tp + fp + positives)", "f1_score")}, {rd("auc", "auc_score")} from counted join ranked using (model) where model = 'ensemble'""", _TESTED))
def _(spark, folder):
    rows = scores(spark, folder)
    report = tr.evaluate(tr.predictions(rows, tr.anomaly_threshold(rows))).filter("model = 'ensemble'")
    return shown(report, "accuracy", "precision", "recall", "f1_score", "auc_score")


@query("mod_12_score_given", scored_answer(f"""
select {_BY_TIME}, case when keep then 0.4 * (error > {STORED_PARAMETERS['autoencoder_f1_threshold']})::int + 0.6 * prob > 0.5 end as is_suspicious,
  case when keep then round(prob + {nudge(6)}, 6) + 0.0 end as classifier_probability,
  case when not keep then 'Missing features: Gap' end as error
from (select *, epoch(ts)::bigint // 86400 % 10 <> 0 as keep from modelled)"""))
def _(spark, folder):
    """Each bar's features as a dictionary; every tenth day lacks one."""
    rows = data(spark, folder)
    keep = F.floor(F.unix_seconds("ts") / 86400) % 10 != 0
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in FEATURES])
    given = F.map_from_entries(F.filter(pairs, lambda p: keep | (p["k"] != "Gap")))
    asked = rows.select("symbol", F.unix_seconds("ts").alias("timestamp"), given.alias("given"))
    return shown(inf.score_given(asked, "given", tr.train_scaler(rows)),
                 "symbol", "timestamp", "is_suspicious", "classifier_probability", "error")


@query("src_24_error_rows", """
select distinct 'Brand#' || (o_custkey % 40 + 1) as symbol, 0.0::double as ensemble_score, 0.0::double as classifier_probability, 0 as anomaly_score, false as is_suspicious,
  'ERROR' as risk_level, 'Error: No market data available' as alerts
from orders where 'Brand#' || (o_custkey % 40 + 1) not in (select p_brand from part)""")
def _(spark, folder):
    missing = lk.latest_for_requests(
        _brand_requests(spark, folder).select("symbol").distinct(), latest_row(bars_brand(spark, folder)))
    failed = lk.error_rows(missing.filter(F.col("error").isNotNull()), F.col("error"))
    return failed.withColumn("alerts", F.concat_ws(",", "alerts"))
