"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof, volatility
from tidemark.sources.prices import daily_closes

KEYS = ("instrument_id", "session_date", "price", "regime", "target_start", "target_end", "n_obs", "model", "measure", "horizon", "split", "role")


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[c if c in KEYS else F.round(c, 6 if "zscore" in c else 8).alias(c) for c in frame.columns])


def rv_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.returns(daily_closes(spark, sf_dir)))


def rv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.features(daily_closes(spark, sf_dir)))


def rv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.report(daily_closes(spark, sf_dir)))


def rv_naive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.naive_errors(volatility.report(daily_closes(spark, sf_dir))))


def rv_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{m}_forecast_annualized_{x}" for m in ("naive", "ewma") for x in ("variance", "volatility")]
    return _rounded(volatility.backtest(daily_closes(spark, sf_dir)).select("instrument_id", "session_date", *names, "regime"))


def rv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.metrics(volatility.backtest(daily_closes(spark, sf_dir)), ("naive", "ewma")))


def rv_regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.metrics(volatility.backtest(daily_closes(spark, sf_dir)), ("naive",), ("instrument_id", "regime")))


def rv_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.estimates(volatility.features(daily_closes(spark, sf_dir))))


def rv_latest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.latest_complete(volatility.features(daily_closes(spark, sf_dir))))


def rv_absolute_return_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.absolute_return_proxy(daily_closes(spark, sf_dir)))


def rv_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(volatility.drawdown(daily_closes(spark, sf_dir)))


def rv_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.walk_forward(daily_closes(spark, sf_dir), *SPLITS)


def _middle(events: DataFrame):
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return (ends["a"] + (ends["b"] - ends["a"]) / 2).replace(microsecond=0) if ends["a"] else datetime.datetime(1970, 1, 1)


def latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return asof.latest(events, "user_id", "ts", "event_id", _middle(events), ["event_type", "value"])


def knowledge_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    records = events.select(F.col("event_id").alias("record_id"), before.alias("supersedes_record_id"), F.col("ts").alias("recorded_at"))
    return asof.knowledge_leaves(records, _middle(events))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.repeated_keys(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type")


SPLITS = (500, 60, 60)
QUERIES = {
    f.__name__: f
    for f in (
        rv_returns, rv_features, rv_report, rv_naive_errors, rv_backtest, rv_metrics, rv_regime_metrics, rv_estimates, rv_latest_complete,
        rv_absolute_return_proxy, rv_drawdown, rv_walk_forward, latest_as_of, knowledge_leaves, repeated_keys,
    )
}

_PRICES = """p as (select o_orderpriority as instrument_id, cast(o_orderdate as date) as session_date, max_by(o_totalprice, o_orderkey) as price from orders group by 1, 2),
r0 as (select *, ln(case when price > 0 and price < 'infinity'::double then price end) as l from p),
r as (select instrument_id, session_date, price, l - lag(l) over w as log_return from r0 window w as (partition by instrument_id order by session_date)),
s as (select *, log_return * log_return as q from r)"""
_BY = "partition by instrument_id order by session_date"
_H = ", ".join(f"case when count(q) over ({_BY} rows between {h - 1} preceding and current row) = {h} then sum(q) over ({_BY} rows between {h - 1} preceding and current row) end as v{h}" for h in (1, 5, 21, 63))
_OUT = ", ".join(f"round(v{h}, 8) as horizon_variance_{h}d, round(v{h} * 252 / {h}, 8) as annualized_variance_{h}d, round(sqrt(v{h} * 252 / {h}), 8) as annualized_volatility_{h}d" for h in (1, 5, 21, 63))
_PRIOR = f"over ({_BY} rows between 63 preceding and 1 preceding)"
_REPORT = f"""{_PRICES}, t as (select instrument_id, session_date, price,
 case when count(q) over ({_BY} rows between 1 following and 5 following) = 5 then sum(q) over ({_BY} rows between 1 following and 5 following) * 252 / 5 end as f,
 lead(session_date) over ({_BY}) as target_start, lead(session_date, 5) over ({_BY}) as target_end,
 case when count(q) over ({_BY} rows between 4 preceding and current row) = 5 then avg(q) over ({_BY} rows between 4 preceding and current row) * 252 end as n from s)"""

_FEATURES = f"""h as (select *, {_H} from s), a as (select *, sqrt(v21 * 252 / 21) as vol from h),
z0 as (select *, case when count(vol) {_PRIOR} = 63 then (vol - avg(vol) {_PRIOR}) / nullif(stddev_pop(vol) {_PRIOR}, 0) end as z from a),
z as (select *, case when z is null then 'unknown' when z <= -1 then 'low' when z >= 1 then 'high' else 'normal' end as regime from z0)"""
_BACKTEST = f"""with recursive {_REPORT.removeprefix("with ")}, {_FEATURES},
o as materialized (select instrument_id, session_date, q, row_number() over ({_BY}) as i from s),
e as (select instrument_id, i, q as m, 1.0::double as w, (q is not null)::int as c from o where i = 1
 union all select e.instrument_id, o.i, case when o.q is null then e.m when e.m is null then o.q else (e.w * 2 / 3 * e.m + o.q / 3) / (e.w * 2 / 3 + 1.0::double / 3) end,
 case when o.q is null then e.w * 2 / 3 else 1.0::double end, e.c + (o.q is not null)::int from e join o on o.instrument_id = e.instrument_id and o.i = e.i + 1),
b as (select t.instrument_id, t.session_date, t.f, t.n, case when e.c >= 5 then e.m * 252 end as w, z.regime from t join o using (instrument_id, session_date)
 join e on e.instrument_id = o.instrument_id and e.i = o.i join z on z.instrument_id = t.instrument_id and z.session_date = t.session_date)"""


def _metrics_sql(column: str, model: str, by: str) -> str:
    return f"""(select {by}, measure, '{model}' as model, round(avg(abs(p - y)), 8) as mae, round(sqrt(avg((p - y) * (p - y))), 8) as rmse,
 round(case when stddev_pop(y) * stddev_pop(p) > 0 then covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) end, 8) as correlation, round(avg(same), 8) as change_direction_accuracy, count(*) as n_obs
 from (select *, case when lag(y) over d is not null then (sign(y - lag(y) over d) = sign(p - lag(p) over d))::int::double end as same
 from (select instrument_id, session_date, regime, measure, case measure when 'variance' then f else sqrt(f) end as y, case measure when 'variance' then {column} else sqrt({column}) end as p
 from (select *, row_number() over ({_BY}) - 1 as k from b where f is not null and {column} is not null), (values ('variance'), ('volatility')) as m(measure) where k % 5 = 0)
 window d as (partition by {by}, measure order by session_date)) group by {by}, measure)"""


ORACLE_SQL = {
    "rv_returns": f"with {_PRICES} select instrument_id, session_date, price, round(log_return, 8) as log_return, round(q, 8) as squared_return from s",
    "rv_features": f"""with {_PRICES}, h as (select *, {_H} from s), a as (select *, sqrt(v21 * 252 / 21) as vol from h),
z as (select *, case when count(vol) {_PRIOR} = 63 then (vol - avg(vol) {_PRIOR}) / nullif(stddev_pop(vol) {_PRIOR}, 0) end as z from a)
select instrument_id, session_date, {_OUT}, round((v5 * 252 / 5) / nullif(v21 * 252 / 21, 0), 8) as variance_ratio_5_21, round(z, 6) as volatility_zscore_21,
case when z is null then 'unknown' when z <= -1 then 'low' when z >= 1 then 'high' else 'normal' end as regime from z""",
    "rv_report": f"""with {_REPORT} select instrument_id, session_date, price, round(f, 8) as forward_annualized_variance, target_start, target_end,
round(n, 8) as naive_forecast_annualized_variance, round(sqrt(f), 8) as forward_annualized_volatility, round(sqrt(n), 8) as naive_forecast_annualized_volatility from t""",
    "rv_naive_errors": f"""with {_REPORT}, e as (select *, row_number() over ({_BY}) - 1 as k from t where f is not null and n is not null)
select instrument_id, round(avg(abs(sqrt(n) - sqrt(f))), 8) as mae, round(sqrt(avg((sqrt(n) - sqrt(f)) * (sqrt(n) - sqrt(f)))), 8) as rmse, count(*) as n_obs from e where k % 5 = 0 group by 1""",
    "latest_as_of": """with c as (select date_trunc('second', min(ts) + (max(ts) - min(ts)) / 2) as as_of from events)
select user_id, max(ts) as ts, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type, max_by(value, (ts, event_id)) as value
from events, c where ts <= as_of group by user_id""",
    "rv_backtest": f"""{_BACKTEST} select instrument_id, session_date, round(n, 8) as naive_forecast_annualized_variance, round(sqrt(n), 8) as naive_forecast_annualized_volatility,
round(w, 8) as ewma_forecast_annualized_variance, round(sqrt(w), 8) as ewma_forecast_annualized_volatility, regime from b""",
    "rv_metrics": f"{_BACKTEST} {_metrics_sql('n', 'naive', 'instrument_id')} union all {_metrics_sql('w', 'ewma', 'instrument_id')}",
    "rv_regime_metrics": f"{_BACKTEST} {_metrics_sql('n', 'naive', 'instrument_id, regime')}",
    "rv_estimates": f"with {_PRICES}, h as (select *, {_H} from s) " + " union all ".join(
        f"""select instrument_id, session_date, {h} as horizon, round(v{h}, 8) as horizon_variance, round(v{h} * 252 / {h}, 8) as annualized_variance,
round(sqrt(v{h} * 252 / {h}), 8) as annualized_volatility from h where v1 is not null and v5 is not null and v21 is not null and v63 is not null"""
        for h in (1, 5, 21, 63)
    ),
    "rv_latest_complete": f"""with {_PRICES}, {_FEATURES} select instrument_id, session_date, {", ".join(f"round(sqrt(v{h} * 252 / {h}), 8) as annualized_volatility_{h}d" for h in (1, 5, 21, 63))}, regime
from z where v1 is not null and v5 is not null and v21 is not null and v63 is not null qualify row_number() over (partition by instrument_id order by session_date desc) = 1""",
    "rv_absolute_return_proxy": f"""with {_PRICES} select instrument_id, session_date, round(case when count(log_return) over w = 21 then avg(abs(log_return)) over w end * sqrt(252), 8) as proxy
from s window w as ({_BY} rows between 20 preceding and current row)""",
    "rv_drawdown": f"with {_PRICES} select instrument_id, session_date, round(max(price) over ({_BY} rows unbounded preceding) - price, 8) as drawdown from p",
    "rv_walk_forward": f"""with {_PRICES}, o as (select instrument_id, session_date, row_number() over ({_BY}) - 1 as i, count(*) over (partition by instrument_id) as n from p)
select instrument_id, session_date, k::int as split, case when i - k * {SPLITS[2]} < {SPLITS[0]} then 'train' else 'test' end as role
from o, unnest(generate_series(0, n // {SPLITS[2]})) as g(k) where k * {SPLITS[2]} <= i and i < k * {SPLITS[2]} + {SPLITS[0] + SPLITS[1]} and k * {SPLITS[2]} + {SPLITS[0] + SPLITS[1]} <= n""",
    "knowledge_leaves": """with c as (select date_trunc('second', min(ts) + (max(ts) - min(ts)) / 2) as as_of from events),
r as (select event_id as record_id, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as supersedes_record_id, ts as recorded_at from events),
k as (select r.* from r, c where recorded_at <= as_of)
select * from k where not exists (select 1 from k as x where x.supersedes_record_id = k.record_id)""",
    "repeated_keys": "select user_id, event_type, count(*) as n_rows from events group by 1, 2 having count(*) > 1",
}
