"""Close-to-close realized volatility: returns, multi-horizon features, regimes, targets, naive forecasts and their errors.

Frames count sessions, never calendar days, and a window is null unless every session in it is valid.
An invalid price (null, not finite, not positive) becomes null before differencing, so it voids two returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZONS, YEAR, BENCHMARK = (1, 5, 21, 63), 252, 63


def _by():
    return W.partitionBy("instrument_id").orderBy("session_date")


def _full(aggregate, column: str, n: int, first: int, last: int) -> Column:
    frame = _by().rowsBetween(first, last)
    return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))


def returns(prices: DataFrame) -> DataFrame:
    """prices (instrument_id, session_date, price) with log_return and squared_return."""
    valid = F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.col("price"))
    change = F.log("valid_price") - F.log(F.lag("valid_price").over(_by()))
    return prices.withColumn("valid_price", valid).withColumn("log_return", change).withColumn("squared_return", F.col("log_return") ** 2).drop("valid_price")


def realized_variance(prices: DataFrame, window: int) -> DataFrame:
    """returns() with `realized_variance`, the sum of the last `window` squared returns, all of them needed."""
    if window < 1:
        raise ValueError("a window has at least one session")
    return returns(prices).withColumn("realized_variance", _full(F.sum, "squared_return", window, 1 - window, 0))


def realized_volatility(prices: DataFrame, window: int, year: int | None = None) -> DataFrame:
    """realized_variance() with its root, `realized_volatility`, of a year of so many sessions if given."""
    scale = 1.0 if year is None else year / window
    return realized_variance(prices, window).withColumn("realized_volatility", F.sqrt(F.col("realized_variance") * scale))


def _with_features(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, year: int = YEAR) -> DataFrame:
    if not {5, 21} <= set(horizons) or min(horizons) < 1 or len(set(horizons)) < len(horizons) or year < 1:
        raise ValueError("horizons are distinct, positive and hold 5 and 21; a year has sessions")
    out = returns(prices)
    for h in horizons:
        out = out.withColumn(f"horizon_variance_{h}d", _full(F.sum, "squared_return", h, 1 - h, 0))
    for h in horizons:
        out = out.withColumn(f"annualized_variance_{h}d", F.col(f"horizon_variance_{h}d") * year / h)
        out = out.withColumn(f"annualized_volatility_{h}d", F.sqrt(f"annualized_variance_{h}d"))
    current, prior = "annualized_volatility_21d", (BENCHMARK, -BENCHMARK, -1)
    mean, spread = _full(F.avg, current, *prior), _full(F.stddev_pop, current, *prior)
    long_run = F.when(F.col("annualized_variance_21d") != 0, F.col("annualized_variance_21d"))
    z = F.col("volatility_zscore_21")
    return (
        out.withColumn("variance_ratio_5_21", F.col("annualized_variance_5d") / long_run)
        .withColumn("volatility_zscore_21", (F.col(current) - mean) / F.when(spread != 0, spread))
        .withColumn("regime", F.when(z.isNull(), "unknown").when(z <= -1, "low").when(z >= 1, "high").otherwise("normal"))
    )


def features(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, year: int = YEAR) -> DataFrame:
    return _with_features(prices, horizons, year).drop("price", "log_return", "squared_return")


def report(prices: DataFrame, horizon: int = 5, lookback: int | None = None) -> DataFrame:
    """Forward variance of each session's next `horizon` sessions beside the trailing naive forecast."""
    return _targets(returns(prices), horizon, lookback or horizon)


def _targets(sessions: DataFrame, horizon: int, back: int, *kept: str) -> DataFrame:
    forward = _full(F.sum, "squared_return", horizon, 1, horizon)
    out = sessions.select(
        *kept,
        "instrument_id", "session_date", "price", (forward * YEAR / horizon).alias("forward_annualized_variance"),
        F.lead("session_date").over(_by()).alias("target_start"), F.lead("session_date", horizon).over(_by()).alias("target_end"),
        (_full(F.avg, "squared_return", back, 1 - back, 0) * YEAR).alias("naive_forecast_annualized_variance"),
    )
    for name in ("forward", "naive_forecast"):
        out = out.withColumn(f"{name}_annualized_volatility", F.sqrt(f"{name}_annualized_variance"))
    return out


def naive_errors(report_: DataFrame, stride: int = 5) -> DataFrame:
    """Errors over non-overlapping eligible rows: every stride-th after nulls are gone."""
    pairs = report_.filter("forward_annualized_volatility is not null and naive_forecast_annualized_volatility is not null")
    chosen = pairs.withColumn("k", F.row_number().over(_by()) - 1).filter(F.col("k") % stride == 0)
    error = F.col("naive_forecast_annualized_volatility") - F.col("forward_annualized_volatility")
    return chosen.groupBy("instrument_id").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n_obs"))


def backtest(prices: DataFrame, horizon: int = 5, span: int | None = None) -> DataFrame:
    """The report with each session's regime and the EWMA forecast beside the naive one."""
    out = ewma(_targets(_with_features(prices), horizon, horizon, "regime", "squared_return"), "squared_return", span or max(horizon, 2))
    out = out.withColumn("ewma_forecast_annualized_variance", F.col("ewma") * YEAR)
    return out.withColumn("ewma_forecast_annualized_volatility", F.sqrt("ewma_forecast_annualized_variance")).drop("ewma", "squared_return")


def ewma(sessions: DataFrame, column: str, span: int) -> DataFrame:
    """Adds `ewma`, the recursive mean of weight 2 / (span + 1): history decays over nulls too, and the first span - 1 values stay null.

    The recursion follows one instrument's sessions, a few hundred a year, so a group is small whatever the number of instruments.
    """
    alpha = 2 / (span + 1)

    def follow(frame):
        frame = frame.sort_values("session_date")
        mean, weight, seen, out = None, 1.0, 0, []
        for x in frame[column].tolist():
            weight *= 1 - alpha
            if x == x and x is not None:
                mean = x if mean is None else (weight * mean + alpha * x) / (weight + alpha)
                weight, seen = 1.0, seen + 1
            out.append(mean if seen >= span else None)
        return frame.assign(ewma=out).astype({"ewma": "float64"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sessions.schema)
    return sessions.groupBy("instrument_id").applyInPandas(follow, f"{fields}, ewma double")


def metrics(backtest_: DataFrame, models: tuple[str, ...], by: tuple[str, ...] = ("instrument_id",), stride: int = 5) -> DataFrame:
    """Errors, correlation and shared direction of change of variance and volatility over non-overlapping rows of each model.

    Rows are chosen before they are grouped; a change is against the previous chosen row of the same group.
    Correlation is null where a side is constant, direction where a group has one row. The backtest is read once for all models.
    An instrument without eligible rows has nulls and no observations; other groups exist only where rows were chosen.
    """
    if stride <= 0 or not models:
        raise ValueError("a positive stride and a model are needed")
    target = F.col("forward_annualized_variance")
    forecasts = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_forecast_annualized_variance").alias("forecast")) for m in models])
    rows = backtest_.select(*dict.fromkeys(("instrument_id", *by)), "session_date", target.alias("target"), F.explode(forecasts).alias("f")).select("*", "f.*").drop("f")
    known = F.col("target").isNotNull() & F.col("forecast").isNotNull()
    place = F.row_number().over(W.partitionBy("instrument_id", "model").orderBy(~known, "session_date")) - 1
    empty = (F.col("k") == 0) & F.lit(by == ("instrument_id",))
    chosen = rows.withColumn("k", place).filter(F.when(known, F.col("k") % stride == 0).otherwise(empty))
    measures = [F.struct(F.lit(m).alias("measure"), f("target").alias("y"), f("forecast").alias("p")) for m, f in (("variance", F.col), ("volatility", F.sqrt))]
    rows = chosen.select("*", F.explode(F.array(*measures)).alias("m")).select("*", "m.*").drop("m")
    order = W.partitionBy(*by, "model", "measure").orderBy("session_date")
    same = F.signum(F.col("y") - F.lag("y").over(order)) == F.signum(F.col("p") - F.lag("p").over(order))
    error, spread = F.col("p") - F.col("y"), F.stddev_pop("y") * F.stddev_pop("p")
    return rows.withColumn("same", same.cast("double")).groupBy(*by, "measure", "model").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 0, F.covar_pop("y", "p") / spread).alias("correlation"), F.avg("same").alias("change_direction_accuracy"), F.count(error).alias("n_obs"),
    )


def evaluation_span(backtest_: DataFrame, model: str, stride: int = 5) -> DataFrame:
    """The first and the last row that each instrument's metrics of a model rest on, and their number."""
    rows = backtest_.dropna(subset=["forward_annualized_variance", f"{model}_forecast_annualized_variance"])
    chosen = rows.withColumn("k", F.row_number().over(_by()) - 1).filter(F.col("k") % stride == 0)
    return chosen.groupBy("instrument_id").agg(F.min("session_date").alias("evaluation_start_date"), F.max("session_date").alias("evaluation_end_date"), F.count(F.lit(1)).alias("n_obs"))


def estimates(features_: DataFrame) -> DataFrame:
    """One row per session and horizon, of sessions where every horizon is known."""
    names = ("horizon_variance", "annualized_variance", "annualized_volatility")
    rows = [F.struct(F.lit(h).alias("horizon"), *[F.col(f"{n}_{h}d").alias(n) for n in names]) for h in HORIZONS]
    complete = features_.dropna(subset=[f"{n}_{h}d" for n in names for h in HORIZONS])
    return complete.select("instrument_id", "session_date", F.explode(F.array(*rows)).alias("e")).select("instrument_id", "session_date", "e.*")


def latest_complete(features_: DataFrame) -> DataFrame:
    """Each instrument's last session where every horizon is known."""
    values = [f"annualized_volatility_{h}d" for h in HORIZONS]
    complete = features_.dropna(subset=values)
    return complete.groupBy("instrument_id").agg(F.max_by(F.struct("session_date", *values, "regime"), "session_date").alias("s")).select("instrument_id", "s.*")


def absolute_return_proxy(prices: DataFrame, window: int = 21) -> DataFrame:
    """The rolling mean of absolute returns, annualized; a diagnostic, not an estimator of volatility."""
    moves = returns(prices).withColumn("move", F.abs("log_return"))
    return moves.select("instrument_id", "session_date", (_full(F.avg, "move", window, 1 - window, 0) * F.sqrt(F.lit(YEAR))).alias("proxy"))


def drawdown(prices: DataFrame) -> DataFrame:
    """How far each price lies below the highest so far."""
    peak = F.max("price").over(_by().rowsBetween(W.unboundedPreceding, W.currentRow))
    return prices.select("instrument_id", "session_date", (peak - F.col("price")).alias("drawdown"))


def walk_forward(prices: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(instrument_id, session_date, split, role) of rolling fixed slices; each session finds its splits by arithmetic, without a join."""
    size, i = train + test, F.col("i")
    rows = prices.select("instrument_id", "session_date", (F.row_number().over(_by()) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy("instrument_id")).alias("n"))
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("int")
    last = F.least(F.floor(i / step), F.floor((F.col("n") - size) / step)).cast("int")
    rows = rows.withColumn("first", first).withColumn("last", last).filter("n >= {} and first <= last".format(size))
    rows = rows.select("instrument_id", "session_date", "i", F.explode(F.sequence("first", "last")).alias("split"))
    return rows.select("instrument_id", "session_date", "split", F.when(i - F.col("split") * step < train, "train").otherwise("test").alias("role"))


def last_rows(rows: DataFrame, n: int, *needed: str) -> DataFrame:
    """Each instrument's last n rows in which all needed columns are known."""
    newest = W.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    return rows.dropna(subset=list(needed)).withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n).drop("place")


def annualized(rows: DataFrame, variance: str, year: int = YEAR) -> DataFrame:
    """Daily variance with its yearly value and, floored at 0, the volatility; values that are not finite become null."""
    daily = F.when(F.abs(variance) < float("inf"), F.col(variance))
    out = rows.withColumn("daily_variance", daily).withColumn("annualized_variance", F.col("daily_variance") * year)
    return out.withColumn("annualized_volatility", F.sqrt(F.when(F.col("annualized_variance").isNotNull(), F.greatest("annualized_variance", F.lit(0.0)))))
