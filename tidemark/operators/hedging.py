"""Hedge decisions, simulated fills, ledger entries and attribution over tables of states and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Policies, and their reasons to hold and to trade.
POLICIES = ("no_hedge", "fixed_interval", "delta_threshold", "constant_band", "whalley_wilmott", "forced_reduction")

HOLDS = {"no_hedge": "policy_never_hedges", "fixed_interval": "outside_scheduled_step", "delta_threshold": "inside_delta_threshold", "constant_band": "inside_constant_band", "whalley_wilmott": "inside_whalley_wilmott_band"}
TRADES = {"fixed_interval": "scheduled_rebalance", "delta_threshold": "delta_threshold_breached", "constant_band": "constant_band_breached", "whalley_wilmott": "whalley_wilmott_band_breached", "forced_reduction": "absolute_delta_forced_hedge"}


def half_band(cost_rate: float, aversion: float, spot: Column, gamma: Column) -> Column:
    """Half the width of the no-trade band of Whalley and Wilmott."""
    return F.cbrt(F.lit(3.0 * cost_rate) * spot * gamma * gamma / (2.0 * aversion))


def decisions(states: DataFrame, policies: tuple[str, ...] = POLICIES, interval: int = 3, limit: float = 10.0, goal: float = 0.0, lower: float = -8.0, upper: float = 12.0, cost_rate: float = 0.01, aversion: float = 2.0, widest: float = 20.0) -> DataFrame:
    """One row per state (step_index, net_delta, spot, gamma, delta_per_contract, ...) and policy: the boundaries, the target and the contracts to trade.

    goal: the net delta that fixed_interval and delta_threshold trade back to; the threshold is the distance from zero.
    """
    unknown = set(policies) - set(POLICIES)
    if unknown or interval <= 0 or limit < 0 or lower >= upper or widest <= 0:
        raise ValueError(f"invalid policies or parameters: {sorted(unknown)}")
    delta, policy = F.col("net_delta"), F.col("policy_id")
    width = F.least(half_band(cost_rate, aversion, F.col("spot"), F.abs("gamma")), F.lit(widest))

    def bound(threshold, constant, dynamic, forced):
        return F.when(policy == "delta_threshold", threshold).when(policy == "constant_band", constant).when(policy == "whalley_wilmott", dynamic).when(policy == "forced_reduction", forced)

    rows = states.withColumn("policy_id", F.explode(F.array(*map(F.lit, policies)))).withColumn("lower_boundary", bound(F.lit(-limit), F.lit(lower), -width, F.lit(0.0))).withColumn("upper_boundary", bound(F.lit(limit), F.lit(upper), width, F.lit(0.0)))
    inside = delta.between(F.col("lower_boundary"), F.col("upper_boundary"))
    banded = policy.isin("constant_band", "whalley_wilmott")
    trades = F.when(policy == "no_hedge", F.lit(False)).when(policy == "fixed_interval", F.col("step_index") % interval == 0).when(policy == "forced_reduction", F.lit(True)).otherwise(~inside)
    edge = F.when(delta < F.col("lower_boundary"), F.col("lower_boundary")).otherwise(F.col("upper_boundary"))
    target = F.when(policy == "no_hedge", delta).when(banded, F.when(inside, delta).otherwise(edge)).when(policy == "forced_reduction", 0.0).otherwise(float(goal))
    rows = rows.withColumn("trades", trades).withColumn("target_net_delta", target)
    continuous = F.when(F.col("trades"), (F.col("target_net_delta") - delta) / F.col("delta_per_contract")).otherwise(0.0)
    rows = rows.withColumn("continuous_quantity", continuous).withColumn("contracts", F.bround("continuous_quantity", 0).cast("long"))
    after = delta + F.col("contracts") * F.col("delta_per_contract")
    action = F.when(F.col("contracts") > 0, "buy_hedge").when(F.col("contracts") < 0, "sell_hedge").otherwise("hold")
    named = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[policy]
    reason = F.when(F.col("trades") & (F.col("contracts") == 0), "rounded_quantity_zero").when(F.col("trades"), named(TRADES)).otherwise(named(HOLDS))
    rows = rows.withColumn("net_delta_after", after).withColumn("residual_delta", after - F.col("target_net_delta"))
    return rows.withColumn("action", action).withColumn("reason", reason).drop("trades")


def money(amount: Column) -> Column:
    """An amount in hundredths, halves to even."""
    return F.bround(amount, 2).cast("decimal(18,2)")


def fills(orders: DataFrame, half_spread: str, slippage: str, rate: str, fixed: str) -> DataFrame:
    """Orders (side, quantity, multiplier, reference decimal, ...) executed at a side-aware price, each cost rounded on its own."""
    exact = lambda x: F.lit(x).cast("decimal(10,4)")
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    units = (F.col("quantity") * F.col("multiplier")).cast("decimal(12,0)")
    worse = sign.cast("decimal(2,0)") * (exact(half_spread) + exact(slippage))
    out = orders.withColumn("fill_price", money(F.greatest(F.col("reference") + worse, F.lit(0).cast("decimal(10,2)")))).withColumn("gross_notional", money(F.col("reference") * units))
    out = out.withColumn("half_spread_cost", money(exact(half_spread) * units)).withColumn("slippage_cost", money(exact(slippage) * units))
    out = out.withColumn("proportional_cost", money(exact(rate) * F.col("gross_notional"))).withColumn("fixed_cost", money(exact(fixed)))
    return out.withColumn("total_cost", (F.col("half_spread_cost") + F.col("slippage_cost") + F.col("proportional_cost") + F.col("fixed_cost")).cast("decimal(18,2)"))


def ledger(fills_: DataFrame) -> DataFrame:
    """Two entries per fill: the trade and its cost."""
    buy = F.col("side") == "buy"
    trade = F.struct(F.lit("trade").alias("entry_type"), F.when(buy, F.col("quantity")).otherwise(-F.col("quantity")).alias("quantity_change"), F.when(buy, -F.col("gross_notional")).otherwise(F.col("gross_notional")).alias("cash_change"), F.lit(0).cast("decimal(18,2)").alias("cost"))
    cost = F.struct(F.lit("transaction_cost").alias("entry_type"), F.lit(0).cast(fills_.schema["quantity"].dataType).alias("quantity_change"), (-F.col("total_cost")).cast("decimal(18,2)").alias("cash_change"), F.col("total_cost").alias("cost"))
    return fills_.select("*", F.explode(F.array(trade, cost)).alias("e")).select(*fills_.columns, "e.*")


def cash(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(money(F.sum("cash_change")).alias("cash"), money(F.sum("cost")).alias("costs"))


def portfolio_value(entries: DataFrame, by: str, *order: str) -> DataFrame:
    """Cash and the marked position after each entry (reference, multiplier, ...), in order."""
    so_far = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    held, spent = F.sum("quantity_change").over(so_far), F.sum("cash_change").over(so_far)
    out = entries.withColumn("quantity", held).withColumn("cash", spent.cast("decimal(18,2)"))
    return out.withColumn("value", (F.col("cash") + money(F.col("reference") * (F.col("quantity") * F.col("multiplier")).cast("decimal(12,0)"))).cast("decimal(18,2)"))


def drawdown(values: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """Per group the greatest fall below the highest value so far, over values in order."""
    peak = F.max(value).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return values.withColumn("below", peak - F.col(value)).groupBy(by).agg(F.max("below").alias("maximum_drawdown"))


def reconciliation(fills_: DataFrame, by: str, terminal: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Per group with a terminal profit (by, terminal_pnl): the profit of options and futures, their costs, and what is unexplained; without fills all of it."""
    gross = F.when(F.col("side") == "sell", F.col("gross_notional")).otherwise(-F.col("gross_notional"))
    part = lambda kind, c: money(F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0).cast("decimal(18,2)")))
    sums = fills_.groupBy(by).agg(*[part(k, c).alias(f"{k}_{n}") for k in ("option", "futures") for n, c in (("pnl", gross), ("costs", F.col("total_cost")))])
    names = [c for c in sums.columns if c != by]
    out = terminal.join(sums, by, "left").select(by, *(F.coalesce(c, F.lit(0).cast("decimal(18,2)")).alias(c) for c in names), *(c for c in terminal.columns if c != by))
    explained = F.col("option_pnl") + F.col("futures_pnl") - F.col("option_costs") - F.col("futures_costs")
    out = out.withColumn("residual", money(F.col("terminal_pnl") - explained))
    return out.withColumn("reconciled", F.abs("residual") <= F.lit(tolerance).cast("decimal(18,2)"))


def premium_at_risk(fills_: DataFrame, by: str) -> DataFrame:
    """What the entries of options cost in all; a sale among them makes the group invalid (null)."""
    total = money(F.sum(F.col("gross_notional") + F.col("total_cost")))
    return fills_.groupBy(by).agg(F.when(F.max((F.col("side") != "buy").cast("int")) == 0, total).alias("premium_at_risk"))


def greek_attribution(legs: DataFrame, run: str, leg: str, clock: str) -> DataFrame:
    """Per interval the change of value by Greek, summed over legs.

    legs: spot, implied, step_years, price, delta, gamma, theta, vega (of the position), units; `lag` pairs each state with the one before.
    """
    order = W.partitionBy(run, leg).orderBy(clock)
    before = lambda c: F.lag(c).over(order)
    move, shift = F.col("spot") - before("spot"), F.col("implied") - before("implied")
    parts = {"delta": before("delta") * move, "gamma": before("gamma") * move * move / 2, "theta": before("theta") * F.col("step_years"), "vega": before("vega") * shift, "exact": (F.col("price") - before("price")) * before("units")}
    steps = legs.select(run, F.col(clock), before(clock).alias("since"), *[v.alias(f"{k}_change") for k, v in parts.items()]).filter("since is not null")
    out = steps.groupBy(run, "since", clock).agg(*[F.sum(f"{k}_change").alias(f"{k}_change") for k in parts])
    return out.withColumn("residual", F.col("exact_change") - F.col("delta_change") - F.col("gamma_change") - F.col("theta_change") - F.col("vega_change"))


def daily_theta(legs: DataFrame, by: str, theta: Column, periods: int = 252) -> DataFrame:
    """Per group the size of what its positions lose in a session: the sum of their yearly thetas (decimals), never netted over groups."""
    return legs.groupBy(by).agg(money(F.abs(F.sum(theta)) / F.lit(periods)).alias("theta"))


def summary(runs: DataFrame, run: str, decisions_: DataFrame, fills_: DataFrame, attribution: DataFrame) -> DataFrame:
    """One row for each run (run, starting_nav, terminal_value): hedges, turnover, deltas before and after hedging, drawdown, seconds and attribution.

    decisions_: run, step, at, delta_before, delta_after, value_before, value_after (nulls are passed over), traded. fills_: run,
    kind, gross_notional. attribution: run and delta_change, gamma_change, theta_change, vega_change, residual. The drawdown runs
    over the start, both values of each step in order, and the end. Runs without decisions have no deltas and no seconds.
    """
    size = lambda c: F.abs(F.col(c))
    deltas = [f(c).alias(f"{name}_{c}") for c in ("delta_before", "delta_after") for name, f in (("greatest", lambda c: F.max(size(c))), ("mean", lambda c: F.avg(size(c))), ("root_mean_square", lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))))]
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6
    d = decisions_.groupBy(run).agg(F.count_if("traded").alias("hedges"), *deltas, seconds.alias("seconds"))
    turnover = fills_.filter("kind = 'futures'").groupBy(run).agg(money(F.sum("gross_notional")).alias("futures_turnover"))
    parts = [c for c in attribution.columns if c.endswith("_change") or c == "residual"]
    greeks = attribution.groupBy(run).agg(*(F.sum(c).alias(c) for c in parts if c != "exact_change"))
    value = lambda step, at, v: F.struct(step.cast("long").alias("step"), F.lit(at).alias("place"), F.col(v).cast("decimal(18,2)").alias("value"))
    ends = runs.select(run, F.explode(F.array(value(F.lit(-(2**62)), 0, "starting_nav"), value(F.lit(2**62), 0, "terminal_value"))).alias("_v"))
    between = decisions_.select(run, F.explode(F.array(value(F.col("step"), 0, "value_before"), value(F.col("step"), 1, "value_after"))).alias("_v"))
    path = ends.unionByName(between).select(run, "_v.*").filter("value is not null")
    out = runs.join(d, run, "left").join(turnover, run, "left").join(greeks, run, "left").join(drawdown(path, run, "value", "step", "place"), run, "left")
    counted = {"hedges": F.coalesce("hedges", F.lit(0)).cast("long"), "futures_turnover": F.coalesce("futures_turnover", F.lit(0).cast("decimal(18,2)")), **{c: F.coalesce(c, F.lit(0.0)) for c in greeks.columns if c != run}}
    return out.withColumns(counted)
