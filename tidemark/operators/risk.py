"""Risk rules as rows: entry gates, gates of a running position, the gate after a fill, marked states and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rule(name: str, observed: Column, limit: Column, decision: Column, reason: Column) -> Column:
    return F.struct(F.lit(name).alias("rule_id"), observed.cast("double").alias("observed"), limit.cast("double").alias("limit"), decision.alias("decision"), reason.alias("reason"))


def entry_gates(entries: DataFrame, nav: float, premium_fraction: float, theta_fraction: float, widest_spread: float, least_edge: float, quality: bool = True, liquidity: bool = True) -> DataFrame:
    """Seven rows per entry: six rules approve or reject, the expected edge is left to a later stage.

    entries: premium_at_risk, daily_theta, spread, volume, open_interest, matched (whether both legs agree in strike, expiry and multiplier).
    A null input rejects.
    """
    c = F.col

    def gate(name: str, observed: Column, limit: Column, holds: Column, reason: str) -> Column:
        good = F.coalesce(holds, F.lit(False))
        return _rule(name, observed, limit, F.when(good, "approve").otherwise("reject"), F.when(good, f"{reason}_within_limit").otherwise(f"{reason}_breached"))

    premium, theta = F.bround(F.lit(nav * premium_fraction), 2), F.bround(F.lit(nav * theta_fraction), 2)
    traded = lambda name: F.lit(not liquidity) | (c(name) > 0)
    rules = [
        gate("maximum_premium_at_risk", c("premium_at_risk"), premium, c("premium_at_risk") <= premium, "premium_at_risk"),
        gate("option_spread_quality", c("spread"), F.lit(widest_spread), F.lit(not quality) | (c("spread") <= widest_spread), "option_spread"),
        gate("option_volume_quality", c("volume"), F.lit(1), traded("volume"), "option_volume"),
        gate("option_open_interest_quality", c("open_interest"), F.lit(1), traded("open_interest"), "option_open_interest"),
        gate("matched_straddle_integrity", c("matched"), F.lit(1), c("matched"), "matched_straddle_integrity"),
        gate("maximum_daily_theta", c("daily_theta"), theta, c("daily_theta") <= theta, "daily_theta"),
        _rule("minimum_expected_net_edge", F.lit(None), F.lit(least_edge), F.lit("not_evaluated"), F.lit("deferred_to_edge_1")),
    ]
    return entries.withColumn("r", F.explode(F.array(*rules))).select(*entries.columns, "r.*")


def marked(states: DataFrame, run: str, session: str, clock: str, value: str, reference: str, hedged: Column) -> DataFrame:
    """Profit since entry and since the last mark of the session before, and hedges so far, in all and in the session.

    states: one row per run and clock; `reference` is the run's value at entry. A row's own hedge counts from that row on.
    """
    order, within = W.partitionBy(run).orderBy(clock), W.partitionBy(run, session).orderBy(clock)
    count = F.coalesce(hedged.cast("long"), F.lit(0))
    so_far = lambda w: F.sum(count).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    # all that goes by the run's order first, then all that goes by the session's: one sort for each
    out = states.withColumns({"_before": F.coalesce(F.lag(value).over(order), F.col(reference)), "_total": so_far(order)})
    out = out.withColumns({"_first": F.first("_before").over(within), "_session": so_far(within)})
    named = {"position_pnl": F.col(value) - F.col(reference), "session_pnl": F.col(value) - F.col("_first"), "session_hedges": F.col("_session"), "total_hedges": F.col("_total")}
    return out.withColumns(named).drop("_before", "_total", "_first", "_session")


def state_gates(states: DataFrame, nav: float, position_fraction: float, daily_fraction: float, most_hedges: int, widest_delta: float) -> DataFrame:
    """Five rows per state (position_pnl, session_pnl, session_hedges, net_delta, kill_switch): exit, record or pass. A null input passes."""
    c, daily, position = F.col, nav * daily_fraction, nav * position_fraction

    def gate(name: str, observed: Column, limit: Column, breached: Column, reason: str, then: str = "exit") -> Column:
        bad = F.coalesce(breached, F.lit(False))
        return _rule(name, observed, limit, F.when(bad, then).otherwise("pass"), F.when(bad, reason).otherwise(f"{name}_within_limit"))

    loss = lambda name: F.greatest(-c(name), F.lit(0))
    rules = [
        gate("manual_kill_switch", c("kill_switch"), F.lit(0), c("kill_switch"), "manual_kill_switch_engaged"),
        gate("daily_loss_limit", loss("session_pnl"), F.lit(daily), c("session_pnl") <= -daily, "daily_loss_limit_breached"),
        gate("position_loss_limit", loss("position_pnl"), F.lit(position), c("position_pnl") <= -position, "position_loss_limit_breached"),
        gate("maximum_hedge_count", c("session_hedges"), F.lit(most_hedges), c("session_hedges") >= most_hedges, "maximum_hedge_count_breached"),
        gate("maximum_absolute_delta", F.abs("net_delta"), F.lit(widest_delta), F.abs("net_delta") > widest_delta, "maximum_absolute_delta_breached", "record"),
    ]
    return states.withColumn("r", F.explode(F.array(*rules))).select(*states.columns, "r.*")


def after_fill(disposition: Column) -> Column:
    """What follows from the delta left after a hedge: pass, override or exit."""
    return F.when(disposition == "within_limit", "pass").when(disposition == "forced_hedge", "override").otherwise("exit")


def exit_reason(breached: Column, precedence: list[str], years_left: Column, least_years: float, session: Column, horizon: int, final: Column) -> Column:
    """The first reason to leave in the order given, of those breached and of time; the kill switch goes before all."""
    timed = F.array_compact(F.array(F.when(years_left < least_years, "insufficient_time_to_expiry"), F.when(session >= horizon, "maximum_holding_period"), F.when(final, "simulation_end")))
    all_ = F.array_union(F.coalesce(breached, F.array().cast("array<string>")), timed)
    held = F.filter(F.array(*map(F.lit, precedence)), lambda reason: F.array_contains(all_, reason))
    return F.when(F.array_contains(all_, "manual_kill_switch"), "manual_kill_switch").otherwise(F.get(held, F.lit(0)))
