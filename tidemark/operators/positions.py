"""Positions at average cost: a fold over each instrument's fills in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hedging import money

_STATE = "struct<quantity: bigint, average: decimal(18,2), mark: decimal(18,2), realized: decimal(18,2)>"


def positions(fills: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The position after all fills (side, quantity, multiplier, reference decimal): quantity, average_price, mark_price, realized, market value and unrealized.

    Adding averages the price, closing realizes profit, a flip restarts at the fill's price; each fill is rounded to hundredths.
    The fold runs inside one expression; it gathers one instrument's fills of one account, so `by` must name both. A change of multiplier makes the row null.
    """
    fill = F.struct(*order, F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("long").alias("q"), F.col("reference").cast("decimal(18,2)").alias("p"))
    grouped = fills.groupBy(*by).agg(F.array_sort(F.collect_list(fill)).alias("f"), F.min("multiplier").alias("m"), F.max("multiplier").alias("most"))
    units = lambda x: x.cast("decimal(12,0)")

    def step(s, x):
        now = s["quantity"] + x["q"]
        adds = (s["quantity"] == 0) | ((s["quantity"] > 0) == (x["q"] > 0))
        total = s["average"] * units(F.abs(s["quantity"])) + x["p"] * units(F.abs(x["q"]))
        mean = F.when(now != 0, money(total / units(F.abs(now))))
        closed = F.least(F.abs(s["quantity"]), F.abs(x["q"])) * F.signum(s["quantity"]).cast("long")
        gain = money((x["p"] - s["average"]) * units(closed) * units(F.col("m")))
        flips = ((s["quantity"] > 0) & (now < 0)) | ((s["quantity"] < 0) & (now > 0))
        average = F.when(adds, mean).when(now == 0, F.lit(0)).when(flips, x["p"]).otherwise(s["average"])
        realized = F.when(adds, s["realized"]).otherwise(s["realized"] + gain)
        return F.struct(now.alias("quantity"), average.alias("average"), x["p"].alias("mark"), realized.alias("realized")).cast(_STATE)

    start = F.struct(F.lit(0).alias("quantity"), F.lit(0).alias("average"), F.lit(0).alias("mark"), F.lit(0).alias("realized")).cast(_STATE)
    out = grouped.withColumn("s", F.when(F.col("m") == F.col("most"), F.aggregate("f", start, step)))
    held = units(F.col("s.quantity") * F.col("m"))
    return out.select(*by, "s.quantity", F.col("s.average").alias("average_price"), F.col("s.mark").alias("mark_price"), "s.realized", money(F.col("s.mark") * held).alias("market_value"), money((F.col("s.mark") - F.col("s.average")) * held).alias("unrealized"))
