"""Acceptance and freshness of live quotes as one stateful stream.

Quotes are accepted, numbered and turn stale in the same operator: state is the last number, price and receipt of each
instrument and whether its quote is stale, kept over restarts. A quote turns stale by a timer, without a new event: by the
watermark ("event": replays and tests give the same rows every time) or by the machine's clock ("processing").
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "sequence long, price double, received long, stale boolean"
DOWN = "down"


def followed(quotes: DataFrame, seconds: float = 5, ahead_seconds: float = 300, clock: str = "event", late: str = "0 seconds") -> DataFrame:
    """A stream of instrument, sequence, price, received_at, freshness: a fresh row for each accepted quote, a stale row once one has grown too old.

    quotes: instrument, price, traded_at, received_at, and kind (null for quotes; `down` for the loss of an instrument's
    connection, which makes its last quote stale at once). Accepted are quotes with a positive finite price that are not
    traded more than `ahead_seconds` after receipt; others leave no trace. Within a micro-batch an instrument's rows are taken
    by receipt and gathered for that, so bound a backlog at its source (maxFilesPerTrigger); rows of equal receipt by price.
    A quote as old as `seconds` is fresh still. Quotes received before the last one are accepted too and numbered on.
    """
    limit = int(seconds * 1e6)
    kind = quotes.schema["instrument"].dataType.simpleString()

    def follow(key, frames, state):
        sequence, price, received, stale = state.get if state.exists else (0, None, None, True)
        out = []

        def row(freshness):
            out.append((key[0], sequence, price, pd.Timestamp(received, unit="us"), freshness))

        if state.hasTimedOut:
            stale = True
            row("stale")
        else:
            frame = pd.concat(list(frames)).sort_values(["received_at", "price"], kind="stable")
            at = frame["received_at"].astype("datetime64[us]").astype("int64").to_numpy()
            for now, value, what in zip(at.tolist(), frame["price"].tolist(), frame["kind"].tolist()):
                if not stale and (what == DOWN or clock == "event" and now > received + limit):
                    stale = True
                    row("stale")
                if what != DOWN:
                    sequence, price, received, stale = sequence + 1, value, now, False
                    row("fresh")
        state.update((sequence, price, received, stale))
        if not stale:
            if clock == "processing":
                state.setTimeoutDuration(max(1, limit // 1000))
            elif (received + limit) // 1000 > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp((received + limit) // 1000)
            else:
                state.update((sequence, price, received, True))
                row("stale")
        yield pd.DataFrame(out, columns=["instrument", "sequence", "price", "received_at", "freshness"])

    traded = F.coalesce(F.col("traded_at") <= F.col("received_at") + F.make_dt_interval(secs=F.lit(ahead_seconds)), F.lit(False))
    good = (F.col("price") > 0) & (F.col("price") < float("inf")) & traded
    seen = quotes.filter(F.col("received_at").isNotNull() & (F.coalesce(F.col("kind") == DOWN, F.lit(False)) | (F.col("kind").isNull() & good)))
    seen = seen.withWatermark("received_at", late).select("instrument", "price", "received_at", "kind").groupBy("instrument")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if clock == "processing" else GroupStateTimeout.EventTimeTimeout
    return seen.applyInPandasWithState(follow, f"instrument {kind}, sequence long, price double, received_at timestamp, freshness string", STATE, "append", timeout)
