"""Burst limit as a token bucket: a bucket of ``capacity`` requests per client refills at a steady rate.

A request finds the bucket's level; with less than one token it is over the limit, and it takes what is
there, at most one. Written on the level less what time has refilled, a request is the map
``y -> max(c, min(b, y + a))``. Such maps compose to maps of the same form, so a client's requests are
cut into pieces, each piece is composed to three numbers, the pieces' numbers are composed in
order, and every piece then runs from its own beginning. One client may fill any number of tasks.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.operators.ordered import free_name, page_index
from civiltext.sources.storage import materialise

#: Requests of a piece.
PIECE = 50_000
_LOW = -(1 << 62)
_HIGH = 1 << 62


def _units(per_seconds: int, refill: int) -> tuple[int, int]:
    """(units of a token, units that a microsecond refills), both whole."""
    token, step = per_seconds * 1_000_000, refill
    shared = math.gcd(token, step)
    return token // shared, step // shared


def composed(t: np.ndarray, capacity: int, token: int, step: int) -> tuple[int, int, int]:
    """(a, b, c) of the requests at times ``t`` in order."""
    a, b, c = 0, _HIGH, _LOW
    for x in t.tolist():
        high, low = capacity * token - token - step * x, -step * x
        a, b, c = a - token, max(low, min(high, b - token)), max(low, min(high, c - token))
    return a, b, c


def levels(t: np.ndarray, y: int, capacity: int, token: int, step: int) -> np.ndarray:
    """The levels that the requests find, from ``y`` on."""
    out = np.empty(len(t), np.int64)
    for i, x in enumerate(t.tolist()):
        found = min(capacity * token, y + step * x)
        out[i] = found
        y = max(0, found - token) - step * x
    return out


def token_bucket(events: DataFrame, key: str, ts: str, event_id: str, capacity: int, refill: int = 1, per_seconds: int = 1, piece: int = PIECE) -> DataFrame:
    """(event_id, key, ts, tokens, over) of every event: the tokens it found, and whether that was less than one.

    The bucket is full at a client's first request and gains ``refill`` tokens every ``per_seconds``.
    Requests at one time are taken in the order of ``event_id``. A null key is a client; events without a
    time are left out. An empty table gives an empty result.
    """
    token, step = _units(per_seconds, refill)
    k = events.select(F.col(event_id).alias("id"), F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    start = k.agg(F.min("t")).first()[0] or 0  # times from here on keep the numbers small
    timed = materialise(k.filter("t is not null").withColumn("t", F.col("t") - start), "bucket-events")
    rn = free_name(timed.columns, "rn")
    placed = page_index(timed, ["k", "t", "id"]).numbered(rn).withColumn("piece", F.floor(F.col(rn) / piece)).drop(rn)
    placed = materialise(placed, "bucket-pieces")
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        a, b, c = composed(rows["t"].to_numpy(), capacity, token, step)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "piece": rows["piece"].iloc[:1], "first": rows["t"].iloc[:1], "a": [a], "b": [b], "c": [c]})

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        rows, y = rows.sort_values("piece"), None
        begin = []
        for first, a, b, c in zip(*(rows[x].tolist() for x in ("first", "a", "b", "c"))):
            y = capacity * token - step * first if y is None else y
            begin.append(y)
            y = max(c, min(b, y + a))
        return pd.DataFrame({"k": rows["k"], "piece": rows["piece"], "y": begin})

    def run(key_: tuple, rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        if not len(rows):
            return pd.DataFrame({"id": [], "k": [], "t": [], "level": []})
        found = levels(rows["t"].to_numpy(), int(begin["y"].iloc[0]), capacity, token, step)
        return pd.DataFrame({"id": rows["id"], "k": rows["k"], "t": rows["t"], "level": found})

    # one row for each piece of a client; a client's pieces are a small part of its events
    pieces = placed.groupBy("k", "piece").applyInPandas(compose, f"k {kinds['k']}, piece long, first long, a long, b long, c long")
    begins = pieces.groupBy("k").applyInPandas(chained, f"k {kinds['k']}, piece long, y long")
    both = placed.groupBy("k", "piece").cogroup(begins.groupBy("k", "piece"))
    out = both.applyInPandas(run, f"id {kinds['id']}, k {kinds['k']}, t long, level long")
    return out.select(
        F.col("id").alias(event_id), F.col("k").alias(key), F.timestamp_micros(F.col("t") + start).alias(ts),
        (F.col("level") / token).alias("tokens"), (F.col("level") < token).alias("over"),
    )
