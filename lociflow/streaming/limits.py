"""Per-client token buckets, over a table or a stream."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.folders import scratch

#: Requests a second, burst, and idle seconds after which a client is forgotten (fixed values).
RATE, BURST, IDLE = 15, 40, 600


#: The session's state store, and the one that keeps state with a time to live.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settings(spark) -> dict[str, int]:
    """rate, burst and idle of a session: what its configuration says under lociflow.limit, else the fixed values. Not a positive number counts as unset."""
    out = {}
    for name, usual in (("rate", RATE), ("burst", BURST), ("idle", IDLE)):
        told = spark.conf.get(f"lociflow.limit.{name}", "")
        out[name] = int(told) if told.isdigit() and int(told) > 0 else usual
    return out


def spend(seconds: list[int], tokens: int, last: int | None, rate: int, burst: int, per: int) -> tuple[list[bool], int, int | None]:
    """Decides requests in order. Tokens are counted in 1/per of one, so that whole seconds stay whole numbers."""
    out = []
    for at in seconds:
        tokens = min(burst * per, tokens + (at - last) * rate) if last is not None else burst * per
        last = at
        ok = tokens >= per
        tokens -= per if ok else 0
        out.append(ok)
    return out, tokens, last


class Transition:
    """What a stretch of requests makes of any number of tokens it may begin with.

    A list of pieces (from, value, whether it rises): from that many tokens on, up
    to the next piece, the stretch leaves the value, which rises with the tokens
    or is the same for all. Whoever begins with more is allowed as many requests
    or more, and the difference is bounded by the burst, so the steps are some
    four times the burst at most, however many requests there are.
    """

    def __init__(self, burst: int, per: int):
        self.full, self.per, self.pieces = burst * per, per, [(0, 0, True)]

    def request(self, gained: int) -> None:
        """A request after so many tokens have flowed in."""
        full, per, out = self.full, self.per, []
        ends = [p[0] for p in self.pieces[1:]] + [full + 1]

        def put(start: int, value: int, rises: bool) -> None:
            value -= per if value >= per else 0
            goes_on = out and out[-1][2] == rises and out[-1][1] + (start - out[-1][0]) * rises == value
            if not goes_on:
                out.append((start, value, rises))

        for (start, value, rises), end in zip(self.pieces, ends, strict=True):
            value += gained
            if not rises:
                put(start, min(value, full), False)
                continue
            capped = max(start, min(end, start + full - value))
            spent = max(start, min(capped, start + per - value))
            if start < spent:
                put(start, value, True)
            if spent < capped:
                put(spent, value + spent - start, True)
            if capped < end:
                put(capped, full, False)
        self.pieces = out

    def after(self, tokens: int) -> int:
        start, value, rises = self.pieces[bisect.bisect_right(self.pieces, (tokens, self.full + 1, True)) - 1]
        return value + (tokens - start if rises else 0)


def token_bucket(events: DataFrame, client: str, seconds: str, order: str, rate: int | None = None, burst: int | None = None, per: int = 1) -> DataFrame:
    """events' (client, order, allowed): whether each request found a token. rate tokens flow in every `per` seconds.

    rate and burst are the session's settings where they are not given. Requests
    are cut into stretches by ranges of (client, time, order), so a client that
    makes very many is several stretches. Each stretch says what it makes of any
    number of tokens; these are put together in turn, a row a stretch, and then
    every stretch decides from what it begins with. Requests of a null client are
    one client's; repeated rows are requests each.
    """
    told = settings(events.sparkSession)
    rate, burst = rate or told["rate"], burst or told["burst"]
    spark, kind = events.sparkSession, dict(events.dtypes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = scratch(spark, "requests")
    rows = events.select(F.col(client).alias("client"), F.col(seconds).cast("bigint").alias("at"), F.col(order).alias("n"))
    rows.repartitionByRange(n, "client", "at", "n").withColumn("part", F.spark_partition_id()).write.parquet(kept)
    stretches = spark.read.parquet(kept).groupBy("client", "part")
    key = f"client {kind[client]}, part int"

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        at = sorted(pdf["at"].tolist())
        made = Transition(burst, per)
        for before, now in zip([at[0], *at], at, strict=False):
            made.request((now - before) * rate)
        start, value, rises = (list(x) for x in zip(*made.pieces, strict=True))
        return pd.DataFrame({"client": pdf["client"].iloc[:1], "part": pdf["part"].iloc[:1], "first": at[0], "last": at[-1], "start": [start], "value": [value], "rises": [rises]})

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, last, begins = burst * per, None, []
        pdf = pdf.sort_values("part", ignore_index=True)
        for r in pdf.itertuples():
            tokens = min(burst * per, tokens + (r.first - last) * rate) if last is not None else burst * per
            begins.append(tokens)
            made = Transition(burst, per)
            made.pieces = list(zip(map(int, r.start), map(int, r.value), map(bool, r.rises), strict=True))
            tokens, last = made.after(tokens), r.last
        return pdf[["client", "part"]].assign(tokens=begins)

    def decide(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"], ignore_index=True)
        allowed, _, _ = spend(pdf["at"].tolist(), int(begin["tokens"].iloc[0]), int(pdf["at"].iloc[0]), rate, burst, per)
        return pdf.assign(allowed=allowed)[["client", "n", "allowed"]]

    summed = stretches.applyInPandas(sum_up, f"{key}, first bigint, last bigint, start array<bigint>, value array<bigint>, rises array<boolean>")
    begins = summed.groupBy("client").applyInPandas(put_together, f"{key}, tokens bigint")
    decided = stretches.cogroup(begins.groupBy("client", "part")).applyInPandas(decide, f"client {kind[client]}, n {kind[order]}, allowed boolean")
    return decided.select(F.col("client").alias(client), F.col("n").alias(order), "allowed")


class Bucket(StatefulProcessor):
    """A client's tokens and the second of its last request, which are forgotten when it is idle."""

    def __init__(self, columns: list[str], rate: int, burst: int, per: int, idle: int):
        self.columns, self.rate, self.burst, self.per, self.idle = columns, rate, burst, per, idle

    def init(self, handle) -> None:
        self.held = handle.getValueState("bucket", "tokens bigint, last bigint", ttlDurationMs=self.idle * 1000)

    def handleInputRows(self, key, rows, timerValues):
        client, seconds, order = self.columns
        pdf = pd.concat(list(rows)).sort_values([seconds, order], ignore_index=True)
        tokens, last = self.held.get() if self.held.exists() else (0, None)
        allowed, tokens, last = spend(pdf[seconds].tolist(), tokens, last, self.rate, self.burst, self.per)
        self.held.update((int(tokens), int(last)))
        yield pdf.assign(allowed=allowed)[[client, order, "allowed"]]

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, client: str, seconds: str, order: str, rate: int | None = None, burst: int | None = None, per: int = 1, idle: int | None = None) -> DataFrame:
    """The same over a stream. A client that is idle that long is forgotten and starts with a full bucket.

    State has a time to live, so nothing wakes up for clients that are gone. It
    needs the RocksDB state store, which the session is given if it has the
    usual one.
    """
    spark = events.sparkSession
    told = settings(spark)
    rate, burst, idle = rate or told["rate"], burst or told["burst"], idle or told["idle"]
    if "RocksDB" not in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKSDB)
    kind = dict(events.dtypes)
    grouped = events.select(client, seconds, order).groupBy(client)
    bucket = Bucket([client, seconds, order], rate, burst, per, idle)
    return grouped.transformWithStateInPandas(bucket, f"{client} {kind[client]}, {order} {kind[order]}, allowed boolean", "Append", "ProcessingTime")


def sessions(events: DataFrame, client: str, time: str, idle: str = "10 minutes") -> DataFrame:
    """A client's sessions: how long its bucket lived before it was forgotten."""
    return events.groupBy(client, F.session_window(time, idle).alias("w")).agg(F.count("*").alias("requests")).select(client, F.col("w.start").alias("opened"), F.col("w.end").alias("forgotten"), "requests")
