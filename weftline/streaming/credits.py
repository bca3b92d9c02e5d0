"""A ledger of credits on a stream: balances with expiry, as state that outlives restarts."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.sources.tables import shared_dir

#: The expiry of credits that have none, in microseconds.
NEVER = 1 << 62
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Wallet(StatefulProcessor):
    """One key's open credits by expiry, what no credit covered, and the time of its last entry."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wallet", "expiries array<bigint>, credits array<bigint>, over bigint, last bigint")

    def _read(self) -> tuple[dict[int, int], int, int]:
        if not self.state.exists():
            return {}, 0, -NEVER
        expiries, credits, over, last = self.state.get()
        return dict(zip(expiries, credits)), over, last

    def _write(self, open_: dict[int, int], over: int, last: int) -> None:
        kept = sorted((e, v) for e, v in open_.items() if e >= last and v > 0)
        self.state.update(([e for e, _ in kept], [v for _, v in kept], over, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, over, last = self._read()
        out, timers = [], set()
        for at, tie, credits, expires in sorted(x for frame in rows for x in frame[["at", "id", "credits", "expires"]].itertuples(index=False, name=None)):
            last = max(last, at)  # what comes late counts from now on
            if credits >= 0:
                open_[expires] = open_.get(expires, 0) + credits
                if expires < NEVER and expires >= last:
                    timers.add(expires // 1000 + 1)
            else:
                left = -credits
                for e in sorted(e for e, v in open_.items() if e >= last and v > 0):
                    used = min(left, open_[e])
                    open_[e], left = open_[e] - used, left - used
                    if not left:
                        break
                over += left
            out.append((*key, at, tie, sum(v for e, v in open_.items() if e >= last) - over))
        for t in timers:
            self.handle.registerTimer(t)
        self._write(open_, over, last)
        yield pd.DataFrame(out, columns=[*self.keys, "at", "id", "balance"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        open_, over, last = self._read()
        gone = any(e < at and v > 0 for e, v in open_.items())
        last = max(last, at)
        self._write(open_, over, last)
        rows = [(*key, at, None, sum(v for e, v in open_.items() if e >= at) - over)] if gone else []
        yield pd.DataFrame(rows, columns=[*self.keys, "at", "id", "balance"]).astype({"at": "int64", "id": "Int64", "balance": "int64"})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State of any size lies in RocksDB while a query starts; the session's own choice comes back."""
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, old)


def balances(stream: DataFrame, keys: list[str], late: str, at: str = "at", tie: str = "id", credits: str = "credits", expires: str = "expires") -> DataFrame:
    """``keys, at, id, balance``: the balance behind each entry of a stream, and, with a NULL id, when credits have expired.

    Debits use the credits that expire first; what none covers is an overdraft. ``at`` and ``expires`` are timestamps, NULL
    expires never. Within a batch entries count in the order of ``at`` and ``id``; an entry older than its key's last one counts at
    that one's time; one older than the watermark (``late``) is left out by Spark. An expiry is told by a timer when the
    watermark has passed it. ``at`` comes out in microseconds. A key's open credits, one number for each expiry, are its state.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = stream.withColumn("__time", F.col(at).cast("timestamp")).withWatermark("__time", late)
    rows = timed.select(*keys, "__time", micros(at).alias("at"), F.col(tie).cast("long").alias("id"), F.col(credits).cast("long").alias("credits"), F.coalesce(micros(expires), F.lit(NEVER)).alias("expires"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "at long", "id long", "balance long"])
    return rows.groupBy(*keys).transformWithStateInPandas(_Wallet(keys), schema, "append", "EventTime")


def run_available(out: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all there is now, into Parquet at ``path``, and read that; with the same ``checkpoint`` it goes on where it ended."""
    spark = out.sparkSession
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/rows", checkpoint or f"{base}/checkpoint"
    with _rocks(spark):
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
