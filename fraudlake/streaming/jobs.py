"""Structured Streaming jobs with the definitions of the batch operators.

Every job takes a streaming transaction DataFrame with the canonical columns and returns a
streaming DataFrame; ``run_available`` writes one to files in append mode.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fraudlake.cols import HOUR_US
from fraudlake.operators import pit
from fraudlake.session import ensure_checkpoint_dir

DELAY = "1 hour"


def run_available(df: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available now into Parquet files and read them back.

    The same ``path`` continues from its own checkpoint, so a restart repeats nothing.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def alert_feed(txn: DataFrame, known: DataFrame, score: float = 0.9, delay: str = DELAY) -> DataFrame:
    """High-score transactions, each once, without those that are alerts already."""
    hot = txn.where(F.col("risk_score") >= score).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["txn_id"])
    return hot.join(known.select("txn_id"), "txn_id", "left_anti").select("txn_id", "ts", "customer_id", "card", "risk_score", "amt")


def daily_counts(txn: DataFrame, delay: str = DELAY) -> DataFrame:
    g = txn.withWatermark("ts", delay).groupBy("card", F.window("ts", "1 day").alias("w"))
    return g.agg(F.count("*").alias("n"), F.count(F.when(F.col("channel") == "online", 1)).alias("n_online")).select(
        "card", F.unix_micros("w.start").alias("start_us"), "n", "n_online")


def sliding_bursts(txn: DataFrame, length: str = "48 hours", slide: str = "24 hours", min_n: int = 2, delay: str = DELAY) -> DataFrame:
    g = txn.where(F.col("channel") == "online").withWatermark("ts", delay).groupBy("card", F.window("ts", length, slide).alias("w"))
    n = g.agg(F.count("*").alias("n_online"))
    return n.where(F.col("n_online") >= min_n).select("card", F.unix_micros("w.start").alias("start_us"), "n_online")


def burst_sessions(txn: DataFrame, gap: str = "48 hours", delay: str = DELAY) -> DataFrame:
    g = txn.withWatermark("ts", delay).groupBy("card", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum(F.col("amt").cast("decimal(28,6)")).cast("double").alias("amt")).select(
        "card", F.unix_micros("w.start").alias("start_us"), "n", "amt")


FIRST_OUT = "txn_id long, is_new_device boolean, unseen_product boolean, unseen_email boolean, home_addr1 string"
FIRST_STATE = "n long, devices array<string>, products array<string>, emails array<string>, regions array<string>, counts array<long>"


def _first_seen(min_prior: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, dev, prod, mail, regs, cnt = state.get if state.exists else (0, [], [], [], [], [])
        dev, prod, mail = set(dev), set(prod), set(mail)
        homes = dict(zip(regs, cnt))  # keeps the order of first use
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts_us", "txn_id"])
        for r in rows.itertuples(index=False):
            on, enough = r.channel == "online", n >= min_prior
            home = max(homes, key=homes.get) if homes else None
            out.append((r.txn_id,
                        r.device_profile not in dev if enough and on and r.device_profile is not None else None,
                        r.product_cd not in prod if enough and r.product_cd is not None else None,
                        r.p_email not in mail if enough and on and r.p_email is not None else None, home))
            for s, v in ((dev, r.device_profile), (prod, r.product_cd), (mail, r.p_email)):
                if v is not None:
                    s.add(v)
            if r.channel == "in_person" and r.addr1 is not None:
                homes[r.addr1] = homes.get(r.addr1, 0) + 1
            n += 1
        state.update((n, sorted(dev), sorted(prod), sorted(mail), list(homes), [int(v) for v in homes.values()]))
        yield pd.DataFrame(out, columns=["txn_id", "is_new_device", "unseen_product", "unseen_email", "home_addr1"])
    return step


def first_seen(txn: DataFrame, min_prior: int = 5) -> DataFrame:
    """First-seen flags and running home region from per-card state; in-order input equals the batch features.

    The state holds distinct values and counters only, never rows.
    """
    cols = ["card", "txn_id", "ts_us", "channel", "device_profile", "product_cd", "p_email", "addr1"]
    return txn.select(*cols).groupBy("card").applyInPandasWithState(_first_seen(min_prior), FIRST_OUT, FIRST_STATE, "append", GroupStateTimeout.NoTimeout)


TEST_OUT = "txn_id long, n_small long"
TEST_STATE = "small array<long>"


def _testing(small: float, large: float, k: int, span_us: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts_us", "txn_id"])
        for r in rows.itertuples(index=False):
            if r.amt > large:
                n = sum(1 for t in times if r.ts_us - span_us <= t < r.ts_us)
                if n >= k:
                    out.append((r.txn_id, n))
            elif r.amt < small:
                times.append(int(r.ts_us))
            # small rows older than the span cannot count again
            while times and times[0] < r.ts_us - span_us:
                times.pop(0)
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max(times[-1] + span_us, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["txn_id", "n_small"])
    return step


def testing_sequences(txn: DataFrame, small: float = 5.0, large: float = 100.0, k: int = 3, hours: float = 1.0, delay: str = DELAY) -> DataFrame:
    """Large online rows after ``k`` small ones; state keeps the small rows of the last ``hours`` and expires with them."""
    rows = txn.where((F.col("channel") == "online") & ((F.col("amt") < small) | (F.col("amt") > large)))
    rows = rows.withWatermark("ts", delay).select("card", "ts", "ts_us", "txn_id", "amt")
    return rows.groupBy("card").applyInPandasWithState(_testing(small, large, k, int(hours * HOUR_US)), TEST_OUT, TEST_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def nearby_join(alerts: DataFrame, txn: DataFrame, hours: int = 48, delay: str = DELAY, key: str = "card") -> DataFrame:
    """Alerts with the card's transactions within ``hours``; both sides are keyed by time bucket as well.

    ``alerts(alert_id, card, at)``; the time condition bounds the join state.
    """
    width = 2 * hours * HOUR_US
    b = lambda c: F.floor(F.unix_micros(c) / width)
    gap = F.expr(f"INTERVAL {hours} HOURS")
    a = alerts.withWatermark("at", delay)
    a = a.withColumn("_b", F.explode(F.array_distinct(F.array(b(F.col("at") - gap), b(F.col("at") + gap)))))
    t = txn.withWatermark("ts", delay).select(F.col(key).alias("_key"), "ts", "txn_id", b(F.col("ts")).alias("_tb"))
    on = ((F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_tb")) & (F.col("ts") >= F.col("at") - gap) & (F.col("ts") <= F.col("at") + gap))
    return a.join(t, on, "inner").select("alert_id", "txn_id")


def case_history(txn: DataFrame, cj: DataFrame) -> DataFrame:
    """As-of case flags on a stream: the static side holds one earliest closing time for each key."""
    return pit.prior_case_flags(txn, cj).select("txn_id", "prior_fraud_card", "prior_fraud_customer", "prior_cleared_travel", "prior_cleared_phone")


def append_memory(cases: DataFrame, path: str, at: str):
    """Start writing investigated cases; a repeated batch overwrites its own folder, so nothing doubles.

    Of a case that comes several times the newest by ``at`` is kept, in a batch and between batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        one = newest(batch, at).withColumn("batch_id", F.lit(batch_id).cast("long"))
        one.write.mode("overwrite").parquet(f"{path}/case/batch={batch_id}")
    return (cases.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def newest(rows: DataFrame, *at: str) -> DataFrame:
    """One row for each case: the newest by ``at``, ties by the row as text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy("case_id").agg(F.max_by(whole, F.struct(*at, F.to_json(whole))).alias("r")).select("r.*")


def read_memory(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Stored cases; of a case written in several batches the newest stays."""
    return newest(spark.read.parquet(f"{path}/case").drop("batch"), at, "batch_id").drop("batch_id")
