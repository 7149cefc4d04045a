"""Point-in-time features: every value uses only rows of the card strictly before the row.

Row order on a card is ``(ts_us, txn_id)``. One shuffle by card serves all windows of a
normal card. Cards above the task limit take the sliced path with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US, SEC_US, is_proxied
from fraudlake.operators.ranks import from_key, keys_at
from fraudlake.operators.rolling import rolling_median
from fraudlake.operators.timeline import (_carry, add_slice, find_slices, heavy_keys, join_key, window_sums)
from fraudlake.session import cut, max_rows, small

ORDER = ["ts_us", "txn_id"]
RAW = ["n_prior", "prev_txn_id", "gap_secs", "n_prior_90d", "n_online_48h", "n_online_24h", "n_in_person_24h",
       "new_device", "new_product", "new_email", "home_addr1", "prior_max_amt"]
# name, frame length, counted rows
FRAMES = [("n_prior_90d", 90 * DAY_US, None), ("n_online_48h", 48 * HOUR_US, "online"),
          ("n_online_24h", 24 * HOUR_US, "online"), ("n_in_person_24h", 24 * HOUR_US, "in_person")]


def online() -> Column:
    return F.col("channel") == "online"


def in_person() -> Column:
    return F.col("channel") == "in_person"


def _hit(channel: str | None) -> Column:
    return F.lit(1) if channel is None else F.when(F.col("channel") == channel, 1).otherwise(0)


def _range_count(channel: str | None, frame_us: int) -> Column:
    """Rows in ``[ts - frame, ts - 1 s]`` as a difference of two growing frames, each linear."""
    w = Window.partitionBy("card").orderBy("ts_us")
    upto = lambda end: F.coalesce(
        F.sum(_hit(channel)).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    return upto(-SEC_US) - upto(-frame_us - 1)


def _home_pick(best: Column) -> Column:
    return best.getField("addr1")


def _card_windows(txn: DataFrame) -> DataFrame:
    w = Window.partitionBy("card").orderBy(*ORDER)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda v: F.row_number().over(Window.partitionBy("card", v).orderBy(*ORDER)) == 1
    df = txn.withColumn("_rn", F.row_number().over(w))
    df = df.withColumn("n_prior", (F.col("_rn") - 1).cast("long"))
    for name, frame, ch in FRAMES:
        df = df.withColumn(name, _range_count(ch, frame))
    df = (df.withColumn("prev_txn_id", F.lag("txn_id").over(w))
            .withColumn("gap_secs", (F.col("ts_us") - F.lag("ts_us").over(w)) / F.lit(1e6))
            .withColumn("prior_max_amt", F.max("amt").over(prior)))
    counted = in_person() & F.col("addr1").isNotNull()
    by_addr = Window.partitionBy("card", "addr1").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    df = (df.withColumn("_n", F.sum(F.when(counted, 1).otherwise(0)).over(by_addr))
            .withColumn("_first", F.min(F.when(counted, F.col("_rn"))).over(by_addr))
            .withColumn("_cand", F.when(counted, F.struct(F.col("_n"), (-F.col("_first")).alias("f"), "addr1"))))
    df = df.withColumn("home_addr1", _home_pick(F.max("_cand").over(prior)))
    return (df.withColumn("new_device", first("device_profile")).withColumn("new_product", first("product_cd"))
              .withColumn("new_email", first("p_email")).select(*txn.columns, *RAW))


def _card_slices(txn: DataFrame, slices: DataFrame) -> DataFrame:
    """The same columns for cards too large for one task."""
    key = ["card"]
    txn = cut(txn)
    df = add_slice(txn, slices, key)
    w = Window.partitionBy("card", "_slice").orderBy(*ORDER)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("ts_us", "txn_id"))
    c = _carry(df, key, {"n": F.count("*"), "last": last, "amt": F.max("amt")},
               {"n": "sum", "last": "max", "amt": "max"})
    df = join_key(df, small(c), [*key, "_slice"], "left")
    prev = F.coalesce(F.lag(F.struct("ts_us", "txn_id")).over(w), F.col("_c_last"))
    df = (df.withColumn("_rn", F.row_number().over(w) + F.coalesce("_c_n", F.lit(0)))
            .withColumn("n_prior", F.col("_rn") - 1).withColumn("_prev", prev)
            .withColumn("prev_txn_id", F.col("_prev.txn_id"))
            .withColumn("gap_secs", (F.col("ts_us") - F.col("_prev.ts_us")) / F.lit(1e6))
            .withColumn("prior_max_amt", F.greatest(F.max("amt").over(prior), F.col("_c_amt"))))
    # home region: running count for each (card, region), then a running maximum for the card
    counted = in_person() & F.col("addr1").isNotNull()
    seen = df.where(counted).select("card", "_slice", "txn_id", "addr1", "_rn", "ts_us")
    rk = ["card", "addr1"]
    wr = Window.partitionBy(*rk, "_slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    cr = _carry(seen, rk, {"n": F.count("*"), "f": F.min("_rn")}, {"n": "sum", "f": "min"})
    seen = (join_key(seen, cr, [*rk, "_slice"], "left")
            .withColumn("_n", F.count("*").over(wr) + F.coalesce("_c_n", F.lit(0)))
            .withColumn("_f", F.least(F.min("_rn").over(wr), F.col("_c_f")))
            .select("txn_id", F.struct("_n", (-F.col("_f")).alias("f"), "addr1").alias("_cand")))
    df = cut(df.join(seen, "txn_id", "left"))
    cb = _carry(df, key, {"best": F.max("_cand")}, {"best": "max"})
    df = join_key(df, small(cb), [*key, "_slice"], "left")
    df = df.withColumn("home_addr1", _home_pick(F.greatest(F.max("_cand").over(prior), F.col("_c_best"))))
    for name, v in (("new_device", "device_profile"), ("new_product", "product_cd"), ("new_email", "p_email")):
        firsts = (txn.groupBy("card", v).agg(F.min(F.struct("ts_us", "txn_id")).alias("_m"))
                  .select(F.col("_m.txn_id").alias("txn_id"), F.lit(True).alias(name)))
        df = df.join(firsts, "txn_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    probes = df.select("card", "txn_id", "ts_us").withColumn("f", F.explode(F.array(
        *[F.struct(F.lit(n).alias("frame"), F.lit(fr).alias("len")) for n, fr, _ in FRAMES])))
    probes = probes.select("card", "txn_id", F.col("f.frame").alias("frame"),
                           (F.col("ts_us") - F.col("f.len")).alias("lo_us"), (F.col("ts_us") - SEC_US).alias("hi_us"))
    sums = window_sums(probes, txn, key, {"n_all": _hit(None), "n_on": _hit("online"), "n_ip": _hit("in_person")},
                       ["txn_id", "frame"], prune=False)
    pick = {None: "n_all", "online": "n_on", "in_person": "n_ip"}
    counts = sums.groupBy("txn_id").agg(*[
        F.max(F.when(F.col("frame") == n, F.col(pick[ch]))).alias(n) for n, _, ch in FRAMES])
    return df.join(counts, "txn_id", "left").select(*txn.columns, *RAW)


def pit_base(txn: DataFrame) -> DataFrame:
    """Counts, previous row, first-seen flags, running home region and running maximum."""
    giant = heavy_keys(txn, ["card"], max_rows(txn.sparkSession))
    if giant is None:
        return _card_windows(txn)
    keys = small(giant.select("card"))
    many = join_key(txn, keys, ["card"], "left_semi")
    slices = find_slices(many, ["card"])
    return _card_windows(join_key(txn, keys, ["card"], "left_anti")).unionByName(cut(_card_slices(many, slices)))


def pit_counts(txn: DataFrame) -> DataFrame:
    return pit_base(txn).select("txn_id", "n_prior", *[n for n, _, _ in FRAMES])


def pit_amount(txn: DataFrame, frame_us: int = 90 * DAY_US) -> DataFrame:
    """Rolling median, then the rolling median of each prior row's distance to its own prior median."""
    med = rolling_median(txn, "amt", frame_us, "prior_median")
    dev = med.withColumn("_dev", F.abs(F.col("amt") - F.col("prior_median")))
    return rolling_median(dev, "_dev", frame_us, "prior_mad").drop("_dev")


def amount_z() -> Column:
    usable = (F.col("n_prior_90d") >= 5) & F.col("prior_mad").isNotNull() & (F.col("prior_mad") != 0)
    return F.when(usable, (F.col("amt") - F.col("prior_median")) / (1.4826 * F.col("prior_mad")))


def flag_columns(min_prior: int = 5) -> dict[str, Column]:
    """Three-valued flags: NULL where not applicable or the card has too little history."""
    enough = F.col("n_prior") >= min_prior
    return {
        "is_new_device": F.when(enough & online() & F.col("device_profile").isNotNull(), F.col("new_device")),
        "unseen_product": F.when(enough & F.col("product_cd").isNotNull(), F.col("new_product")),
        "unseen_email": F.when(enough & online() & F.col("p_email").isNotNull(), F.col("new_email")),
        "out_of_home": F.when(enough & in_person() & F.col("addr1").isNotNull() & F.col("home_addr1").isNotNull(),
                              F.col("addr1") != F.col("home_addr1")),
    }


def burst_bucket() -> Column:
    n = F.col("n_online_48h")
    return F.when(n >= 5, "5+").when(n >= 2, "2-4").when(n == 1, "1").otherwise("0")


def mixed_channel() -> Column:
    return (F.col("n_online_24h") > 0) & (F.col("n_in_person_24h") > 0)


def prior_case_flags(txn: DataFrame, cj: DataFrame) -> DataFrame:
    """Four as-of flags: a case closed before the row exists exactly when the earliest closed before it."""
    note = F.col("analyst_notes")
    fraud, cleared = F.col("outcome") == "confirmed_fraud", F.col("outcome") == "cleared"
    by_card = cj.where(F.col("card").isNotNull()).groupBy("card").agg(
        F.min(F.when(fraud, F.col("closed_us"))).alias("_f"),
        F.min(F.when(cleared & note.ilike("%confirmed travel%"), F.col("closed_us"))).alias("_t"),
        F.min(F.when(cleared & note.ilike("%new phone%"), F.col("closed_us"))).alias("_p"))
    by_cust = cj.groupBy("customer_id").agg(F.min(F.when(fraud, F.col("closed_us"))).alias("_cf"))
    before = lambda c: F.coalesce(F.col(c) < F.col("ts_us"), F.lit(False))
    j = txn.join(by_card, "card", "left").join(by_cust, "customer_id", "left")
    return (j.withColumn("prior_fraud_card", before("_f")).withColumn("prior_fraud_customer", before("_cf"))
             .withColumn("prior_cleared_travel", before("_t")).withColumn("prior_cleared_phone", before("_p"))
             .drop("_f", "_t", "_p", "_cf"))


def risk_decile(txn: DataFrame, tiles: int = 10) -> DataFrame:
    """Global ``ntile`` over (score, id) with the NULL score last.

    The first key of each tile is found by counting ranges of the scores; the rows themselves are
    then compared with these few keys where they are, without a shuffle.
    """
    z, s = F.col("risk_score").isNull(), F.coalesce("risk_score", F.lit(0.0))
    keys = txn.select(z.alias("z"), s.alias("s"), "txn_id")
    total = keys.count()
    q, r = divmod(total, tiles)
    tile = F.lit(1)
    for first in set(keys_at(keys, total, sorted({i * q + min(i, r) for i in range(1, tiles) if i * q + min(i, r) < total}))):
        tile = tile + F.when(from_key(z, s, F.col("txn_id"), first), 1).otherwise(0)
    return txn.withColumn("risk_decile", tile.cast("int"))


def pit_features(txn: DataFrame, cj: DataFrame) -> DataFrame:
    """The full feature row for every transaction."""
    df = prior_case_flags(pit_amount(pit_base(txn)), cj)
    df = df.withColumn("proxy_flag", is_proxied()).withColumn("amt_z", amount_z())
    for name, col in flag_columns().items():
        df = df.withColumn(name, col)
    df = df.withColumn("mixed_24h", mixed_channel()).withColumn("burst_bucket", burst_bucket())
    return risk_decile(df).drop("new_device", "new_product", "new_email")


def next_edges(txn: DataFrame) -> DataFrame:
    """Edge from each card row to its successor with the gap in seconds."""
    return (pit_base(txn).where(F.col("prev_txn_id").isNotNull())
            .select(F.col("prev_txn_id").alias("src"), F.col("txn_id").alias("dst"), "gap_secs"))


def device_first_seen(txn: DataFrame) -> DataFrame:
    return (txn.where(F.col("device_profile").isNotNull()).groupBy("card", "device_profile")
            .agg(F.min("ts_us").alias("first_us"), F.count("*").alias("n_seen")))
