"""Exact rolling median over a time range.

Cards with few rows use Spark's own ``percentile`` over a range frame, whose cost grows with rows times
window length. Busier cards are answered by rank selection over value ranges. The distinct values of a card are
numbered in order; a range is a prefix of the number written in base ``FAN``. In each round a window asks how many of its
rows lie in each of the ``FAN`` parts of its range: two probes on a time line of (card, range) that carries ``FAN``
running counts. The part that holds the wanted rank is the range of the next round; after the last one it is a single value.
A round costs one sorted pass whatever the length of the windows, a card with ``D`` distinct values takes ``log(D)`` rounds to
base ``FAN``, and time lines of hot cards are cut into slices like all others. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import SEC_US
from fraudlake.operators.timeline import _carry, add_slice, find_slices, heavy_keys, join_key, running_at
from fraudlake.session import cut, small

NATIVE_ROWS_CONF = "fraudlake.nativeMedianRows"
FAN = 16


def value_numbers(rows: DataFrame) -> DataFrame:
    """``(card, v, number)``: the distinct values of each card numbered from 0 in ascending order, NaN last.

    A card with too many values for one task is numbered in slices of its value range.
    """
    key = ["card"]
    values = rows.select("card", "v").distinct()
    order = F.struct(F.isnan("v").alias("nan"), "v")
    plain = values.where(~F.isnan("v"))
    slices = find_slices(plain, key, "v")
    d = add_slice(values, slices, key, "v")
    if slices is not None:
        # a NaN is above every slice start
        d = d.withColumn("_slice", F.when(F.isnan("v"), F.lit(2**31 - 1)).otherwise(F.col("_slice")))
    part = [*key, "_slice"] if slices is not None else key
    d = d.withColumn("number", F.row_number().over(Window.partitionBy(*part).orderBy(order)).cast("long") - 1)
    if slices is not None:
        c = _carry(d, key, {"n": F.count("*")}, {"n": "sum"})
        d = join_key(d, c, [*key, "_slice"], "left").withColumn("number", F.col("number") + F.coalesce("_c_n", F.lit(0)))
    return d.select("card", "v", "number")


def _part_of(counts: list[Column], rank: Column) -> Column:
    """The part that holds ``rank`` (from 0), and the rank inside it."""
    found, below = None, F.lit(0).cast("long")
    for k, c in enumerate(counts):
        here = rank < below + c
        pick = F.struct(F.lit(k).cast("long").alias("part"), (rank - below).alias("rank"))
        found = F.when(here, pick) if found is None else found.when(here, pick)
        below = below + c
    return found


def _selected(rows: DataFrame, value: str, frame_us: int) -> DataFrame:
    """``(card, ts_us, med)`` for every card and time of ``rows`` whose window holds a value.

    The window depends on the card and the time alone, so rows with the same or no id need no special care.
    """
    key = ["card"]
    data = cut(rows.select("card", "ts_us", F.col(value).cast("double").alias("v")))
    times = data.select("card", "ts_us").distinct()
    data = data.where(F.col("v").isNotNull())
    values = cut(value_numbers(data))
    most = values.agg(F.max("number")).first()[0]
    if most is None:
        return times.select("card", "ts_us", F.lit(None).cast("double").alias("med")).where(F.lit(False))
    rounds = 1
    while FAN**rounds <= most:
        rounds += 1
    # equal rows of one time count once, with their number
    events = cut(join_key(data.groupBy("card", "ts_us", "v").agg(F.count("*").alias("n")), values, ["card", "v"], "inner").select("card", "ts_us", "number", "n"))
    asks = times.select("card", "ts_us", F.lit(0).cast("long").alias("range"), F.lit(None).cast("string").alias("which"), F.lit(None).cast("long").alias("rank"))
    names = [f"c{k}" for k in range(FAN)]
    for r in range(rounds):
        width = FAN ** (rounds - r - 1)     # values in a part
        part = F.floor(F.col("number") / F.lit(width)) % FAN
        line = events.select("card", F.floor(F.col("number") / F.lit(width * FAN)).alias("range"), F.col("ts_us").alias("t"),
                             *[F.when(part == k, F.col("n")).otherwise(F.lit(0).cast("long")).alias(names[k]) for k in range(FAN)])
        ends = F.array(F.struct((F.col("ts_us") - frame_us - 1).alias("t"), F.lit(-1).alias("sign")),
                       F.struct((F.col("ts_us") - SEC_US).alias("t"), F.lit(1).alias("sign")))
        ids = ["card", "range", "ts_us", "which", "rank"]
        probes = asks.select(*ids, F.explode(ends).alias("_p")).select(*ids, "_p.t", "_p.sign")
        counts = running_at(line, probes, ["card", "range"], names, ids)
        cols = [F.col(c) for c in names]
        if r == 0:
            # both middle ranks from the number of rows; they are one and the same when it is odd
            total = sum(cols[1:], cols[0])
            ranks = F.array(F.struct(F.lit("low").alias("which"), F.floor((total - 1) / F.lit(2)).alias("rank")),
                            F.struct(F.lit("high").alias("which"), F.floor(total / F.lit(2)).alias("rank")))
            counts = (counts.where(total > 0).drop("which", "rank")
                      .select("card", "range", "ts_us", *names, F.explode(F.when(total % 2 == 1, F.slice(ranks, 1, 1)).otherwise(ranks)).alias("_w"))
                      .select("card", "range", "ts_us", *names, "_w.which", "_w.rank"))
        got = _part_of(cols, F.col("rank"))
        asks = (counts.withColumn("_g", got)
                .select("card", "ts_us", (F.col("range") * FAN + F.col("_g.part")).alias("range"), "which", F.col("_g.rank").alias("rank")))
        if r + 1 < rounds:
            asks = cut(asks)
    picked = join_key(asks.select("card", "ts_us", "which", F.col("range").alias("number")), values, ["card", "number"], "inner")
    low, high = F.max(F.when(F.col("which") == "low", F.col("v"))), F.max(F.when(F.col("which") == "high", F.col("v")))
    both = picked.groupBy("card", "ts_us").agg(low.alias("lo"), F.coalesce(high, low).alias("hi"))
    # same interpolation as an exact 0.5 percentile
    return both.select("card", "ts_us", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0.5 * F.col("lo") + 0.5 * F.col("hi")).alias("med"))


def rolling_median(txn: DataFrame, value: str, frame_us: int, out: str) -> DataFrame:
    """Add ``out``: the median of ``value`` over the card's rows in ``[ts - frame, ts - 1 s]``."""
    w = Window.partitionBy("card").orderBy("ts_us").rangeBetween(-frame_us, -SEC_US)
    native = lambda df: df.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(w))
    rows = int(txn.sparkSession.conf.get(NATIVE_ROWS_CONF, "2000"))
    busy = heavy_keys(txn, ["card"], rows)
    if busy is None:
        return native(txn)
    # three readers follow: the input, with all windows before it, is computed once
    txn = cut(txn)
    keys = small(busy.select("card"))
    few, many = join_key(txn, keys, ["card"], "left_anti"), join_key(txn, keys, ["card"], "left_semi")
    med = cut(_selected(many.select("card", "ts_us", value), value, frame_us))
    many = join_key(many, med.withColumnRenamed("med", out), ["card", "ts_us"], "left")
    return native(few).unionByName(many)
