"""Per-key time lines that stay balanced when one key holds much of the data.

A window partitioned by a key puts the whole key into one task. Here a key with more
rows than a task should hold is cut into consecutive time slices; every slice is
computed on its own and the state at its start (the *carry*) comes from pre-aggregated
slice totals. Without such keys no slices exist and the plans are plain windows.

Counts in a time range are differences of two running totals, so a probe costs two
rows in one sorted pass instead of one row for each partner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.session import BROADCAST_ROWS, cut, max_rows, small


def _memo(df: DataFrame, what: tuple, make):
    """Reuse a size check for the same plan; a stale answer costs balance, never results."""
    store = df.sparkSession.__dict__.setdefault("_fraudlake_checks", {})
    name = (df.semanticHash(), df.sparkSession.sparkContext.applicationId, *what)
    if name not in store:
        store[name] = make()
    return store[name]


def join_key(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """Equi-join on ``key`` that matches NULL with NULL, as the partitions of a window do."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") if k in key else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in key:
        same = same & left[k].eqNullSafe(r[f"_k_{k}"])
    return left.join(r, same, how).drop(*[f"_k_{k}" for k in key])


def heavy_keys(df: DataFrame, key: list[str], rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``rows`` rows and their counts, materialised; None if there are none."""
    rows = rows or max_rows(df.sparkSession)

    # a table that fits one task has no heavy key, whatever the key is
    total = _memo(df, ("count",), df.count)
    if total <= rows:
        return None

    def make():
        heavy = df.groupBy(*key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > rows)
        return None if heavy.isEmpty() else cut(heavy)
    return _memo(df, ("heavy", tuple(key), rows), make)


def find_slices(df: DataFrame, key: list[str], t: str = "ts_us", rows: int | None = None) -> DataFrame | None:
    """Slice starts for every heavy key: ``(*key, starts array<long>)``; None if no key is heavy.

    Any starts give right results, so approximate percentiles are enough; the table is
    materialised because all readers have to see the same starts.
    """
    rows = rows or max_rows(df.sparkSession)
    heavy = heavy_keys(df, key, rows)
    if heavy is None:
        return None

    def make():
        most = heavy.agg(F.max("n_rows")).first()[0]
        pieces = min(max(2, math.ceil(2 * most / rows)), 20_000)
        marks = [i / pieces for i in range(1, pieces)]
        return cut(
            join_key(df, small(heavy.select(*key)), key, "left_semi").groupBy(*key)
            .agg(F.array_sort(F.array_distinct(F.percentile_approx(t, marks, 10 * pieces))).alias("starts")))
    return _memo(df, ("slices", tuple(key), t, rows), make)


def add_slice(df: DataFrame, slices: DataFrame | None, key: list[str], t: str = "ts_us") -> DataFrame:
    """Number of slice starts at or before the row's time; 0 for keys that are not sliced."""
    if slices is None:
        return df.withColumn("_slice", F.lit(0))
    s = small(slices.withColumnRenamed("starts", "_starts"))
    return (join_key(df, s, key, "left")
            .withColumn("_slice", F.coalesce(F.expr(f"size(filter(_starts, s -> s <= {t}))"), F.lit(0)))
            .drop("_starts"))


def _carry(df: DataFrame, key: list[str], aggs: dict[str, Column], merge: dict[str, str]) -> DataFrame:
    """For each (key, slice): the aggregate over all earlier slices of the key."""
    tot = df.groupBy(*key, "_slice").agg(*[a.alias(n) for n, a in aggs.items()])
    w = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cols = [getattr(F, merge[n])(n).over(w).alias(f"_c_{n}") for n in aggs]
    return tot.select(*key, "_slice", *cols)


def running_at(events: DataFrame, probes: DataFrame, key: list[str], measures: list[str],
               ids: list[str], t: str = "t", slices: DataFrame | None = None,
               auto: bool = True) -> DataFrame:
    """Totals of ``measures`` over events of the key with time at or before each probe.

    ``events(*key, t, *measures)``; ``probes(*key, t, sign, *ids)``. Returns one row for
    each distinct ``ids`` with the signed sum over its probes.
    """
    if slices is None and auto:
        slices = find_slices(events, key, t)
    extra = [i for i in ids if i not in key]
    e = events.select(*key, F.col(t).alias("t"), F.lit(0).alias("_q"), F.lit(0).alias("sign"),
                      *[F.lit(None).cast(probes.schema[i].dataType).alias(i) for i in extra],
                      *[F.coalesce(F.col(m), F.lit(0).cast(events.schema[m].dataType)).alias(m) for m in measures])
    p = probes.select(*key, F.col(t).alias("t"), F.lit(1).alias("_q"), "sign", *extra,
                      *[F.lit(0).cast(events.schema[m].dataType).alias(m) for m in measures])
    both = add_slice(e.unionByName(p), slices, key, "t")
    part = [*key, "_slice"] if slices is not None else key
    w = Window.partitionBy(*part).orderBy("t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("*", *[F.sum(m).over(w).alias(f"_r_{m}") for m in measures]).where("_q = 1")
    if slices is not None:
        c = _carry(both, key, {m: F.sum(m) for m in measures}, {m: "sum" for m in measures})
        run = join_key(run, c, [*key, "_slice"], "left")
        for m in measures:
            zero = F.lit(0).cast(run.schema[f"_r_{m}"].dataType)
            run = run.withColumn(f"_r_{m}", F.col(f"_r_{m}") + F.coalesce(F.col(f"_c_{m}"), zero))
    return run.groupBy(*ids).agg(*[F.sum(F.col("sign") * F.col(f"_r_{m}")).alias(m) for m in measures])


def running_max(events: DataFrame, probes: DataFrame, key: list[str], measure: str, ids: list[str], t: str = "t") -> DataFrame:
    """The largest ``measure`` over events of the key with time at or before each probe, NULL before the first one.

    A maximum cannot be subtracted like a sum, so the line carries it forward: one sorted pass over events and
    probes, and for a key cut into slices the maximum of all earlier slices as its start.
    """
    slices = find_slices(events, key, t)
    extra = [i for i in ids if i not in key]
    kind = events.schema[measure].dataType
    e = events.select(*key, F.col(t).alias("t"), F.lit(0).alias("_q"), *[F.lit(None).cast(probes.schema[i].dataType).alias(i) for i in extra], measure)
    p = probes.select(*key, F.col(t).alias("t"), F.lit(1).alias("_q"), *extra, F.lit(None).cast(kind).alias(measure))
    both = add_slice(e.unionByName(p), slices, key, "t")
    part = [*key, "_slice"] if slices is not None else key
    w = Window.partitionBy(*part).orderBy("t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("_m", F.max(measure).over(w)).where("_q = 1")
    if slices is not None:
        c = _carry(both, key, {"m": F.max(measure)}, {"m": "max"})
        run = join_key(run, c, [*key, "_slice"], "left").withColumn("_m", F.greatest("_m", "_c_m"))
    return run.select(*ids, F.col("_m").alias(measure))


def asked(probes: DataFrame, data: DataFrame, key: list[str], hi: Column) -> DataFrame:
    """Rows of ``data`` that some probe can count: a probe's key, and a time from the first ``lo_us`` to the last ``hi``.

    Sums are differences of running totals, so rows outside cancel out. The time bounds are literals
    and reach the scan; few probes send their keys to every task, many meet the rows by the shuffle that the
    window needs anyway.
    """
    span = probes.agg(F.min("lo_us").alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n")).first()
    if span["lo"] is None or span["hi"] is None:
        return data.where(F.lit(False))
    rows = data.where(F.col("ts_us").between(span["lo"], span["hi"]))
    keys = probes.select(*key).distinct()
    return rows.join(F.broadcast(keys) if span["n"] <= BROADCAST_ROWS else keys, key, "left_semi")


def window_sums(probes: DataFrame, data: DataFrame, key: list[str], measures: dict[str, Column],
                ids: list[str], prune: bool = True) -> DataFrame:
    """Sums of ``measures`` over the key's rows with ``lo_us <= ts_us <= hi_us``, for each probe.

    Probes with a NULL key are dropped; probes without rows give zeros. ``prune`` reads only the rows some
    probe asks for; leave it off where every row asks about its own key.
    """
    ok = F.lit(True)
    for k in key:
        ok = ok & F.col(k).isNotNull()
    probes = probes.where(ok)
    rows = data.where(ok)
    if prune:
        rows = asked(probes, rows, key, F.col("hi_us"))
    ev = rows.select(*key, F.col("ts_us").alias("t"), *[m.alias(n) for n, m in measures.items()])
    # checked on the key alone, so that questions with other measures reuse the answer
    slices = find_slices(rows.select(*key, "ts_us"), key)
    extra = [i for i in ids if i not in key]
    pr = probes.select(*key, *extra, F.explode(F.array(
        F.struct((F.col("lo_us") - 1).alias("t"), F.lit(-1).alias("sign")),
        F.struct(F.col("hi_us").alias("t"), F.lit(1).alias("sign")))).alias("_p"))
    pr = pr.select(*key, *extra, F.col("_p.t").alias("t"), F.col("_p.sign").alias("sign"))
    return running_at(ev, pr, key, list(measures), ids, slices=slices, auto=False)


def prior_time(df: DataFrame, key: list[str], t: str = "ts_us") -> DataFrame:
    """Distinct ``(key, t)`` rows with the key's previous time in ``prev_us`` (NULL for the first)."""
    rows = df.select(*key, F.col(t).alias("ts_us"))
    # checked before the distinct: cheaper, and at least as careful
    slices = find_slices(rows, key)
    d = add_slice(rows.distinct(), slices, key)
    part = [*key, "_slice"] if slices is not None else key
    d = d.withColumn("prev_us", F.lag("ts_us").over(Window.partitionBy(*part).orderBy("ts_us")))
    if slices is not None:
        c = _carry(d, key, {"last": F.max("ts_us")}, {"last": "max"})
        d = (join_key(d, c, [*key, "_slice"], "left")
             .withColumn("prev_us", F.coalesce("prev_us", "_c_last")).drop("_c_last"))
    return d.drop("_slice")


def window_distinct(probes: DataFrame, data: DataFrame, key: list[str], item: str, width_us: int,
                    ids: list[str], out: str) -> DataFrame:
    """Distinct ``item`` values of the key inside ``[lo_us, lo_us + width_us]``, for each probe.

    A row is the first of its item inside a window of fixed length exactly while
    ``max(prev + 1, ts - width) <= lo <= ts``: two events, no pairs.
    """
    ok = F.lit(True)
    for k in [*key, item]:
        ok = ok & F.col(k).isNotNull()
    okk = F.lit(True)
    for k in key:
        okk = okk & F.col(k).isNotNull()
    probes = probes.where(okk)
    # an earlier time of an item that no probe reaches back to would not change any answer
    data = asked(probes, data.where(okk), key, F.col("lo_us") + width_us)
    d = prior_time(data.where(ok), [*key, item])
    ev = d.select(*key, F.explode(F.array(
        F.struct(F.greatest(F.col("prev_us") + 1, F.col("ts_us") - width_us).alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("ts_us") + 1).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    ev = ev.select(*key, F.col("e.t").alias("t"), F.col("e.d").alias(out))
    pr = probes.select(*key, *ids, F.col("lo_us").alias("t"), F.lit(1).alias("sign"))
    slices = find_slices(data.select(*key, "ts_us"), key)
    return running_at(ev, pr, key, [out], ids, slices=slices, auto=False)


def window_counts(probes: DataFrame, data: DataFrame, key: list[str], item: str, width_us: int, id_col: str) -> DataFrame:
    """For each probe ``(id, *key, item, lo_us, hi_us)``: rows of the key, distinct items and rows of the probe's own item.

    Rows and distinct items are running totals of one time line, so both come from one pass over rows that are bounded once: a
    row adds 1 at its time, and opens and closes the span in which it is the first of its item (see ``window_distinct``).
    Windows have the length ``width_us``.
    """
    ok = F.lit(True)
    for k in key:
        ok = ok & F.col(k).isNotNull()
    probes = probes.where(ok)
    rows = asked(probes, data.where(ok), key, F.col("hi_us"))
    slices = find_slices(rows.select(*key, "ts_us"), key)
    zero, one = F.lit(0), F.lit(1)
    first = prior_time(rows.where(F.col(item).isNotNull()), [*key, item])
    line = rows.select(*key, F.col("ts_us").alias("t"), one.alias("n"), zero.alias("d")).unionByName(
        first.select(*key, F.explode(F.array(F.struct(F.greatest(F.col("prev_us") + 1, F.col("ts_us") - width_us).alias("t"), one.alias("d")),
                                             F.struct((F.col("ts_us") + 1).alias("t"), F.lit(-1).alias("d")))).alias("e"))
        .select(*key, "e.t", zero.alias("n"), "e.d"))
    asks = probes.select(id_col, *key, F.explode(F.array(
        F.struct((F.col("lo_us") - 1).alias("t"), F.lit(-1).alias("sign"), F.lit("n").alias("what")), F.struct(F.col("hi_us").alias("t"), one.alias("sign"), F.lit("n").alias("what")),
        F.struct(F.col("lo_us").alias("t"), one.alias("sign"), F.lit("d").alias("what")))).alias("p"))
    asks = asks.select(id_col, *key, "p.t", "p.sign", "p.what")
    got = running_at(line, asks, key, ["n", "d"], [id_col, "what"], slices=slices, auto=False)
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    both = got.groupBy(id_col).agg(of("n", "n").alias("n_rows"), of("d", "d").alias("n_items"))
    own = window_sums(probes.where(F.col(item).isNotNull()), rows, [*key, item], {"n_own": one}, [id_col], prune=False)
    return both.join(own, id_col, "left")


def window_members(probes: DataFrame, data: DataFrame, key: list[str], width_us: int,
                   how: str = "inner") -> DataFrame:
    """Rows of ``data`` with the probe's key and ``lo_us <= ts_us <= hi_us``, one for each match.

    Both sides are keyed by (key, time bucket), so a hot key spreads over its buckets.
    Column names other than ``key`` must not repeat.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(width_us))
    p = probes.withColumn("_b", F.explode(F.sequence(b("lo_us"), b("hi_us"))))
    d = data.withColumn("_b", b("ts_us"))
    return (p.join(d, [*key, "_b"], how)
            .where((F.col("ts_us") >= F.col("lo_us")) & (F.col("ts_us") <= F.col("hi_us"))).drop("_b"))
