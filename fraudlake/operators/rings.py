"""Multi-hop ring questions: proxy rings, ring components, connected cards, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US, MONEY, SEC_US, exact_sum
from fraudlake.operators.neighbors import around, device_peers, longs, one, online, proxied
from fraudlake.operators.tables import device_degree
from fraudlake.operators.timeline import window_members, window_sums
from fraudlake.session import cut, cut_all, small


def proxy_rings(txn: DataFrame, known: DataFrame, lo_us: int, hi_us: int, cap: int = 100, k: int = 3) -> DataFrame:
    """Narrow devices with a proxied row in the period and the cards on them in that period."""
    rows = txn.where(F.col("device_profile").isNotNull() & F.col("ts_us").between(lo_us, hi_us))
    per = rows.groupBy("device_profile", "card").agg(F.sum(one(proxied())).alias("p"), F.count("*").alias("c"))
    agg = per.groupBy("device_profile").agg(F.count("*").alias("n_cards"), F.sum("p").alias("n_proxied"), F.sum("c").alias("n_txns"))
    narrow = device_degree(known).where(F.col("degree") <= cap)
    return (agg.where(F.col("n_proxied") > 0).join(narrow, "device_profile")
            .withColumn("passes_threshold", F.col("n_cards") >= k))


def proxy_ring_counts(txn: DataFrame, known: DataFrame, lo_us: int, hi_us: int, cap: int = 100, k: int = 3) -> DataFrame:
    """Candidate devices, those under the degree cap, and those that pass the card threshold."""
    every = proxy_rings(txn, known, lo_us, hi_us, cap=2**62, k=k)
    ok = F.col("degree") <= cap
    return every.agg(F.count("*").alias("n_candidates"), F.sum(one(ok)).alias("n_narrow"),
                     F.sum(one(ok & F.col("passes_threshold"))).alias("n_passing"))


def ring_devices(flags: DataFrame, txn: DataFrame, known: DataFrame, cap: int = 100,
                 families: DataFrame | None = None) -> DataFrame:
    """Narrow devices the alert's card used in the window; with ``families``, narrow siblings too.

    ``families(device_profile, device_family)``; the cap applies to the summed degree of a family.
    """
    deg = device_degree(known)
    pairs = flags.select("alert_id", "card", "lo_us", "hi_us").join(known.select("card", "device_profile"), "card")
    pairs = cut(pairs.join(deg.where(F.col("degree") <= cap), "device_profile", "left_semi"))
    used = window_sums(pairs, txn, ["card", "device_profile"], {"n": F.lit(1)}, ["alert_id", "device_profile"])
    used = used.where(F.col("n") > 0).select("alert_id", "device_profile")
    if families is None:
        return used
    fam_deg = families.join(deg, "device_profile").groupBy("device_family").agg(F.sum("degree").alias("d"))
    ok = families.join(fam_deg.where(F.col("d") <= cap), "device_family", "left_semi")
    hop = (used.join(families, "device_profile").select("alert_id", "device_family").distinct()
           .join(ok, "device_family").select("alert_id", "device_profile"))
    return used.unionByName(hop).distinct()


def ring_cards(flags: DataFrame, devices: DataFrame, known: DataFrame, fraud: DataFrame, cc_connected: DataFrame, cc_card: DataFrame) -> DataFrame:
    """The seed, cards known on the ring devices, and cards of the fraud cases attached to those devices (``ring_cases``)."""
    seed = flags.select("alert_id", "card")
    direct = devices.join(known.select("device_profile", "card"), "device_profile").select("alert_id", "card")
    linked = fraud.join(cc_connected, "case_id").select("alert_id", "card")
    on_card = fraud.join(cc_card, "case_id").select("alert_id", "card")
    return seed.unionByName(direct).unionByName(linked).unionByName(on_card).distinct()


def ring_cases(devices: DataFrame, cj: DataFrame, cc_dev: DataFrame) -> DataFrame:
    """Confirmed-fraud cases on a ring device, once for each (alert, case)."""
    fraud = cj.where(F.col("outcome") == "confirmed_fraud").select("case_id", "exposure_usd")
    hit = devices.join(cc_dev, "device_profile").select("alert_id", "case_id").distinct()
    return hit.join(fraud, "case_id")


def ring_activity(flags: DataFrame, devices: DataFrame, txn: DataFrame, known: DataFrame) -> DataFrame:
    """In-window use of the ring devices by each of their cards: counts, flags and amount."""
    w = flags.select("alert_id", "lo_us", "hi_us")
    probes = cut(devices.join(known.select("device_profile", "card"), "device_profile").join(w, "alert_id"))
    m = {"n": F.lit(1), "n_new": one(F.coalesce(F.col("id_15") == "New", F.lit(False))), "n_proxied": one(proxied()),
         "amt": F.col("amt").cast(MONEY)}
    use = window_sums(probes, txn, ["device_profile", "card"], m, ["alert_id", "device_profile", "card"])
    return use.where(F.col("n") > 0)


def ring_components(flags: DataFrame, txn: DataFrame, known: DataFrame, cj: DataFrame, cc_dev: DataFrame,
                    cc_connected: DataFrame, cc_card: DataFrame, cap: int = 100,
                    families: DataFrame | None = None) -> DataFrame:
    """Size, flagged cards and exposure of the device ring around each alert's card."""
    # every later hop starts from this set, so its pass over the transactions is done once
    devices = cut(ring_devices(flags, txn, known, cap, families))
    fraud_cases = cj.where(F.col("outcome") == "confirmed_fraud")
    fraud, per_card = cut_all(
        lambda: ring_cases(devices, cj, cc_dev),
        lambda: ring_activity(flags, devices, txn, known).groupBy("alert_id", "card").agg(
            F.sum("n").alias("n"), F.sum("n_new").alias("n_new"), F.sum("n_proxied").alias("n_proxied"), F.sum("amt").alias("amt")))
    cards = cut(ring_cards(flags, devices, known, fraud, cc_connected, cc_card))

    def activity():
        return per_card.groupBy("alert_id").agg(
            F.sum(one(F.col("n_new") > 0)).alias("n_new_device_cards"), F.sum(one(F.col("n_proxied") > 0)).alias("n_proxied_cards"),
            F.sum("n").alias("n_ring_txns"), exact_sum("amt").alias("ring_txn_exposure"))

    def earlier():
        on_card = (fraud_cases.join(cc_card.select("case_id", F.col("card").alias("_c")), "case_id")
                   .groupBy(F.col("_c").alias("card")).agg(F.count("*").alias("k"), F.sum(F.col("exposure_usd").cast(MONEY)).alias("e")))
        return cards.join(on_card, "card").groupBy("alert_id").agg(F.sum("k").alias("n_closed_cases"), exact_sum("e").alias("prior_fraud_exposure"))
    act, prior = cut_all(activity, earlier)
    cc = fraud.groupBy("alert_id").agg(F.count("*").alias("n_ring_cases"), exact_sum("exposure_usd").alias("ring_case_exposure"))
    size = cards.groupBy("alert_id").agg(F.count("*").alias("n_cards"))
    nd = devices.groupBy("alert_id").agg(F.count("*").alias("n_devices"))
    out = flags.select("alert_id")
    for part in (size, nd, act, prior, cc):
        out = out.join(part, "alert_id", "left")
    out = longs(out, "n_cards", "n_devices", "n_new_device_cards", "n_proxied_cards", "n_ring_txns", "n_closed_cases", "n_ring_cases")
    for c in ("ring_txn_exposure", "prior_fraud_exposure", "ring_case_exposure"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out.withColumn("ring_exposure", F.col("ring_txn_exposure") + F.col("ring_case_exposure"))


def ring_risk_cards(flags: DataFrame, txn: DataFrame, known: DataFrame, cj: DataFrame, cc_dev: DataFrame,
                    cc_connected: DataFrame, cc_card: DataFrame, cap: int = 100) -> DataFrame:
    """Ring cards with their own risk sign: new or proxied in the window, or named by a fraud case of the ring."""
    devices = cut(ring_devices(flags, txn, known, cap))
    use = ring_activity(flags, devices, txn, known).where((F.col("n_new") > 0) | (F.col("n_proxied") > 0))
    fraud = ring_cases(devices, cj, cc_dev)
    linked = fraud.join(cc_connected, "case_id").select("alert_id", "card")
    return use.select("alert_id", "card").unionByName(linked).distinct()


# Widths of the time cells a window is put together from, each a whole multiple of the next; the last one is settled by exact times.
CELLS_US = [DAY_US, 90 * 60 * SEC_US, 5 * 60 * SEC_US, 20 * SEC_US, SEC_US]


def window_cells(probes: DataFrame, cells: list[int] | None = None) -> DataFrame:
    """``probes(…, lo_us, hi_us)`` with one row for each cell their window consists of: ``level`` and ``cell``.

    A cell belongs to the coarsest level at which it lies wholly inside the window; what is left at both ends at the
    last level keeps its cell with ``level`` equal to the number of levels, to be settled by exact times. The number of
    rows for a window depends on the widths alone, not on the data.
    """
    cells = cells or CELLS_US
    lo, end = F.col("lo_us"), F.col("hi_us") + 1     # half open
    pieces, inner = [], None
    none = F.array().cast("array<struct<level:int,cell:bigint>>")

    def run(first: Column, last: Column, level: int) -> Column:
        """Cells ``first`` to ``last - 1`` of a level."""
        return F.when(first < last, F.transform(F.sequence(first, last - 1), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))).otherwise(none)

    for level, width in enumerate(cells):
        a, b = F.ceil(lo / F.lit(width)), F.floor(end / F.lit(width))
        if inner is None:
            pieces.append(run(a, b, level))
        else:
            # what the coarser level left over: before its first and behind its last cell, all of it if it had none
            up, ua, ub = inner
            k = F.lit(up // width)
            whole = ua < ub
            pieces.append(F.when(whole, F.concat(run(a, F.least(ua * k, b), level), run(F.greatest(ub * k, a), b, level))).otherwise(run(a, b, level)))
        inner = (width, a, b)
    width, a, b = inner
    edge = len(cells)
    first, last = F.floor(lo / F.lit(width)), F.floor(F.col("hi_us") / F.lit(width))
    ends = F.filter(F.array_distinct(F.array(F.struct(F.lit(edge).alias("level"), first.alias("cell")), F.struct(F.lit(edge).alias("level"), last.alias("cell")))),
                    lambda e: ~((e["cell"] >= a) & (e["cell"] < b)))
    x = probes.withColumn("_e", F.explode(F.concat(*pieces, ends)))
    return x.select(*probes.columns, F.col("_e.level").alias("level"), F.col("_e.cell").alias("cell"))


def day_bounds(probes: DataFrame, rows: DataFrame, keep: int) -> DataFrame:
    """``probes`` with ``top``: the ``keep``-th smallest card of the whole days inside the window, NULL where they have fewer cards.

    Windows over the same days of a region share one bound; a day keeps its ``keep`` smallest cards.
    """
    width = F.lit(CELLS_US[0])
    p = probes.withColumn("_a", F.ceil(F.col("lo_us") / width)).withColumn("_z", F.floor((F.col("hi_us") + 1) / width))
    spans = cut(p.where(F.col("_a") < F.col("_z")).select("addr1", "_a", "_z").distinct())
    days = rows.where(F.col("card").isNotNull()).select("addr1", F.floor(F.col("ts_us") / width).alias("_day"), "card").distinct()
    by_day = Window.partitionBy("addr1", "_day").orderBy("card")
    days = days.withColumn("_rn", F.row_number().over(by_day)).where(F.col("_rn") <= keep).drop("_rn")
    met = spans.withColumn("_day", F.explode(F.sequence(F.col("_a"), F.col("_z") - 1))).join(days, ["addr1", "_day"])
    by_span = Window.partitionBy("addr1", "_a", "_z").orderBy("card")
    tops = (met.select("addr1", "_a", "_z", "card").distinct().withColumn("_rn", F.row_number().over(by_span))
            .where(F.col("_rn") == keep).select("addr1", "_a", "_z", F.col("card").alias("top")))
    return p.join(small(cut(tops)), ["addr1", "_a", "_z"], "left").select(*probes.columns, "top")


def region_peers(flags: DataFrame, txn: DataFrame, min_cards: int = 2, cap: int = 25) -> DataFrame:
    """The first ``cap`` other cards by key on the alert's region in its window, where there are at least ``min_cards``.

    The smallest ``cap + 1`` cards of a window are among the smallest ``cap + 1`` of its time cells (one more, as the
    alert's own card does not count). Windows become cells first; every cell that some alert asks for keeps
    its smallest cards, and an alert merges the lists of its cells. All tables between are linear in alerts, whatever the cards of a region.

    The whole days inside a window bound its answer: no card behind the ``cap + 1`` smallest of these days can enter the list
    (``day_bounds``), so a cell keeps and passes on only cards up to the bound of the windows that ask for it.
    """
    if min_cards > cap:
        raise ValueError("min_cards is larger than cap")
    keep = cap + 1
    probes = flags.where(F.col("addr1").isNotNull()).select("alert_id", F.col("card").alias("own"), "addr1", "lo_us", "hi_us")
    span = probes.agg(F.min("lo_us").alias("lo"), F.max("hi_us").alias("hi")).first()
    if span["lo"] is None:
        return flags.select("alert_id", "card").where(F.lit(False))
    rows = txn.where(F.col("addr1").isNotNull() & F.col("ts_us").between(span["lo"], span["hi"])).select("addr1", "card", "ts_us")
    pieces = cut(window_cells(day_bounds(probes, rows, keep)))
    # a cell lies in windows over few different days, so it has few bounds
    wanted = pieces.select("addr1", "level", "cell", "top").distinct()
    edge = len(CELLS_US)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("ts_us") / F.lit(w)).alias("cell"), F.lit(None).cast("long").alias("at")) for k, w in enumerate(CELLS_US)],
                     F.struct(F.lit(edge).alias("level"), F.floor(F.col("ts_us") / F.lit(CELLS_US[-1])).alias("cell"), F.col("ts_us").alias("at")))
    in_cells = rows.select("addr1", "card", F.explode(levels).alias("_l")).select("addr1", "card", "_l.level", "_l.cell", "_l.at")
    within = F.col("top").isNull() | (F.col("card") <= F.col("top"))
    in_cells = in_cells.join(wanted, ["addr1", "level", "cell"]).where(F.col("card").isNull() | within).drop("top").distinct()
    # at the edge level every exact time has a list of its own
    w = Window.partitionBy("addr1", "level", "cell", "at").orderBy("card")
    first = in_cells.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")
    met = pieces.hint("merge").join(first, ["addr1", "level", "cell"]).where(within & (F.col("at").isNull() | F.col("at").between(F.col("lo_us"), F.col("hi_us"))))
    mine = met.where(F.col("card") != F.col("own")).select("alert_id", "card").distinct()
    ranked = (mine.withColumn("_rn", F.row_number().over(Window.partitionBy("alert_id").orderBy("card")))
              .withColumn("_n", F.count("*").over(Window.partitionBy("alert_id"))))
    return ranked.where((F.col("_rn") <= cap) & (F.col("_n") >= min_cards)).select("alert_id", "card")


def connected_cards(flags: DataFrame, risk: DataFrame, degree: DataFrame, peers: DataFrame, region: DataFrame,
                    cap: int = 25, device_cap: int = 100) -> DataFrame:
    """Genuine peers of each alert, the first ``cap`` of the published list by leg and card.

    Ring cards count on a narrow device only; device and region peers count when at least two exist.
    """
    narrow = (flags.select("alert_id", "device_profile").join(degree.where(F.col("degree") <= device_cap), "device_profile")
              .select("alert_id"))
    a = risk.join(narrow, "alert_id", "left_semi").withColumn("leg", F.lit(1))

    def enough(df, leg):
        n = df.groupBy("alert_id").agg(F.countDistinct("card").alias("_n")).where("_n >= 2").select("alert_id")
        return df.join(n, "alert_id", "left_semi").withColumn("leg", F.lit(leg))
    # region peers come with their own limit: the first ``cap`` of them are all that can enter the list
    every = a.unionByName(enough(peers, 2)).unionByName(region.withColumn("leg", F.lit(3)))
    best = (every.join(flags.select("alert_id", F.col("card").alias("own")), "alert_id").where(F.col("card") != F.col("own"))
            .groupBy("alert_id", "card").agg(F.min("leg").alias("leg")))
    w = Window.partitionBy("alert_id").orderBy("leg", "card")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def shared_element(flags: DataFrame, connected: DataFrame, tiers: DataFrame, region: DataFrame, recipient: DataFrame) -> DataFrame:
    """What ties the alert to other cards: device, region, recipient or nothing."""
    n = connected.groupBy("alert_id").agg(F.count("*").alias("n_connected"))
    j = (flags.select("alert_id").join(n, "alert_id", "left")
         .join(tiers.select("alert_id", "n_prior_fraud", "degree"), "alert_id", "left")
         .join(region.select("alert_id", F.col("n_other_cards").alias("n_reg")), "alert_id", "left")
         .join(recipient.select("alert_id", F.col("n_other_cards").alias("n_rec")), "alert_id", "left"))
    j = longs(j, "n_connected", "n_prior_fraud", "degree", "n_reg", "n_rec")
    v = (F.when((F.col("n_connected") >= 2) | ((F.col("n_prior_fraud") > 0) & (F.col("degree") <= 100)), "device")
         .when(F.col("n_reg") >= 2, "region").when(F.col("n_rec") >= 2, "recipient"))
    return j.select("alert_id", "n_connected", v.alias("shared_element"))


def neighborhood(flags: DataFrame, txn: DataFrame, known: DataFrame, cj: DataFrame, cc_dev: DataFrame, cap: int = 100,
                 max_peers: int = 40, max_cases: int = 8) -> DataFrame:
    """Typed node rows around each alert: its device, peer cards and fraud cases on the device.

    The row limits belong to the drawing; ``n_total`` keeps the full count of each kind.
    """
    deg = device_degree(known)
    dev = flags.where(F.col("device_profile").isNotNull()).join(deg, "device_profile")
    kind = F.when(F.col("degree") > cap, "hub").otherwise("device")
    device = dev.select("alert_id", F.lit("alert").alias("parent"), kind.alias("kind"), F.col("device_profile").alias("node"),
                        F.lit(1).cast("long").alias("n_total"))
    w = lambda o: Window.partitionBy("alert_id").orderBy(o)
    every = lambda: Window.partitionBy("alert_id")
    p = device_peers(flags, txn, cap, known)
    p = (p.withColumn("_rn", F.row_number().over(w("card"))).withColumn("n_total", F.count("*").over(every()))
         .where(F.col("_rn") <= max_peers).select("alert_id", F.lit("device").alias("parent"), F.lit("card").alias("kind"),
                                                  F.col("card").alias("node"), "n_total"))
    fraud = cj.where(F.col("outcome") == "confirmed_fraud").select("case_id")
    c = (dev.where(F.col("degree") <= cap).select("alert_id", "device_profile").join(cc_dev, "device_profile")
         .join(fraud, "case_id", "left_semi").select("alert_id", "case_id").distinct())
    c = (c.withColumn("_rn", F.row_number().over(w("case_id"))).withColumn("n_total", F.count("*").over(every()))
         .where(F.col("_rn") <= max_cases).select("alert_id", F.lit("device").alias("parent"), F.lit("closed_case").alias("kind"),
                                                  F.col("case_id").alias("node"), "n_total"))
    return device.unionByName(p).unionByName(c)


def episode_members(decided: DataFrame, txn: DataFrame, detector_ids: DataFrame, hours: int = 48, days: int = 14,
                    entity: str = "customer_id") -> DataFrame:
    """Affected transactions of each alert with ``base`` = found before the signature expansion.

    ``decided`` is ``flags`` with ``verdict``, ``pattern`` and ``ring_cards``; ``detector_ids(alert_id, txn_id)``.
    """
    live = decided.where(F.col("verdict") != "legitimate")
    flagged = live.select("alert_id", F.col("flagged_txn_id").alias("txn_id"))
    base = flagged.unionByName(detector_ids.join(live.select("alert_id"), "alert_id", "left_semi").select("alert_id", "txn_id"))
    ring = live.where((F.col("ring_cards") >= 2) & F.col("device_profile").isNotNull()).select(
        "alert_id", entity, "device_profile", (F.col("opened_us") - days * DAY_US).alias("lo_us"), F.col("opened_us").alias("hi_us"))
    ring_ids = window_members(ring, txn.select(entity, "device_profile", "txn_id", "ts_us"), [entity, "device_profile"],
                              days * DAY_US).select("alert_id", "txn_id")
    sig = around(live.where(F.col("verdict") == "fraud"), hours * HOUR_US).select(
        "alert_id", entity, "lo_us", "hi_us", "pattern", F.col("device_profile").alias("_dev"), F.col("addr1").alias("_addr"))
    near = window_members(sig, txn.select(entity, "txn_id", "ts_us", "device_profile", "addr1", "channel"), [entity], 2 * hours * HOUR_US)
    pat = F.col("pattern")
    same = (F.when(pat.isin("card_not_present_new_device", "undocumented", "account_takeover"), F.col("device_profile") == F.col("_dev"))
            .when(pat == "out_of_region_use", F.col("addr1") == F.col("_addr"))
            .when(pat.isin("card_testing", "card_not_present_fraud"), online()))
    sig_ids = near.where(same).select("alert_id", "txn_id")
    tagged = (base.withColumn("b", F.lit(1)).unionByName(ring_ids.unionByName(sig_ids).withColumn("b", F.lit(0))))
    return tagged.groupBy("alert_id", "txn_id").agg((F.max("b") == 1).alias("base"))


def episodes(flags: DataFrame, members: DataFrame, txn: DataFrame) -> DataFrame:
    """Counts before and after expansion, exposure in dollars, earliest transaction and activity dates."""
    j = members.join(txn.select("txn_id", "amt", "ts_us"), "txn_id")
    agg = j.groupBy("alert_id").agg(
        F.sum(one(F.col("base"))).alias("n_before"), F.count("*").alias("n_after"),
        F.round(exact_sum(F.abs("amt")), 2).alias("exposure_usd"),
        F.min(F.struct("ts_us", "txn_id")).getField("txn_id").alias("first_txn_id"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    out = flags.select("alert_id").join(agg, "alert_id", "left")
    out = longs(out, "n_before", "n_after").withColumn("exposure_usd", F.coalesce("exposure_usd", F.lit(0.0)))
    date = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    return (out.withColumn("first_date", date("first_us")).withColumn("last_date", date("last_us")).drop("first_us", "last_us"))


