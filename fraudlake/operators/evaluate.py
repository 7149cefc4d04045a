"""Back-test sampling, splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.operators.ranks import class_ranks, quantiles, running_total

# Note patterns of cleared cases, tried in this order.
ARCHETYPES = [
    ("travel", r"(?i)\btravel(?:led|ling)?\b|\btrip\b"),
    ("new_phone", r"(?i)\b(new phone|new device|got a new)\b"),
    ("big_purchase", r"(?i)\b(large|big|expensive) (?:purchase|transaction)\b"),
]
# Names of patterns.
PATTERNS = ["card_testing", "card_not_present_fraud", "card_not_present_new_device", "out_of_region_use", "account_takeover", "undocumented", "none"]


def archetype(note: str = "analyst_notes") -> Column:
    text = F.coalesce(F.col(note), F.lit(""))
    out = None
    for name, rx in ARCHETYPES:
        out = F.when(text.rlike(rx), name) if out is None else out.when(text.rlike(rx), name)
    return out.otherwise("other")


def stratified_sample(cases: DataFrame, by: Column, n: int, seed: int = 42, key: str = "case_id") -> DataFrame:
    """Equal shares of each stratum in hashed order, topped up to ``n`` from what is left.

    Ranks are taken in ranges of the hash, so a stratum is spread over tasks whatever ``n`` is.
    """
    d = cases.withColumn("stratum", by)
    strata = max(1, d.select("stratum").distinct().count())
    share = max(1, n // strata)
    ranked = class_ranks(d, key, "stratum", seed).where(F.col("_rank") < n)
    return ranked.orderBy(F.col("_rank") >= share, "_h", key).limit(n).drop("_h", "_rank", "_class_rows")


def oot_split(cases: DataFrame, cut_us: int) -> DataFrame:
    """Train on cases closed before the cut, test on cases opened from it on; straddlers drop out."""
    s = F.when(F.unix_micros("closed_at") < cut_us, "train").when(F.unix_micros("opened_at") >= cut_us, "test")
    return cases.withColumn("split", s).where(F.col("split").isNotNull())


def response_label(actions: str = "actions_taken") -> Column:
    a = F.upper(F.coalesce(F.col(actions), F.lit("")))
    return F.when(a.contains("BLOCK_CARD"), "denied").when(a.contains("CLOSE_NO_FRAUD"), "confirmed").otherwise("no_reply")


def n_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def verdict_accuracy(p: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``p(gt, verdict)``: accuracy over all rows and without the uncertain ones."""
    d = p.where(F.col("gt").isNotNull() & F.col("verdict").isNotNull())
    g = d.groupBy(*group) if group else d
    out = g.agg(F.count("*").alias("n"), n_if((F.col("verdict") == F.col("gt")) & (F.col("verdict") != "uncertain")).alias("correct"),
                n_if(F.col("verdict") == "uncertain").alias("uncertain"))
    return (out.withColumn("acc_all", share(F.col("correct"), F.col("n")))
            .withColumn("acc_certain", share(F.col("correct"), F.col("n") - F.col("uncertain"))))


def confusion(p: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """True by predicted pattern; the columns are the fixed pattern list."""
    labels = labels or PATTERNS
    return p.groupBy("gt_pattern").pivot("pattern", labels).agg(F.count(F.lit(1))).na.fill(0, labels)


def binary_agreement(p: DataFrame, truth: str = "gt_report", pred: str = "report", group: list[str] | None = None) -> DataFrame:
    t, q = F.col(truth), F.col(pred)
    g = p.groupBy(*group) if group else p
    c = g.agg(n_if(t & q).alias("tp"), n_if(~t & q).alias("fp"), n_if(t & ~q).alias("fn"), n_if(~t & ~q).alias("tn"))
    return (c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"))))


def exposure_error(p: DataFrame, truth: str = "gt_exposure", pred: str = "exposure") -> DataFrame:
    d = F.abs(F.coalesce(F.col(truth), F.lit(0.0)) - F.coalesce(F.col(pred), F.lit(0.0)))
    exact = F.sum(d.cast("decimal(28,6)")).cast("double")
    return p.agg(F.count("*").alias("n"), share(exact, F.count("*")).alias("mae"), F.max(d).alias("max_abs_err"))


def jaccard(a: str, b: str) -> Column:
    """Overlap of two id sets; two empty sets agree."""
    x, y = F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>"))
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / u)


def mean_jaccard(p: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    return p.agg(F.count("*").alias("n"), F.avg(jaccard(truth, before)).alias("before"), F.avg(jaccard(truth, after)).alias("after"))


def brier(p: DataFrame, weight: str | None = None, group: list[str] | None = None) -> DataFrame:
    e = F.pow(F.col("p") - F.col("y"), 2)
    w = F.col(weight) if weight else F.lit(1.0)
    g = p.groupBy(*group) if group else p
    return g.agg((F.sum(w * e) / F.sum(w)).alias("brier"))


def auc(p: DataFrame) -> DataFrame:
    """Mann-Whitney area with tied scores averaged, from counts of distinct scores.

    The rank of a score needs the number of rows below it: a running sum over range-partitioned
    scores plus the totals of the ranges before.
    """
    by = p.groupBy("p").agg(n_if(F.col("y") == 1).alias("pos"), n_if(F.col("y") == 0).alias("neg"))
    below = running_total(by, "p", "neg")
    return below.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                     F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0)).alias("u")).select(
        "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def reliability(p: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"), F.count("*").alias("n"))


def reliability_quantile(p: DataFrame, weight: str, bins: int = 10) -> DataFrame:
    """Weighted reliability over bins with equal row counts; equal edges merge."""
    edges = sorted(set(quantiles(p.where(F.col("p").isNotNull()), "p", [i / bins for i in range(bins + 1)])))
    if len(edges) < 3:
        edges = [i / bins for i in range(bins + 1)]
    arr = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    b = F.size(F.filter(arr, lambda e: e <= F.col("p")))
    w = F.col(weight)
    return p.groupBy(b.alias("bin")).agg((F.sum(w * F.col("p")) / F.sum(w)).alias("mean_p"),
                                         (F.sum(w * F.col("y")) / F.sum(w)).alias("mean_y"), F.count("*").alias("n"))


# The threshold grid.
TAUS = [round(0.05 * i, 2) for i in range(1, 18)]


def threshold_curve(p: DataFrame, taus: list[float] | None = None) -> DataFrame:
    """Accuracy of ``p >= tau`` against the label for each threshold: one pass, one column for each."""
    taus = taus or TAUS
    one = p.agg(F.count("*").alias("total"), *[n_if((F.col("p") >= t) == (F.col("y") == 1)).alias(f"c{i}") for i, t in enumerate(taus)])
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"c{i}").alias("correct"), F.col("total").alias("total")) for i, t in enumerate(taus)])
    return one.select(F.inline(rows)).withColumn("accuracy", F.round(share(F.col("correct"), F.col("total")), 4))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Highest accuracy; the smallest threshold wins ties."""
    return curve.agg(F.max_by("tau", F.struct("accuracy", -F.col("tau"))).alias("tau"), F.max("accuracy").alias("accuracy"))


def report(p: DataFrame, group: str = "split") -> DataFrame:
    """Accuracy, report agreement and Brier score of each split."""
    g = [group]
    return (verdict_accuracy(p, g).join(binary_agreement(p, group=g), group).join(brier(p, group=g), group))


def runtime_summary(p: DataFrame) -> DataFrame:
    return p.agg(F.count("*").alias("n"), F.avg(F.coalesce("tool_calls", F.lit(0))).alias("mean_tool_calls"),
                 F.avg(F.coalesce("latency_s", F.lit(0.0))).alias("mean_latency_s"))
