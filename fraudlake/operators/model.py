"""Alert model: features, class weights, folds, logistic fit, calibration and scoring."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.operators.evaluate import auc, brier
from fraudlake.operators.evidence import BUCKETS, TIER_TESTS, sigmoid
from fraudlake.operators.ranks import RANGE_ROWS, class_ranks, cut_points, in_ranges
from fraudlake.session import cut

PREVALENCE = 0.838  # share of fraud among the labelled cases behind the published intercept shift

# Published feature names in model order, each with its boolean SQL over the signal table.
FEATURES: dict[str, str] = {
    "id_15_new": "id_15 = 'New'",
    "proxy_flag": "proxy_flag",
    "is_new_device_for_card": "is_new_device",
    "unseen_productcd": "unseen_product",
    "unseen_p_emaildomain": "unseen_email",
    "out_of_home_region_asof": "out_of_home",
    "had_prior_txn_in_region": "had_prior_txn_in_region",
    "prior_cleared_travel_on_card": "prior_cleared_travel",
    "prior_cleared_new_phone_on_card": "prior_cleared_phone",
    "prior_fraud_on_card_tuple": "prior_fraud_card",
    "prior_fraud_on_customer": "prior_fraud_customer",
    "mixed_channel_last_24h": "mixed_24h",
    "recurring_ge3": "recurring_ge3",
    "amt_z_gt_3": "abs(amt_z) > 3",
    "amt_z_gt_2": "abs(amt_z) > 2",
    "n_online_48h_2_4": "burst_bucket = '2-4'",
    "n_online_48h_ge_5": "burst_bucket = '5+'",
    **{f"risk_decile_{d}": f"risk_decile = {d}" for d in range(1, 11)},
    "channel_online": "channel = 'online'",
    "channel_in_person": "channel = 'in_person'",
    **{f"{t}_{b}": f"({p}) AND bucket = '{b}'" for t, p in TIER_TESTS.items() for b in BUCKETS},
    "device_neighbors_ge2": "n_device_others >= 2",
    "region_cluster_ge2": "n_region_others >= 2",
    "recipient_cluster_ge2": "n_recipient_others >= 2",
    "testing_sequence_fires": "testing_fires",
    "near_threshold_burst": "near_threshold_fires",
}


# The evidence channel of each feature; features without an entry belong to the history channel.
CHANNEL: dict[str, str] = {
    "id_15_new": "identity_flags",
    "proxy_flag": "identity_flags",
    "mixed_channel_last_24h": "identity_flags",
    "is_new_device_for_card": "device",
    "device_neighbors_ge2": "device",
    **{f"{t}_{b}": "device" for t in TIER_TESTS for b in BUCKETS},
    "out_of_home_region_asof": "region",
    "had_prior_txn_in_region": "region",
    "prior_cleared_travel_on_card": "region",
    "region_cluster_ge2": "region",
    "amt_z_gt_2": "amount",
    "amt_z_gt_3": "amount",
    "unseen_productcd": "amount",
    "unseen_p_emaildomain": "amount",
    "recurring_ge3": "amount",
    "recipient_cluster_ge2": "amount",
    "n_online_48h_2_4": "sequence",
    "n_online_48h_ge_5": "sequence",
    "testing_sequence_fires": "sequence",
    "near_threshold_burst": "sequence",
}


def alert_features(signals: DataFrame, key: str = "alert_id") -> DataFrame:
    """46 columns of 0 or 1; unknown counts as 0 only here."""
    return signals.select(key, *[F.coalesce(F.expr(f"({sql})"), F.lit(False)).cast("int").alias(n) for n, sql in FEATURES.items()])


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Weight ``n / (2 * n_class)`` on every row."""
    tot = df.groupBy(label).agg(F.count("*").alias("_c"))
    n = tot.agg(F.sum("_c")).first()[0]  # a two-row table
    return df.join(F.broadcast(tot), label).withColumn("weight", F.lit(float(n)) / (2.0 * F.col("_c"))).drop("_c")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number by rank within the class, so that fold sizes of a class differ by one row at most."""
    return class_ranks(df, key, label, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_class_rows", "_h")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The same share of each class, rounded to whole rows, is test data."""
    share = F.floor(F.lit(test) * F.col("_class_rows") + 0.5)
    return class_ranks(df, key, label, seed).withColumn("is_test", F.col("_rank") < share).drop("_rank", "_class_rows", "_h")


def pool(x0: np.ndarray, x1: np.ndarray, wy: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks ``(first score, last score, weighted label sum, weight)`` in score order, pooled until their means rise strictly.

    Neighbours that do not rise belong to one block of the fit, so whole runs of them are added up at a time. What many
    rounds leave over goes through a stack, whose work is linear.
    """
    def merged(at):
        ends = np.append(at[1:], len(w)) - 1
        return x0[at], x1[ends], np.add.reduceat(wy, at), np.add.reduceat(w, at)
    for _ in range(30):
        m = wy / w
        rises = np.append(True, m[1:] > m[:-1])
        if rises.all():
            return x0, x1, wy, w
        x0, x1, wy, w = merged(np.flatnonzero(rises))
    starts, sums, weights = [], [], []
    for k, (a, b) in enumerate(zip(wy.tolist(), w.tolist())):
        at = k
        while sums and sums[-1] / weights[-1] >= a / b:
            a, b, at = a + sums.pop(), b + weights.pop(), starts.pop()
        starts.append(at)
        sums.append(a)
        weights.append(b)
    return merged(np.array(starts))


BLOCKS = ["x0", "x1", "wy", "w"]
POOL_FAN = 16


def fit_isotonic(df: DataFrame, p: str = "p", y: str = "y", weight: str = "weight", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Knots ``(x, y)`` of a weighted monotone fit, clipped to [0, 1].

    Equal scores are pooled first, which leaves the fit as it is. Ranges of scores are pooled on their own, and
    their blocks then meet in a tree, ``POOL_FAN`` neighbours at a time: a node holds the blocks of its ranges, whose
    means rise strictly, and not their scores. For labels of 0 and 1 on ``n`` rows there are at most about ``n ** (2 / 3)``
    different rising means, usually far fewer. Nothing passes through the driver.
    """
    pooled = (df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).groupBy(F.col(p).cast("double").alias("x"))
              .agg(F.sum(F.col(y).cast("double") * F.col(weight)).alias("wy"), F.sum(F.col(weight).cast("double")).alias("w")).where("w > 0"))
    pooled = cut(pooled)
    starts = cut_points(pooled, "x", -(-pooled.count() // range_rows))
    ddl = "node long, x0 array<double>, x1 array<double>, wy array<double>, w array<double>"

    def packed(node: int, blocks: tuple[np.ndarray, ...]) -> pa.Table:
        return pa.table([pa.array([node], pa.int64()), *(pa.array([b], pa.list_(pa.float64())) for b in blocks)], ["node", *BLOCKS])

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by("x")
        x, wy, w = (t.column(c).to_numpy() for c in ("x", "wy", "w"))
        return packed(t.column("node")[0].as_py(), pool(x, x, wy, w))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        return packed(t.column("up")[0].as_py(), pool(*(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in BLOCKS)))

    nodes = in_ranges(pooled, "x", starts, "node").withColumn("node", F.col("node").cast("long")).groupBy("node").applyInArrow(first, ddl)
    left = len(starts) + 1
    while left > 1:
        left = -(-left // POOL_FAN)
        nodes = nodes.withColumn("up", F.floor(F.col("node") / F.lit(POOL_FAN))).groupBy("up").applyInArrow(meet, ddl)
    b = nodes.select(F.explode(F.arrays_zip(*BLOCKS)).alias("b")).select("b.*")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("wy") / F.col("w")))
    # a block of one score is one knot, a longer one has its first and its last score
    return b.select(F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), value.alias("y"))


def knots(df: DataFrame) -> tuple[list[float], list[float]]:
    rows = df.orderBy("x").collect()  # calibration knots
    return [r.x for r in rows], [r.y for r in rows]


def _assemble(feats: DataFrame) -> DataFrame:
    return feats.withColumn("features", array_to_vector(F.array(*[F.col(f"`{n}`").cast("double") for n in FEATURES])))


def fit_alert_model(feats: DataFrame, label: str = "y", c: float = 1.0) -> DataFrame:
    """Class-balanced L2 logistic fit: ``(feature, coef)`` with the intercept rows.

    The intercept is shifted so that no evidence means one half.
    """
    data = cut(balanced_weights(_assemble(feats), label).select("features", F.col(label).cast("double").alias("label"), "weight"))
    n = data.count()
    m = LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    rows = [(f, float(v)) for f, v in zip(FEATURES, m.coefficients.toArray())]
    shift = math.log(PREVALENCE / (1 - PREVALENCE))
    rows += [("__intercept_raw__", float(m.intercept)), ("__intercept__", float(m.intercept) - shift)]
    return feats.sparkSession.createDataFrame(rows, "feature string, coef double")


def coefficients(model: DataFrame) -> dict[str, float]:
    return {r.feature: r.coef for r in model.collect()}  # one row for each feature


def score_alerts(feats: DataFrame, coef: dict[str, float], key: str = "alert_id") -> DataFrame:
    """Probability and the fired features with their weights."""
    on = [n for n in FEATURES if n in coef]
    logit = F.lit(coef.get("__intercept__", 0.0))
    for n in on:
        logit = logit + F.col(f"`{n}`") * F.lit(coef[n])
    fired = F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == 1, F.struct(F.lit(n).alias("feature"), F.lit(coef[n]).alias("coef"))) for n in on]))
    return feats.select(key, logit.alias("logit"), sigmoid(logit).alias("p"), fired.alias("fired"))


def cv_eval(feats: DataFrame, key: str = "alert_id", label: str = "y", k: int = 5) -> DataFrame:
    """AUC and Brier score of each held-out fold."""
    folds = cut(stratified_folds(feats, key, label, k))
    parts = None
    for i in range(k):
        coef = coefficients(fit_alert_model(folds.where(F.col("fold") != i), label))
        coef["__intercept__"] = coef["__intercept_raw__"]
        test = score_alerts(folds.where(F.col("fold") == i), coef, key).join(folds.select(key, F.col(label).alias("y")), key)
        row = auc(test).withColumn("_k", F.lit(1)).join(brier(test).withColumn("_k", F.lit(1)), "_k").select(F.lit(i).alias("fold"), "auc", "brier")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def fit_properties(feats: DataFrame, coef: DataFrame, label: str = "y", c: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """What holds for a right fit: the gradient of the penalised loss vanishes, and the two intercepts differ by the published shift."""
    w = coefficients(coef)
    data = balanced_weights(feats, label)
    logit = F.lit(w["__intercept_raw__"])
    for n in FEATURES:
        logit = logit + F.col(f"`{n}`") * F.lit(w[n])
    err = F.col("weight") * (sigmoid(logit) - F.col(label))
    sums = data.agg(F.sum("weight").alias("_n"), F.sum(err).alias("_g"), *[F.sum(err * F.col(f"`{n}`")).alias(f"g_{k}") for k, n in enumerate(FEATURES)])
    worst = F.greatest(F.abs(F.col("_g") / F.col("_n")), *[F.abs(F.col(f"g_{k}") + F.lit(w[n] / c)) / F.col("_n") for k, n in enumerate(FEATURES)])
    shift = abs(w["__intercept_raw__"] - w["__intercept__"] - math.log(PREVALENCE / (1 - PREVALENCE))) < 1e-9
    return sums.select(F.lit(len(w)).cast("long").alias("n_rows"), (worst < tol).alias("flat"), F.lit(shift).alias("shifted"))


def cv_properties(folds: DataFrame) -> DataFrame:
    """Folds, whether their figures are possible ones, and whether the mean area beats a model that knows nothing."""
    ok = F.col("auc").between(0, 1) & F.col("brier").between(0, 1)
    return folds.agg(F.count("*").alias("n_folds"), F.min(F.coalesce(ok, F.lit(False))).alias("in_range"), (F.avg("auc") > 0.5).alias("better_than_none"))


def sentence_table(spark) -> DataFrame:
    """Channel and analyst sentence of each feature; sentences are built from a few rules."""
    tier = {"T1": "its device has a confirmed-fraud case", "T2": "its device has a confirmed-fraud case and the row is proxied",
            "T3": "a proxied row on a fraud device that other cards used as new or proxied", "T4": "fraud cases of several customers on its device"}
    size = {"le5": "up to 5 cards", "6-20": "6 to 20 cards", "21-100": "21 to 100 cards"}

    def text(f: str) -> str:
        if f.startswith("risk_decile_"):
            return f"The risk score lies in decile {f.rsplit('_', 1)[1]} of 10"
        if f[:2] in tier and f[2:3] == "_":
            return f"Device tier {f[:2]} ({size[f[3:]]}): {tier[f[:2]]}"
        return "The alert shows " + f.replace("_", " ")
    rows = [(f, CHANNEL.get(f, "history"), text(f) + " (weight %+.2f).") for f in FEATURES]
    return spark.createDataFrame(rows, "feature string, channel string, template string")


def model_evidence(scored: DataFrame, min_weight: float = 0.05, key: str = "alert_id") -> DataFrame:
    """One evidence row for each fired feature that weighs enough; 0.5 is the bar for published output."""
    t = F.broadcast(sentence_table(scored.sparkSession))  # 46 rows
    x = scored.select(key, F.explode("fired").alias("f")).select(key, "f.feature", "f.coef").where(F.abs("coef") >= min_weight)
    x = x.join(t, "feature")
    claim = F.regexp_replace(F.col("template"), F.lit(r"%\+\.2f"), F.format_string("%+.2f", F.col("coef")))
    return x.select(key, F.concat(F.lit("alert_model:"), "feature").alias("ref"), "channel", F.col("coef").alias("log_lr"),
                    claim.alias("claim"), (F.abs("coef") >= 0.5).alias("published"))


def fold_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("fold", "y").agg(F.count("*").alias("n"))


def top_features(model: DataFrame, n: int = 10) -> DataFrame:
    w = Window.orderBy(F.desc(F.abs("coef")), "feature")  # 46 rows
    return model.where(~F.col("feature").startswith("__")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
