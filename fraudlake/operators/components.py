"""Connected components of the card-device projection, hubs pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.cols import MONEY
from fraudlake.operators.neighbors import longs
from fraudlake.operators.tables import device_degree
from fraudlake.operators.timeline import window_sums
from fraudlake.session import cut

SALTS = 32


def narrow_edges(known: DataFrame, cap: int, src: str = "card", dst: str = "device_profile") -> DataFrame:
    """Edges whose device has at most ``cap`` cards."""
    e = known.select(F.col(src).alias("card"), F.col(dst).alias("device_profile")).distinct()
    return e.join(device_degree(e).where(F.col("degree") <= cap), "device_profile", "left_semi").select("card", "device_profile")


def wcc(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Label every node of ``edges(card, device_profile)`` with the smallest node of its component.

    Every round takes the smallest neighbour label and then jumps to that label's own label, so
    long chains shrink quickly. Rounds are checkpointed. The jump joins on the label, which one
    giant component makes hot: that join is salted, and only changed labels take part.
    """
    a = F.concat(F.lit("c:"), F.col("card").cast("string"))
    b = F.concat(F.lit("d:"), F.col("device_profile").cast("string"))
    both = edges.select(F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))).alias("e"))
    both = cut(both.select("e.u", "e.v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the jump table reads the step twice, so the step is written once
        step = cut(step)
        jump = (step.where(F.col("label") != F.col("node")).select(F.col("node").alias("label"), F.col("label").alias("to"))
                .join(step.select("label").distinct(), "label", "left_semi")
                .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        salted = step.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        moved = cut(salted.join(jump, ["label", "_s"], "left")
                    .select("node", "old", F.coalesce("to", "label").alias("label")))
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    card = F.col("node").startswith("c:")
    return labels.groupBy("label").agg(F.sum(F.when(card, 1).otherwise(0)).alias("n_cards"),
                                       F.sum(F.when(card, 0).otherwise(1)).alias("n_devices"))


def alert_components(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Component of each alert's card by lookup: the way to answer many seeds from one labelling."""
    node = labels.where(F.col("node").startswith("c:")).select(F.expr("substring(node, 3)").alias("card"), "label")
    j = flags.select("alert_id", "card").join(node, "card", "left")
    out = j.join(component_sizes(labels), "label", "left")
    out = longs(out, "n_cards", "n_devices")
    # a card without narrow devices is its own component
    return out.select("alert_id", F.greatest("n_cards", F.lit(1)).alias("n_cards"), "n_devices")


WORDS = 8               # longs of a bitmap
SEEDS = 64 * WORDS      # seeds of a block
BITS = [f"b{k}" for k in range(WORDS)]


def _or(df: DataFrame, key: list[str], *names: str) -> DataFrame:
    return df.groupBy(*key).agg(*[F.bit_or(n).alias(n) for n in names])


def _fresh(found: DataFrame, seen: DataFrame | None, key: list[str]) -> DataFrame:
    """Bits of ``found`` that ``seen`` does not have yet; rows without any drop out."""
    if seen is None:
        return _or(found, key, *BITS)
    old = [f"old_{b}" for b in BITS]
    zero = F.lit(0).cast("long")
    both = found.select(*key, *BITS, *[zero.alias(o) for o in old]).unionByName(seen.select(*key, *[zero.alias(b) for b in BITS], *[F.col(b).alias(o) for b, o in zip(BITS, old)]))
    new = _or(both, key, *BITS, *old).select(*key, *[F.col(b).bitwiseAND(F.bitwise_not(F.col(o))).alias(b) for b, o in zip(BITS, old)])
    some = F.lit(False)
    for b in BITS:
        some = some | (F.col(b) != 0)
    return new.where(some)


def _seeds_of() -> Column:
    """Numbers of the bits that are set, as an array."""
    word = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(BITS[k]).bitwiseAND(_one_bit(i)) != 0), lambda i: i + 64 * k)
    return F.concat(*[F.when(F.col(b) == 0, F.array().cast("array<int>")).otherwise(word(k)) for k, b in enumerate(BITS)])


def _one_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def ring_wcc(flags: DataFrame, known: DataFrame, txn: DataFrame, cap: int = 100, max_iter: int = 8) -> DataFrame:
    """Component reached from each alert's card in at most ``max_iter`` card-device-card rounds.

    All seeds search at once: distinct seed cards are numbered in blocks of ``SEEDS``, and every card and device
    carries, for each block, a bitmap of the seeds that have reached it. A round passes the bits that are new on to the neighbours; new
    bits are appended to the rows of earlier rounds. Cards that the same seeds of a block reach form one class, and
    an alert counts the rows of its classes in its window on their time lines. So no table has a row for each (seed, card).
    """
    edges = cut(narrow_edges(known, cap))
    at = F.monotonically_increasing_id()
    seeds = cut(flags.select("card").where(F.col("card").isNotNull()).distinct().select("card", at.alias("at")))
    seeds = seeds.select("card", F.shiftright("at", SEEDS.bit_length() - 1).alias("block"), F.col("at").bitwiseAND(F.lit(SEEDS - 1)).cast("int").alias("seed"))
    zero = F.lit(0).cast("long")
    front = cut(seeds.select("block", "card", *[F.when(F.floor(F.col("seed") / F.lit(64)) == k, _one_bit(F.col("seed") % 64)).otherwise(zero).alias(b) for k, b in enumerate(BITS)]))
    cards, devices = front.withColumn("round", F.lit(0)), None
    for i in range(1, max_iter + 1):
        hop = cut(_fresh(front.join(edges, "card").select("block", "device_profile", *BITS), devices, ["block", "device_profile"]))
        devices = hop if devices is None else devices.unionByName(hop)
        front = cut(_fresh(hop.join(edges, "device_profile").select("block", "card", *BITS), cards, ["block", "card"]))
        if front.isEmpty():
            break
        cards = cards.unionByName(front.withColumn("round", F.lit(i)))
    # set bits are counted as they are unpacked; only the counts of a seed are kept
    size = (cards.select("block", "round", F.explode(_seeds_of()).alias("seed")).groupBy("block", "seed")
            .agg(F.count("*").alias("size"), F.least(F.max("round") + 1, F.lit(max_iter)).alias("iterations")))
    nd = devices.select("block", F.explode(_seeds_of()).alias("seed")).groupBy("block", "seed").agg(F.count("*").alias("n_devices"))
    asking = flags.select("alert_id", "card", "lo_us", "hi_us").join(seeds, "card")
    members = cut(_or(cards, ["block", "card"], *BITS))
    classes = members.select("block", *BITS).distinct().select("block", *BITS, F.explode(_seeds_of()).alias("seed"))
    probes = cut(asking.select("alert_id", "block", "seed", "lo_us", "hi_us").join(classes, ["block", "seed"]).drop("seed"))
    rows = txn.select("card", "ts_us", F.col("amt").cast(MONEY).alias("amt")).join(members, "card")
    use = window_sums(probes, rows, ["block", *BITS], {"n": F.lit(1), "amt": F.col("amt")}, ["alert_id"])
    out = asking.select("alert_id", "block", "seed").join(size, ["block", "seed"]).join(nd, ["block", "seed"], "left").join(use, "alert_id", "left")
    out = longs(out, "n_devices", "n", "iterations")
    return out.select("alert_id", "size", "n_devices", "iterations", F.col("n").alias("component_n_txns"),
                      F.coalesce(F.col("amt").cast("double"), F.lit(0.0)).alias("component_exposure"))
