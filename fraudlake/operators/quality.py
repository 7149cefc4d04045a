"""Checks on finished cases: thirteen invariants, citation scrub, link audit, acceptance roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.cols import exact_sum
from fraudlake.operators.decide import route
from fraudlake.operators.evaluate import PATTERNS
from fraudlake.session import cut, small

# Identifiers, citations and enumerations.
CASE_ID = r"\b(?:CC-\d{4,}|CASE-[A-Z0-9]+-\d+)\b"
CITATION = r"\bR(?:10|[1-9])\b|§3[ab]|§[4-7]"
VERDICTS = ["fraud", "legitimate", "uncertain"]
STATUSES = ["open", "closed_fraud", "closed_legitimate", "escalated"]
LEAKS = r"(?i)customer\s+(denied|confirmed|reply|said|confirms)|no[_\s-]reply|confirmed[_\s-]?(fraud|as[_\s-]fraud)|denied\s+—\s+block"

# A finished case: case_id, verdict, status, p, pattern, pattern_description, exposure_usd, affected (array<string>),
# connected (array<string>), similar (array<string>), report, narrative, summary, asked, what_changed,
# initial / final (array<struct<action, route, reason>>), subjects (array<string>)


def ids_cited(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CASE_ID), F.lit(0))


def invented_ids() -> Column:
    """Case ids cited in the prose of a finished case that are neither its own nor among its similar ones."""
    cited = F.array_union(F.array_union(ids_cited("summary"), ids_cited("pattern_description")), ids_cited("narrative"))
    return F.array_except(cited, F.concat(F.array("case_id"), F.coalesce("similar", F.array().cast("array<string>"))))


def _names(col: str) -> Column:
    return F.transform(F.col(col), lambda a: a["action"])


def row_violations(cases: DataFrame) -> DataFrame:
    """Invariants that need nothing but the case itself."""
    fin, ini = _names("final"), _names("initial")
    has = lambda arr, a: F.array_contains(arr, a)
    empty = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)) == 0
    legit, fraud = F.col("verdict") == "legitimate", F.col("verdict") == "fraud"
    pat = F.col("pattern")
    bad_route = lambda c: F.exists(c, lambda a: ~a["route"].eqNullSafe(F.coalesce(route(a["action"], F.col("exposure_usd")), F.lit("unknown action"))))
    no_rule = lambda c: F.exists(c, lambda a: ~F.coalesce(a["reason"], F.lit("")).rlike(CITATION))
    both = [("initial", ini), ("final", fin)]
    unknown = invented_ids()
    peers = F.size("connected") >= 2
    checks: list[tuple[str, str, Column]] = [
        ("I1", "report flag and FILE_REPORT disagree", F.col("report") != has(fin, "FILE_REPORT")),
        ("I2", "legitimate with affected transactions", legit & (F.size("affected") > 0)),
        ("I2", "legitimate with exposure", legit & (F.col("exposure_usd") != 0)),
        ("I2", "legitimate with a report", legit & F.col("report")),
        ("I3", "undocumented without description", (pat == "undocumented") & empty("pattern_description")),
        ("I3", "documented with description", (pat != "undocumented") & ~empty("pattern_description")),
        ("I3", "unknown pattern", ~pat.isin(PATTERNS)),
        ("I3", "unknown verdict", ~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))),
        ("I3", "unknown status", ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False))),
        ("I4", "actions changed without a question", ~F.col("asked") & (ini != fin)),
        ("I4", "change text without a question", ~F.col("asked") & (F.col("what_changed") != "nothing")),
        ("I7", "initial route differs", bad_route("initial")), ("I7", "final route differs", bad_route("final")),
        ("I8", "initial reason without rule", no_rule("initial")), ("I8", "final reason without rule", no_rule("final")),
        ("I9", "legitimate with a pattern", legit & ~F.coalesce(pat, F.lit("none")).isin("", "none")),
        *[("I10", f"{n}: all cards blocked without fraud", has(a, "BLOCK_ALL_CARDS") & ~fraud) for n, a in both],
        *[("I10", f"{n}: all cards blocked and closed", has(a, "BLOCK_ALL_CARDS") & has(a, "CLOSE_NO_FRAUD")) for n, a in both],
        ("I11", "fraud below one half", fraud & (F.col("p") < 0.5)), ("I11", "legitimate above one half", legit & (F.col("p") > 0.5)),
        ("I12", "cites an unknown case", F.size(unknown) > 0),
        ("I13", "linked fraud without report", fraud & peers & ~has(fin, "FILE_REPORT")),
        ("I13", "linked fraud without monitoring", fraud & peers & ~has(fin, "MONITOR_CONNECTED_CARDS")),
    ]
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("invariant"), F.lit(d).alias("detail"))) for i, d, c in checks]))
    return cases.select("case_id", F.inline(rows))


def asked_txn(ids: DataFrame, txn: DataFrame) -> DataFrame:
    """Transactions that ``ids(id string)`` names: the big table is filtered before any shuffle of it."""
    asked = cut(ids.select(F.expr("try_cast(id AS BIGINT)").alias("txn_id")).where("txn_id IS NOT NULL").distinct())
    return txn.join(small(asked), "txn_id", "left_semi").withColumn("id", F.col("txn_id").cast("string"))


def exposure_violations(cases: DataFrame, txn: DataFrame) -> DataFrame:
    """I5: exposure equals the absolute amounts of the affected transactions, to the cent."""
    x = cases.select("case_id", F.explode("affected").alias("id"))
    amt = asked_txn(x, txn).select("id", F.abs("amt").alias("a"))
    tot = x.join(amt, "id", "left").groupBy("case_id").agg(F.round(exact_sum("a"), 2).alias("total"), F.max(F.col("a").isNull()).alias("missing"))
    j = cases.select("case_id", "exposure_usd").join(tot, "case_id", "left")
    off = F.abs(F.coalesce("total", F.lit(0.0)) - F.round(F.coalesce("exposure_usd", F.lit(0.0)), 2)) > 0.01
    bad = F.coalesce(F.col("missing"), F.lit(False)) | off
    detail = F.when(F.coalesce(F.col("missing"), F.lit(False)), "amount of a transaction is missing").otherwise("exposure differs from the amounts")
    return j.where(bad).select("case_id", F.lit("I5").alias("invariant"), detail.alias("detail"))


def id_violations(cases: DataFrame, txn: DataFrame, cards: DataFrame, closed: DataFrame) -> DataFrame:
    """I6: every published id exists; one row for each unknown id."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("ids"))
                      for k, c in (("transaction", "affected"), ("first transaction", "_first"), ("card", "connected"), ("case", "similar"), ("subject", "subjects"))])
    first = F.when(F.col("first_suspicious").isNotNull(), F.array(F.col("first_suspicious").cast("string")))
    x = (cases.withColumn("_first", first).select("case_id", F.explode(kinds).alias("k")).select("case_id", "k.kind", F.explode("k.ids").alias("id"))
         .where(F.coalesce(F.col("id"), F.lit("")) != "").distinct())
    txns = asked_txn(x, txn).select("id")
    card_ids = cards.select(F.col("card").alias("id"))
    owners = cards.select(F.col("customer_id").alias("id"))
    tag = lambda df, k: df.distinct().withColumn("kind", F.lit(k))
    known = tag(txns, "transaction").unionByName(tag(txns, "first transaction")).unionByName(tag(card_ids, "card")).unionByName(tag(closed.select(F.col("case_id").alias("id")), "case"))
    known = known.unionByName(tag(txns.unionByName(card_ids).unionByName(owners), "subject"))
    bad = x.join(known, ["kind", "id"], "left_anti")
    return bad.select("case_id", F.lit("I6").alias("invariant"), F.concat(F.lit("unknown "), "kind", F.lit(" "), "id").alias("detail"))


def check_invariants(cases: DataFrame, txn: DataFrame, cards: DataFrame, closed: DataFrame) -> DataFrame:
    return row_violations(cases).unionByName(exposure_violations(cases, txn)).unionByName(id_violations(cases, txn, cards, closed))


def scrub_citations(df: DataFrame, text: str = "text", allowed: str = "allowed") -> DataFrame:
    """Drop sentences that cite a case id outside ``allowed``; text without such ids stays as it is."""
    ids = lambda c: F.regexp_extract_all(c, F.lit(CASE_ID), F.lit(0))
    t = F.coalesce(F.col(text), F.lit(""))
    invented = F.array_distinct(F.array_except(ids(t), F.col(allowed)))
    kept = F.filter(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda s: (F.length(s) > 0) & (F.size(F.array_except(ids(s), F.col(allowed))) == 0))
    clean = F.when(F.size(invented) == 0, t).otherwise(F.trim(F.array_join(kept, " ")))
    return df.withColumn("clean", clean).withColumn("n_invented", F.size(invented))


def audit_links(ev: DataFrame) -> DataFrame:
    """Concerns about device evidence: ``ev(alert_id, ref, channel, claim, has_link, overlap)``."""
    dev = F.col("channel") == "device"
    unfounded = dev & ~F.col("has_link") & F.lower("claim").contains("shared")
    late = dev & F.col("has_link") & (F.col("overlap") == "after")
    c = (F.when(unfounded, F.struct(F.lit("shared device without a link").alias("concern"), F.lit("med").alias("severity")))
         .when(late, F.struct(F.lit("device first seen after the linked window").alias("concern"), F.lit("high").alias("severity"))))
    return ev.withColumn("_c", c).where(F.col("_c").isNotNull()).select("alert_id", "ref", "_c.concern", "_c.severity")


def acceptance(cases: DataFrame) -> DataFrame:
    """Verdict counts with reports, report mismatches, initial reasons that leak the answer, and prose that cites invented cases."""
    leak = F.exists("initial", lambda a: F.coalesce(a["reason"], F.lit("")).rlike(LEAKS))
    n = lambda c: F.count(F.when(c, 1))
    return cases.groupBy("verdict").agg(
        F.count("*").alias("n"), n(F.col("report")).alias("n_reports"), n(F.col("report") != F.array_contains(_names("final"), "FILE_REPORT")).alias("n_mismatch"),
        n(leak).alias("n_leaks"), n(F.size(invented_ids()) > 0).alias("n_citing"), F.sum(F.size(invented_ids())).alias("n_citations"), n(F.col("asked") & (_names("initial") != _names("final"))).alias("n_ask_first"))
