"""Decision table, quality checks and evaluation metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fraudlake.operators import decide, evaluate, evidence, quality
from fraudlake.plans.registry import query

# Every transaction becomes one decision input: remainders of its id and counter run through all rules.
INPUT_SQL = """
SELECT txn_id AS case_id, CASE txn_id % 3 WHEN 0 THEN 'fraud' WHEN 1 THEN 'uncertain' ELSE 'legitimate' END AS verdict, risk_score AS p,
  round(amt * (1 + 20 * (txn_id % 7)), 2) AS exposure,
  CASE txn_id % 7 WHEN 0 THEN 'card_testing' WHEN 1 THEN 'out_of_region_use' WHEN 2 THEN 'undocumented' WHEN 3 THEN 'account_takeover' ELSE 'none' END AS pattern,
  txn_id % 4 AS n_channels, CASE txn_id % 5 WHEN 0 THEN 'device' WHEN 1 THEN 'region' END AS shared_element,
  CASE txn_id % 11 WHEN 0 THEN 'denied' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'no_reply' END AS response,
  txn_id % 13 < 4 AS is_dispute, txn_id % 17 < 6 AS is_recurring, k % 3 = 1 AS two_cards, txn_id % 19 = 0 AS undocumented_coordinated,
  txn_id % 23 < 5 AS testing_fires, k % 2 = 0 AS over_100_cleared,
  CASE txn_id % 29 % 4 WHEN 1 THEN 'risk_score' WHEN 2 THEN 'customer_report' WHEN 3 THEN 'analyst_request' END AS trigger_type,
  channel, coalesce(id_15 = 'New', FALSE) AS id_15_new, txn_id % 31 < 10 AS evidence_requested, txn_id % 43 < 3 AS credentials_compromised
FROM txn
"""
A = lambda cond, name: f"CASE WHEN {cond} THEN '{name}' END"
UND = "(pattern = 'undocumented' OR undocumented_coordinated)"
STEP = "(channel = 'online' AND id_15_new)"
WEAK = "(p < 0.85 AND n_channels <= 1)"
REPORT = f"(exposure > 1000 OR shared_element IS NOT NULL OR {UND})"
SURE = "(verdict = 'fraud' OR (verdict <> 'legitimate' AND p >= 0.85))"
CASE_OPEN = "(p >= 0.3 OR is_dispute OR evidence_requested)"
SH = "shared_element IS NOT NULL"
RULE_SQL = f"""
SELECT *, CASE WHEN is_recurring AND is_dispute AND (trigger_type IS NULL OR trigger_type = 'customer_report') THEN 'recurring' WHEN verdict = 'legitimate' THEN 'legitimate'
  WHEN response = 'denied' THEN 'denied' WHEN response = 'confirmed' THEN 'confirmed' WHEN response = 'no_reply' THEN 'no_reply'
  WHEN verdict = 'uncertain' AND trigger_type IS DISTINCT FROM 'customer_report' AND NOT testing_fires AND NOT {UND} THEN 'ask'
  WHEN {UND} THEN 'undocumented' WHEN testing_fires THEN 'testing' WHEN {SH} AND verdict = 'fraud' THEN 'shared'
  WHEN verdict = 'uncertain' AND exposure > 500 THEN 'exposed' WHEN {WEAK} THEN 'single_signal' WHEN verdict = 'fraud' THEN 'fraud' WHEN p >= 0.7 THEN 'elevated' ELSE 'watch' END AS rule
FROM inp
"""
LISTS = {
    "recurring": ["'CREATE_CASE'", "'VERIFY_WITH_CUSTOMER'", "'WARN_CUSTOMER'"], "legitimate": ["'CLOSE_NO_FRAUD'"], "confirmed": ["'CLOSE_NO_FRAUD'"],
    "denied": ["'BLOCK_CARD'", "'CREATE_CASE'", A(f"(pattern <> 'none' OR {SURE}) AND {REPORT}", "FILE_REPORT"), A(SH, "MONITOR_CONNECTED_CARDS")],
    "no_reply": ["'MONITOR_CARD'", "'DECLINE_TRANSACTION'", A("exposure > 500", "ESCALATE_TO_ANALYST")],
    "ask": [f"CASE WHEN {STEP} THEN 'STEP_UP_AUTH' ELSE 'VERIFY_WITH_CUSTOMER' END", A("exposure > 500", "ESCALATE_TO_ANALYST"), "'CREATE_CASE'"],
    "undocumented": [f"CASE WHEN verdict = 'uncertain' AND response IS NULL THEN CASE WHEN {STEP} THEN 'STEP_UP_AUTH' ELSE 'VERIFY_WITH_CUSTOMER' END END",
                     A("verdict = 'fraud'", "BLOCK_CARD"), "'CREATE_CASE'", "'FILE_REPORT'", "'ESCALATE_TO_ANALYST'", A(SH, "MONITOR_CONNECTED_CARDS")],
    "testing": ["'DECLINE_TRANSACTION'", "'STEP_UP_AUTH'", A(f"over_100_cleared AND NOT {WEAK}", "BLOCK_CARD"), A(WEAK, "VERIFY_WITH_CUSTOMER")],
    "shared": ["'CREATE_CASE'", "'FILE_REPORT'", "'MONITOR_CONNECTED_CARDS'"], "exposed": ["'ESCALATE_TO_ANALYST'", "'CREATE_CASE'"],
    "single_signal": ["'VERIFY_WITH_CUSTOMER'", A(CASE_OPEN, "CREATE_CASE")],
    "fraud": ["'BLOCK_CARD'", "'CREATE_CASE'", A(f"{SURE} AND {REPORT}", "FILE_REPORT"), A(SH, "MONITOR_CONNECTED_CARDS")],
    "elevated": ["'MONITOR_CARD'", "'VERIFY_WITH_CUSTOMER'", "'CREATE_CASE'"], "watch": ["'MONITOR_CARD'", A(CASE_OPEN, "CREATE_CASE")],
}
CHAIN = "CASE rule " + " ".join(f"WHEN '{r}' THEN [{', '.join(v)}]" for r, v in LISTS.items()) + " END"
FRAUD = "verdict = 'fraud' AND rule <> 'recurring'"


def _add(src, cond, name):
    return f"SELECT * REPLACE (CASE WHEN {cond} AND NOT list_contains(a, '{name}') THEN list_append(a, '{name}') ELSE a END AS a) FROM {src}"


DECIDE = {
    "inp": INPUT_SQL, "ruled": RULE_SQL, "d0": f"SELECT *, list_filter({CHAIN}, lambda x: x IS NOT NULL) AS a FROM ruled",
    "d1": _add("d0", FRAUD, "BLOCK_CARD"), "d2": _add("d1", f"{FRAUD} AND exposure > 1000", "FILE_REPORT"),
    "d3": _add("d2", f"{FRAUD} AND ({SH} OR pattern IN ('undocumented', 'card_testing'))", "MONITOR_CONNECTED_CARDS"),
    "d4": _add("d3", f"{FRAUD} AND pattern = 'card_testing'", "STEP_UP_AUTH"),
    "d5": _add("d4", "verdict = 'fraud' AND (two_cards OR credentials_compromised) AND pattern <> 'none' AND NOT list_contains(a, 'CLOSE_NO_FRAUD')", "BLOCK_ALL_CARDS"),
}


def decide_ctes(inp: str, suffix: str, block_all: bool = True) -> dict[str, str]:
    """The steps of the decision for another input; the table of the final lists is ``d5`` with the suffix."""
    out = {f"inp{suffix}": inp}
    for n in ("ruled", "d0", "d1", "d2", "d3", "d4", "d5"):
        step = DECIDE[n] if block_all or n != "d5" else "SELECT * FROM d4"
        out[n + suffix] = re.sub(r"FROM (inp|ruled|d[0-4])\b", rf"FROM \g<1>{suffix}", step)
    return out


ROUTE_SQL = """CASE WHEN action = 'BLOCK_CARD' THEN CASE WHEN {e} > 2500 THEN 'L2' ELSE 'L1' END WHEN action IN ('BLOCK_ALL_CARDS', 'FILE_REPORT') THEN 'L2'
 WHEN action = 'DECLINE_TRANSACTION' THEN 'L1' ELSE 'auto' END"""
T = ("txn",)


def inputs(f):
    return f._sql(INPUT_SQL, txn=f.txn)


def decided(f):
    return decide.decide(inputs(f))


@query("p01_decision_actions", f"""
SELECT case_id, rule, CAST(pos AS INT) AS pos, action, {ROUTE_SQL.format(e='exposure')} AS route
FROM (SELECT case_id, rule, exposure, unnest(a) AS action, unnest(range(len(a))) AS pos FROM d5)
""", T, DECIDE)
def _(f):
    x = decided(f).select("case_id", "rule", F.posexplode("actions").alias("pos", "x"))
    return x.select("case_id", "rule", "pos", "x.action", "x.route")


@query("p01_decision_flags", f"""
SELECT case_id, rule, list_contains(a, 'FILE_REPORT') AS report, list_contains(a, 'ESCALATE_TO_ANALYST') AS escalate,
  CASE WHEN rule IN ('legitimate', 'confirmed', 'no_reply', 'testing', 'single_signal', 'watch') THEN {CASE_OPEN} ELSE TRUE END AS case_open FROM d5
""", T, DECIDE)
def _(f):
    return decided(f).select("case_id", "rule", "report", "escalate", "case_open")


@query("p02_report_required", f"SELECT case_id, {SURE} AND {REPORT} AS report FROM inp", T, DECIDE)
def _(f):
    return inputs(f).select("case_id", decide.report_required().alias("report"))


@query("p03_case_required", f"SELECT case_id, {CASE_OPEN} AS case_open FROM inp", T, DECIDE)
def _(f):
    return inputs(f).select("case_id", decide.case_required().alias("case_open"))


@query("p04_reroute", f"""SELECT case_id, CAST(pos AS INT) AS pos, action, {ROUTE_SQL.format(e='exposure * 3')} AS route
FROM (SELECT case_id, exposure, unnest(a) AS action, unnest(range(len(a))) AS pos FROM d5)""", T, DECIDE)
def _(f):
    d = decided(f).withColumn("again", decide.reroute(F.col("actions"), F.col("exposure") * 3))
    return d.select("case_id", F.posexplode("again").alias("pos", "x")).select("case_id", "pos", "x.action", "x.route")


@query("p05_block_all_gate", "SELECT case_id FROM d5 WHERE list_contains(a, 'BLOCK_ALL_CARDS')", T, DECIDE)
def _(f):
    return decided(f).where(F.exists("actions", lambda a: a["action"] == "BLOCK_ALL_CARDS")).select("case_id")


# decided twice: with the customer's answer and without it
NO_ANSWER = {k.replace("inp", "inp0"): v for k, v in {"inp": INPUT_SQL.replace("CASE txn_id % 11 WHEN 0 THEN 'denied' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'no_reply' END AS response", "CAST(NULL AS VARCHAR) AS response")}.items()}
for _n in ("ruled", "d0", "d1", "d2", "d3", "d4", "d5"):
    _s = DECIDE[_n]
    for _o in ("inp", "ruled", "d0", "d1", "d2", "d3", "d4"):
        _s = _s.replace(f"FROM {_o}", f"FROM {_o}0")
    NO_ANSWER[_n + "0"] = _s.replace("FROM inp00", "FROM inp0")
DIFF = {**DECIDE, **NO_ANSWER, "two": """SELECT i.case_id, i.response IS NOT NULL AS asked,
  CASE WHEN i.p >= 0.85 AND i.n_channels >= 2 THEN z.a ELSE list_filter(z.a, lambda x: x <> 'BLOCK_CARD') END AS ini,
  CASE WHEN i.response IS NOT NULL AND NOT list_contains(i.a, 'CREATE_CASE') THEN list_append(i.a, 'CREATE_CASE') ELSE i.a END AS fin FROM d5 i JOIN d50 z USING (case_id)"""}


@query("p06_action_diff", """
SELECT case_id, array_to_string(ini, ',') AS initial, array_to_string(fin, ',') AS final, CASE WHEN NOT asked OR (len(added) = 0 AND len(removed) = 0) THEN 'nothing' ELSE
  concat_ws('; ', CASE WHEN len(added) > 0 THEN 'added: ' || array_to_string(added, ', ') END, CASE WHEN len(removed) > 0 THEN 'removed: ' || array_to_string(removed, ', ') END) END AS what_changed
FROM (SELECT *, list_filter(fin, lambda x: NOT list_contains(ini, x)) AS added, list_filter(ini, lambda x: NOT list_contains(fin, x)) AS removed FROM two)
""", T, DIFF)
def _(f):
    base = inputs(f)
    first = decide.decide(base.withColumn("response", F.lit(None).cast("string"))).select("case_id", F.col("actions").alias("initial"))
    both = decide.decide(base).withColumnRenamed("actions", "final").join(first, "case_id")
    both = both.withColumn("p_initial", F.col("p")).withColumn("asked", F.col("response").isNotNull())
    d = decide.action_diff(both)
    return d.select("case_id", F.array_join("initial_names", ",").alias("initial"), F.array_join("final_names", ",").alias("final"), "what_changed")


@query("p07_report_replay", """SELECT count(*) AS n, count(*) FILTER (WHERE w = g) AS agree, count(*) FILTER (WHERE w AND NOT g) AS only_rule, count(*) FILTER (WHERE g AND NOT w) AS only_filed
FROM (SELECT exposure_usd > 100 OR pattern = 'undocumented' OR first_fraud_txn_id % 7 = 0 AS w, report_filed = 'Yes' AS g FROM closed_case WHERE outcome = 'confirmed_fraud')""", ("closed_case",))
def _(f):
    linked = F.when(F.col("first_fraud_txn_id") % 7 == 0, F.col("card")).when(F.col("first_fraud_txn_id") % 7 == 1, "")
    return decide.replay_reports(f.cases.withColumn("connected_card_ids", linked), 100.0)


# Finished cases built from every transaction, with defects of all kinds spread by remainders.
CASES_SQL = """
SELECT concat('CASE-EV-', CAST(txn_id AS VARCHAR)) AS case_id, txn_id, card, customer_id,
  CASE txn_id % 3 WHEN 0 THEN 'fraud' WHEN 1 THEN 'uncertain' ELSE 'legitimate' END AS verdict,
  CASE WHEN txn_id % 41 = 0 THEN 'odd' WHEN txn_id % 3 = 0 THEN 'closed_fraud' WHEN txn_id % 3 = 1 THEN 'open' ELSE 'closed_legitimate' END AS status,
  CASE WHEN txn_id % 37 = 0 THEN 0.5 ELSE CASE txn_id % 3 WHEN 0 THEN 0.5 + risk_score / 2 WHEN 1 THEN risk_score ELSE risk_score * 0.52 END END AS p,
  CASE WHEN txn_id % 43 = 0 THEN 'strange' WHEN txn_id % 3 = 2 AND txn_id % 47 <> 0 THEN 'none' WHEN txn_id % 2 = 0 THEN 'undocumented' ELSE 'card_testing' END AS pattern,
  CASE WHEN txn_id % 53 = 0 THEN 'text' WHEN txn_id % 3 <> 2 AND txn_id % 2 = 0 AND txn_id % 43 <> 0 THEN 'Linked rows. See CC-0000008.' ELSE '' END AS pattern_description,
  CASE WHEN txn_id % 3 = 2 AND txn_id % 59 <> 0 THEN 0 ELSE abs(amt) + CASE WHEN txn_id % 61 = 0 THEN 1 ELSE 0 END END AS exposure_usd,
  CASE WHEN txn_id % 3 = 2 AND txn_id % 67 <> 0 THEN NULL WHEN txn_id % 71 = 0 THEN '999999999' ELSE CAST(txn_id AS VARCHAR) END AS aff,
  CASE WHEN txn_id % 7 = 0 THEN card END AS conn1, CASE WHEN txn_id % 7 = 0 AND txn_id % 2 = 0 THEN 'NO-CARD' END AS conn2,
  CASE WHEN txn_id % 73 = 0 THEN 'CC-NONE' ELSE 'CC-0000008' END AS sim, CASE WHEN txn_id % 107 = 0 THEN 888888888 WHEN txn_id % 2 = 0 THEN txn_id END AS first_suspicious, txn_id % 109 = 0 AS odd_action,
  txn_id % 103 = 0 AS leaking,
  txn_id % 3 = 0 AND txn_id % 5 < 3 AS has_report, txn_id % 3 = 0 AND txn_id % 5 < 3 AND txn_id % 79 <> 0 AS report, txn_id % 4 = 0 AS has_monitor, txn_id % 83 = 0 AS has_all,
  txn_id % 3 = 2 OR txn_id % 89 = 0 AS has_close, txn_id % 97 = 0 AS bad_route, txn_id % 101 = 0 AS bad_reason, txn_id % 6 < 3 AS asked, txn_id % 11 = 0 AS differs,
  CASE WHEN txn_id % 13 = 0 THEN 'Seen in CC-1234567 and CASE-EV-5. ' ELSE 'Nothing special. ' END AS summary, CASE WHEN txn_id % 17 = 0 THEN 'As in CC-0000008.' ELSE '' END AS narrative
FROM txn
"""


def finished(f):
    d = f._sql(CASES_SQL, txn=f.txn)
    r = F.when(F.col("bad_reason"), "because").when(F.col("leaking"), "R2: the customer denied it").otherwise("R2: rule")
    act = lambda name, rt, cond=None: (F.struct(F.lit(name).alias("action"), rt.alias("route"), r.alias("reason")) if cond is None
                                       else F.when(cond, F.struct(F.lit(name).alias("action"), rt.alias("route"), r.alias("reason"))))
    a, l2 = F.lit("auto"), F.lit("L2")
    final = F.array_compact(F.array(act("CREATE_CASE", F.when(F.col("bad_route"), "L1").otherwise("auto"), ~F.col("odd_action")), act("DO_SOMETHING", a, F.col("odd_action")), act("FILE_REPORT", l2, F.col("has_report")),
                                    act("MONITOR_CONNECTED_CARDS", a, F.col("has_monitor")), act("BLOCK_ALL_CARDS", l2, F.col("has_all")), act("CLOSE_NO_FRAUD", a, F.col("has_close"))))
    arr = lambda *c: F.array_compact(F.array(*[F.col(x) for x in c]))
    return (d.withColumn("final", final).withColumn("initial", F.when(F.col("differs"), F.slice("final", 1, 1)).otherwise(F.col("final")))
            .withColumn("what_changed", F.when(F.col("differs"), "removed").otherwise("nothing")).withColumn("affected", arr("aff")).withColumn("connected", arr("conn1", "conn2"))
            .withColumn("similar", arr("sim")).withColumn("subjects", arr("customer_id", "card")))


_N_FINAL = "(1 + has_report::INT + has_monitor::INT + has_all::INT + has_close::INT)"
INV = [
    ("I1", "report flag and FILE_REPORT disagree", "report <> has_report"), ("I2", "legitimate with affected transactions", "verdict = 'legitimate' AND aff IS NOT NULL"),
    ("I2", "legitimate with exposure", "verdict = 'legitimate' AND exposure_usd <> 0"), ("I2", "legitimate with a report", "verdict = 'legitimate' AND report"),
    ("I3", "undocumented without description", "pattern = 'undocumented' AND pattern_description = ''"), ("I3", "documented with description", "pattern <> 'undocumented' AND pattern_description <> ''"),
    ("I3", "unknown pattern", "pattern = 'strange'"), ("I3", "unknown status", "status = 'odd'"),
    ("I4", "actions changed without a question", f"NOT asked AND differs AND {_N_FINAL} > 1"), ("I4", "change text without a question", "NOT asked AND differs"),
    ("I7", "initial route differs", "bad_route OR odd_action"), ("I7", "final route differs", "bad_route OR odd_action"), ("I8", "initial reason without rule", "bad_reason"), ("I8", "final reason without rule", "bad_reason"),
    ("I9", "legitimate with a pattern", "verdict = 'legitimate' AND pattern <> 'none'"),
    ("I10", "initial: all cards blocked without fraud", "has_all AND NOT differs AND verdict <> 'fraud'"), ("I10", "initial: all cards blocked and closed", "has_all AND has_close AND NOT differs"),
    ("I10", "final: all cards blocked without fraud", "has_all AND verdict <> 'fraud'"), ("I10", "final: all cards blocked and closed", "has_all AND has_close"),
    ("I11", "fraud below one half", "verdict = 'fraud' AND p < 0.5"), ("I11", "legitimate above one half", "verdict = 'legitimate' AND p > 0.5"),
    ("I12", "cites an unknown case", "txn_id % 13 = 0 OR ((pattern_description LIKE '%CC-0000008%' OR narrative <> '') AND sim <> 'CC-0000008')"),
    ("I13", "linked fraud without report", "verdict = 'fraud' AND conn2 IS NOT NULL AND NOT has_report"), ("I13", "linked fraud without monitoring", "verdict = 'fraud' AND conn2 IS NOT NULL AND NOT has_monitor"),
]
INV_SQL = " UNION ALL ".join(f"SELECT case_id, '{i}' AS invariant, '{d}' AS detail FROM done WHERE {c}" for i, d, c in INV) + """
UNION ALL SELECT case_id, 'I5', 'amount of a transaction is missing' FROM done WHERE aff = '999999999'
UNION ALL SELECT case_id, 'I5', 'exposure differs from the amounts' FROM done WHERE coalesce(aff, '') <> '999999999' AND abs(round(exposure_usd, 2) - CASE WHEN aff IS NULL THEN 0 ELSE (SELECT round(abs(t.amt), 2) FROM txn t WHERE t.txn_id = done.txn_id) END) > 0.01
UNION ALL SELECT case_id, 'I6', 'unknown transaction 999999999' FROM done WHERE aff = '999999999'
UNION ALL SELECT case_id, 'I6', 'unknown first transaction 888888888' FROM done WHERE first_suspicious = 888888888
UNION ALL SELECT case_id, 'I6', 'unknown card NO-CARD' FROM done WHERE conn2 IS NOT NULL
UNION ALL SELECT case_id, 'I6', concat('unknown case ', sim) FROM done WHERE sim NOT IN (SELECT case_id FROM closed_case)
"""


@query("p08_invariants", INV_SQL, ("txn", "closed_case"), {"done": CASES_SQL})
def _(f):
    return quality.check_invariants(finished(f), f.txn, f.txn.select("card", "customer_id").distinct(), f.cases)


# prose with case ids: the text itself never cites any, so ids are woven in by remainders
PROSE_SQL = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'As in CC-1234567 before. ' ELSE 'Seen before. ' END, trim(regexp_replace(text, '\\s+', ' ', 'g')), ' Compare CASE-AB-12! Known as CC-0000008 too.') AS text FROM documents"""


@query("p09_scrub_citations", r"""
SELECT doc_id, CASE WHEN len(inv) = 0 THEN text ELSE trim(array_to_string(list_filter(parts, lambda s: len(list_filter(regexp_extract_all(s, '\b(?:CC-\d{4,}|CASE-[A-Z0-9]+-\d+)\b'), lambda i: i <> 'CC-0000008')) = 0), ' ')) END AS clean, CAST(len(inv) AS INT) AS n_invented
FROM (SELECT doc_id, text, list_distinct(list_filter(regexp_extract_all(text, '\b(?:CC-\d{4,}|CASE-[A-Z0-9]+-\d+)\b'), lambda i: i <> 'CC-0000008')) AS inv,
  string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM prose)
""", (), {"prose": PROSE_SQL})
def _(f):
    d = f.raw("documents").select("doc_id", F.concat(
        F.when(F.col("doc_id") % 3 == 0, "As in CC-1234567 before. ").otherwise("Seen before. "), F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " ")),
        F.lit(" Compare CASE-AB-12! Known as CC-0000008 too.")).alias("text"), F.array(F.lit("CC-0000008")).alias("allowed"))
    return quality.scrub_citations(d).select("doc_id", "clean", "n_invented")


LINK_SQL = """SELECT txn_id AS alert_id, product_cd AS ref, CASE WHEN channel = 'online' THEN 'device' ELSE 'region' END AS channel,
 CASE WHEN k % 3 = 0 THEN 'A Shared device.' ELSE 'A device.' END AS claim, k % 2 = 0 AS has_link, CASE WHEN k % 5 = 0 THEN 'after' ELSE 'in' END AS overlap FROM txn"""


@query("p10_audit_links", """SELECT alert_id, ref, CASE WHEN NOT has_link THEN 'shared device without a link' ELSE 'device first seen after the linked window' END AS concern,
 CASE WHEN NOT has_link THEN 'med' ELSE 'high' END AS severity FROM l WHERE channel = 'device' AND ((NOT has_link AND lower(claim) LIKE '%shared%') OR (has_link AND overlap = 'after'))""", T, {"l": LINK_SQL})
def _(f):
    return quality.audit_links(f._sql(LINK_SQL, txn=f.txn))


@query("p11_case_status", "SELECT case_id, CASE WHEN verdict = 'legitimate' THEN 'closed_legitimate' WHEN list_contains(a, 'ESCALATE_TO_ANALYST') THEN 'escalated' WHEN verdict = 'fraud' THEN 'closed_fraud' ELSE 'open' END AS status FROM d5", T, DECIDE)
def _(f):
    return decided(f).select("case_id", decide.status(F.col("verdict"), F.col("escalate")).alias("status"))


@query("p12_acceptance", f"""SELECT verdict, count(*) AS n, count(*) FILTER (WHERE report) AS n_reports, count(*) FILTER (WHERE report <> has_report) AS n_mismatch, count(*) FILTER (WHERE leaking AND NOT bad_reason) AS n_leaks,
 count(*) FILTER (WHERE n_inv > 0) AS n_citing, CAST(sum(n_inv) AS BIGINT) AS n_citations,
 count(*) FILTER (WHERE asked AND differs AND {_N_FINAL} > 1) AS n_ask_first
 FROM (SELECT *, CASE WHEN txn_id % 13 = 0 THEN 1 + (txn_id <> 5)::INT ELSE 0 END + ((pattern_description LIKE '%CC-0000008%' OR narrative <> '') AND sim <> 'CC-0000008')::INT AS n_inv FROM done) GROUP BY 1""", T, {"done": CASES_SQL})
def _(f):
    return quality.acceptance(finished(f))


@query("p14_stop_reason", """SELECT case_id, concat_ws(' ', CASE WHEN response IS NULL THEN 'No customer answer was needed.' ELSE 'The customer answer (' || response || ') settled the verdict.' END,
 CASE WHEN n_channels > 0 THEN 'Audit concerns: ' || array_to_string(list_slice(['a', 'b', 'c', 'd'], 1, least(3, n_channels)), '; ') END, CASE WHEN is_dispute THEN 'Errors: e1; e2; e3; e4; e5' END) AS reason FROM inp""", T, DECIDE)
def _(f):
    concerns = F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), F.col("n_channels").cast("int"))
    errors = F.when(F.col("is_dispute"), F.array(*[F.lit(f"e{i}") for i in range(1, 7)])).otherwise(F.array().cast("array<string>"))
    return inputs(f).select("case_id", decide.stop_reason(F.col("response"), concerns, errors).alias("reason"))


# ---- evaluation ---------------------------------------------------------------------

C, P = ("closed_case",), ("prediction",)
ARCH_SQL = """CASE WHEN regexp_matches(t, '(?i)\\btravel(?:led|ling)?\\b|\\btrip\\b') THEN 'travel' WHEN regexp_matches(t, '(?i)\\b(new phone|new device|got a new)\\b') THEN 'new_phone'
 WHEN regexp_matches(t, '(?i)\\b(large|big|expensive) (?:purchase|transaction)\\b') THEN 'big_purchase' ELSE 'other' END"""


@query("b01_note_archetype", f"SELECT case_id, {ARCH_SQL} AS archetype FROM (SELECT case_id, analyst_notes AS t FROM closed_case)", C)
def _(f):
    return f.cases.select("case_id", evaluate.archetype().alias("archetype"))


@query("b01_archetype_of_texts", f"SELECT conv_id, turn, {ARCH_SQL} AS archetype FROM (SELECT conv_id, turn, text AS t FROM conversations)")
def _(f):
    return f.raw("conversations").select("conv_id", "turn", evaluate.archetype("text").alias("archetype"))


SAMPLE_SQL = """SELECT case_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, case_id) - 1 AS r FROM (
  SELECT case_id, pattern AS stratum, md5(case_id || '|42') AS h FROM closed_case))
ORDER BY r >= greatest(1, 60 // (SELECT count(DISTINCT pattern) FROM closed_case)), h, case_id LIMIT 60"""


@query("b02_stratified_sample", "SELECT stratum, count(*) AS n FROM s GROUP BY 1", C, {"s": SAMPLE_SQL})
def _(f):
    return evaluate.stratified_sample(f.cases, F.col("pattern"), 60).groupBy("stratum").agg(F.count("*").alias("n"))


@query("b02_sampled_cases", "SELECT * FROM s", C, {"s": SAMPLE_SQL})
def _(f):
    return evaluate.stratified_sample(f.cases, F.col("pattern"), 60).select("case_id", "stratum")


CUT = 1_705_276_800_000_000  # 2024-01-15


@query("b03_oot_split", f"SELECT case_id, CASE WHEN epoch_us(closed_at) < {CUT} THEN 'train' ELSE 'test' END AS split FROM closed_case WHERE epoch_us(closed_at) < {CUT} OR epoch_us(opened_at) >= {CUT}", C)
def _(f):
    return evaluate.oot_split(f.cases, CUT).select("case_id", "split")


@query("b04_response_label", "SELECT case_id, CASE WHEN actions_taken LIKE '%BLOCK_CARD%' THEN 'denied' WHEN actions_taken LIKE '%CLOSE_NO_FRAUD%' THEN 'confirmed' ELSE 'no_reply' END AS response FROM closed_case", C)
def _(f):
    return f.cases.select("case_id", evaluate.response_label().alias("response"))


PV_SQL = """SELECT case_id, y, p, CASE WHEN y = 1 THEN 'fraud' ELSE 'legitimate' END AS gt, CASE WHEN p >= 0.5 THEN 'fraud' WHEN p < 0.3 THEN 'legitimate' ELSE 'uncertain' END AS verdict,
 gt_report = 1 AS gt_report, pred = 1 AS report, CASE WHEN case_id % 2 = 0 THEN 'tune' ELSE 'eval' END AS split, p * 1000 AS exposure, y * 500.0 AS gt_exposure,
 CASE case_id % 3 WHEN 0 THEN 'card_testing' WHEN 1 THEN 'undocumented' ELSE 'none' END AS gt_pattern, CASE case_id % 4 WHEN 0 THEN 'card_testing' WHEN 1 THEN 'undocumented' ELSE 'none' END AS pattern,
 case_id % 7 AS tool_calls, p * 3 AS latency_s FROM prediction"""
PV = {"pv": PV_SQL}


def pv(f):
    return f._sql(PV_SQL, prediction=f.predictions)


ACC = """count(*) AS n, count(*) FILTER (WHERE verdict = gt) AS correct, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain,
 round(count(*) FILTER (WHERE verdict = gt) / count(*)::DOUBLE, 6) AS acc_all, round(count(*) FILTER (WHERE verdict = gt) / count(*) FILTER (WHERE verdict <> 'uncertain')::DOUBLE, 6) AS acc_certain"""
AGREE = """count(*) FILTER (WHERE gt_report AND report) AS tp, count(*) FILTER (WHERE NOT gt_report AND report) AS fp, count(*) FILTER (WHERE gt_report AND NOT report) AS fn, count(*) FILTER (WHERE NOT gt_report AND NOT report) AS tn,
 round(count(*) FILTER (WHERE gt_report AND report) / nullif(count(*) FILTER (WHERE report), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE gt_report AND report) / nullif(count(*) FILTER (WHERE gt_report), 0)::DOUBLE, 6) AS recall"""


def r6(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query("b05_verdict_accuracy", f"SELECT {ACC} FROM pv", P, PV)
def _(f):
    return r6(evaluate.verdict_accuracy(pv(f)), "acc_all", "acc_certain")


@query("b06_confusion", "SELECT gt_pattern, count(*) FILTER (WHERE pattern = 'card_testing') AS card_testing, 0::BIGINT AS card_not_present_fraud, 0::BIGINT AS card_not_present_new_device, 0::BIGINT AS out_of_region_use, 0::BIGINT AS account_takeover, count(*) FILTER (WHERE pattern = 'undocumented') AS undocumented, count(*) FILTER (WHERE pattern = 'none') AS \"none\" FROM pv GROUP BY 1", P, PV)
def _(f):
    return evaluate.confusion(pv(f))


@query("b07_report_agreement", f"SELECT {AGREE} FROM pv", P, PV)
def _(f):
    return r6(evaluate.binary_agreement(pv(f)), "precision", "recall")


@query("b08_exposure_error", "SELECT count(*) AS n, round(avg(abs(gt_exposure - exposure)), 6) AS mae, round(max(abs(gt_exposure - exposure)), 6) AS max_abs_err FROM pv", P, PV)
def _(f):
    return r6(evaluate.exposure_error(pv(f)), "mae", "max_abs_err")


@query("b09_jaccard", """SELECT count(*) AS n, round(avg(1.0 / n_ids), 6) AS before, round(avg(CASE WHEN n_ids = 1 THEN 0.5 ELSE 2.0 / n_ids END), 6) AS after FROM (
 SELECT len(string_split(txn_ids, '|')) AS n_ids FROM closed_case)""", C)
def _(f):
    ids = F.split("txn_ids", r"\|")
    extra = F.concat(F.slice(ids, 1, 1), F.when(F.size(ids) > 1, F.slice(ids, 2, 1)).otherwise(F.array(F.lit("other"))))
    c = f.cases.select(ids.alias("gt"), F.slice(ids, 1, 1).alias("b"), extra.alias("a"))
    out = evaluate.mean_jaccard(c, "gt", "b", "a")
    return r6(out, "before", "after")


@query("b10_brier", "SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM prediction", P)
def _(f):
    return r6(evaluate.brier(f.predictions), "brier")


@query("b10_weighted_brier", "SELECT round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY y) AS w FROM prediction)", P)
def _(f):
    from fraudlake.operators.model import balanced_weights
    return r6(evaluate.brier(balanced_weights(f.predictions), "weight"), "brier")


@query("b11_auc", """SELECT CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
 round((SELECT avg(CASE WHEN a.q > b.q THEN 1.0 WHEN a.q = b.q THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0), 6) AS auc FROM s""", P, {"s": "SELECT y, round(p, 1) AS q FROM prediction"})
def _(f):
    return r6(evaluate.auc(f.predictions.select("y", F.round("p", 1).alias("p"))), "auc")


@query("b11_auc_of_scores", """WITH z AS (SELECT * FROM q) SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg,
 round((sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)::DOUBLE AS auc FROM z""".replace("WITH z AS (SELECT * FROM q) ", "").replace("FROM z", "FROM q"),
       ("txn", "fraud_ids"), {"q": "SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS rk FROM (SELECT risk_score AS p, CASE WHEN f.txn_id IS NULL THEN 0 ELSE 1 END AS y FROM txn t LEFT JOIN fraud_ids f USING (txn_id))"})
def _(f):
    d = evidence.labels(f.txn, f.fraud_ids, f.cleared_ids).select("y", F.col("risk_score").alias("p"))
    return r6(evaluate.auc(d), "auc")


@query("b12_reliability", "SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, count(*) AS n FROM prediction GROUP BY 1", P)
def _(f):
    return r6(evaluate.reliability(f.predictions), "mean_p", "mean_y")


@query("b13_reliability_quantile", """SELECT CAST(len(list_filter(e[2:10], lambda x: x <= p)) AS INT) AS bin, round(sum(w * p) / sum(w), 6) AS mean_p, round(sum(w * y) / sum(w), 6) AS mean_y, count(*) AS n
FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY y) AS w FROM prediction), (SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM prediction) GROUP BY 1""", P)
def _(f):
    from fraudlake.operators.model import balanced_weights
    return r6(evaluate.reliability_quantile(balanced_weights(f.predictions), "weight"), "mean_p", "mean_y")


CURVE_SQL = "SELECT v.tau, count(*) FILTER (WHERE (p >= tau) = (y = 1)) AS correct, count(*) AS total, round(count(*) FILTER (WHERE (p >= tau) = (y = 1)) / count(*)::DOUBLE, 4) AS accuracy FROM prediction, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in evaluate.TAUS) + ") v(tau) GROUP BY 1"


@query("b14_threshold_curve", CURVE_SQL, P)
def _(f):
    return evaluate.threshold_curve(f.predictions)


@query("b14_best_threshold", "SELECT tau, accuracy FROM curve ORDER BY accuracy DESC, tau LIMIT 1", P, {"curve": CURVE_SQL})
def _(f):
    return evaluate.best_threshold(evaluate.threshold_curve(f.predictions))


@query("b15_split_report", f"SELECT split, {ACC}, {AGREE}, round(avg((p - y) * (p - y)), 6) AS brier FROM pv GROUP BY 1", P, PV)
def _(f):
    return r6(evaluate.report(pv(f)), "acc_all", "acc_certain", "precision", "recall", "brier")


@query("b16_runtime_summary", "SELECT count(*) AS n, round(avg(tool_calls), 6) AS mean_tool_calls, round(avg(latency_s), 6) AS mean_latency_s FROM pv", P, PV)
def _(f):
    return r6(evaluate.runtime_summary(pv(f)), "mean_tool_calls", "mean_latency_s")
