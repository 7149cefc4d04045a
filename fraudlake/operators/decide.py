"""Decision table: ordered actions, approval routes, report and case triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Approval route of each action; BLOCK_CARD goes to L2 above the exposure limit.
ROUTES = {
    "ALLOW_TRANSACTION": "auto", "MONITOR_CARD": "auto", "MONITOR_CONNECTED_CARDS": "auto", "WARN_CUSTOMER": "auto",
    "VERIFY_WITH_CUSTOMER": "auto", "STEP_UP_AUTH": "auto", "GENERATE_REPORT": "auto", "CREATE_CASE": "auto",
    "ESCALATE_TO_ANALYST": "auto", "CLOSE_NO_FRAUD": "auto", "DECLINE_TRANSACTION": "L1", "BLOCK_CARD": "L1",
    "BLOCK_ALL_CARDS": "L2", "FILE_REPORT": "L2",
}
BLOCK_L2_ABOVE = 2500.0
REPORT_ABOVE = 1000.0
ESCALATE_ABOVE = 500.0
# verdict, p, exposure, pattern, n_channels, shared_element, response, is_dispute, is_recurring, two_cards,
# undocumented_coordinated, testing_fires, over_100_cleared, trigger_type, channel, id_15_new, evidence_requested
INPUTS = ["verdict", "p", "exposure", "pattern", "n_channels", "shared_element", "response", "is_dispute", "is_recurring", "two_cards",
          "undocumented_coordinated", "testing_fires", "over_100_cleared", "trigger_type", "channel", "id_15_new", "evidence_requested"]


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def route(action: Column, exposure: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return F.when((action == "BLOCK_CARD") & (exposure > BLOCK_L2_ABOVE), "L2").otherwise(table[action])


def undocumented() -> Column:
    return (F.coalesce(F.col("pattern"), F.lit("none")) == "undocumented") | flag("undocumented_coordinated")


def report_required(sure: Column | None = None, above: float = REPORT_ABOVE) -> Column:
    """Strong suspicion, and large exposure, a shared element or an undocumented pattern."""
    if sure is None:
        sure = (F.col("verdict") == "fraud") | ((F.col("verdict") != "legitimate") & (F.col("p") >= 0.85))
    return sure & ((F.col("exposure") > above) | F.col("shared_element").isNotNull() | undocumented())


def case_required() -> Column:
    return (F.col("p") >= 0.30) | flag("is_dispute") | flag("evidence_requested")


def recurring_dispute() -> Column:
    return flag("is_recurring") & flag("is_dispute") & (F.coalesce(F.col("trigger_type"), F.lit("customer_report")) == "customer_report")


def rule() -> Column:
    """First rule of the ladder that holds."""
    resp, v = F.coalesce(F.col("response"), F.lit("")), F.col("verdict")
    open_question = ((v == "uncertain") & (resp == "") & (F.coalesce(F.col("trigger_type"), F.lit("")) != "customer_report")
                     & ~flag("testing_fires") & ~undocumented())
    return (F.when(recurring_dispute(), "recurring").when(v == "legitimate", "legitimate").when(resp == "denied", "denied")
            .when(resp == "confirmed", "confirmed").when(resp == "no_reply", "no_reply").when(open_question, "ask")
            .when(undocumented(), "undocumented").when(flag("testing_fires"), "testing")
            .when(F.col("shared_element").isNotNull() & (v == "fraud"), "shared")
            .when((v == "uncertain") & (F.col("exposure") > ESCALATE_ABOVE), "exposed")
            .when((F.col("p") < 0.85) & (F.col("n_channels") <= 1), "single_signal")
            .when(v == "fraud", "fraud").when(F.col("p") >= 0.70, "elevated").otherwise("watch"))


def _act(name: str, reason: str, when: Column | None = None) -> Column:
    s = F.struct(F.lit(name).alias("action"), F.lit(reason).alias("reason"))
    return s if when is None else F.when(when, s)


def _ladder() -> dict[str, list[Column]]:
    shared = F.col("shared_element").isNotNull()
    fraud, uncertain = F.col("verdict") == "fraud", F.col("verdict") == "uncertain"
    quiet = F.coalesce(F.col("response"), F.lit("")) == ""
    step_up = (F.col("channel") == "online") & flag("id_15_new")
    step_up = F.coalesce(step_up, F.lit(False))
    much = F.col("exposure") > ESCALATE_ABOVE
    weak = (F.col("p") < 0.85) & (F.col("n_channels") <= 1)
    # a denial with a named pattern counts as strong suspicion
    named = F.coalesce(F.col("pattern"), F.lit("none")) != "none"
    denial_report = F.when(named, report_required(F.lit(True))).otherwise(report_required())
    return {
        "recurring": [_act("CREATE_CASE", "R7: keep a record of the recurring-charge dispute"), _act("VERIFY_WITH_CUSTOMER", "R7: ask whether the dispute stands"),
                      _act("WARN_CUSTOMER", "R7: remind the customer of the recurring charge")],
        "legitimate": [_act("CLOSE_NO_FRAUD", "R3/§6: score below the stop threshold or purchase confirmed")],
        "denied": [_act("BLOCK_CARD", "R2: purchase denied"), _act("CREATE_CASE", "R2: purchase denied"),
                   _act("FILE_REPORT", "R2/§3a: report condition holds", denial_report), _act("MONITOR_CONNECTED_CARDS", "R6: cards share an element", shared)],
        "confirmed": [_act("CLOSE_NO_FRAUD", "R3: purchase confirmed")],
        "no_reply": [_act("MONITOR_CARD", "R4: no answer in time"), _act("DECLINE_TRANSACTION", "R4: hold authorizations until an answer"),
                     _act("ESCALATE_TO_ANALYST", "R4: exposure above 500", much)],
        "ask": [_act("STEP_UP_AUTH", "R1/§5: new device online, step up first", step_up), _act("VERIFY_WITH_CUSTOMER", "R1/§5: open question, ask first", ~step_up),
                _act("ESCALATE_TO_ANALYST", "R8: uncertain with exposure above 500", much), _act("CREATE_CASE", "§3a: evidence asked for")],
        "undocumented": [_act("STEP_UP_AUTH", "R1/§5: step up before filing", uncertain & quiet & step_up),
                         _act("VERIFY_WITH_CUSTOMER", "R1/§5: ask before filing", uncertain & quiet & ~step_up),
                         _act("BLOCK_CARD", "R2/R9: fraud in a coordinated pattern", fraud), _act("CREATE_CASE", "R9: coordinated pattern"),
                         _act("FILE_REPORT", "R9: coordinated pattern across customers"), _act("ESCALATE_TO_ANALYST", "R9: needs an analyst"),
                         _act("MONITOR_CONNECTED_CARDS", "R9/R6: cards share an element", shared)],
        "testing": [_act("DECLINE_TRANSACTION", "R5: testing sequence"), _act("STEP_UP_AUTH", "R5: passcode before more activity"),
                    _act("BLOCK_CARD", "R5: a large purchase has cleared", flag("over_100_cleared") & ~weak),
                    _act("VERIFY_WITH_CUSTOMER", "R1/§6: one signal only", weak)],
        "shared": [_act("CREATE_CASE", "R6: fraud with a shared element"), _act("FILE_REPORT", "R6: shared element across cards"),
                   _act("MONITOR_CONNECTED_CARDS", "R6: cards share an element")],
        "exposed": [_act("ESCALATE_TO_ANALYST", "R8: uncertain with exposure above 500"), _act("CREATE_CASE", "§3a: keep a record")],
        "single_signal": [_act("VERIFY_WITH_CUSTOMER", "R1/§6: one signal only"), _act("CREATE_CASE", "§3a: case condition holds", case_required())],
        "fraud": [_act("BLOCK_CARD", "R2/R6: fraud verdict"), _act("CREATE_CASE", "R2: fraud verdict"), _act("FILE_REPORT", "R2/§3a: report condition holds", report_required()),
                  _act("MONITOR_CONNECTED_CARDS", "R6: cards share an element", shared)],
        "elevated": [_act("MONITOR_CARD", "R1: elevated score"), _act("VERIFY_WITH_CUSTOMER", "R1: ask before any block"), _act("CREATE_CASE", "§3a: case condition holds")],
        "watch": [_act("MONITOR_CARD", "R8: too little signal"), _act("CREATE_CASE", "§3a: case condition holds", case_required())],
    }


def _has(actions: Column, name: str) -> Column:
    return F.exists(actions, lambda a: a["action"] == name)


def _guards(block_all: bool, credentials: Column | None = None) -> Column:
    """Actions a fraud verdict guarantees, in order; each is added unless ``unless`` is in the list."""
    fraud = (F.col("verdict") == "fraud") & (F.col("rule") != "recurring")
    pat = F.coalesce(F.col("pattern"), F.lit("none"))
    rows = [
        ("BLOCK_CARD", "R2: a fraud verdict blocks the card", fraud, "BLOCK_CARD"),
        ("FILE_REPORT", "§3a: fraud verdict and exposure above 1,000", fraud & (F.col("exposure") > REPORT_ABOVE), "FILE_REPORT"),
        ("MONITOR_CONNECTED_CARDS", "R6: linked cards", fraud & (F.col("shared_element").isNotNull() | pat.isin("undocumented", "card_testing")), "MONITOR_CONNECTED_CARDS"),
        ("STEP_UP_AUTH", "R5: card testing", fraud & (pat == "card_testing"), "STEP_UP_AUTH"),
    ]
    if block_all:
        rows.append(("BLOCK_ALL_CARDS", "R10: fraud on two cards of the customer, or compromised credentials", block_all_gate(credentials), "CLOSE_NO_FRAUD"))
    return F.array(*[F.struct(F.lit(n).alias("action"), F.lit(r).alias("reason"), F.coalesce(c, F.lit(False)).alias("on"), F.lit(u).alias("unless")) for n, r, c, u in rows])


def block_all_gate(credentials: Column | None = None) -> Column:
    """Two cards with fraud or compromised credentials, a fraud verdict and a named pattern; a closed case still excludes it."""
    why = flag("two_cards") if credentials is None else flag("two_cards") | F.coalesce(credentials, F.lit(False))
    return (F.col("verdict") == "fraud") & why & (F.coalesce(F.col("pattern"), F.lit("none")) != "none")


def decide(df: DataFrame, block_all: bool = True) -> DataFrame:
    """Add ``rule``, ``actions`` (ordered, with route and reason), ``case_open``, ``report`` and ``escalate``.

    A column ``credentials_compromised`` is optional; without it nothing is known to be compromised.
    """
    credentials = F.col("credentials_compromised") if "credentials_compromised" in df.columns else None
    acts = None
    for name, rows in _ladder().items():
        arr = F.array_compact(F.array(*rows))
        acts = F.when(F.col("rule") == name, arr) if acts is None else acts.when(F.col("rule") == name, arr)
    add = lambda acc, g: F.when(
        g["on"] & ~F.exists(acc, lambda a: a["action"] == g["unless"]),
        F.concat(acc, F.array(F.struct(g["action"].alias("action"), g["reason"].alias("reason"))))).otherwise(acc)
    routed = lambda acc: F.transform(acc, lambda a: F.struct(
        a["action"].alias("action"), route(a["action"], F.col("exposure")).alias("route"), a["reason"].alias("reason")))
    d = df.withColumn("rule", rule())
    # one expression that names the ladder once: a chain of columns would repeat it in every later filter
    d = d.withColumn("actions", F.aggregate(_guards(block_all, credentials), acts, add, routed))
    d = d.withColumn("case_open", F.when(F.col("rule").isin("legitimate", "confirmed", "no_reply", "testing", "single_signal", "watch"), case_required()).otherwise(True))
    return d.withColumn("report", _has(F.col("actions"), "FILE_REPORT")).withColumn("escalate", _has(F.col("actions"), "ESCALATE_TO_ANALYST"))


def reroute(actions: Column, exposure: Column) -> Column:
    """Routes again after the episode's exposure is known."""
    return F.transform(actions, lambda a: F.struct(a["action"].alias("action"), route(a["action"], exposure).alias("route"), a["reason"].alias("reason")))


def names(actions: str) -> Column:
    return F.transform(F.col(actions), lambda a: a["action"])


def action_diff(df: DataFrame, initial: str = "initial", final: str = "final") -> DataFrame:
    """What the answer changed. An initial block stays only with a high score on two channels."""
    keep = (F.col("p_initial") >= 0.85) & (F.col("n_channels") >= 2)
    before = F.when(keep, names(initial)).otherwise(F.array_remove(names(initial), "BLOCK_CARD"))
    after = F.when(F.col("asked") & ~F.array_contains(names(final), "CREATE_CASE"), F.concat(names(final), F.array(F.lit("CREATE_CASE")))).otherwise(names(final))
    d = df.withColumn("initial_names", before).withColumn("final_names", after)
    added, removed = F.array_except("final_names", "initial_names"), F.array_except("initial_names", "final_names")
    part = lambda t, a: F.when(F.size(a) > 0, F.concat(F.lit(t), F.array_join(a, ", ")))
    text = F.concat_ws("; ", part("added: ", added), part("removed: ", removed))
    return d.withColumn("what_changed", F.when((text == "") | ~F.col("asked"), "nothing").otherwise(text))


def replay_reports(cases: DataFrame, threshold: float = REPORT_ABOVE) -> DataFrame:
    """The report rule on closed fraud cases against what was filed: agreement counts.

    Cards listed in ``connected_card_ids`` are the shared element of a case.
    """
    shared = F.when(F.length(F.trim("connected_card_ids")) > 0, F.col("connected_card_ids"))
    rows = (cases.where(F.col("outcome") == "confirmed_fraud").withColumn("shared_element", shared)
            .withColumn("undocumented_coordinated", F.lit(False)).withColumn("exposure", F.col("exposure_usd")))
    want = F.coalesce(report_required(F.lit(True), threshold), F.lit(False))
    got = F.col("report_filed") == "Yes"
    return rows.agg(F.count("*").alias("n"), F.count(F.when(want == got, 1)).alias("agree"), F.count(F.when(want & ~got, 1)).alias("only_rule"),
                    F.count(F.when(~want & got, 1)).alias("only_filed"))


def status(verdict: Column, escalate: Column) -> Column:
    return F.when(verdict == "legitimate", "closed_legitimate").when(escalate, "escalated").when(verdict == "fraud", "closed_fraud").otherwise("open")


def stop_reason(response: Column, concerns: Column, errors: Column) -> Column:
    """Why the case stopped: the answer, up to three audit concerns and up to five errors."""
    first = F.when(response.isNotNull(), F.concat(F.lit("The customer answer ("), response, F.lit(") settled the verdict."))).otherwise(F.lit("No customer answer was needed."))
    part = lambda t, a, n: F.when(F.size(a) > 0, F.concat(F.lit(t), F.array_join(F.slice(a, 1, n), "; ")))
    return F.concat_ws(" ", first, part("Audit concerns: ", concerns, 3), part("Errors: ", errors, 5))
