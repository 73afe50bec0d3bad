"""Gold labels of the families of work decisions over states made from order lines; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import families
from verdictflow.plans.catalog import query, read

# A state for each order line; k tells the fields, as SQL that both engines read alike.
_FIELDS = {
    "k": "l_orderkey * 7 + l_linenumber", "error_pct": "k % 41", "users": "(k % 13) * (k % 7)", "spend": "CASE WHEN k % 6 > 0 THEN k % 90 END", "baseline": "k % 11 + 1", "cap": "k % 60", "threshold_pct": "k % 19", "disk_pct": "k % 101",
    "p95_ms": "k % 500", "slo_ms": "k % 400", "coverage_pct": "k % 97", "least_pct": "k % 83", "today": "k % 29", "due": "k % 31", "days": "CASE WHEN k % 17 > 0 THEN k % 53 END", "age_hours": "k % 30", "rpo_hours": "k % 24",
    "done_pct": "k % 89", "elapsed_pct": "k % 71", "approvals": "k % 4", "open_blockers": "k % 3", "on_call_hours": "k % 61", "finding": "CASE k % 5 WHEN 0 THEN 'nit' WHEN 1 THEN 'style' WHEN 2 THEN 'bug' WHEN 3 THEN 'security' END",
    "change": "CASE k % 4 WHEN 0 THEN 'breaking' WHEN 1 THEN 'feature' WHEN 2 THEN 'bugfix' END", "observed": "l_returnflag", "specified": "l_linestatus", "email": "l_returnflag", "other_email": "CASE WHEN k % 3 > 0 THEN 'N' END", "asked": "k % 5", "recorded": "k % 3",
}
# Each flag has a period of its own; every ninth value is missing.
_FLAGS = "asks_for_credentials required relevant conflict leads_incident other_urgent revenue tested ci_green freeze rollback_ready friday_evening customer_facing outage pushed shared major cve crash workaround fails_every_run reproduces coverage_gap risky mature_vendor core debt_blocks cross_team legal single_point backups sole_owner debate executive did_what_asked evidence timing_dependent".split()
_FIELDS |= {name: f"CASE WHEN (k + {i}) % 9 > 0 THEN (k + {i}) % {i % 5 + 2} = 0 END" for i, name in enumerate(_FLAGS)}
_STATES = "WITH b AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem), s AS (SELECT " + ", ".join(("k" if n == "k" else e) + f" AS {n}" for n, e in _FIELDS.items()) + " FROM b) "
_N = "coalesce({}, false)"
_GOLD = {
    ("everyone", "phishing_email", "phish"): _N.format("asks_for_credentials"),
    ("everyone", "meeting_attendance", "answer"): "if(coalesce(required, false) OR coalesce(relevant, false), if(coalesce(conflict, false), 'send_delegate', 'attend'), 'decline')",
    ("everyone", "meeting_attendance", "weight"): "required::INT * 2 + relevant::INT",
    ("everyone", "numeric_reads", "within_slo"): _N.format("slo_ms >= p95_ms"),
    ("everyone", "numeric_reads", "errors_over"): _N.format("threshold_pct < error_pct"),
    ("everyone", "numeric_reads", "covered"): _N.format("least_pct <= coverage_pct"),
    ("everyone", "numeric_reads", "disk_over"): _N.format("threshold_pct < disk_pct"),
    ("everyone", "numeric_reads", "over_cap"): _N.format("cap < spend"),
    ("everyone", "numeric_reads", "past_due"): _N.format("due < today"),
    ("everyone", "work_life_basics", "break"): _N.format("NOT leads_incident AND NOT other_urgent"),
    ("operations", "alert_severity", "level"): "if(error_pct >= 30 AND (users >= 50 OR coalesce(revenue, false)), 3, if(error_pct >= 5 OR users >= 20, 2, if(error_pct >= 1 OR users >= 1, 1, 0)))",
    ("operations", "alert_severity", "page"): "NOT (error_pct < 5 AND users < 20)",
    ("operations", "capacity_thresholds", "critical"): "if(spend IS NULL, disk_pct > threshold_pct, spend >= baseline * 5)",
    ("operations", "cert_expiry", "urgent"): "coalesce(days, 8) <= 7",
    ("operations", "cert_expiry", "level"): "CAST(days <= 3 AS INT) + CAST(days <= 14 AS INT) + CAST(days <= 45 AS INT)",
    ("operations", "backup_verification", "reliable"): _N.format("tested AND NOT age_hours > rpo_hours"),
    ("operations", "change_window", "go"): _N.format('ci_green AND rollback_ready AND NOT (s."freeze" OR friday_evening)'),
    ("operations", "incident_comms", "status_page"): _N.format("outage AND customer_facing"),
    ("developers", "code_review_severity", "level"): "list_position(['nit', 'style', 'bug', 'security'], finding) - 1",
    ("developers", "code_review_severity", "blocks"): "coalesce(finding, '') = 'bug' OR coalesce(finding, '') = 'security'",
    ("developers", "pr_merge_rules", "safe"): _N.format("approvals > 1 AND ci_green"),
    ("developers", "git_undo", "undo"): "if(pushed IS NULL, NULL, if(pushed, 'revert', 'reset'))",
    ("developers", "git_undo", "force_push"): "NOT coalesce(shared, true)",
    ("developers", "semver_bump", "part"): "['major', 'minor', 'patch'][list_position(['breaking', 'feature', 'bugfix'], change)]",
    ("developers", "dependency_upgrade_risk", "risk"): "if(coalesce(major, false) AND coalesce(cve, false), 3, if(coalesce(major, false) OR coalesce(cve, false), 2, NULL))",
    ("testers", "bug_vs_expected", "bug"): "observed IS DISTINCT FROM specified",
    ("testers", "bug_severity", "level"): "if(coalesce(crash, false) AND users >= 50, 3, if(coalesce(crash, false) OR users >= 20, 2, if(coalesce(workaround, true), 0, 1)))",
    ("testers", "flaky_vs_regression", "regression"): _N.format("reproduces AND fails_every_run"),
    ("testers", "release_signoff", "ready"): "open_blockers < 1 AND NOT coalesce(coverage_gap, true)",
    ("testers", "environment_choice", "staging_first"): _N.format("risky"),
    ("testers", "reproducibility", "actionable"): _N.format("reproduces"),
    ("tech_leads", "build_vs_buy", "buy"): "coalesce(mature_vendor, false) AND NOT coalesce(core, true)",
    ("tech_leads", "tech_debt_vs_deadline", "ship"): "coalesce(days < 4, false) AND NOT coalesce(debt_blocks, true)",
    ("tech_leads", "escalate_or_handle", "escalate"): "coalesce(cross_team, false) OR coalesce(legal, false)",
    ("tech_leads", "escalate_or_handle", "fair"): "NOT on_call_hours > 40",
    ("tech_leads", "architecture_risk", "risky"): "coalesce(single_point, false) OR NOT coalesce(backups, true)",
    ("managers", "oneonone_vs_escalation", "now"): _N.format("other_urgent"),
    ("managers", "leave_vs_release", "block"): _N.format("days < 6 AND sole_owner"),
    ("managers", "meeting_vs_async", "meeting"): _N.format("debate"),
    ("managers", "status_reporting", "status"): "if(done_pct >= elapsed_pct + 15, 'on_track', if(done_pct + 20 < elapsed_pct, 'off_track', 'at_risk'))",
    ("managers", "budget_status", "over"): _N.format("cap < spend"),
    ("managers", "stakeholder_comms", "formal"): _N.format("executive"),
    ("managers", "feedback_timeliness", "timely"): _N.format("days < 8"),
    ("agent", "same_entity", "same_email"): _N.format("other_email = email"),
    ("agent", "claim_check", "holds"): "recorded = asked",
    ("agent", "judge_turn", "accept"): _N.format("evidence AND did_what_asked"),
    ("agent", "judge_turn", "stopped_short"): _N.format("NOT evidence OR NOT did_what_asked"),
    ("agent", "flaky_vs_real_ci", "real"): _N.format("NOT timing_dependent AND reproduces AND fails_every_run"),
}
_ONE = ", ".join(f"{{'role': '{r}', 'family': '{f}', 'qid': '{q}', 'label': CAST({x} AS VARCHAR)}}" for (r, f, q), x in _GOLD.items())


@query(
    _STATES + f"SELECT q.role AS role, q.family AS family, q.qid AS qid, q.label AS label, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys, max(k) AS last FROM (SELECT k, unnest([{_ONE}]) AS q FROM s) WHERE q.label IS NOT NULL GROUP BY ALL"
)
def family_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often all families' questions have each answer over a state of each order line, with sums of the lines' keys."""
    lines = read(spark, sf_dir, "lineitem").withColumn("k", F.expr(_FIELDS["k"]))
    states = lines.select(*[F.expr("k" if n == "k" else e).alias(n) for n, e in _FIELDS.items()])
    return families.gold_counts(states, "k").drop("type")
