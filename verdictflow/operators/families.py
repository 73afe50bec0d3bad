"""Families of work decisions as data: a role, questions with a rule each over the fields of a state, wordings by split.

``gold_of`` compiles the questions of the chosen families to a few row expressions over a table of states, so a new family is an entry of the
registry. A rule is a Spark SQL expression. A rule that cannot be told, as a field is missing, gives ``false`` for a yes/no question and no
label for others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FamilyQuestion:
    qid: str
    type: str
    rule: str


@dataclass(frozen=True)
class Family:
    role: str
    name: str
    questions: tuple[FamilyQuestion, ...]
    evaluation_only: bool = False


# Role, family (* for evaluation only), question, type, rule.
RULES = """
everyone | phishing_email | phish | noul | asks_for_credentials
everyone | meeting_attendance | answer | choice | CASE WHEN (required OR relevant) AND conflict THEN 'send_delegate' WHEN required OR relevant THEN 'attend' ELSE 'decline' END
everyone | meeting_attendance | weight | score | 2 * int(required) + int(relevant)
everyone | numeric_reads | within_slo | noul | p95_ms <= slo_ms
everyone | numeric_reads | errors_over | noul | error_pct > threshold_pct
everyone | numeric_reads | covered | noul | coverage_pct >= least_pct
everyone | numeric_reads | disk_over | noul | disk_pct > threshold_pct
everyone | numeric_reads | over_cap | noul | spend > cap
everyone | numeric_reads | past_due | noul | today > due
everyone | work_life_basics * | break | noul | NOT (leads_incident OR other_urgent)
operations | alert_severity | level | score | CASE WHEN error_pct >= 30 AND (users >= 50 OR revenue) THEN 3 WHEN error_pct >= 5 OR users >= 20 THEN 2 WHEN error_pct >= 1 OR users >= 1 THEN 1 ELSE 0 END
operations | alert_severity | page | noul | error_pct >= 5 OR users >= 20
operations | capacity_thresholds | critical | noul | CASE WHEN spend IS NOT NULL THEN spend >= 5 * baseline ELSE disk_pct > threshold_pct END
operations | cert_expiry | urgent | noul | days <= 7
operations | cert_expiry | level | score | CASE WHEN days <= 3 THEN 3 WHEN days <= 14 THEN 2 WHEN days <= 45 THEN 1 WHEN days > 45 THEN 0 END
operations | backup_verification | reliable | noul | tested AND age_hours <= rpo_hours
operations | change_window | go | noul | ci_green AND NOT freeze AND rollback_ready AND NOT friday_evening
operations | incident_comms * | status_page | noul | customer_facing AND outage
developers | code_review_severity | level | score | CASE finding WHEN 'nit' THEN 0 WHEN 'style' THEN 1 WHEN 'bug' THEN 2 WHEN 'security' THEN 3 END
developers | code_review_severity | blocks | noul | finding IN ('bug', 'security')
developers | pr_merge_rules | safe | noul | ci_green AND approvals >= 2
developers | git_undo | undo | choice | CASE WHEN pushed THEN 'revert' WHEN NOT pushed THEN 'reset' END
developers | git_undo | force_push | noul | NOT shared
developers | semver_bump | part | choice | CASE change WHEN 'breaking' THEN 'major' WHEN 'feature' THEN 'minor' WHEN 'bugfix' THEN 'patch' END
developers | dependency_upgrade_risk | risk | score | CASE WHEN major AND cve THEN 3 WHEN major OR cve THEN 2 END
testers | bug_vs_expected | bug | noul | observed <> specified
testers | bug_severity | level | score | CASE WHEN crash AND users >= 50 THEN 3 WHEN crash OR users >= 20 THEN 2 WHEN NOT workaround THEN 1 ELSE 0 END
testers | flaky_vs_regression | regression | noul | fails_every_run AND reproduces
testers | release_signoff | ready | noul | open_blockers = 0 AND NOT coverage_gap
testers | environment_choice | staging_first | noul | risky
testers | reproducibility * | actionable | noul | reproduces
tech_leads | build_vs_buy | buy | noul | mature_vendor AND NOT core
tech_leads | tech_debt_vs_deadline | ship | noul | days <= 3 AND NOT debt_blocks
tech_leads | escalate_or_handle | escalate | noul | cross_team OR legal
tech_leads | escalate_or_handle | fair | noul | on_call_hours <= 40
tech_leads | architecture_risk | risky | noul | single_point OR NOT backups
managers | oneonone_vs_escalation | now | noul | other_urgent
managers | leave_vs_release | block | noul | sole_owner AND days <= 5
managers | meeting_vs_async | meeting | noul | debate
managers | status_reporting | status | choice | CASE WHEN done_pct - elapsed_pct >= 15 THEN 'on_track' WHEN done_pct - elapsed_pct < -20 THEN 'off_track' WHEN done_pct IS NOT NULL THEN 'at_risk' END
managers | budget_status | over | noul | spend > cap
managers | stakeholder_comms | formal | noul | executive
managers | feedback_timeliness * | timely | noul | days <= 7
agent | same_entity | same_email | noul | email = other_email
agent | claim_check | holds | noul | asked = recorded
agent | judge_turn | accept | noul | did_what_asked AND evidence
agent | judge_turn | stopped_short | noul | NOT (did_what_asked AND evidence)
agent | flaky_vs_real_ci | real | noul | fails_every_run AND reproduces AND NOT timing_dependent
"""
FAMILIES: dict[str, Family] = {}
#: Rules in one expression. The JVM compiles no method of more than 8,000 bytes of code; one with all rules would be interpreted.
RULES_AT_ONCE = 12


def register(family: Family) -> None:
    if family.name in FAMILIES:
        raise ValueError(f"there is a family {family.name}")
    FAMILIES[family.name] = family


def _load() -> None:
    asked: dict[tuple[str, str], list[FamilyQuestion]] = {}
    for line in RULES.strip().splitlines():
        role, name, qid, kind, rule = [c.strip() for c in line.split(" | ")]
        asked.setdefault((role, name), []).append(FamilyQuestion(qid, kind, rule))
    for (role, name), questions in asked.items():
        register(Family(role, name.removesuffix("*").strip(), tuple(questions), name.endswith("*")))


_load()

# Wordings of a question. The last is for gates only and the one before for evaluation too, so neither was seen in training.
WORDINGS = ("{q}", "Given these facts: {q}", "Decide from the state alone. {q}", "Going by what is stated, {q}")


def wordings_of(split: str, wordings: Sequence[str] = WORDINGS) -> Sequence[str]:
    return {"gate": wordings[-1:], "eval": wordings[:-1]}.get(split, wordings[:-2])


def worded(question: Column, split: Column, key: Column, wordings: Sequence[str] = WORDINGS) -> Column:
    """The question in one of the wordings that its split may use, by the hash of a key."""

    def pick(some: Sequence[str]) -> Column:
        at = F.pmod(F.xxhash64(key), F.lit(len(some))).cast("int")
        return F.replace(F.get(F.array(*map(F.lit, some)), at), F.lit("{q}"), question)

    return F.when(split == "gate", pick(wordings_of("gate", wordings))).when(split == "eval", pick(wordings_of("eval", wordings))).otherwise(pick(wordings_of("train", wordings)))


def label_of(question: FamilyQuestion) -> Column:
    value = F.expr(question.rule)
    return F.coalesce(value, F.lit(False)).cast("string") if question.type == "noul" else value.cast("string")


def asked_of(states: DataFrame, names: Sequence[str] | None = None) -> list[tuple[Family, FamilyQuestion]]:
    """The questions of the families (all whose fields ``states`` has, if not named)."""
    has = {c.lower() for c in states.columns}
    chosen = [FAMILIES[n] for n in names] if names is not None else [f for f in FAMILIES.values() if fields_of(states, f) <= has]
    return [(f, q) for f in chosen for q in f.questions]


def labels_of(states: DataFrame, keep: Sequence[str], asked: Sequence[tuple[Family, FamilyQuestion]], split: Column | None = None) -> DataFrame:
    """The columns to keep with ``asked``, the place of a question in the list, and its label, for each question that has one: rows are many, so
    they carry a number instead of names. ``states`` is gone through once for each ``RULES_AT_ONCE`` questions."""
    train = F.lit(False) if split is None else ~split.isin("gate", "eval")
    label = lambda f, q: F.when(~train, label_of(q)) if f.evaluation_only else label_of(q)
    parts = []
    for k in range(0, len(asked), RULES_AT_ONCE):
        labels = F.array(*[label(f, q) for f, q in asked[k : k + RULES_AT_ONCE]])
        parts.append(states.select(*keep, F.posexplode(labels).alias("asked", "label")).where("label is not null").withColumn("asked", F.col("asked") + k))
    return reduce(DataFrame.unionAll, parts)


def named(labels: DataFrame, asked: Sequence[tuple[Family, FamilyQuestion]]) -> DataFrame:
    """``labels`` with role, family, qid and type of the question in the place of its number."""
    q = F.get(F.array(*[F.struct(*map(F.lit, (f.role, f.name, q.qid, q.type))) for f, q in asked]), F.col("asked"))
    names = [q[f"col{i}"].alias(n) for i, n in enumerate(("role", "family", "qid", "type"), 1)]
    return labels.select(*[x for c in labels.columns for x in (names if c == "asked" else [F.col(f"`{c}`")])])


def gold_of(states: DataFrame, keep: Sequence[str], names: Sequence[str] | None = None, split: Column | None = None) -> DataFrame:
    """The columns to keep with role, family, qid, type and label for each question of the families (all whose fields ``states`` has, if not
    named). Where ``split`` is given, families for evaluation are not asked in training rows."""
    asked = asked_of(states, names)
    return named(labels_of(states, keep, asked, split), asked)


def gold_counts(states: DataFrame, key: str, names: Sequence[str] | None = None, split: Column | None = None) -> DataFrame:
    """role, family, qid, type, label with n, the number of states with that answer, and sum (``keys``) and greatest (``last``) of their keys."""
    asked = asked_of(states, names)
    sums = (F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"), F.max(key).alias("last"))
    return named(labels_of(states, [key], asked, split).groupBy("asked", "label").agg(*sums), asked)


def fields_of(states: DataFrame, family: Family) -> set[str]:
    """Names in the rules of a family that are neither words of SQL nor quoted."""
    import re

    words = {w.lower() for q in family.questions for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", q.rule))}
    return words - {"case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "in", "int"}
