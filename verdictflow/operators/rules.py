"""Rule catalogs and the deterministic labellers over them: numeric thresholds, dates, opening hours, log triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Numeric rules as rule, field, comparison, training threshold, gate threshold.
NUMERIC_RULES = """
driving_licence age >= 18 17
voting age >= 18 21
car_rental age >= 21 25
senior_discount age >= 60 65
child_ticket age < 5 3
movie_rating age >= 18 16
retirement age >= 60 58
fever temperature_c >= 38.0 37.5
battery_low battery_percent < 20 15
storage_full storage_used_percent >= 90 85
free_shipping cart_total_rs >= 500 499
discount_min cart_total_rs >= 999 1499
baggage bag_weight_kg <= 23 20
cabin_bag cabin_bag_kg <= 7 10
speeding speed_kmh > 50 60
pass_mark score >= 35 40
attendance attendance_percent >= 75 80
password_length password_length >= 8 12
cpu_alert cpu_percent > 90 85
error_rate error_rate_percent >= 5 2
latency_slo p95_latency_ms < 300 250
coverage coverage_percent >= 80 70
approvals approvals >= 2 1
stock_out stock_units == 0 0
reorder stock_units < 20 50
bmi_over bmi >= 25.0 30.0
budget spent_rs > 20000 15000
min_balance balance_rs < 1000 5000
atm_limit withdrawn_today_rs <= 25000 20000
water_boil water_temperature_c >= 100 100
freezing temperature_c <= 0 0
rain_umbrella rain_chance_percent >= 60 50
aqi aqi > 150 100
elevator people <= 8 6
fuel_low fuel_percent < 15 10
tyre_pressure tyre_psi < 30 32
hotel_checkin arrival_hour >= 14 12
loan_age age >= 21 18
credit_score credit_score >= 700 750
overtime hours_worked > 48 40
leave_balance days_requested <= 12 8
parking parked_minutes <= 30 60
screen_time screen_minutes > 120 90
steps_goal steps >= 10000 8000
blood_sugar fasting_sugar_mg_dl >= 126 100
gst_invoice invoice_rs > 50000 20000
delivery_radius distance_km <= 10 5
"""

# Log templates as family, template, team, kind of failure, base severity, transient, noise, gated by rate (- unknown).
LOG_TEMPLATES = """
db/postgres | 23505 | backend | data | 1 | False | False | False
db/postgres | 40P01 | backend | code_bug | 1 | True | False | True
db/postgres | 40001 | backend | code_bug | 1 | True | False | True
db/postgres | 53100 | database | capacity | 3 | False | False | False
db/postgres | 53200 | database | capacity | 2 | False | False | False
db/postgres | 53300 | database | capacity | 2 | False | False | False
db/postgres | 57P01 | database | - | 1 | True | False | True
db/postgres | 57014 | backend | capacity | 1 | False | False | True
db/postgres | 42P01 | backend | code_bug | 2 | False | False | False
db/postgres | 42703 | backend | code_bug | 2 | False | False | False
db/postgres | 28P01 | infra | auth | 1 | False | False | True
db/postgres | XX000 | database | - | 2 | False | False | False
db/postgres | PANIC | database | capacity | 3 | False | False | False
db/postgres | checkpoint | database | - | 0 | - | True | False
db/postgres | autovacuum | database | - | 0 | - | True | False
db/mysql | 1205 | backend | code_bug | 1 | True | False | True
db/mysql | 1213 | backend | code_bug | 1 | True | False | True
db/mysql | 1040 | database | capacity | 2 | False | False | False
db/mysql | 2013 | database | network | 1 | True | False | True
db/mysql | diskfull | database | capacity | 3 | False | False | False
db/mysql | aborted | database | - | 0 | - | True | False
db/mysql | page_cleaner | database | - | 0 | - | True | False
db/slow_query | mysql_slow | database | capacity | 1 | False | False | True
db/slow_query | pg_duration | database | capacity | 1 | False | False | True
app/java | npe | backend | code_bug | 2 | False | False | False
app/java | oom | backend | capacity | 3 | False | False | False
app/java | hikari | backend | capacity | 2 | True | False | True
app/java | started | backend | - | 0 | - | True | False
app/python | keyerror | backend | code_bug | 2 | False | False | False
app/python | pg_refused | database | - | 3 | False | False | False
app/python | redis_refused | infra | network | 2 | False | False | False
app/python | timeout | backend | network | 1 | True | False | True
app/python | uvicorn_ok | backend | - | 0 | - | True | False
app/node | unhandled | backend | code_bug | 2 | False | False | False
app/node | econnrefused | infra | network | 2 | False | False | False
app/node | etimedout | infra | network | 1 | True | False | True
app/node | heap_oom | backend | capacity | 3 | False | False | False
app/go_panic | nil_deref | backend | code_bug | 3 | False | False | False
app/go_panic | index | backend | code_bug | 3 | False | False | False
app/go_panic | map_writes | backend | code_bug | 3 | False | False | False
app/go_panic | deadline | backend | network | 1 | True | False | True
app/nginx | 504 | backend | - | 2 | True | False | True
app/nginx | 502 | backend | - | 3 | False | False | False
app/nginx | 499 | backend | capacity | 1 | False | False | True
app/nginx | 200 | backend | - | 0 | - | True | False
app/json_logs | 500 | backend | code_bug | 2 | False | False | False
app/json_logs | upstream_timeout | backend | network | 1 | True | False | True
app/json_logs | retrying | backend | network | 1 | True | False | True
app/json_logs | ok | backend | - | 0 | - | True | False
fe/console | typeerror | frontend | code_bug | 2 | False | False | False
fe/console | chunkload | frontend | config | 2 | False | False | False
fe/console | cors | frontend | config | 2 | False | False | False
fe/console | csp | frontend | config | 1 | False | False | False
fe/console | promise_fetch | frontend | network | 1 | True | False | True
fe/console | hydration | frontend | code_bug | 1 | False | False | False
fe/console | react_key | frontend | - | 0 | - | True | False
fe/console | devtools | frontend | - | 0 | - | True | False
fe/network | refused | infra | network | 3 | False | False | False
fe/network | 401 | backend | auth | 1 | False | False | True
fe/network | 403 | backend | auth | 1 | False | False | True
fe/network | 404 | frontend | code_bug | 1 | False | False | False
fe/network | 500 | backend | code_bug | 2 | False | False | False
fe/network | 503 | infra | capacity | 2 | True | False | True
fe/sentry | TypeError: Cannot read prope... | frontend | code_bug | 2 | False | False | False
fe/sentry | ChunkLoadError: Loading chun... | frontend | config | 2 | False | False | False
fe/sentry | TypeError: Failed to fetch... | frontend | network | 1 | True | False | True
fe/sentry | Error: Hydration failed beca... | frontend | code_bug | 1 | False | False | False
"""

# Date rules as rule, field and whether it holds after the date (else up to it); opening hours, the close excluded.
DATE_RULES = """
parcel_late promised_date after
bill_overdue due_date after
warranty warranty_end_date until
passport_valid expiry_date until
deadline deadline after
subscription renewal_date until
"""
OPENING_HOURS = """
store_open 10 21
bank_hours 9 16
quiet_hours 22 24
support_hours 9 18
"""
COMPARISONS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


def _rows(text: str, sep: str | None = None) -> list[list[str]]:
    return [[c.strip() for c in line.split(sep)] for line in text.strip().splitlines()]


def numeric_rules(spark: SparkSession) -> DataFrame:
    """rule, field, op, train_threshold, gate_threshold: 47 rows, a fixed size."""
    return spark.createDataFrame(
        [(r, f, op, float(a), float(b)) for r, f, op, a, b in _rows(NUMERIC_RULES)], "rule string, field string, op string, train_threshold double, gate_threshold double"
    )


def log_templates(spark: SparkSession) -> DataFrame:
    """family, template, team, failure, base, transient, noise, rate_gated: 67 rows, a fixed size."""
    flag = {"True": True, "False": False, "-": None}
    rows = [(f, t, None if team == "-" else team, None if kind == "-" else kind, int(base), flag[tr], bool(flag[no]), bool(flag[rg])) for f, t, team, kind, base, tr, no, rg in _rows(LOG_TEMPLATES, "|")]
    return spark.createDataFrame(rows, "family string, template string, team string, failure string, base int, transient boolean, noise boolean, rate_gated boolean")


def compare(value: Column, op: Column, threshold: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, f in COMPARISONS.items():
        out = F.when(op == name, f(value, threshold)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def apply_numeric_rules(values: DataFrame, rules: DataFrame, value: str, threshold: str = "train_threshold") -> DataFrame:
    """Every value under every rule: the catalog has a fixed size and is broadcast."""
    return values.join(F.broadcast(rules)).withColumn("holds", compare(F.col(value), F.col("op"), F.col(threshold)))


def date_rule(today: Column, day: Column, kind: str) -> Column:
    """``after``: holds once the day has passed; ``until``: holds up to and on the day."""
    return F.coalesce(today > day if kind == "after" else today <= day, F.lit(False))


def open_at(minute: Column, opens: int, closes: int) -> Column:
    return F.coalesce((minute >= opens * 60) & (minute < closes * 60), F.lit(False))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open intervals that share a moment."""
    return (s1 < e2) & (s2 < e1)


def overlapping_pairs(intervals: DataFrame, key: str, start: str, end: str, ident: str, slot: int) -> DataFrame:
    """Pairs of overlapping intervals of one key, by slots of ``slot`` seconds: an equi-join on (key, slot), each pair once.

    A pair is made in the slot in which the later of its starts lies, so long intervals do not repeat it."""
    parts = intervals.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s < e")
    slots = parts.select("*", F.explode(F.sequence(F.floor(F.col("s") / slot), F.floor((F.col("e") - 1) / slot))).alias("slot"))
    a, b = slots.alias("a"), slots.alias("b")
    hit = (F.col("a.k") == F.col("b.k")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.i") < F.col("b.i")) & overlap(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    once = F.floor(F.greatest("a.s", "b.s") / slot) == F.col("a.slot")
    return a.join(b, hit & once).select(F.col("a.k").alias(key), F.col("a.i").alias("first_id"), F.col("b.i").alias("second_id"))


#: The template whose failed logins are the security team's if they come from outside and exceed the threshold, and the
#: addresses that count as outside.
LOGIN_TEMPLATE = "28P01"
EXTERNAL_IPS = ("203.0.113.7", "198.51.100.23", "192.0.2.44", "203.0.113.150", "198.51.100.91")


def triage(facts: DataFrame) -> DataFrame:
    """Log triage: noise, real, severity, page, deploy, action and team from template attributes and facts.

    Facts: base, noise, rate_gated, transient, failure, team, environment, service_criticality, alert_threshold_per_5m, errors_last_5m,
    users_affected, matches_known_benign_pattern, retry_succeeded, started_after_latest_deploy; and, where logins are triaged, template and
    source_ip. Nulls among the flags count as false."""
    c = F.col
    facts = facts.withColumns({n: F.lit(None).cast("string") for n in ("template", "source_ip", "team") if n not in facts.columns})
    below = c("errors_last_5m") < c("alert_threshold_per_5m")
    is_noise = F.coalesce(c("noise"), F.lit(False)) | c("matches_known_benign_pattern") | (c("rate_gated") & below) | (F.coalesce(c("transient"), F.lit(False)) & c("retry_succeeded") & below)
    prod = c("environment") == "production"
    out = facts.withColumn("is_noise", is_noise).withColumn("is_real", ~c("is_noise"))
    raised = F.least(F.lit(3), c("base") + F.when(~below | (c("users_affected") >= 100), 1).otherwise(0))
    out = out.withColumn("severity", F.when(c("is_noise"), 0).when(prod, raised).otherwise(F.least(raised, F.lit(1))))
    out = out.withColumn("page", prod & c("is_real") & ((c("severity") == 3) | ((c("severity") == 2) & (c("service_criticality") == "critical"))))
    out = out.withColumn("deploy", c("is_real") & c("started_after_latest_deploy") & F.coalesce(c("failure").isin("code_bug", "config"), F.lit(False)))
    action = F.when(~c("is_real"), "ignore").when(prod & c("deploy") & (c("severity") >= 2), "roll_back").when(c("page"), "page").otherwise("ticket")
    outside = (c("template") == LOGIN_TEMPLATE) & c("source_ip").isin(*EXTERNAL_IPS) & ~below
    return out.withColumn("action", action).withColumn("team", F.when(F.coalesce(outside, F.lit(False)), "security").otherwise(c("team")))


def triage_gold(triaged: DataFrame) -> DataFrame:
    """``triaged`` with ``gold``, a map from question to label: what its template lets be asked. Noise has no team; a template without a
    failure kind has no kind and deploy question, one that is not known to be transient or not has no retry question."""
    c = F.col
    text = lambda x: x.cast("string")
    always = F.create_map(*[v for k, x in (("page", c("page")), ("real", c("is_real")), ("noise", c("is_noise")), ("action", c("action")), ("sev", c("severity"))) for v in (F.lit(k), text(x))])
    none = F.create_map().cast("map<string,string>")
    loud = ~F.coalesce(c("noise"), F.lit(False))
    team = F.when(loud & c("team").isNotNull(), F.create_map(F.lit("team"), c("team"))).otherwise(none)
    kind = F.when(loud & c("failure").isNotNull(), F.create_map(F.lit("kind"), c("failure"), F.lit("deploy"), text(c("deploy")))).otherwise(none)
    retry = F.when(loud & c("transient").isNotNull(), F.create_map(F.lit("retry"), text(c("transient")))).otherwise(none)
    return triaged.withColumn("gold", F.map_concat(always, team, kind, retry))
