"""Business domains: a banded measure and two rules each, as conditions over a state's fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions.conditions import Atom, Condition, tier

# Domain | entity | field and thresholds of the band | its labels | rule | rule. Domains marked * are for evaluation only.
DOMAINS = """
ecommerce_orders | order | order_total_usd: [25, 50, 150] | standard_shipping, reduced_fee_shipping, free_shipping, priority_free_shipping | order_total_usd gte 50 | payment_status eq paid
retail_pricing | product | discount_pct: [10, 25, 50] | no_discount, minor_discount, major_discount, clearance | discount_pct gte 25 | is_clearance is_true
banking_accounts | account | balance_usd: [0, 100, 10000] | overdrawn, low_balance, healthy, high_value | balance_usd lt 0 | kyc_verified is_true
banking_loans | loan application | credit_score: [580, 670, 740] | poor, fair, good, excellent | credit_score gte 670 | has_collateral is_true
payments_fraud | transaction | fraud_risk_score: [30, 60, 85] | low_risk, medium_risk, high_risk, critical_risk | fraud_risk_score gte 60 | is_first_time_merchant is_true
insurance_claims | claim | claim_amount_usd: [1000, 10000, 50000] | minor_claim, standard_claim, major_claim, catastrophic_claim | claim_amount_usd gt 50000 | claim_status eq approved
insurance_policies | policy | premium_usd: [500, 1500, 3000] | basic_tier, standard_tier, premium_tier, elite_tier | premium_usd gte 3000 | renewal_date within_days 30
healthcare_appointments | appointment | wait_time_minutes: [15, 30, 60] | on_time, minor_delay, significant_delay, severe_delay | wait_time_minutes gt 60 | insurance_verified is_true
healthcare_eligibility | patient | age_years: [18, 26, 65] | minor, young_adult, adult, senior | age_years gte 18 | insurance_id is_not_null
pharmacy_stock | medication | stock_units: [0, 10, 200] | out_of_stock, low_stock, adequate_stock, overstocked | stock_units gt 0 | expiry_date before
hr_employees | employee | tenure_months: [3, 12, 60] | probation, junior, established, veteran | tenure_months lt 3 | is_manager is_true
hr_leave | leave request | days_requested: [3, 10, 20] | short_leave, medium_leave, long_leave, extended_leave | days_requested gt 10 | leave_type eq sick
hr_payroll | paycheck | gross_pay_usd: [2000, 5000, 10000] | entry_band, mid_band, senior_band, executive_band | gross_pay_usd gte 10000 | overtime_eligible is_true
recruiting | candidate | years_experience: [2, 5, 10] | entry_level, mid_level, senior_level, principal_level | years_experience gte 5 | stage eq hired
education_students | student | gpa: [2.0, 3.0, 3.5] | at_risk, satisfactory, good_standing, honors | gpa lt 2.0 | financial_aid_id is_null
education_enrollment | enrollment | attendance_pct: [60, 80, 95] | chronic_absence, at_risk_attendance, good_attendance, excellent_attendance | attendance_pct lt 60 | tuition_paid is_true
travel_flights | flight booking | days_until_departure: [1, 7, 30] | imminent, departing_soon, upcoming, far_out | days_until_departure lte 1 | checkin_deadline within_days 1
hotels | reservation | nights_booked: [3, 7, 14] | short_stay, standard_stay, extended_stay, long_term_stay | nights_booked gte 14 | cancellation_deadline before
logistics_shipping | shipment | transit_days: [2, 5, 10] | express, standard, economy, delayed | transit_days gt 10 | handling_flags contains fragile
warehousing * | pallet | capacity_used_pct: [70, 90, 100] | low_utilization, normal_utilization, near_capacity, overcapacity | capacity_used_pct gt 100 | hazmat_flag is_true
manufacturing_qa | production batch | defect_rate_pct: [0.5, 2.0, 5.0] | excellent, acceptable, marginal, reject | defect_rate_pct gt 5.0 | passed_inspection is_true
energy_utilities | utility bill | usage_kwh: [300, 800, 2000] | low_usage, typical_usage, high_usage, excessive_usage | usage_kwh gt 2000 | autopay_enabled is_true
telecom_plans * | subscriber | data_used_gb: [5, 20, 50] | light_user, moderate_user, heavy_user, over_limit | data_used_gb gt 50 | contract_end_date within_days 30
real_estate_listings | listing | days_on_market: [14, 45, 90] | fresh_listing, active_listing, stale_listing, long_stale_listing | days_on_market gt 90 | price_reduced is_true
real_estate_leases | lease | days_until_expiry: [30, 90, 180] | expiring_now, expiring_soon, mid_term, long_term | days_until_expiry lte 30 | security_deposit_ref is_not_null
saas_subscriptions | subscription | usage_pct_of_limit: [70, 90, 100] | low_usage, normal_usage, near_limit, over_limit | usage_pct_of_limit gt 100 | plan_status eq past_due
saas_billing | invoice | days_overdue: [0, 7, 30] | current, recently_due, overdue, severely_overdue | days_overdue gt 30 | payment_method_on_file is_true
identity_access | user account | failed_login_attempts: [3, 5, 10] | normal, elevated, high_risk, locked_out | failed_login_attempts gte 10 | mfa_enabled is_true
devops_sre | host | cpu_pct: [70, 90, 95] | normal, elevated, warning, critical | cpu_pct gt 90 | alert_acknowledged is_true
cicd_builds | build | test_coverage_pct: [60, 80, 90] | poor_coverage, acceptable_coverage, good_coverage, excellent_coverage | test_coverage_pct lt 60 | status eq failed
git_prs | pull request | lines_changed: [50, 300, 1000] | trivial, small, large, massive | lines_changed gt 1000 | ci_passing is_true
databases | database instance | replication_lag_seconds: [5, 30, 120] | healthy, minor_lag, significant_lag, critical_lag | replication_lag_seconds gt 120 | backups_enabled is_true
networking | connection | packet_loss_pct: [1.0, 5.0, 20.0] | healthy, degraded, poor, down | packet_loss_pct gte 20.0 | vpn_active is_true
iot_sensors | sensor | battery_pct: [10, 25, 50] | critical_battery, low_battery, ok_battery, full_battery | battery_pct lt 10 | last_calibration_date is_null
weather_alerts | weather station | wind_speed_kmh: [40, 65, 120] | calm, advisory, warning, extreme | wind_speed_kmh gte 120 | flood_risk is_true
agriculture * | field record | soil_moisture_pct: [20, 40, 70] | drought, dry, adequate, saturated | soil_moisture_pct lt 20 | pest_detected is_true
restaurants_delivery | order ticket | prep_time_minutes: [10, 20, 40] | fast, normal, slow, very_slow | prep_time_minutes gt 40 | allergens contains peanut
ride_hailing | trip | eta_minutes: [3, 8, 15] | imminent_pickup, short_wait, long_wait, very_long_wait | eta_minutes gt 15 | surge_pricing_active is_true
gaming | player account | player_level: [10, 30, 60] | novice, intermediate, advanced, elite | player_level gte 60 | is_banned is_true
social_moderation * | post | report_count: [1, 5, 15] | no_reports, low_reports, moderate_reports, high_reports | report_count gte 15 | content_text contains banned_term
marketing_campaigns | campaign | ctr_pct: [0.5, 2.0, 5.0] | poor_ctr, average_ctr, good_ctr, excellent_ctr | ctr_pct lt 0.5 | end_date before
crm_leads | lead | lead_score: [25, 50, 80] | cold_lead, warm_lead, hot_lead, sales_ready_lead | lead_score gte 80 | assigned_rep is_null
legal_contracts * | contract | days_until_renewal: [30, 90, 180] | imminent_renewal, upcoming_renewal, mid_term, long_term | days_until_renewal lte 30 | auto_renew_clause is_true
"""
NUMERIC_OPS = ("lt", "lte", "gt", "gte", "eq", "ne")


@dataclass(frozen=True)
class Domain:
    name: str
    entity: str
    field: str
    thresholds: tuple[float, ...]
    labels: tuple[str, ...]
    first: Condition
    second: Condition
    evaluation_only: bool

    def band(self) -> Column:
        return tier(F.col(self.field), self.thresholds, self.labels)

    def branch(self, labels: tuple[str, str, str] = ("first", "second", "neither")) -> Column:
        return F.when(self.first.column(), labels[0]).when(self.second.column(), labels[1]).otherwise(labels[2])


def rule_condition(text: str) -> Condition:
    """A condition from ``field op value``; the operator tells the kind of the field."""
    field, op, *rest = text.split()
    value = " ".join(rest)
    if op in ("is_true", "is_false"):
        return Atom("bool", field, op)
    if op in ("is_null", "is_not_null"):
        return Atom("nullable", field, op)
    if field.endswith("_text"):
        return Atom("text", field, op, value)
    if op in ("contains", "not_contains") or op.startswith("count_"):
        return Atom("list", field, op, int(value) if op.startswith("count_") else value)
    if op in ("before", "after"):
        return Atom("date", field, op)
    if op in ("within_days", "older_than"):
        return Atom("date", field, op, int(value))
    try:
        number = float(value)
    except ValueError:
        return Atom("enum", field, op, value)
    return Atom("num", field, op, number)


def domains() -> list[Domain]:
    out = []
    for line in DOMAINS.strip().splitlines():
        name, entity, band, labels, first, second = [c.strip() for c in line.split("|")]
        field, thresholds = band.split(":")
        out.append(
            Domain(
                name.removesuffix("*").strip(), entity, field.strip(), tuple(float(t) for t in thresholds.strip(" []").split(",")), tuple(x.strip() for x in labels.split(",")),
                rule_condition(first), rule_condition(second), name.endswith("*"),
            )
        )
    return out


def band_table(spark: SparkSession) -> DataFrame:
    """domain, thresholds, labels: 43 rows, a fixed size."""
    return spark.createDataFrame([(d.name, list(d.thresholds), list(d.labels)) for d in domains()], "domain string, thresholds array<double>, labels array<string>")


def apply_bands(values: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Every value in the bands of every domain: the number of thresholds it reaches picks the label."""
    reached = F.size(F.filter("thresholds", lambda t: F.col(value) >= t))
    return values.join(F.broadcast(bands)).withColumn("band", F.when(F.col(value).isNotNull(), F.get("labels", reached))).drop("thresholds", "labels")
