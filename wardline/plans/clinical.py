"""Laboratory results and the clinical records a doctor writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import rules
from wardline.functions.ordering import first_of, highest, with_sequence
from wardline.functions.text import blank, sanitize_string, strip
from wardline.plans.common import REASON, Change, Outcome, changed, first_failure, known
from wardline.plans.registry import _appended
from wardline.schema import ENUMS
from wardline.sources.staging import cut
from wardline.sources.tables import Hospital, conform

# Reason texts and limits.
NOT_PENDING = "Lab order is not pending."
TOO_LONG = "One of the fields is too long. Please shorten your input."
RESULT_SHOWN, RESULT_STORED = 200, 100
FREQUENCIES = ("Once daily", "Twice daily", "Three times daily", "Every 8 hours", "As needed (SOS)")
ORDER = ["request_ts", "request_id"]


def apply_lab_results(h: Hospital, requests: DataFrame, *, mode: str = "technician") -> Outcome:
    """requests: request_id, request_ts, order_id, result_value, is_abnormal.

    The first result of a pending order closes it. In mode "trigger" every first result counts as
    abnormal; in mode "technician" the flag is the technician's.
    """
    if mode not in ("technician", "trigger"):
        raise ValueError(f"unknown mode {mode!r}")
    orders = h.lab_orders.select("order_id", "status", F.col("result_value").alias("_had"))
    checked = requests.join(orders, "order_id", "left")
    text = rules.text("result_value", "Result Value", required=True, max_len=RESULT_SHOWN)
    reason = first_failure(
        text,
        (F.length(strip("result_value")) > RESULT_STORED, TOO_LONG),
        (F.coalesce(F.col("status") != "Pending", F.lit(True)), NOT_PENDING),
    )
    checked = cut(checked.withColumn(REASON, reason).drop("status", "_had"))
    winners = first_of(checked.filter(F.col(REASON).isNull()), ["order_id"], ORDER, "request_id")
    decided = known(checked, winners, "request_id", "_won").withColumn(
        REASON, F.coalesce(REASON, F.when(~F.col("_won"), NOT_PENDING))
    )
    flag = F.lit(True) if mode == "trigger" else F.coalesce("is_abnormal", F.lit(False))
    accepted = decided.filter(F.col(REASON).isNull()).select(
        "request_id", "order_id", strip("result_value").alias("result_value"), flag.alias("is_abnormal"),
        F.lit("Done").alias("status"), F.col("request_ts").alias("result_date"),
    )
    columns = ["result_value", "is_abnormal", "status", "result_date"]
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    return changed(accepted, rejected, "lab_orders", h.lab_orders, Change(accepted, "order_id", columns))


def abnormal_alerts(results: DataFrame) -> DataFrame:
    """Results marked abnormal, from a batch or a stream of results."""
    return results.filter(F.col("is_abnormal") & F.col("result_value").isNotNull()).select(
        "order_id", "result_value", F.lit("Result marked ABNORMAL").alias("message")
    )


def _append(h: Hospital, checked: DataFrame, reason: Column, table: str, key: str) -> Outcome:
    decided = cut(checked.withColumn(REASON, reason))
    accepted = with_sequence(
        decided.filter(F.col(REASON).isNull()).drop(REASON), [F.col(c) for c in ORDER], key, highest(h.table(table), key)
    )
    return Outcome(
        accepted,
        decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {table: _appended(h.table(table), conform(accepted, table))},
    )


def record_diagnoses(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, appt_id, icd_code, description, severity."""
    code, text = rules.icd_code("icd_code"), rules.text("description", "Description")
    reason = first_failure(
        (~F.col("_known"), "Select an appointment."),
        code,
        text,
        (~F.coalesce(F.col("severity").isin(*ENUMS["diagnoses", "severity"]), F.lit(False)), "Severity required."),
    )
    checked = known(requests, h.appointments, "appt_id", "_known").withColumn(REASON, reason).drop("_known")
    cleaned = checked.withColumns(
        {
            "icd_code": F.upper(strip("icd_code")),
            "description": sanitize_string("description"),
            "diagnosed_at": F.col("request_ts"),
        }
    )
    return _append(h, cleaned, F.col(REASON), "diagnoses", "diag_id")


def record_prescriptions(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, diag_id, medicine_id, dosage, frequency, duration_days, instructions."""
    dosage, days = rules.dosage("dosage"), rules.duration_days("duration_days")
    reason = first_failure(
        (~F.col("_diag"), "Select a diagnosis."),
        (~F.col("_med"), "Select a medicine."),
        dosage,
        (~F.coalesce(F.col("frequency").isin(*FREQUENCIES), F.lit(False)), "Frequency required."),
        days,
    )
    checked = known(known(requests, h.diagnoses, "diag_id", "_diag"), h.medicines, "medicine_id", "_med")
    cleaned = checked.withColumn(REASON, reason).drop("_diag", "_med").withColumns(
        {
            "dosage": strip("dosage"),
            "instructions": F.when(~blank("instructions"), strip("instructions")),
            "prescribed_at": F.col("request_ts"),
        }
    )
    return _append(h, cleaned, F.col(REASON), "prescriptions", "rx_id")


def record_lab_orders(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, appt_id, test_id."""
    reason = first_failure(
        (~F.col("_appt"), "Select an appointment."), (~F.col("_test"), "Select at least one test.")
    )
    checked = known(known(requests, h.appointments, "appt_id", "_appt"), h.lab_tests, "test_id", "_test")
    cleaned = checked.withColumn(REASON, reason).drop("_appt", "_test").withColumn("ordered_at", F.col("request_ts"))
    return _append(h, cleaned, F.col(REASON), "lab_orders", "order_id")
