"""Scalar column expressions (C7-C17, C24, C25). All are JVM-side and codegen'd."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab


def risk_level(p: Column, threshold: float = vocab.FALLBACK_THRESHOLD) -> Column:
    """Inclusive lower bounds."""
    return (F.when(p >= vocab.CRITICAL_PROBABILITY, "Critical")
            .when(p >= F.lit(threshold), "High")
            .when(p >= vocab.MEDIUM_PROBABILITY, "Medium")
            .otherwise("Low"))


def predicted_label(p: Column, threshold: float = vocab.FALLBACK_THRESHOLD) -> Column:
    """C8."""
    return (p >= F.lit(threshold)).cast("int")


def risk_rank(level: Column) -> Column:
    """Low 0 … Critical 3, unknown → 0."""
    m = F.create_map(*[x for k, v in vocab.RISK_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[level], F.lit(0))


def whole_number_text(x: Column) -> Column:
    """Python ``f'{x:.0f}'``: round half to even, then print without decimals (Q4)."""
    return F.bround(x, 0).cast("long").cast("string")


def abnormal_reason(channels: Mapping[str, Column], max_findings: int = vocab.MAX_FINDINGS) -> Column:
    """Fixed channel order, strict bounds, first ``max_findings`` joined by ', '."""
    findings = []
    for name, low, high, unit, label in vocab.VITAL_RANGES:
        v = channels.get(name)
        if v is None:
            continue
        txt = lambda kind: F.concat(F.lit(f"{kind} {label} ("), whole_number_text(v), F.lit(f"{unit})"))
        e = None
        if low is not None:
            e = F.when(v < F.lit(low), txt("Low"))
        if high is not None:
            e = (e.when(v > F.lit(high), txt("Elevated")) if e is not None else F.when(v > F.lit(high), txt("Elevated")))
        findings.append(e)
    if not findings:
        return F.lit("")
    arr = F.filter(F.array(*findings), lambda x: x.isNotNull())
    return F.array_join(F.slice(arr, 1, max_findings), ", ")


def alert_message(level: Column, patient_id: Column, p: Column, reason: Column) -> Column:
    """C11: '[High] Sepsis risk for patient X: 28% probability -- reason'."""
    why = F.when(F.coalesce(reason, F.lit("")) == "", F.lit(f" -- {vocab.FALLBACK_REASON}")) \
        .otherwise(F.concat(F.lit(" -- "), reason))
    return F.concat(F.lit("["), level, F.lit("] Sepsis risk for patient "), patient_id.cast("string"),
                    F.lit(": "), whole_number_text(p * 100), F.lit("% probability"), why)


def focal_loss(y: Column, p: Column, alpha: float = vocab.FOCAL_ALPHA, gamma: float = vocab.FOCAL_GAMMA,
               eps: float = vocab.FOCAL_EPSILON) -> Column:
    """C17: per-row binary focal loss with clipping."""
    pc = F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    yd = y.cast("double")
    p_t = yd * pc + (1 - yd) * (1 - pc)
    a_t = yd * alpha + (1 - yd) * (1 - alpha)
    return -a_t * F.pow(1 - p_t, F.lit(gamma)) * F.log(p_t)


def vitals_topic(pid: Column) -> Column:
    """C12."""
    return F.concat(F.lit("icu/"), pid.cast("string"), F.lit("/vitals"))


def prediction_topic(pid: Column) -> Column:
    return F.concat(F.lit("icu/"), pid.cast("string"), F.lit("/prediction"))


def alert_topic(pid: Column) -> Column:
    return F.concat(F.lit("icu/"), pid.cast("string"), F.lit("/alert"))


def topic_patient(topic: Column) -> Column:
    return F.regexp_extract(topic, r"^icu/([^/]+)/[^/]+$", 1)


def display_time(ts_text: Column) -> Column:
    """C14: ISO text (with 'Z') → 'yyyy-MM-dd HH:mm UTC'; unparsable text passes through; null → '--'."""
    parsed = F.coalesce(F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")),
                        F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                        F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))
    return F.when(ts_text.isNull(), F.lit("--")).when(parsed.isNull(), ts_text) \
        .otherwise(F.date_format(parsed, "yyyy-MM-dd HH:mm 'UTC'"))


def one_decimal(x: Column) -> Column:
    """One decimal place of the exact binary value, ties to even (Q4), '--' when missing.

    Ten times the value is the exact sum of two products (the value is split
    into two halves of its digits), so its distance from the nearest half is exact.
    """
    a = F.abs(x)
    big = a * F.lit(134217729.0)  # 2**27 + 1
    high = big - (big - a)
    up, low = high * 10, (a - high) * 10
    below = F.floor(up + low)
    past_half = (up - (below + 0.5)) + low
    tenths = below + F.when((past_half > 0) | ((past_half == 0) & (below % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, F.lit("-")).otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))
    # beyond 2**49 a double has no tenths to round
    return F.when(x.isNull(), F.lit("--")).when(a < 2.0 ** 49, text).otherwise(F.format_string("%.1f", x))


def direction(contribution: Column) -> Column:
    """C16."""
    return F.when(contribution > 0, "Increases risk").otherwise("Decreases risk")


def window_start(window_end: Column, window_size: int = vocab.STREAM_WINDOW_SIZE) -> Column:
    """window_start = end − (w−1) hours."""
    return window_end - F.make_interval(hours=F.lit(window_size - 1))


def dispatched_channels(status: Column) -> Column:
    """Keys of a status map whose value is not 'skipped'."""
    return F.map_keys(F.map_filter(status, lambda k, v: v != "skipped"))
