"""Keyed table queries and maintenance.

Spark has no in-place update on Parquet: maintenance operators are pure
functions (base, change) → new base, written to a new path or version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- reads -------------------------------------------------------------------

def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key by ``order`` (last column is the tie-break id).

    ``max_by`` is a partial aggregate: each map task keeps one row per key
    before the shuffle, so a hot key costs no more than a cold one.
    """
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_n_per_key(df: DataFrame, key: str, order: Sequence[str], n: int, rank_col: str = "rank") -> DataFrame:
    """Newest ``n`` rows per key (``row_number() <= n`` lets Spark insert a
    partial window-group limit before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def live_view(readings: DataFrame, key: str = "patient_id", order: Sequence[str] = ("timestamp", "id"), n: int = 50) -> DataFrame:
    """Per patient the newest reading and the list of the last ``n``, newest first."""
    rows = last_n_per_key(readings, key, order, n)
    fields = F.struct(*[c for c in readings.columns if c != key])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", fields.alias("r")))), lambda x: x["r"])
    return rows.groupBy(key).agg(listed.alias("recent")).select(key, F.get("recent", F.lit(0)).alias("latest"), "recent")


def in_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """D1 range part: optional inclusive bounds."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df


def history(df: DataFrame, ts: str, id_col: str, key: str | None = None, key_value=None,
            start=None, end=None, limit: int = 1000) -> DataFrame:
    """D1 + H4: one entity's rows in an inclusive range, newest first, limited (TakeOrderedAndProject)."""
    if key is not None and key_value is not None:
        df = df.filter(F.col(key) == F.lit(key_value))
    return in_range(df, ts, start, end).orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(limit)


def list_alerts(alerts: DataFrame, patient_id=None, patient_ids: DataFrame | None = None, acknowledged: bool | None = None,
                risk_level: str | None = None, limit: int | None = None, key: str = "patient_id") -> DataFrame:
    """Composed filters; a single patient wins over a patient set (semi join, no id list on the driver)."""
    df = alerts
    if patient_id is not None:
        df = df.filter(F.col(key) == F.lit(patient_id))
    elif patient_ids is not None:
        df = df.join(patient_ids.select(key).distinct(), key, "left_semi")
    if acknowledged is not None:
        df = df.filter(F.col("acknowledged") == F.lit(acknowledged))
    if risk_level is not None:
        df = df.filter(F.col("risk_level") == F.lit(risk_level))
    if limit is not None:
        df = df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return df


def owned_ids(patients: DataFrame, owner: str | Column, key: str = "patient_id") -> DataFrame:
    o = owner if isinstance(owner, Column) else F.lit(owner)
    return patients.filter(F.col("created_by") == o).select(key)


def scope_to_owner(df: DataFrame, patients: DataFrame, owner: str, key: str = "patient_id") -> DataFrame:
    """Rows of patients created by the caller; anything else looks absent."""
    return df.join(owned_ids(patients, owner, key), key, "left_semi")


def with_owner(df: DataFrame, patients: DataFrame, key: str = "patient_id") -> DataFrame:
    """E6 for every caller at once: each row tagged with its owner."""
    return df.join(patients.select(key, F.col("created_by").alias("owner")), key)


AUDIT_SALTS = 16


def audit_visible(audit: DataFrame, patients: DataFrame, action: str | None = None, key: str = "patient_id") -> DataFrame:
    """D3 for every caller: (owner, audit row) where actor = owner OR details.patient_id is owned.

    One pass: owned rows by join on the patient key, actor rows by join on the
    owner name, union, then distinct on (owner, id). Most audit rows have the
    one actor "system": the actor join is salted, with the owners repeated.
    """
    a = audit if action is None else audit.filter(F.col("action") == action)
    owners = patients.select(F.col("created_by").alias("owner")).distinct()
    by_patient = a.join(patients.select(F.col(key).alias("details_patient_id"), F.col("created_by").alias("owner")),
                        "details_patient_id")
    salt = F.pmod(F.xxhash64("id"), F.lit(AUDIT_SALTS)).cast("int")
    owners = owners.select("owner", F.explode(F.sequence(F.lit(0), F.lit(AUDIT_SALTS - 1))).alias("_salt"))
    by_actor = a.withColumn("_salt", salt).join(owners.withColumn("actor", F.col("owner")), ["actor", "_salt"])
    cols = ["owner", *a.columns]
    return by_patient.select(*cols).unionByName(by_actor.select(*cols)).dropDuplicates(["owner", "id"])


def list_patients(patients: DataFrame, status: str | None = None, owner: str | None = None,
                  limit: int | None = None, key: str = "patient_id") -> DataFrame:
    """D4 (with a deterministic order added)."""
    df = patients
    if status is not None:
        df = df.filter(F.col("current_status") == status)
    if owner is not None:
        df = df.filter(F.col("created_by") == owner)
    if limit is not None:
        df = df.orderBy(key).limit(limit)
    return df


def count_by_domain(df: DataFrame, col: str, domain: Sequence[str], kind: str) -> DataFrame:
    """counts over a fixed domain, zero-filled, values outside the domain ignored."""
    row = df.agg(*[F.count_if(F.col(col) == v).alias(f"_{i}") for i, v in enumerate(domain)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("key"), F.col(f"_{i}").alias("n")) for i, v in enumerate(domain)])))


# --- maintenance ---------------------------------------------------------------

@dataclass
class InsertResult:
    inserted: DataFrame
    rejected: DataFrame


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> InsertResult:
    """Unique-key insert. Within the batch the first row per key (by
    ``order``, whose last column should be a unique id) wins and later ones
    are rejected as duplicates; keys already present are rejected too.
    The winner comes from a partial ``min_by`` aggregate, so a key repeated
    in a third of the batch still never lands whole in one task."""
    head = first_per_key(new, key, order)
    dups = new.join(head.select(key, *order), [key, *order], "left_anti").withColumn("reason", F.lit("duplicate key in batch"))
    inserted = head.join(existing.select(key), key, "left_anti")
    clash = head.join(existing.select(key), key, "left_semi").withColumn("reason", F.lit("duplicate key"))
    return InsertResult(inserted, dups.select(*head.columns, "reason").unionByName(clash))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Earliest row per key (partial aggregation via ``min_by``)."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def apply_patch(base: DataFrame, patch: DataFrame, key: str, fields: Sequence[str],
                set_fields: str = "set_fields", updated_at: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """L2: only fields listed in the patch row's ``set_fields`` change (an
    explicit null is applied; an unset field keeps the base value);
    ``updated_at`` is bumped on matched rows; unmatched patch keys are ignored;
    an empty patch changes nothing. Several patches of a key act as if applied
    in ``order`` (by default ``updated_at``, then the field values): each field
    takes the last value set."""
    last = F.struct(*[F.col(c) for c in order], *([updated_at] if updated_at is not None else []), *[F.col(c) for c in fields])
    p = patch.groupBy(key).agg(
        F.array_distinct(F.flatten(F.collect_set(set_fields))).alias(set_fields),
        *[F.max_by(c, F.when(F.array_contains(set_fields, c), last)).alias(f"_p_{c}") for c in fields],
        *([F.max(updated_at).alias("_p_updated_at")] if updated_at is not None else []))
    j = base.join(p, key, "left")
    matched = F.col(set_fields).isNotNull() & (F.size(F.col(set_fields)) > 0)
    out = []
    for c in base.columns:
        if c in fields:
            out.append(F.when(matched & F.array_contains(F.col(set_fields), c), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and updated_at is not None:
            out.append(F.when(matched, F.col("_p_updated_at")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def unmatched(change: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Change rows whose key is not in the base ("not matched")."""
    return change.join(base.select(key), key, "left_anti")


def delete_by_key(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """L3."""
    return base.join(keys.select(key), key, "left_anti")


def acknowledge(alerts: DataFrame, acks: DataFrame, id_col: str = "id") -> DataFrame:
    """L4: set acknowledged / by / at for matched alert ids; one ack per id (earliest wins).

    ``unmatched`` gives the acknowledgements of unknown alerts, ``acknowledge_audit`` the audit rows."""
    a = first_per_key(acks.select(id_col, "acknowledged_by", "acknowledged_at"), id_col, ["acknowledged_at", "acknowledged_by"])
    base = alerts.drop("acknowledged_by", "acknowledged_at")
    j = base.join(a, id_col, "left")
    hit = F.col("acknowledged_at").isNotNull()
    return j.withColumn("acknowledged", F.coalesce(F.col("acknowledged"), F.lit(False)) | hit)


def acknowledge_audit(alerts: DataFrame, acks: DataFrame, id_col: str = "id") -> DataFrame:
    """L4 + L5: one audit row per acknowledgement that met its alert (the earliest of each)."""
    hit = first_per_key(acks.select(id_col, "acknowledged_by", "acknowledged_at"), id_col, ["acknowledged_at", "acknowledged_by"])
    hit = hit.join(alerts.select(id_col), id_col, "left_semi")
    return audit_rows(hit, F.col("acknowledged_by"), "alert_acknowledged", "alert", id_col, {}, "acknowledged_at")


# --- write-time rules ---------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column  # true when the row breaks the rule


def required(c: str) -> Rule:
    return Rule(f"required:{c}", F.col(c).isNull())


def enum(c: str, values: Sequence[str], nullable: bool = False) -> Rule:
    return Rule(f"enum:{c}", F.when(F.col(c).isNull(), F.lit(not nullable)).otherwise(~F.col(c).isin(list(values))))


def in_range_rule(c: str, lo: float | None = None, hi: float | None = None) -> Rule:
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (F.col(c) < lo)
    if hi is not None:
        cond = cond | (F.col(c) > hi)
    return Rule(f"range:{c}", F.coalesce(cond, F.lit(False)))


def max_length(c: str, n: int) -> Rule:
    return Rule(f"length:{c}", F.coalesce(F.length(c) > n, F.lit(False)))


def validate(df: DataFrame, rules: Sequence[Rule], unique_key: str | None = None) -> DataFrame:
    """Adds ``violations array<string>``; accepted rows have an empty array.

    Uniqueness is checked by a keyed count joined back (partial aggregation),
    not by a window that would put a hot key into one task.
    """
    viol = [F.when(r.violated, F.lit(r.name)) for r in rules]
    out = df
    if unique_key is not None:
        counts = df.groupBy(unique_key).agg(F.count(F.lit(1)).alias("_dup"))
        out = out.join(counts, unique_key, "left")
        viol.append(F.when(F.col("_dup") > 1, F.lit(f"unique:{unique_key}")))
    out = out.withColumn("violations", F.filter(F.array(*viol), lambda x: x.isNotNull()))
    return out.drop("_dup") if unique_key is not None else out


def unknown_channels(channels_map: Column, vocabulary: Sequence[str]) -> Column:
    """Channel names outside the vocabulary."""
    return F.array_except(F.map_keys(channels_map), F.array(*[F.lit(v) for v in vocabulary]))


def latest_with_explanation(predictions: DataFrame, history: DataFrame, key: str = "patient_id") -> DataFrame:
    """Each patient's latest prediction joined to its explanation row (by prediction id)."""
    latest = latest_per_key(predictions, key, ["created_at", "id"])
    h = history.select(F.col("prediction_id").alias("id"), *[F.col(c).alias(f"explanation_{c}") for c in history.columns
                                                            if c not in ("prediction_id", key)])
    return latest.join(h, "id", "left")


def audit_rows(df: DataFrame, actor: Column | str, action: str, target_type: str, target_id: str,
               details: dict[str, Column], ts: str) -> DataFrame:
    """Append-only audit rows derived from an operator's output (one per row)."""
    a = actor if isinstance(actor, Column) else F.lit(actor)
    return df.select(F.concat(F.lit(f"{action}:"), F.col(target_id).cast("string")).alias("id"), a.alias("actor"),
                     F.lit(action).alias("action"), F.lit(target_type).alias("target_type"),
                     F.col(target_id).cast("string").alias("target_id"),
                     F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]).alias("details"),
                     F.col(ts).alias("timestamp"))


def row_count(df: DataFrame) -> DataFrame:
    """F27."""
    return df.agg(F.count(F.lit(1)).alias("n"))
