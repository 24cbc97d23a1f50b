"""Whether the proofs behind a suppression still hold: the calibration fit, the threshold's attestation, an allowlist entry.

Each leg is one column, struct<fresh boolean, reason string>: the first rule that the proof breaks, in the
rules' order, or null. What cannot be read (null, a time without an offset) breaks its rule, as a proof that
cannot be understood is not fresh. Nothing here shuffles but `with_drift`, which joins what happened to
fingerprints.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: The least threshold that can be attested, and who issues fits (a run and a version, no person).
FLOOR, ISSUER = 0.85, r"^[^/\s]+/[^/\s]+$"


def instant(text: Column, naive: bool = False) -> Column:
    """Microseconds of an RFC 3339 time; null if it cannot be read. Times without an offset are UTC if naive, else they cannot be read."""
    t = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    day, clock = r"^\d{4}-\d{2}-\d{2}", r"[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
    read = F.when(t.rlike(day + clock + r"[+-]\d{2}:\d{2}$"), t)
    if naive:
        read = F.coalesce(read, F.when(t.rlike(day + clock + "$"), F.concat(t, F.lit("+00:00"))), F.when(t.rlike(day + "$"), F.concat(t, F.lit("T00:00:00+00:00"))))
    whole = F.regexp_replace(read, r"^(.{10}[T ]\d{2}:\d{2})([+-])", "$1:00$2")  # seconds can be left out
    return F.unix_micros(whole.try_cast("timestamp"))


def config_hash(config: dict) -> str:
    """The digest that an attestation of this configuration carries."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def leg(rules: dict[str, Column]) -> Column:
    """The first rule, by name, that does not hold."""
    reason = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    return F.struct(reason.isNull().alias("fresh"), reason.alias("reason"))


def two_people(people: Column) -> Column:
    """Exactly two different names, none of them empty."""
    return (F.size(F.array_distinct(people)) == 2) & F.forall(people, lambda x: F.coalesce(x, F.lit("")) != "")


def young(since_us: Column, days: Column, now_us: Column) -> Column:
    """No older than so many days, one at least."""
    return now_us - since_us <= F.greatest(F.coalesce(days, F.lit(1)), F.lit(1)).cast("long") * DAY_US


def fit_leg(proof: Column, now_us: Column, model: str, pipeline: str) -> Column:
    """A fit (trained_at, issued_by, valid_days, model, pipeline) for the model and label pipeline in use."""
    at, empty = instant(proof["trained_at"]), F.lit("")
    return leg({
        "invalid fit_trained_at": at.isNotNull(),
        "invalid issued_by": proof["issued_by"].rlike(ISSUER),
        "fit TTL expired": young(at, proof["valid_days"], now_us),
        "model_pin mismatch": F.coalesce(proof["model"], empty) == (model or ""),
        "label pipeline drift": F.coalesce(proof["pipeline"], empty) == (pipeline or ""),
    })


def threshold_leg(attested: Column, now_us: Column, config: dict, bar: float) -> Column:
    """An attestation (threshold, attested_by, due_at, config_hash) of the thresholds in use."""
    due = instant(attested["due_at"])
    return leg({
        "below conf floor": attested["threshold"] >= FLOOR,
        "not two operators": two_people(attested["attested_by"]),
        "invalid revalidation_due_at": due.isNotNull(),
        "revalidation clock lapsed": now_us <= due,
        "threshold is not the live bar": attested["threshold"] == float(bar),
        "config_hash mismatch": attested["config_hash"] == config_hash(config),
    })


def with_drift(entries: DataFrame, incidents: DataFrame, rewrites: DataFrame, key: str = "fingerprint") -> DataFrame:
    """entries with incident (the least name of an incident that the fingerprint was in) and rewritten; each entry stays one row."""
    hit = incidents.groupBy(F.col(key).alias("hit_key")).agg(F.min("incident").alias("incident"))
    new = rewrites.select(F.col(key).alias("new_key")).distinct()
    rows = entries.drop("incident", "rewritten").join(hit, F.col(key) == F.col("hit_key"), "left").join(new, F.col(key) == F.col("new_key"), "left")
    return rows.withColumn("rewritten", F.col("new_key").isNotNull()).drop("hit_key", "new_key")


def entry_leg(entry: Column, now_us: Column, migration_until: Column) -> Column:
    """An allowlist entry (banned, pending, attested_by, attested_at, ttl_days, incident, rewritten). Incidents and rewrites void it whatever its age; pending ones hold while the migration window is open."""
    at, until = instant(entry["attested_at"]), instant(migration_until, naive=True)
    return leg({
        "security category banned": ~F.coalesce(entry["banned"], F.lit(False)),
        "re-attestation pending": ~F.coalesce(entry["pending"], F.lit(False)) | F.coalesce(now_us < until, F.lit(False)),
        "not two people": two_people(entry["attested_by"]),
        "invalid attested_at": at.isNotNull(),
        "entry TTL expired": young(at, entry["ttl_days"], now_us),
        "incident linkage": F.coalesce(entry["incident"], F.lit("")) == "",
        "drift check failed": ~F.coalesce(entry["rewritten"], F.lit(False)),
    })


def stale_reasons(fit: Column, threshold: Column, entry: Column) -> Column:
    """What of the three is stale, in order."""
    return F.array_compact(F.array(*[F.when(~x["fresh"], F.concat(F.lit(f"lock{n}_stale: "), x["reason"])) for n, x in enumerate((fit, threshold, entry), 1)]))
