"""The legs of a decision beside the policy table: answers, locks, freshness, corroboration, lifecycle, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised severities that are never held back by change windows or hash samples.
GRAVE = ["critical", "high", "p1", "p2", "sev1", "sev2"]
#: Field, words and what they stand for; the first that fits, between separators, bans suppression.
BANS = [
    ("check", "waf|ids|ips|siem|xdr|edr|hids|nids|soar|honeypot", "security detection/response platform check"),
    ("check", "bruteforce|brute_force|credential_stuffing|password_spray|auth_fail|login_fail|mfa_fail|token_leak|apikey_leak|api_key_leak|secret_leak|jwt_abuse|oauth_abuse|session_hijack", "authentication attack-surface check"),
    ("check", "malware|ransomware|phishing|intrusion|exfiltration|exfil|breach|ddos|botnet|backdoor|rootkit|c2_beacon|exploit_attempt", "malware/intrusion/exfiltration check"),
    ("check", "vuln|cve", "vulnerability-management check"),
    ("check", "tls_cert", "TLS certificate security-posture check"),
    ("team", "security|infosec|appsec|soc|csirt|redteam|red_team|blueteam|blue_team|threatintel|threat_intel|vulnmgmt|vuln_mgmt|secteam|secops|sec_ops", "security owning team"),
]
#: Severities that always get an advice; actions of the first degraded step by severity (all others pass through); severities that the severity floor pages.
ADVISED = ["critical", "high", "p1", "p2", "emergency", "fatal"]
DEGRADED = {"critical": "page_now", "high": "page_business_hours", "medium": "page_business_hours"}
FLOOR = ["critical", "p1"]
#: What a calibration fit is bound to.
REFERENCE_CLASS, FORMULA = "R(C,W,r=0.00)", "adr013-v1"


def security_ban(check: Column, team: Column, bans=BANS) -> Column:
    """What the first fitting ban stands for, else null."""
    return F.coalesce(*[F.when((check if field == "check" else team).rlike(f"(?i)(^|[_.:/-])({words})([_.:/-]|$)"), what) for field, words, what in bans])


def hash_share(text: Column, percent: int = 1) -> Column:
    """Whether the SHA-256 of text, as a number, is below percent modulo 100: Horner's rule over its digits."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda x: x >= 0), F.lit(0), lambda a, x: (a * 16 + x) % 100) < percent


def window_seconds(text: Column) -> Column:
    """`15m` and the like as seconds; null for anything else."""
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(unit != "", F.regexp_extract(text, r"^(\d+)([smhd])$", 1).cast("long") * size)


def hundredths(text: Column) -> Column:
    """A decimal text in 0..1 as whole hundredths; null unless it is exactly so."""
    value = F.when(text.rlike(r"^[01](\.[0-9]{1,10})?$"), text.cast("decimal(12,10)"))
    return F.when((value <= 1) & (value * 100 == F.floor(value * 100)), (value * 100).cast("int"))


def freshness(legs: dict[str, Column]) -> Column:
    """Names of the stale legs, in order, each once; a leg without a state (null) is stale too."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in legs.items()])))


def advised(severity: Column, fingerprint: Column, percent: int = 1) -> Column:
    """Whether an alert gets an advice: grave ones all, of the others a stable share by the hash of the fingerprint. Nulls count as empty."""
    return F.lower(F.coalesce(severity, F.lit(""))).isin(*ADVISED) | hash_share(F.coalesce(fingerprint, F.lit("")), percent)


def fit_reason(fit: Column, now_us: Column, model: str, bar: float = 0.002, z: float = 1.6449, day_us: int = 86_400_000_000, reference_class: str = REFERENCE_CLASS, formula: str = FORMULA) -> Column:
    """`ok`, or the first rule that a calibration fit (struct) breaks; a field that is null breaks its rule. Its id is the digest of payload, its canonical text."""
    breaks = {
        "binding": (fit["fit_id"] != "") & (fit["fit_id"] == F.sha2(fit["payload"], 256)),
        "class": fit["reference_class"] == reference_class,
        "formula": fit["formula"] == formula,
        "z": fit["z"] == z,
        "elapsed": fit["valid_until_us"] > now_us,
        "model": fit["model"] == model,
        "shift": fit["shift"] == "OK",
        "window": fit["window_end_us"] >= now_us - 7 * day_us,
        "bar": fit["upper"] < bar,
    }
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in breaks.items()], F.lit("ok"))


def attested(entries: Column, author: Column, now_us: Column, max_days: int = 30, day_us: int = 86_400_000_000) -> Column:
    """Whether the first two attestations (by, at_us, ref, ttl_days) are of two people, neither the author, refer to a run and hold now."""
    one, two = F.get(entries, F.lit(0)), F.get(entries, F.lit(1))
    good = lambda a: a["ref"].rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{1,127}$") & (a["by"] != author) & (a["ttl_days"] > 0) & (a["ttl_days"] <= max_days) & (a["at_us"] <= now_us) & (now_us < a["at_us"] + a["ttl_days"] * day_us)
    return F.coalesce(good(one) & good(two) & (one["by"] != two["by"]), F.lit(False))


def by_step(step: Column, severity: Column, admitted: Column) -> Column:
    """What a degraded step does: the first goes by severity, the floor pages critical ones, the third what its budget admits; the rest is held."""
    label = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    first = F.coalesce(*[F.when(label == s, a) for s, a in DEGRADED.items()], F.lit("passthrough"))
    pages = F.when(step == 2, label.isin(*FLOOR)).otherwise(F.coalesce(admitted, F.lit(False)))
    return F.when(step == 1, first).when(pages, "page_now").otherwise("folded")


def compose(d: DataFrame) -> DataFrame:
    """d with `path`, `final` and `why`, in the fixed order of paths.

    d has the policy table's columns and: answered, kind (change_window, duplicate, storm, new), prior (a
    duplicate's disposition), screened, step (of the ladder), stale (names), lifecycle (ok, or what
    blocks), witnesses (distinct corroborations), floor, and if it has them admitted (by the third step's
    budget) and detectors (of the screen, joined).

    A duplicate without prior goes on as if it were new. A screened alert pages, whatever else holds.
    """
    table, quiet, step = F.col("action"), F.col("action") == "suppress", F.coalesce("step", F.lit(0))
    kind = F.when((F.col("kind") == "duplicate") & F.col("prior").isNull(), "new").otherwise(F.coalesce("kind", F.lit("new")))
    structural = kind.isin("change_window", "duplicate", "storm")
    path = F.when(structural, "structural").when(F.col("screened"), "screen").when(step > 0, "degraded").otherwise("table")
    degraded = by_step(step, F.col("severity_in"), F.col("admitted") if "admitted" in d.columns else F.lit(False))
    stale = F.size("stale") > 0
    legs = [
        (~F.coalesce("answered", F.lit(False)), F.lit("passthrough"), F.lit("error:missing_answer")),
        (quiet & stale, F.lit("page_now"), F.concat(F.lit("freshness:"), F.array_join("stale", "|"))),
        (quiet & (F.col("lifecycle") != "ok"), F.lit("passthrough"), F.concat(F.lit("policy_blocked:"), F.col("lifecycle"))),
        (quiet & (F.col("witnesses") < F.col("floor")), F.lit("page_now"), F.lit("uncorroborated")),
    ]
    judged = F.coalesce(*[F.when(c, a) for c, a, _ in legs], table)
    because = F.coalesce(*[F.when(c, w) for c, _, w in legs], F.col("reason"))
    bars = F.when(kind == "change_window", "page_business_hours").when(kind == "duplicate", F.col("prior")).otherwise("folded")
    final = F.when(path == "structural", bars).when(path == "screen", "page_now").when(path == "degraded", degraded).otherwise(judged)
    held = F.concat(F.lit("failopen_step"), step.cast("string"), F.when((step > 1) & (degraded == "folded"), "_digest").otherwise(""))
    why = F.when(path == "structural", F.when(kind == "duplicate", "dedup").otherwise(kind)).when(path == "screen", F.concat_ws(":", F.lit("firewall_flagged"), F.col("detectors") if "detectors" in d.columns else F.lit(None).cast("string"))).when(path == "degraded", held).otherwise(because)
    return d.withColumns({"path": path, "final": final, "why": why})


def corroborate(alerts: DataFrame, evidence: DataFrame, max_age_us: int, skew_us: int = 300_000_000) -> DataFrame:
    """alert_id and witnesses: distinct (kind, witness) of valid evidence of the fingerprint that is neither too old nor from the future.

    Alerts are joined to evidence by (fingerprint, time bucket of max_age), so a long history of one fingerprint is not one task's.
    """
    span = max_age_us + skew_us
    asked = alerts.select("alert_id", "fingerprint", "at_us", F.explode(F.array(F.floor(F.col("at_us") / span) - 1, F.floor(F.col("at_us") / span), F.floor(F.col("at_us") / span) + 1)).alias("bucket"))
    shown = evidence.where("valid").select(F.col("fingerprint").alias("fp"), F.col("at_us").alias("seen_us"), "kind", "witness", F.floor(F.col("at_us") / span).alias("b"))
    near = (F.col("fingerprint") == F.col("fp")) & (F.col("bucket") == F.col("b")) & F.col("seen_us").between(F.col("at_us") - max_age_us, F.col("at_us") + skew_us)
    return asked.join(shown, near, "left").groupBy("alert_id").agg(F.count_distinct(F.when(F.col("kind").isNotNull(), F.struct("kind", "witness"))).alias("witnesses"))


def lifecycle_tick(policies: DataFrame, now_us: int) -> DataFrame:
    """At most one step each: a live override that is over expires, live falls due for review, review-due expires after its grace. Columns: state, new_state, event. Null times never come."""
    said = lambda state, event: F.struct(F.lit(state).alias("new_state"), F.lit(event).alias("event"))
    live = F.col("state") == "live"
    step = (
        F.when(live & (F.col("override_until_us") <= now_us), said("expired", "policy_override_reverted"))
        .when(live & (F.col("review_at_us") <= now_us), said("review_due", "policy_review_due"))
        .when((F.col("state") == "review_due") & (F.col("grace_until_us") <= now_us), said("expired", "policy_expired"))
        .otherwise(F.struct(F.col("state").alias("new_state"), F.lit(None).cast("string").alias("event")))
    )
    return policies.withColumn("s", step).select("policy_id", "version", "state", "s.new_state", "s.event")


def effective_versions(policies: DataFrame) -> DataFrame:
    """The highest live or review-due version of each policy."""
    return policies.where(F.col("state").isin("live", "review_due")).groupBy("policy_id").agg(F.max("version").alias("version"))


def without_baseline(policies: DataFrame, baselines: DataFrame) -> DataFrame:
    """Effective versions that no signed baseline matches."""
    return effective_versions(policies).join(baselines.where("size(array_distinct(signed_by)) >= 2"), ["policy_id", "version"], "left_anti")
