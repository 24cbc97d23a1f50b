"""HMAC-SHA-256 and webhook signatures as column arithmetic: no Python worker sees a body or a secret.

hmac(key, m) = sha256(outer || sha256(inner || m)), where inner and outer are the key,
padded to a block, each byte xor 0x36 and 0x5c. Both are worked out once for each row
of the (small) table of secrets, before it is joined to the deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block; seconds by which a delivery's time may differ from now.
BLOCK, SKEW_S = 64, 300
PREFIX = "sha256="


def pads(secret: Column) -> Column:
    """A struct of inner and outer (binary) of a secret (string or binary); null if it is null or empty."""
    raw = secret.cast("binary")
    key = F.when(F.length(raw) > BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(key), 2 * BLOCK, "0")
    # eight bytes at a time and without lambdas: a literal secret's pads are literals to Spark
    words = [F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("long") for i in range(BLOCK // 8)]
    pad = lambda x: F.unhex(F.concat(*[F.lpad(F.hex(w.bitwiseXOR(F.lit(int.from_bytes([x] * 8, "big")))), 16, "0") for w in words]))
    return F.when(F.length(raw) > 0, F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer")))


def hmac(padded: Column, message: Column) -> Column:
    """Lowercase hex HMAC-SHA-256 of a message (string or binary) under a padded key; null if either is null."""
    inside = F.unhex(F.sha2(F.concat(padded["inner"], message.cast("binary")), 256))
    return F.sha2(F.concat(padded["outer"], inside), 256)


def failure(padded: Column, signature: Column, timestamp: Column, body: Column, now_s: Column, onboarding: bool = False) -> Column:
    """Why a delivery does not verify under one secret, null if it does.

    With a timestamp the signature is over `timestamp.body`, and the time may be SKEW_S off; without
    one it is over the body alone, which is refused by that name, as it can be replayed for ever.
    """
    given = F.substring(signature, len(PREFIX) + 1, 1 << 20)
    number = F.when(F.trim(timestamp).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(timestamp).cast("long"))
    timed = hmac(padded, F.concat(number.cast("string").cast("binary"), F.lit(b"."), body.cast("binary")))
    return (
        F.when(padded.isNull(), "no_secret" if onboarding else "no_secret_prod")
        .when(F.coalesce(signature, F.lit("")) == "", "no_signature" if onboarding else "missing_signature")
        .when(~signature.startswith(PREFIX), "bad_signature_format")
        .when(timestamp.isNotNull() & number.isNull(), "bad_timestamp")
        .when(timestamp.isNotNull() & (F.abs(now_s - number) > SKEW_S), "stale_timestamp")
        .when(timestamp.isNotNull() & (given == timed), None)
        .when(timestamp.isNull() & (given == hmac(padded, body)), "legacy_signature" if onboarding else "legacy_unsigned_ts")
        .otherwise("bad_mac")
    )


def verify(deliveries: DataFrame, secrets: DataFrame, now_s: Column, onboarding: bool = False, key: str = "endpoint") -> DataFrame:
    """deliveries (key, signature, timestamp, body, ...) with `failure`: null if any secret of the endpoint verifies, else why the first one does not.

    secrets: key, current and next (strings; null or empty where there is none), one row an endpoint.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in deliveries.columns])
    asked = deliveries.select(F.col(key).alias("endpoint"), F.col("signature"), F.col("timestamp"), F.col("body"), now_s.alias("now_s"), row.alias("row"))
    known = secrets.select(F.col(key).alias("endpoint"), pads(F.col("current")).alias("current"), pads(F.col("next")).alias("next"))
    rows = asked.join(known, "endpoint", "left")
    of = lambda c: failure(F.col(c), F.col("signature"), F.col("timestamp"), F.col("body"), F.col("now_s"), onboarding)
    rows = rows.withColumns({"one": of("current"), "two": of("next")})  # each is read twice below
    one, two = F.col("one"), F.col("two")
    has = lambda c: F.col(c).isNotNull()
    why = F.when(has("current") & has("next"), F.when(one.isNull() | two.isNull(), None).otherwise(one)).when(has("next"), two).otherwise(one)
    return rows.select("row.*", why.alias("failure"))
