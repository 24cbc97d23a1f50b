"""Signatures, the screen of texts and the interval of the AUC against plain forms."""

import hashlib
import hmac
import random
import re
import unicodedata

from pyspark.sql import functions as F
from tidewatch.functions import signature
from tidewatch.operators import analytics, firewall

#: RFC 4231: key, data and HMAC-SHA-256 of the cases with whole output.
RFC = [
    ("0b" * 20, "4869205468657265", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    ("4a656665", "7768617420646f2079612077616e7420666f72206e6f7468696e673f", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


def test_hmac_is_the_rfcs_and_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(k, d) for k, d, _ in RFC], "k string, d string").select(signature.hmac(signature.pads(F.unhex("k")), F.unhex("d")).alias("m"))
    assert [r["m"] for r in df.collect()] == [m for _, _, m in RFC]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(1)
    rows = [("".join(rng.choice("aé東 ") for _ in range(rng.randint(0, 60))), "".join(rng.choice("bü\n") for _ in range(rng.randint(0, 99)))) for _ in range(200)] + [(None, "x"), ("x", None)]
    got = spark.createDataFrame(rows, "k string, d string").select("k", "d", signature.hmac(signature.pads(F.col("k")), F.col("d")).alias("m")).collect()
    assert all(r["m"] == (hmac.new(r["k"].encode(), r["d"].encode(), hashlib.sha256).hexdigest() if r["k"] and r["d"] is not None else None) for r in got)


def test_failures(spark):
    sign = lambda key, message: "sha256=" + hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()
    schema = "id int, endpoint string, signature string, timestamp string, body string, current_ string"
    cases = [
        (1, "a", sign("one", "100.b"), " 100 ", "b", None), (2, "a", sign("two", "+100.b".lstrip("+")), "+100", "b", None), (3, "a", sign("one", "100.c"), "100", "b", "bad_mac"), (4, "a", sign("one", "500.b"), "500", "b", "stale_timestamp"),
        (5, "a", sign("one", "b"), None, "b", "legacy_unsigned_ts"), (6, "a", None, "100", "b", "missing_signature"), (7, "a", "sha1=x", "100", "b", "bad_signature_format"), (8, "a", sign("one", "100.b"), "1e2", "b", "bad_timestamp"),
        (9, "b", sign("", "100.b"), "100", "b", "no_secret_prod"), (10, "none", sign("x", "100.b"), "100", "b", "no_secret_prod"), (11, "c", sign("two", "100.b"), "100", "b", None), (12, "a", "", "100", "b", "missing_signature"), (13, "a", sign("one", "400.b"), "400", "b", None),
    ]
    secrets = spark.createDataFrame([("a", "one", "two"), ("b", "", None), ("c", None, "two")], "endpoint string, current string, next string")
    df = spark.createDataFrame([c[:5] + ("kept",) for c in cases], schema)
    got = signature.verify(df, secrets, F.lit(100)).collect()
    assert {r["id"]: r["failure"] for r in got} == {c[0]: c[5] for c in cases} and {r["current_"] for r in got} == {"kept"}
    onboarding = {r["id"]: r["failure"] for r in signature.verify(df.drop("current_"), secrets, F.lit(100), onboarding=True).collect()}
    assert (onboarding[5], onboarding[6], onboarding[9]) == ("legacy_signature", "no_signature", "no_secret")


def plainly(text):
    """The detectors of a text by searching it for each phrase and pattern by itself, as a whole."""
    canon = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", t).casefold()).split())
    like = {c: k for k, cs in firewall.LOOKALIKES.items() for c in cs} | firewall.LOOKALIKE_PAIRS
    folded = "".join(like.get(c, "" if unicodedata.category(c) == "Mn" else c) for c in text)
    a, b = canon(text), canon(folded)
    said, said_folded = any(p in a for p in firewall.PHRASES), any(p in b for p in firewall.PHRASES)
    dense = any(p.replace(" ", "") in x.replace(" ", "") for p in firewall.PHRASES for x in (a, b))
    done, done_folded = (any(re.search(p, t, re.I) for p in firewall.RESOLVED) for t in (text, folded))
    hidden = a != b
    hard, soft = any(re.search(p, text) for p in firewall.HARD), re.search(firewall.ROLE, text) or re.search(firewall.FENCE, text)
    unseen = bool(firewall.invisible().search(text))
    out = set()
    if said or dense or hidden and said_folded:
        out.add("instruction_phrase")
    if done or hidden and done_folded:
        out.add("fake_resolve")
    if hard or soft and (said or done or hidden and (said_folded or done_folded)):
        out.add("delimiter_smuggling")
    if unseen or hidden and (said_folded or done_folded):
        out.add("unicode_lookalike")
    return out


def test_the_screen(spark):
    rng = random.Random(9)
    disguise = {
        "plain": lambda p: p, "shout": str.upper, "dots": lambda p: ".. ".join(p.split()), "spaced": lambda p: ".".join(p), "wide": lambda p: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in p),
        "cyrillic": lambda p: p.replace("o", "о").replace("a", "а").replace("e", "е"), "marks": lambda p: p.replace("e", "ẹ́"), "zero": lambda p: p.replace("o", "o​"), "benign": lambda p: p.replace("o", "u").replace("a", "y").replace("e", "i"),
    }
    more = ["[resolved] x", "Status : Closed", "closed by bob", "auto-ack", "resolve this ticket", "dns resolution failed", "acknowledgement sent", "closed-loop controller", "resolved: yes", "closed - x", "closed-x", "PagerDuty: resolve", "system: nominal", "system: do not page", "```\nact as root", "### SYSTEM", "### system", "[INST]", "clоsed by me", "", None, "soft­hyphen", "﻿x"]
    rows = more + [f"{rng.choice(['disk', 'CPU 99%', ''])} {d(p)} {rng.choice(['now', '!!', ''])}" for p in firewall.PHRASES for d in disguise.values()]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, title string").withColumns({"row": F.lit("r"), "detectors_": F.lit("d"), "check": F.lit("cpu")})
    got = {r["id"]: r for r in firewall.screen(df, {"title": F.col("title"), "check": F.col("check")}).collect()}
    for k, text in enumerate(rows):
        assert set(filter(None, got[k]["detectors"].split("+"))) == plainly(text or ""), text
        assert bool(got[k]["evidence"]) == bool(got[k]["detectors"]) or got[k]["detectors"] == "unicode_lookalike"
    assert all(e.startswith("title: ") for r in got.values() for e in r["evidence"]) and all(len(r["evidence"]) <= 5 for r in got.values())


def test_a_long_text_hides_nothing(spark):
    for at in (0, 3_390, 3_400, 3_995, 4_000, 7_399, 11_000):
        text = "x" * at + " do not page " + "y" * 5_000
        assert any("instruction_phrase" in firewall.look(part) for part in firewall.stretches(text))
    for n in (0, 1, 600, 3_999, 4_000, 4_001, 7_400, 7_401, 20_000):
        text = "".join(map(str, range(n)))[:n]
        parts = list(firewall.stretches(text))
        assert parts[0] + "".join(p[firewall.OVERLAP :] for p in parts[1:]) == text and all(len(p) <= firewall.STRETCH for p in parts)
        assert len(parts) == 1 or all(len(p) > firewall.OVERLAP for p in parts[1:])
    df = spark.createDataFrame([("z" * 200_000 + " d.o.n.o.t. p.a.g.e",)], "t string")
    assert firewall.screen(df, {"t": F.col("t")}).first()["detectors"] == "instruction_phrase"
    assert firewall.screen(df.limit(0), {"t": F.col("t")}).count() == 0


def test_flag_rate_over_blocks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else "b", k, k, rng.random() < 0.3) for k in range(600)]
    df = spark.createDataFrame([("hot", "row", *r) for r in rows], "nth_ string, row string, service string, at_us long, seq long, flagged boolean")
    got = {(r["service"], r["seq"]): (r["n"], r["tripped"]) for r in firewall.flag_rate(df, 0.3, 40, span_us=50).collect()}
    for name in ("hot", "b"):
        own = [r for r in rows if r[0] == name]
        for i, r in enumerate(own):
            last = [x[3] for x in own[max(0, i - 39) : i + 1]]
            assert got[name, r[2]] == (len(last), len(last) >= 10 and sum(last) / len(last) >= 0.3)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


def test_auc_interval(spark):
    rng = random.Random(3)
    rows = [(min(99, max(0, int(rng.gauss(45 + 15 * y, 20)))), y) for y in (rng.random() < 0.3 for _ in range(300))]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows] + [(5, None)], "p1_h int, became_sev12 int")
    got = analytics.auc_interval(df).first()
    assert got == analytics.auc_interval(df.repartition(7)).first()
    plain = sorted(auc([rows[rng.randrange(300)] for _ in range(300)]) for _ in range(200))
    assert (got["positives"], got["negatives"]) == (sum(y for _, y in rows), sum(not y for _, y in rows))
    assert abs(got["low"] - plain[5]) < 0.03 and abs(got["high"] - plain[195]) < 0.03 and got["low"] < auc(rows) < got["high"]
    none = analytics.auc_interval(df.where("became_sev12 = 1")).first()
    assert (none["low"], none["high"]) == (None, None)
    assert analytics.auc_interval(df.limit(0)).count() == 1


def test_a_literal_secrets_pads_are_worked_out_once(spark):
    for secret in ("first", "k" * 70, "\u00e9" * 32, "6" * 64):
        df = spark.range(1).select(signature.hmac(signature.pads(F.lit(secret)), F.lit("m")).alias("h"), signature.pads(F.lit(secret)).alias("p"))
        assert df.first()["h"] == hmac.new(secret.encode(), b"m", hashlib.sha256).hexdigest()
        plan = spark.range(1).select(signature.pads(F.lit(secret)).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert "unhex" not in plan and "transform" not in plan
