"""The screen of alerts for text that speaks to the model instead of describing a fault.

A text is looked at in overlapping stretches, so that its length bounds no work and
hides nothing. Four detectors: phrases of instruction, in a canonical form, without its
spaces, and after letters that only look Latin are folded; marks of a faked resolution;
delimiters of prompts; and disguise itself, that is invisible characters, or a hit that
only folding shows. All phrases are searched at once by an automaton. A hit pages; the
screen never suppresses. Texts are screened batch by batch in Arrow.

Null and empty texts have no hits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a stretch, and how many of them the next one sees again.
STRETCH, OVERLAP = 4_000, 600
#: Pieces of evidence of an alert, of a detector and stretch, and characters of one.
EVIDENCE, EACH, EVIDENCE_CHARS = 5, 2, 80

# Names, phrases, patterns and characters that must be the same for results to be.
DETECTORS = ["instruction_phrase", "fake_resolve", "delimiter_smuggling", "unicode_lookalike"]
REASON = "firewall_flagged"
PHRASES = """ignore previous instructions
ignore all previous instructions
disregard previous instructions
disregard all instructions
forget your instructions
override your instructions
update your instructions
new instructions
system instruction
do not page
dont page
never page
do not notify
dont notify
never notify
do not alert
suppress this alert
suppress the alert
suppress all alerts
mark as resolved
mark resolved
resolve this alert
resolve and close
acknowledge and close
close the incident
auto acknowledge
you are now
act as
pretend you are
roleplay as
from now on
bypass the gate
skip the race
skip jev
false alarm
not a real alert
do not page oncall
this is a drill
test alert do not""".split("\n")
RESOLVED = r"""\[(resolved|closed|acknowledged|acked|ack)\]
\((resolved|closed|acknowledged|acked|ack)\)
\bstatus\s*:\s*(resolved|closed|acknowledged|acked)\b
\b(resolved|closed|acknowledged|acked|ack)\s+by\b
\bmarked?\s+as\s+(resolved|closed|acknowledged)\b
\bauto[\s\-_]?(resolve|resolved|ack|acknowledge|close|closed)\b
\bresolve\s+(this\s+)?(ticket|incident|alert|case)\b
\bresolve\s+this\b
^\s*(resolved|closed|acknowledged|acked|ack)\s*([:—–]|\-(?=\s|$))
\backnowledge\s+(this\s+)?(ticket|incident|alert|case)\b
\b(close|resolve)\s+(this\s+)?incident\b
pagerduty\s*:\s*(resolve|acknowledge)
\bno\s+action\s+(needed|required)\b""".split("\n")
HARD = r"""<\|im_start\|>
<\|im_end\|>
\[INST\]
\[/INST\]
<<SYS>>
<</SYS>>
###\s*system\b
###\s*instruction
\bBEGIN\s+(PROMPT|INSTRUCTIONS?|SYSTEM)\b
\bEND\s+OF\s+(ALERT|PROMPT|INSTRUCTIONS?)\b
---\s*NEW\s+INSTRUCTIONS?\s*---""".split("\n")
ROLE, FENCE = r"(?im)^\s*(system|user|assistant)\s*:", r"(?m)```|~~~|^\s*(#{2,}|={3,}|-{3,}|\*{3,})\s*$"
INVISIBLE = "00ad 034f 061c 115f-1160 17b4-17b5 180e 200b-200f 202a-202e 2060-2064 2066-2069 fe00-fe0f feff e0000-e0002 e0020 e0041"
#: Letters by the Latin ones that they look like: Cyrillic, Greek, others.
LOOKALIKES = {
    "a": "аАαΑ", "b": "Вƅ", "c": "сС", "d": "ԁƌ", "e": "еЕεΕ", "f": "ƒ", "g": "Ԍɡ", "h": "һнНʜ", "i": "іІιΙı", "j": "јЈ", "k": "кКκΚʞ", "l": "ӏłʟ", "m": "мМμΜ",
    "n": "ηΗɴ", "o": "оОοΟøᴏ", "p": "рРρΡᴘ", "q": "ԛԚ", "r": "ʀ", "s": "ѕЅſ", "t": "тТτΤᴛ", "u": "υᴜ", "v": "νΝ", "w": "ԝԜωᴡ", "x": "хХχΧ", "y": "уУʏ", "z": "ζΖᴢ",
}
LOOKALIKE_PAIRS = {"œ": "oe", "æ": "ae", "ß": "ss", "ԏ": "t", "υ": "u", "Υ": "u"}


@cache
def folding() -> dict[int, str | None]:
    """What folding makes of characters, for translate: lookalikes become Latin, combining marks go."""
    marks = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Mn"}
    return marks | {ord(c): latin for latin, like in LOOKALIKES.items() for c in like} | {ord(c): s for c, s in LOOKALIKE_PAIRS.items()}


@cache
def invisible() -> re.Pattern:
    spans = [s.split("-") for s in INVISIBLE.split()]
    return re.compile("[" + "".join(f"{chr(int(s[0], 16))}-{chr(int(s[-1], 16))}" for s in spans) + "]")


@cache
def patterns() -> tuple[list[re.Pattern], list[re.Pattern], re.Pattern, re.Pattern]:
    return [re.compile(p, re.IGNORECASE) for p in RESOLVED], [re.compile(p) for p in HARD], re.compile(ROLE), re.compile(FENCE)


@cache
def automaton(spaced: bool):
    """All phrases, with or without their spaces."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, phrase in enumerate(PHRASES):
        own = phrase if spaced else phrase.replace(" ", "")
        out.add_word(own, (k, own))
    out.make_automaton()
    return out


def canonical(text: str) -> str:
    """NFKC, case folded, runs of other than a-z and 0-9 as one space."""
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


def stretches(text: str) -> Iterator[str]:
    """A text's overlapping stretches; what is not longer than the overlap is whole in one of them."""
    yield text[:STRETCH]
    for begin in range(STRETCH - OVERLAP, len(text) - OVERLAP, STRETCH - OVERLAP):
        yield text[begin : begin + STRETCH]


def phrases(text: str, spaced: bool) -> list[str]:
    """Phrases in a text, in order of the list."""
    return [p for _, p in sorted({found for _, found in automaton(spaced).iter(text)})]


def first_of(expressions: list[re.Pattern], text: str) -> list[str]:
    return [m.group(0) for e in expressions if (m := e.search(text))]


def look(text: str) -> dict[str, list[str]]:
    """The detectors that a stretch meets, each with its evidence."""
    resolved, hard, role, fence = patterns()
    bare, folded_text = canonical(text), text.translate(folding())
    folded = canonical(folded_text)
    hidden = folded != bare
    said, dense = phrases(bare, True), phrases(bare.replace(" ", ""), False)
    said_hidden = phrases(folded, True) if hidden else []
    dense_hidden = phrases(folded.replace(" ", ""), False) if folded.replace(" ", "") != bare.replace(" ", "") else []
    done, done_hidden, marks = first_of(resolved, text), first_of(resolved, folded_text) if hidden else [], first_of(hard, text)
    soft = role.search(text) or fence.search(text)
    unseen = invisible().search(text)
    short = lambda found: [re.sub(r"\s+", " ", f).strip()[:EVIDENCE_CHARS] for f in found[:EACH]]
    out: dict[str, list[str]] = {}
    if said or said_hidden or dense or dense_hidden:
        out["instruction_phrase"] = (said + said_hidden + dense + dense_hidden)[:EACH]
    if done or done_hidden:
        out["fake_resolve"] = short(done + done_hidden)
    if marks or soft and (said or done or said_hidden or done_hidden):
        out["delimiter_smuggling"] = short(marks) or ["role/fence delimiter + injection content"]
    if unseen or said_hidden or done_hidden:
        out["unicode_lookalike"] = ["invisible/format characters present"] if unseen else []
    return out


def screen(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """rows with detectors (joined by +, in order of their first hit; empty: none) and evidence, over named texts."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    texts = rows.select(row.alias("row"), F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("text")) for n, c in fields.items()]).alias("texts"))
    kind = texts.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shown = [], []
            for texts in batch.column(1).to_pylist():
                names, evidence = {}, []
                for field in texts:
                    for part in stretches(field["text"]) if field["text"] else ():
                        for name, hits in look(part).items():
                            names[name] = True
                            evidence += [f"{field['name']}: {h}" for h in hits]
                found.append("+".join(names)), shown.append(evidence[:EVIDENCE])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(shown, pa.list_(pa.string()))], ["row", "detectors", "evidence"])

    return texts.mapInArrow(run, f"row {kind}, detectors string, evidence array<string>").select("row.*", "detectors", "evidence")


def flag_rate(rows: DataFrame, threshold: float, last: int = 1_000, key: str = "service", span_us: int = 86_400_000_000) -> DataFrame:
    """rows (key, at_us, seq, flagged) with n and tripped: the share of flagged ones among the key's last rows reaches the threshold, and there are enough of them to tell.

    Rows are numbered over all of a key's time and dealt by blocks of `last`, each with the block before, so no task gets a whole key.
    """
    from tidewatch.operators import asof

    numbered = asof.running(rows, key, span_us)
    spread = numbered.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", F.floor((F.col("nth") - 1) / last) + F.col("late"))
    w = Window.partitionBy(key, "block").orderBy("nth").rowsBetween(1 - last, 0)
    n, hits = F.count(F.lit(1)).over(w), F.sum(F.coalesce(F.col("flagged").cast("int"), F.lit(0))).over(w)
    out = spread.withColumns({"n": n, "hits": hits}).where("late = 0").drop("late", "block", "nth")
    return out.withColumn("tripped", (F.col("n") >= max(10, last // 10)) & (F.col("hits") / F.col("n") >= threshold)).drop("hits")
