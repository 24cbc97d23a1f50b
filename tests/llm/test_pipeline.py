"""The pipeline as a whole, over the smallest tables."""

import corpus_pipeline
from tidewatch.llm import secrets

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert len(corpus_pipeline.STAGES) == 5
    assert set(out.columns) >= {"doc_id", "n_tokens"}
    assert 0.5 * docs.count() < len(rows) <= docs.count()
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_stages_on_planted_cases(spark, tmp_path):
    """Each stage but the first and last on a small table: what goes, what changes, and that clean documents stay as they are."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    passage = words("bench", 30)
    rows = [(1, words("a", 60)), (2, words("a", 60)), (3, words("a", 60) + " more"), (4, words("b", 60)), (5, f"{words('c', 40)} {passage} {words('d', 40)}"), (6, passage + " end"), (7, words("e", 20) + " password=hunter2222 " + words("f", 20)), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("i", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    given = dict(rows)

    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = text(kept)
    assert len(left) == 7 and len({1, 2, 3} & set(left)) == 1
    assert all(given[i] == t for i, t in left.items())

    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    left = text(clean)
    assert set(left) == set(given) - {6}
    assert left[5].split() == (words("c", 40) + " " + words("d", 40)).split()
    assert all(given[i] == t for i, t in left.items() if i != 5)

    redacted = corpus_pipeline.secret_scan(spark, docs, str(tmp_path))
    assert redacted.columns == docs.columns
    left = text(redacted)
    assert set(left) == set(given) and "hunter2222" not in left[7]
    assert all((given[i] or "") == (t or "") for i, t in left.items() if i != 7)
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.where("doc_id = 7").collect())


def test_scattered_edits_are_near_duplicates(spark, tmp_path):
    """Two changed words of 104: 90 of 110 five-word shingles in common, but 96 of 108 of three words."""
    words = [f"w{k}" for k in range(104)]
    edited = [f"edit{k}" if k in (30, 70) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), "aa", "s", 0), (2, " ".join(edited), "aa", "s", 0), (3, "another text", "aa", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    names = "lang_pred string, score double, n_words long, items string, __none string, c long, component string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    extra = ("x", 1.0, 1, "i", "n", 1, "k")
    texts = [(1, "kara mala tara " * 5, "aa"), (2, "kara mala tara " * 5, "aa"), (3, None, None), (4, "", "bb"), (5, "öxi lüti zök " * 5, "bb"), (5, "öxi lüti zök " * 5, "bb")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, *extra) for i, t, lang in texts], schema)
    spark.createDataFrame([("i", "zök lüti")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, docs.limit(0)):
        counts = []
        for _, stage in corpus_pipeline.STAGES[:4]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns
            counts.append(df.count())
        counts.append(corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).count())
        assert counts == ([4, 2, 2, 2, 2] if max(counts) else [0] * 5)


def test_language_stage_without_languages(spark):
    rows = lambda lang: spark.createDataFrame([(1, "a b", lang), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(r[0] for r in corpus_pipeline.language_id(spark, rows(None), "").collect()) == [1, 2]
    assert [r[0] for r in corpus_pipeline.language_id(spark, rows("x"), "").collect()] == [1]


def test_stages_with_the_names_that_they_use_inside(spark, tmp_path):
    """Whatever a stage calls its own columns, a document may have them."""
    inside = "row key hash spans found_assign found_access found_hex __kinds __key __key2 __row __text __id __x __own __hash __n_words __items __ends __lang __score found_lang found_score id x n t c a".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in inside)
    extra = tuple(f"own {n}" for n in inside)
    texts = [(1, "kara mala password=hunter2222 tara " * 3, "aa"), (2, "kara mala password=hunter2222 tara " * 3, "aa"), (3, "öxi lüti zök " * 5, "bb"), (None, "mala kara " * 9, "aa")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, *extra) for i, t, lang in texts], schema)
    spark.createDataFrame([("i", "zök lüti nix")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
    rows = df.collect()
    assert len(rows) == 3 and all(tuple(r[n] for n in inside) == extra for r in rows)
    assert not any("hunter" in r["text"] for r in rows)


def test_redaction_of_many_and_overlapping_spans(spark):
    import random
    import re
    import time

    rng = random.Random(5)
    part = lambda: rng.choice(["é東 ", "😀", "plain words ", "password=" + "a1b2" * rng.randint(1, 9) + " ", "f" * rng.randint(20, 40) + " ", "AKIA" + "Z9" * 9 + " ", "token: 'deadbeefdeadbeefdeadbeefdeadbeef' "])
    texts = ["".join(part() for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "password=hunter2222"]
    rules = [*secrets.BASE, *secrets.MORE]
    want = []
    for k, t in enumerate(texts):
        out, at = [], 0
        for a, b in sorted(s for r in rules for s in secrets.plain_matches(t or "", r)):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want.append((k, t if not out else "".join(out) + t[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, secrets.redact(docs).collect())) == want
    took = []
    for n in (10, 10_000):
        long = " ".join(f"secret=value{k:06d} and {k} words" for k in range(n))
        one = spark.createDataFrame([(1, long)], "doc_id long, text string")
        secrets.redact(one).collect()
        began = time.time()
        got = secrets.redact(one).first()["text"]
        took.append(time.time() - began)
        assert got == re.sub(r"secret=value\d+", "[SECRET]", long)
    assert took[1] - took[0] < 3  # the rest is planning, whatever the text


def test_near_duplicates_send_texts_to_python_in_small_batches(spark):
    import pyarrow as pa
    from tidewatch.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["id"])

    had = spark.conf.get(common.BATCH)
    out = common.stored(spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "id long"), "sizes", common.BATCH_ROWS)
    assert [r["id"] for r in out.collect()] == [1_000] * 5 and spark.conf.get(common.BATCH) == had
