import brute
import pytest
from voxelspark.llm import quality

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.apply_rules(df).collect()
    assert len(got) == len(rows)
    want = sorted((r[0], *(brute.quality(r[1])[m] for m in METRICS)) for r in rows)
    assert sorted((r.doc_id, *(r[m] for m in METRICS)) for r in got) == want
    return {r.doc_id: r for r in got}


def test_small_cases(spark):
    long = " ".join(f"w{i % 7001}x" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\f\x0b\r ", "a"), (4, "one two three", None), (5, "a b c a b c", "a"),
        (6, "a a a a a", "a"), (7, "f\fg\x0bh fine\r\nfor all of four\nfor all of four\n\nx", "b"), (8, long, "b"), (9, "a b c d a b c e b c d", "b"),
        (10, "é è ü " * 40, "b"), (11, "#*$%&|<> word", "b"), (12, " ".join(f"good{i}" for i in range(90)), "b"), (12, " ".join(f"good{i}" for i in range(90)), "b"),
    ]
    got = check(spark, rows)
    assert got[12].kept and not got[1].kept and not got[10].kept


def test_windows_whose_hashes_clash(spark):
    # two windows whose hashes agree in the bits that are sorted by
    fill = lambda n, at: " ".join(f"f{at + k}" for k in range(n))
    a, b = "a1103197 b1103197 c1103197", "a3343839 b3343839 c3343839"
    check(spark, [(1, " ".join([a, fill(30, 0), b, fill(30, 100), a, fill(5, 200)]), "h"), (2, " ".join([a, fill(30, 0), b, fill(30, 100)]), "h")])


def test_repeats_within_long_runs(spark):
    check(spark, [(1, "one two three " * 400, "h"), (2, "x " * 900, "h"), (3, " ".join(f"w{k % 301}" for k in range(2000)), "h")])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    check(spark, [tuple(r) for r in docs.collect()])


def test_strict_host_rejects_single_failures_only_there(spark):
    words = [" ".join(f"word{i}{k}" for i in range(60)) for k in range(40)]
    bad = [w + " ####### ******* $$$$$$" for w in words]
    rows = [(k, b, "bad") for k, b in enumerate(bad[:20])] + [(100 + k, w, "good") for k, w in enumerate(words)]
    rows += [(200, words[0] + " clean", "bad"), (201, bad[30], "good")]
    got = {r.doc_id: r.kept for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(20)) and got[200] and got[201] and all(got[100 + k] for k in range(40))


@pytest.mark.parametrize("extra", [["kept", "_t"], ["n_words", "host_rate"], ["_w", "_k", "soft", "_lines", "host"]])
def test_empty_and_clashing_columns(spark, extra):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra)
    df = spark.createDataFrame([], schema)
    assert quality.apply_rules(df).count() == 0
    assert quality.keep_documents(df).columns == df.columns
    row = (1, " ".join(f"good{k}" for k in range(60)), "h", *("mine" for _ in extra))
    assert [tuple(r) for r in quality.keep_documents(spark.createDataFrame([row], schema)).collect()] == [row]
    got = quality.apply_rules(spark.createDataFrame([row], schema)).first()
    assert got.kept and all(got[c] == "mine" for c in extra if c not in (*quality.METRICS, "host_rate", "kept"))
