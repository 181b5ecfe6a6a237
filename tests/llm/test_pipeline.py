import brute
import corpus_pipeline
from voxelspark.llm import decontaminate


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    quality, near, repeats, clean, tokens = (f for _, f in corpus_pipeline.STAGES)

    one = quality(spark, docs, sf).persist()
    assert one.columns == docs.columns
    left = {r.doc_id for r in one.collect()}
    assert left <= {i for i, t in rows.items() if not brute.quality(t)["base_failed"]} and len(left) > 0.9 * sum(not brute.quality(t)["base_failed"] for t in rows.values())

    two = near(spark, one, sf).persist()
    parts = brute.near_components([(i, rows[i]) for i in left])
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in parts.items() if i == c}

    three = repeats(spark, two, sf).persist()
    before = [(r.doc_id, r.text) for r in two.orderBy("doc_id").collect()]
    kept = {i: n - gone for (i, _), (n, gone, _, _) in zip(before, brute.repeats([t for _, t in before]), strict=True)}
    after = three.orderBy("doc_id").collect()
    assert three.columns == docs.columns and all(kept[r.doc_id] - 6 * 4 <= len(r.text.encode()) <= kept[r.doc_id] for r in after) and all(r.n_chars == len(r.text) for r in after)

    four = clean(spark, three, sf).persist()
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r.doc_id for r in after if any(x in decontaminate.normal(r.text) for x in items)}
    assert held.isdisjoint({r.doc_id for r in four.collect()}) and four.count() >= len(after) - len(held) - 3

    five = tokens(spark, four, sf)
    assert five.count() == four.count() and five.where("not lossless").isEmpty()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in four.collect())


def test_stages_on_an_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept int, items int, id int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
        if name != "tokens":
            assert docs.columns[-3:] == ["kept", "items", "id"]
