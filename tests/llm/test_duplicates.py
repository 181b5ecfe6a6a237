import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelspark.llm import common, minhash, suffix_dedup


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def near_rows():
    rows = []
    for g in range(12):
        base = words(g, 120)
        for k in range(4):
            copy = list(base)
            for j in range(k):
                copy[(g * 7 + j * 31) % len(copy)] = f"x{g}{k}{j}"
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(500 + k, " ".join(words(99, 80))) for k in range(30)]  # one large group of copies
    rows += [(600, None), (601, ""), (602, " \n\t"), (603, "One two"), (604, "one\ttwo"), (605, "one two three"), (606, "É é"), (607, "é é")]
    rows += [(700 + k, " ".join(words(1000 + k, 60))) for k in range(40)]
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near_components(rows)
    assert got[603] == got[604] == (1, 603) and got[600] == (0, 600) and got[606][1] == 606
    assert all(r.kept == (r.id == r.component_id) for r in minhash.near_duplicates(df).collect())


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, "q r s t u v w"), (3, "a b c d e f"), (4, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 1, False)]
    clash = df.select("doc_id", "text", F.lit(1).alias("id"), F.lit(2).alias("kept"), F.lit(3).alias("k1"))
    kept = minhash.keep_first(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_first(clash.limit(0)).count() == 0


def test_large_groups_of_one_template_against_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    base = words(77, 400)
    rows = []
    for k in range(1000):
        copy = list(base)
        for at in r.sample(range(400), r.randrange(6, 10)):
            copy[at] = f"y{r.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(minhash, "BLOCK", 60_000)  # several blocks to a region
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in minhash.near_duplicates(df).collect()}
    ids, texts = [i for i, _ in rows], [t.encode() for _, t in rows]
    sets = [np.unique(common.shingles(*common.words_of_many([t]), minhash.WORDS)[0]) for t in texts]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.zeros((len(sets), column.max() + 1), np.float32)
    table[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    both, n = table @ table.T, np.array([len(s) for s in sets])
    links = 100 * both >= minhash.SIMILARITY * (n[:, None] + n[None, :] - both)
    comp = np.array(ids)
    while True:  # the least id that a row is linked to, until nothing moves
        new = np.where(links, comp[None, :], len(ids)).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    assert got == dict(zip(ids, comp.tolist(), strict=True)) and 1 < len(set(got.values())) < 1000


def test_candidates_do_not_depend_on_plans(spark):
    rows = [(k, " ".join(words(5, 200)[k % 3 :])) for k in range(60)] + near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = minhash.signatures(df).where("n_shingles > 0").select("id", "sig").persist()
    one = {tuple(r) for r in minhash.candidates(signed).collect()}
    changed = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.exchange.reuse": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    many = {tuple(r) for r in minhash.candidates(signed).collect()}
    for k, v in before.items():
        spark.conf.set(k, v)
    assert one == many and len(one) < len(rows) * minhash.TREES * minhash.REACH


def test_blocks_of_an_order_see_what_the_whole_sees(spark, monkeypatch):
    df = spark.createDataFrame(near_rows(), "doc_id long, text string")
    signed = minhash.signatures(df).where("n_shingles > 0").select("id", "sig").persist()
    whole = {tuple(r) for r in minhash.candidates(signed).collect()}
    monkeypatch.setattr(minhash, "ORDER_BLOCK", 20)
    assert {tuple(r) for r in minhash.candidates(signed).collect()} == whole


def test_numbers_of_an_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    rows = common.numbered(df, "x").collect()
    assert sorted((r._at, r.x) for r in rows) == [(k, k) for k in range(1000)]
    parts = common.in_blocks(common.numbered(df, "x"), 100, 5).groupBy("_b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("_b").collect()
    own = [r for r in parts if r.lo < 1000 and r.n > 5]
    assert [(r.lo, r.hi) for r in own] == [(max(0, 100 * k - 5), min(999, 100 * k + 104)) for k in range(10)]


def test_pairs_near_the_threshold_in_a_crowd(spark):
    # texts of one template: unrelated pairs lie just below the threshold, planted ones just above
    r = random.Random(11)
    template = [f"t{k}" for k in range(404)]
    rows = []
    for k in range(400):
        own = [f"o{r.randrange(10**9)}" for _ in range(72)]
        rows.append((2 * k, " ".join(template + own)))
        rows.append((2 * k + 1, " ".join(template + own[:15] + [f"p{r.randrange(10**9)}" for _ in range(57)])))
    got = {x.id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = dict((i, set(np.unique(common.shingles(*common.words_of_many([t.encode()]), minhash.WORDS)[0]).tolist())) for i, t in rows)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(0, 1) >= 0.75 > like(0, 2)
    assert all(got[2 * k] == got[2 * k + 1] for k in range(400)) and len(set(got.values())) == 400


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{200 + k: 100 for k in range(50)}, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_need_no_rounds(spark, monkeypatch):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(r.randrange(100, 700), r.randrange(100, 700)) for _ in range(400)] + [(9, 9)]
    first, more = (spark.createDataFrame(x, "a long, b long") for x in (edges, [(0, 650), (900, 901), (60, 901)]))
    write, found = common.written, []
    for few in (1 << 17, 0):
        made = []
        monkeypatch.setattr(common, "written", lambda df: made.append(1) or write(df))
        monkeypatch.setattr(common, "FEW_EDGES", few)
        same = common.components(first)
        assert (len(made) <= 2) == (few > 0)
        assert common.tied(same, more.limit(0)) is same
        found.append([sorted(map(tuple, x.collect())) for x in (same, common.tied(same, more), common.components(first.union(more)))])
        assert found[-1][1] == found[-1][2] != found[-1][0]
    assert found[0] == found[1]


def test_word_hashes_tell_words_apart():
    data = b"One\ttwo  one\x0btwo three\ntwo"
    h, start, end = common.word_hashes(np.frombuffer(data, np.uint8))
    assert [data[a:b] for a, b in zip(start, end, strict=True)] == data.split()
    assert h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    long = b"word other " * 300_000
    assert np.array_equal(common.text_words(long), common.word_hashes(np.frombuffer(long, np.uint8))[0])


def repeat_rows():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 450, 900)]
    rows = [(k, text(300) + shared[k % 5] + text(150) + shared[(k + 1) % 5]) for k in range(25)]
    rows += [(100 + k, text(800)) for k in range(8)] + [(200, rows[0][1]), (201, rows[0][1])]
    rows += [(300, "ab" * 400), (301, "x" * 200), (302, "y" * 201), (303, None), (304, ""), (305, "short"), (306, text(150) * 3)]
    return rows


def check_repeats(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suffix_dedup.digest(df).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute.repeats([t for _, t in rows]), strict=True))


def test_repeats_against_counting(spark):
    check_repeats(spark, repeat_rows())


@pytest.mark.parametrize("most", [1, 3, 40])
def test_crowded_anchors_are_dealt_again(spark, monkeypatch, most):
    rows = repeat_rows()
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core = text(120)  # one string in many surroundings, some of them alike on one side or both
    sides = [text(130) for _ in range(6)]
    rows += [(1000 + k, text(20) + sides[k % 6][-60 - k :] + core + sides[k % 5][: 70 + k] + text(30)) for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", most)
    check_repeats(spark, rows)


def test_merging_of_blocks_by_search():
    r = random.Random(8)
    core = bytes(r.randrange(97, 105) for _ in range(260))
    segments = {k: [bytes(r.randrange(97, 105) for _ in range(39 + k)) + bytes([65 + k]) + core + bytes([65 + k]) * 30, False] for k in range(12)}
    segments[12] = [bytes(r.randrange(97, 105) for _ in range(280)), False]
    plain = sorted(suffix_dedup.repeated_windows([(1, segments)]))
    before, suffix_dedup.BLOCK = suffix_dedup.BLOCK, 700
    try:
        assert sorted(suffix_dedup.repeated_windows([(1, segments)])) == plain
    finally:
        suffix_dedup.BLOCK = before
    assert [p[1:] for p in plain] == [(k, 40 + k, 300 + k) for k in range(12)]


@pytest.mark.parametrize("text", [b"banana" * 60, b"abcabcabc", b"a" * 300, bytes(range(256)) * 3, b"x"])
def test_suffix_arrays(text):
    data = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(data, 1024)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    lcp = suffix_dedup.common_prefixes(data, order, np.array([0]))
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_long_text_is_taken_in_blocks(spark):
    r = random.Random(2)
    piece = "".join(r.choice("abcdefghij ") for _ in range(5000))
    long = "".join(r.choice("abcdefghij ") for _ in range(1_060_000)) + piece
    got = {x.doc_id: x for x in suffix_dedup.digest(spark.createDataFrame([(1, long), (2, "zz" + piece), (None, piece[:250])], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[None].n_removed) == (5000, 5000, 250) and got[1].n_spans == 1


def test_texts_after_removal(spark):
    shared = "é" * 150
    df = spark.createDataFrame([(1, "a" + shared + "b", 5, "p"), (2, "c" + shared + "d", 6, "q"), (3, None, 7, "r")], "doc_id long, text string, _k long, spans string")
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "ab", 5, "p"), (2, "cd", 6, "q"), (3, None, 7, "r")]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
