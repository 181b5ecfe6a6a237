import hashlib
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from voxelspark.llm import sharding, url_filter, warc


def test_jump_hash_matches_the_published_one_and_moves_little():
    keys = np.array([0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 3000)], dtype=np.int64)
    for n in (1, 2, 24, 25):
        assert sharding.jump_hash(keys, n).tolist() == [brute.jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and (a != b).mean() < 0.08


def test_assign_shards(spark):
    rows = [(i, f"text {i} é") for i in range(500)] + [(7, "text 7 é"), (None, None), (1000, "")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0


def test_slots_of_a_hot_key_and_long_texts(spark):
    rows = [(None, "x")] * 700 + [(1, "é" * 300_000), (1, "y")] + [(5, "z")] * 300
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len(got) == len(rows) and max(r["size"] for r in got) == 600_008


def test_jump_sharding_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    keys = {r.doc_id: (r.h, r.text) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").collect()}
    for r in sharding.assign_shards(docs).collect():
        h, text = keys[r.doc_id]
        raw = (text or "").encode()
        assert (r.shard, r.grown_shard, r["size"], r.text_crc32, r.law) == (brute.jump(h, 24), brute.jump(h, 25), len(raw) + 8, zlib.crc32(raw), "key")


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é" + "x" * 1500, "y" * 999
    rows = [(1, big), (2, big), (3, big), (4, other), (5, other), (6, None), (7, ""), (8, "\r\n\r\nWARC/1.1\r\n\x1f" * 200), (None, big)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(2)
    files = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/w")
    for split in (97, 1000, 1 << 20):
        got = warc.read_archives(files, split).withColumns({"page_id": warc.page_number("record_id"), "refers_to": warc.page_number("refers_to")}).collect()
        assert len(got) == len(rows) and all(r.error is None for r in got)
        for r in got:
            text = dict((k, v or "") for k, v in rows)[r.page_id]
            assert r.payload_bytes == len(text.encode()) and r.payload_digest == hashlib.sha1(text.encode()).hexdigest()
            assert r.record_type == ("revisit" if r.page_id in (1, 2, None) else "response")
            assert r.refers_to == (3 if r.page_id in (1, 2, None) else None)
            assert (r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == text.encode()
    empty = spark.createDataFrame([], "page_id long, html string, payload string")
    assert warc.round_trip(empty).count() == 0


def test_groups_beyond_the_broadcast_and_rolled_archives(spark, tmp_path, monkeypatch):
    rows = [(k, "z" * 1200 + str(k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    few = sorted(map(str, map(tuple, warc.round_trip(df).collect())))
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, map(tuple, warc.round_trip(df).collect()))) == few
    files = warc.write_archives(warc.plan_records(df).coalesce(1), f"file://{tmp_path}/w", archive_bytes=2000)
    assert files.count() > 2 and files.agg({"records": "sum"}).first()[0] == 40
    assert warc.read_archives(files).select("record_id").distinct().count() == 40


def foreign(kind, block, **fields):
    lines = ["WARC/1.0", f"warc-type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length:{len(block)}", "", ""]
    squeeze = zlib.compressobj(9, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def test_archives_of_other_writers_and_damaged_ones(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    mark = {"WARC_Record_ID": "<urn:uuid:1>", "Content_Type": "application/http; msgtype=response"}
    sha, noise = hashlib.sha1(b"body").hexdigest(), b"".join(hashlib.sha256(bytes([k])).digest() for k in range(200))
    good = [
        foreign("warcinfo", b"software: y", WARC_Record_ID="<urn:uuid:0>"), foreign("request", b"GET / HTTP/1.0\r\n\r\n", **mark),
        foreign("response", http + b"body", WARC_Target_URI="http://a/", **mark), foreign("response", http + b"body", WARC_Payload_Digest=f"sha1:{sha}", **mark),
        foreign("response", http + b"body", WARC_Payload_Digest="sha1:" + "A" * 32, **mark), foreign("conversion", "text é".encode()), foreign("revisit", b"", WARC_Refers_To="<urn:uuid:1>"),
    ]
    broken = bytearray(foreign("response", http + noise, **mark))
    broken[len(broken) // 2 :] = b"\xff" * (len(broken) - len(broken) // 2)
    raw = b"".join(good[:3]) + bytes(broken) + b"junk" + b"".join(good[3:]) + foreign("resource", noise)[:-30]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(raw)
    files = spark.createDataFrame([(f"file://{path}", len(raw))], "path string, bytes long")
    for split in (50, 1 << 20):
        got = sorted(warc.read_archives(files, split).collect(), key=lambda r: r.start)
        assert [(r.record_type, r.error) for r in got] == [
            ("warcinfo", None), ("request", None), ("response", None), (None, "not to be decompressed"), ("response", None),
            ("response", "payload differs from its digest"), ("conversion", None), ("revisit", None), ("resource", "ends early"),
        ]
        assert bytes(got[2].payload) == b"body" and got[2].target == "http://a/" and got[4].payload_digest == sha and got[7].refers_to == "urn:uuid:1" and got[7].payload is None


def test_magic_inside_a_record_is_no_record(tmp_path):
    inner = zlib.compress(b"WARC", 9)
    raw = b"".join(warc.record_bytes(k, warc.MAGIC * 50 + inner, hashlib.sha1(warc.MAGIC * 50 + inner).hexdigest(), None, False) for k in range(3))
    file = pa.BufferReader(raw)
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), raw)]
    true = [k for k in starts if warc.first_record(file, k, k + 1, len(raw)) == k]
    assert len(true) == 3 and true[0] == 0


URLS = [
    "http://a.com/x", "https://example.com/en/1", "https://sub.example.com/en/", "http://www.example.com/en/2", "http://x.www.example.com/en/2",
    "http://a.net/es/1", "http://net/fr/", "http://a.net/en/", "HTTP://A.COM", "http://notexample.com/en/", "http://a.com?x=/en/", "nohost", None, "", "x://y://z/a#b",
]


def test_url_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k].rule for k in range(9)] == ["com/", "example.com/en/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None]
    assert [got[k].verdict for k in range(7)] == ["allow", "block", "block", "allow", "allow", "block", "block"]
    assert (got[8].host, got[8].path, got[9].rule, got[10].path) == ("a.com", "", "com/", "")
    assert (got[11].host, got[12].host, got[14].host, got[14].path) == ("", "", "y:", "//z/a")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0


def test_url_models_tell_classes_apart(spark):
    good = [f"http://news{i % 17}.com/story/{i}" for i in range(200)]
    bad = [f"http://win{i % 13}.net/es/casino-{i}" for i in range(200)]
    asked = ["http://blog.org/story/5", "http://spam.org/casino-3"]
    rows = [(k, u) for k, u in enumerate(good + bad + asked)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[400].verdict == "allow" and got[401].verdict == "block"


def test_verdicts_against_plain_models(spark):
    """Score, cut and verdict of every URL by models made here."""
    import re
    from collections import Counter
    from math import log

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    made = [f"http://news{i % 17}.com/story/{i}" for i in range(120)] + [f"http://win{i % 13}.net/es/casino-{i}" for i in range(120)] + [f"http://x{i}.org/{'story' if i % 2 else 'casino-'}/{i}" for i in range(40)]
    long = "http://long.org/" + "a1b2-" * 4000
    df = pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate([*made, long])], "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}

    def string(host, path):
        folded = (host + path).translate(str.maketrans(url_filter.UPPER + "0123456789", url_filter.LOWER + "0" * 10))
        return "^^^" + re.sub(r"[^a-z0/.\-_~%+=&:,@]", "*", folded) + "$"

    rules = {"com/": True, "example.com/en/": False, "www.example.com/en/": True, "net/es/": False, "net/fr/": False}
    strings = {i: string(r.host, r.path) for i, r in got.items()}
    label = {}
    for i, r in got.items():
        if r.rule is not None:
            label[strings[i]] = label.get(strings[i], False) or rules[r.rule]
    held = {r.s for r in spark.createDataFrame([(s,) for s in label], "s string").where("pmod(xxhash64('held', s), 5) = 0").collect()}
    grams = lambda s: [s[i : i + 4] for i in range(len(s) - 3)]

    def model(kind):
        by = [Counter() for _ in range(5)]
        for s, ok in label.items():
            if ok == kind and s not in held:
                for g in grams(s):
                    for k in range(1, 5):
                        by[k][g[4 - k :]] += 1
        total = [Counter() for _ in range(5)]
        kinds = [Counter() for _ in range(5)]
        for k in range(1, 5):
            for g, n in by[k].items():
                total[k][g[:-1]] += n
                kinds[k][g[:-1]] += 1

        def law(g):
            p = 1 / url_filter.ALPHABET
            for k in range(1, 5):
                h = g[4 - k : 3]
                if total[k][h]:
                    p = (by[k][g[4 - k :]] + kinds[k][h] * p) / (total[k][h] + kinds[k][h])
            return p

        return law

    good, bad = model(True), model(False)
    score = {s: sum(log(good(g)) - log(bad(g)) for g in grams(s)) / len(grams(s)) for s in set(strings.values())}
    bins = {s: int(np.floor(max(-8.0, min(8.0, score[s])) / url_filter.BIN + 0.5)) if score[s] >= 0 else -int(np.floor(-max(-8.0, score[s]) / url_filter.BIN + 0.5)) for s in held}
    seen, best = sorted(set(bins.values())), None
    for k, b in enumerate(seen):
        at = (b + (seen[k - 1] if k else b - 1)) / 2
        lost = sum(label[s] and bins[s] < b for s in held) / sum(label[s] for s in held)
        let = 1 - sum(not label[s] and bins[s] < b for s in held) / sum(not label[s] for s in held)
        best = min(x for x in (best, (lost + let, abs(at), at)) if x is not None)
    cut = best[2] * url_filter.BIN
    for i, r in got.items():
        s = score[strings[i]]
        assert abs(r.score - s) < 2e-6
        assert r.verdict == (("allow" if rules[r.rule] else "block") if r.rule is not None else "allow" if s >= cut else "block")


def test_probabilities_match_a_plain_model(spark):
    from collections import Counter

    train = ["^^^aab$", "^^^aba$", "^^^aab$"]
    df = spark.createDataFrame([(t, True) for t in train] + [("^^^bbb$", False)], "_s string, _accepted boolean")
    grams = {t[i : i + 4] for t in [*train, "^^^bbb$", "^^^abb$"] for i in range(len(t) - 3)}
    got = {r.gram: r.delta for r in url_filter.fit_ratio(df, spark.createDataFrame([(g,) for g in grams], "gram string")).collect()}

    def law(texts, gram):
        c = Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3))
        p = 1 / url_filter.ALPHABET
        for k in range(1, 5):
            tails = Counter()
            for g, n in c.items():
                tails[g[4 - k :]] += n
            head, full = gram[4 - k : 3], gram[4 - k :]
            n = sum(v for g, v in tails.items() if g[:-1] == head)
            kinds = sum(1 for g in tails if g[:-1] == head)
            if n:
                p = (tails[full] + kinds * p) / (n + kinds)
        return p

    for g in grams:
        want = np.log(law(train, g)) - np.log(law(["^^^bbb$"], g))
        assert abs(got[g] - want) < 1e-9
