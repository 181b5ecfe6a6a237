import itertools
from collections import Counter

import numpy as np
import pytest
from voxelspark.llm import pieces

TEXTS = [
    "", " ", "  a  b ", "a\nb\n\n c\t\r\x0b", "▁ marks ▁▁", "漢字 and ḁ̊ 🙂🙃 \U0001f9ff", "x" * 3000, "word " * 2000, "\x00 nul", "tail space ", None, "é" * 200,
    "antidisestablishmentarianism the the the",
]


def test_round_trip_and_reproduction(spark):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    one = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
    two = {r.doc_id: r for r in pieces.encode(df.orderBy("doc_id", ascending=False).repartition(3)).collect()}
    for k, t in enumerate(TEXTS):
        assert one[k].decoded == t and one[k].ids == two[k].ids
    assert one[0].ids == [] and one[10].ids is None
    again = spark.createDataFrame([(1, TEXTS[12]), (2, TEXTS[12]), (1, TEXTS[12]), (None, "x")], "doc_id long, text string")
    got = [r.ids for r in pieces.encode(again).collect()]
    assert got[0] == got[2]
    assert pieces.round_trip(df.limit(0)).count() == 0
    assert all(r.lossless for r in pieces.round_trip(df).collect())


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "some text", "a", "b", "c")], "doc_id long, text string, _key string, key string, ids string")
    made = pieces.decode(pieces.encode(df))
    assert made.columns == ["doc_id", "text", "_key", "key", "ids", "decoded"]
    row = made.first()
    assert (row._key, row.key, row.decoded) == ("a", "b", "some text") and row.ids


def test_a_task_leaves_nothing_remembered():
    import pyarrow as pa

    step = pieces._Encode(0, 1, pieces.MODEL, 1)
    step(pa.RecordBatch.from_arrays([pa.array(["one two three"]), pa.array([5], pa.int64())], names=["t", "k"]))
    assert step.lattice.last and step.lattice.first.size
    step.close()
    assert not step.lattice.last and not step.lattice.first.size


def test_decoding_agrees_with_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello world, this is a test", "éàü ß 漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode(df).collect():
        assert sp.decode(r.ids) == r.text


@pytest.mark.parametrize("unit", [" then", " aéb", "\n", " ḁx", " of"])
def test_samples_follow_the_weights_of_all_segmentations(unit):
    lattice = pieces.Lattice(pieces.MODEL)
    spell = pieces.pieces(pieces.MODEL)[2]
    weights = {v[0]: v[1] for v in lattice.known.values()}

    def ways(rest):
        if not rest:
            return [((), 1.0)]
        out = []
        for n in range(1, len(rest) + 1):
            got = lattice.known.get(rest[:n])
            if got:
                out += [((got[0], *w), got[1] * p) for w, p in ways(rest[n:])]
        if rest[0] not in lattice.known:
            ids = tuple(lattice.of_byte[b] for b in rest[0].encode())
            out += [((*ids, *w), pieces.RARE * p) for w, p in ways(rest[1:])]
        return out

    want = dict(ways(unit))
    total = sum(want.values())
    n = 40_000
    ids, count = lattice.sample([unit] * n, pieces.mix(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(count)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, count, strict=True))
    assert all(b"".join(spell[i] for i in s) == unit.encode() for s in seen) and set(seen) <= set(want)
    for s, p in itertools.islice(sorted(want.items(), key=lambda x: -x[1]), 5):
        p /= total
        assert abs(seen[s] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    assert weights


HELD = """
import random, re, threading, time
import pyarrow as pa
from voxelspark.llm import pieces

anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
most, draw = [0.0], random.Random(5)
word = lambda: "".join(draw.choices("etaoinshrdlucmfwyp", k=draw.randint(3, 9)))
known = [word() for _ in range(60_000)]
texts = [" ".join(draw.choices(known, k=500)) for _ in range(2_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["d", "t", "k"])
del texts, known
run = pieces._digests(pieces.MODEL, 1)
list(run(iter([batch.slice(0, 1)])))
pieces._Decode(0, pieces.MODEL)

def look():
    while True:
        most[0] = max(most[0], anon())
        time.sleep(0.002)

before = anon()
threading.Thread(target=look, daemon=True).start()
rows = sum(b.num_rows for b in run(iter([batch])))
print(rows, round(most[0] - before), round(anon() - before))
"""


def test_a_task_takes_little_memory_and_leaves_none():
    """2,000 rows of 3,500 bytes of many different words, in a process of their own as in a worker."""
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout
    rows, most, left = map(int, said.split())
    assert rows == 2_000 and most < 65 and left < 20, said
