import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from voxelspark import cli, queries
from voxelspark.functions import address, values
from voxelspark.functions.values import ErrorPolicy
from voxelspark.meta import VolumeMeta, align_up
from voxelspark.operators import codec, extents, requests, scores, stats, verify
from voxelspark.plans import formats, strategy

INF, NAN = math.inf, math.nan
STRICT = [
    (1, 1, True), (1, 1.00099, True), (1000, 1001, False), (1, 1.002, False), (0, 0, True), (0, 1e-12, False), (-0.0, 0, True),
    (NAN, NAN, True), (NAN, 0, False), (INF, INF, True), (-INF, -INF, True), (INF, -INF, False), (INF, 1e30, False),
]
LEGACY = [(1e-7, 1.5e-7, True), (1e-7, 2e-6, False), (0, 1e-7, True), (0, 2e-6, False), (NAN, 1.0, False), (5.0, 5.001, True)]


@pytest.mark.parametrize(("policy", "rows"), [("strict", STRICT), ("legacy", LEGACY)])
def test_error_policies(spark, policy, rows):
    df = spark.createDataFrame([(float(np.float32(a)), float(np.float32(b)), w) for a, b, w in rows], "ref float, got float, want boolean")
    got = verify.pointwise(df, ErrorPolicy(policy)).collect()
    assert [r.passed for r in got] == [r.want for r in got]


def test_other_policies_and_missing_cells(spark):
    df = spark.createDataFrame([(NAN, 1.0), (1.0, 1.002), (0.0, 5e-4), (0.0, 2e-3)], "ref double, got double")
    assert [r.passed for r in verify.pointwise(df, ErrorPolicy("tool")).collect()] == [True, False, False, False]
    assert [r.passed for r in verify.pointwise(df, ErrorPolicy("api")).collect()] == [True, False, True, False]
    with pytest.raises(ValueError):
        ErrorPolicy("kind").passes("ref", "got")
    a = spark.createDataFrame([(0, 0, k, 1.0) for k in range(4)], "x long, y long, z long, v float")
    s = verify.summary(verify.paired(a, a.where("z < 3")), ErrorPolicy()).first()
    assert (s.valid_count, s.violation_count, s.passed) == (4, 1, False)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**21 - 1)] * 3), min_size=1, max_size=50))
def test_morton_and_back(spark, points):
    df = spark.createDataFrame(points, "x long, y long, z long").withColumn("morton", address.morton())
    x, y, z = address.unmorton()
    for r in df.select("x", "y", "z", "morton", x.alias("a"), y.alias("b"), z.alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.x, r.y, r.z)
        assert r.morton == sum(((r[k] >> b) & 1) << (3 * b + k) for b in range(21) for k in range(3))


def test_descriptor_and_shapes(spark):
    with pytest.raises(Exception, match="record size"):
        spark.createDataFrame([(1, 8192)], "codec int, size int").select(address.descriptor()).collect()
    for bad in [((0, 1, 1),), ((4, 4, 4), (6, 6, 6), (4, 4, 4)), ((4, 4, 4), (128, 128, 128), (2, 2, 2))]:
        with pytest.raises(ValueError):
            VolumeMeta(*bad[0], *bad[1:])
    assert align_up(4097) == 8192 and VolumeMeta(65, 1, 1).grid == (2, 1, 1)


def test_value_classes_and_exponents(spark):
    rows = [(0.0, "zero"), (-0.0, "zero"), (NAN, "nan"), (INF, "inf"), (1e-40, "subnormal"), (1.0, "normal")]
    df = spark.createDataFrame(rows, "v float, want string")
    assert df.where(values.value_class("v") != F.col("want")).isEmpty()
    powers = spark.createDataFrame([(float(2.0**k / 7.5e-4),) for k in range(-20, 20)], "v double")
    for (v, e), k in zip(powers.select("v", values.tolerance_exponent("v")).collect(), range(-20, 20), strict=True):
        assert 2.0**e <= v * 7.5e-4 < 2.0 ** (e + 1) and abs(e - k) <= 1


LEAVES = {
    "zero": np.zeros(64), "constant": np.full(64, 3.25), "ramp": 0.1 * np.arange(64) + 1, "signs": (np.arange(64) + 0.5) * (-1.0) ** np.arange(64),
    "small": 1e-5 * (np.arange(64) + 1), "range": 10.0 ** (np.arange(64) - 30), "subnormal": np.full(64, 1e-42) * np.arange(64),
    "special": np.r_[NAN, INF, -INF, 0.0, -0.0, 1e-42, np.linspace(1, 2, 58)], "outlier": np.r_[1e-6, np.linspace(100, 101, 63)],
}


@pytest.mark.parametrize("name", LEAVES)
def test_leaf_forms(name):
    leaf = LEAVES[name].astype(np.float32)[None]
    for mask in (-1, 0x7FFF_FFFF, 0x0F0F_0F0F_0F0F_0F0F):
        form, payload = codec.encode_leaves(leaf, np.array([mask]))
        back = codec.decode_leaf(int(form[0]), payload[0], mask)
        inside = codec._inside(np.array([mask]), 64)[0]
        assert codec.passes(leaf[0][inside], back[inside]).all() and not back[~inside].any()
        assert len(payload[0]) <= 256
    want = {"zero": codec.ZERO, "constant": codec.CONSTANT, "special": codec.EXCEPTIONS, "outlier": codec.EXCEPTIONS}
    if name in want:
        assert codec.encode_leaves(leaf, np.array([-1]))[0][0] == want[name]


def test_random_leaves_and_damage():
    rng = np.random.default_rng(1)
    data = (rng.standard_normal((500, 64)) * 10.0 ** rng.integers(-30, 30, (500, 1))).astype(np.float32)
    data[rng.random(data.shape) < 0.02] = 0
    form, payload = codec.encode_leaves(data, np.full(500, -1))
    for k in range(500):
        assert codec.passes(data[k], codec.decode_leaf(int(form[k]), payload[k], -1)).all()
    for f, p in ((codec.RAW, b"x"), (codec.CONSTANT, b""), (codec.STEPS, b"\0" * 6), (codec.EXCEPTIONS, b"\0" * 9), (9, b""), (codec.ZERO, b"1")):
        with pytest.raises(ValueError):
            codec.decode_leaf(f, p, -1)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 40)), min_size=1, max_size=60))
def test_merged_extents_cover_their_inputs(spark, rows):
    df = spark.createDataFrame([(1, o, s) for o, s in rows], "f int, offset long, size long")
    got = sorted((r.offset, r.offset + r.size) for r in extents.merge_extents(df, "f").collect())
    assert {b for o, s in rows for b in range(o, o + s)} == {b for o, e in got for b in range(o, e)}
    assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
    assert extents.covers(extents.merge_extents(df, "f"), df.drop("f")).isEmpty()


def test_windows_and_read_plans(spark):
    fold = extents.fold_windows
    assert fold([(0, 10), (10, 10), (25, 10), (100, 10)], 100, 5) == [(0, 35, 3), (100, 10, 1)]
    assert fold([(0, 10), (10, 10), (20, 10)], 20, 0) == [(0, 20, 2), (20, 10, 1)]
    assert fold([(0, 10), (0, 10), (5, 10)], 10, 0) == [(0, 15, 3)] and fold([], 1, 1) == []
    df = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 12, 8), ("b", 3, 1)], "f string, offset long, size long")
    assert sorted(tuple(r) for r in extents.build_windows(df, 100, 5, "f").collect()) == [("a", 0, 20, 3), ("b", 3, 1, 1)]
    plan = lambda rows, **k: (lambda df: (extents.plan_costs(df, extents.plan_reads(df, **k)).first(), sorted(tuple(r) for r in extents.plan_reads(df, **k).collect())))(
        spark.createDataFrame(rows, "block int, morton int, offset long, size long, is_plane boolean")
    )
    costs, _ = plan([(0, 0, 0, 64, False), (0, 0, 0, 64, False), (0, 1, 64, 64, False), (0, 2, 300, 0, False), (1, 0, 10**9, 64, False)])
    assert (costs.calls, costs.duplicates, costs.eliminated_bytes, costs.planned_bytes) == (2, 1, 64, 192)
    assert plan([])[0].amplification == 1.0 and plan([])[1] == []
    assert [r[2] for r in plan([(0, k, k * 64, 64, False) for k in range(8)], window=256)[1]] == [4, 4]
    # a record that does not fit gets a read of its own, whole
    assert plan([(0, 0, 0, 10, False), (0, 1, 5, 100, False)], window=50)[1] == [(0, 10, 1), (5, 100, 1)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 90)), min_size=1, max_size=80), st.integers(1, 200), st.integers(0, 40))
def test_plans_cover_all_records(spark, rows, window, gap):
    df = spark.createDataFrame([(0, k, o, s, False) for k, (o, s) in enumerate(rows)], "block int, morton int, offset long, size long, is_plane boolean")
    reads = extents.plan_reads(df, max_gap=gap, window=window)
    assert extents.covers(reads.select("offset", "size"), extents.distinct_records(df).select("offset", "size")).isEmpty()
    most = max(s for _, s in rows)
    assert all(r.size <= max(window, most) for r in reads.collect()) and sum(r.records for r in reads.collect()) == sum(s > 0 for _, s in rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(1, 300)), min_size=1, max_size=60), st.integers(1, 400))
def test_ranges_of_a_file_hand_on_their_runs(spark, rows, span):
    df = spark.createDataFrame([(None, o, s) for o, s in rows], "f string, offset long, size long")
    whole = sorted((r.offset, r.size) for r in extents.merge_with_gap(df, 3, "f").collect())
    assert sorted((r.offset, r.size) for r in extents.merge_with_gap(df, 3, "f", span=span).collect()) == whole
    starts = {r.start for r in extents.islands(df, 3, "f", span=span).collect()}
    assert starts == {o for o, _ in whole}


def test_request_files(spark, tmp_path):
    meta = VolumeMeta(801, 2405, 2501)
    path = tmp_path / "p.csv"
    path.write_bytes("﻿axis,type,index\r\n# note\r\n".encode() + b"".join(b"x,random,%d\r\n" % k for k in range(100)) + b"Z\tContinuous\t5\n z continuous 6\n")
    got = requests.read_requests(spark, str(path))
    assert got.count() == 102 and [r["index"] for r in got.where("axis = 'z'").orderBy("seq").collect()] == [5, 6]
    assert requests.problems(got, meta, 100, 2).isEmpty()
    assert {(r.axis, r.problem) for r in requests.problems(got, meta, 99, 10).collect()} == {("x", "count"), ("z", "count")}
    assert [r.problem for r in requests.problems(got.limit(0), meta).collect()] == ["no requests"]
    path.write_text("x,random,1,2\n")
    with pytest.raises(Exception, match="line 1"):
        requests.read_requests(spark, str(path)).collect()
    made = requests.generate(spark, meta, 3)
    assert requests.problems(made, meta).isEmpty() and made.count() == 330
    assert requests.centred_run(20, 10) == list(range(5, 15))


def test_fingerprint():
    groups = {"x_random": [1, 2, 3, 4, 5], "y_random": [10, 20, 30, 40, 50], "z_random": [100, 200, 300, 400, 500], "x_continuous": [1000, 1001], "y_continuous": [2000, 2001], "z_continuous": [3000, 3001]}
    assert requests.fingerprint(groups) == 0x4D1FAD3B9556A127
    assert requests.fingerprint({}) != requests.fingerprint(groups)


def test_strategies():
    m, g = strategy.MIB, strategy.GIB
    c = strategy.choose((100 * m, 0), (105 * m, 0), (20 * m, 500), mb_s=100, seek_ms=10, limits=strategy.Limits(full_min_advantage=0))
    assert c.uncertain and c.selected == "selective"
    c = strategy.choose((6 * g, 100), (5 * g, 20), (21 * g, 42), mb_s=66, seek_ms=12)
    assert c.full_blocked and c.selected == "whole" and strategy.after_pilot(c, 500).full_blocked
    c = strategy.choose((30 * g, 100), (28 * g, 50), (21 * g, 42), mb_s=150, seek_ms=9)
    assert c.selected == "full" and not c.uncertain
    assert strategy.after_pilot(c, 0.5) is c


def test_formats_and_phases():
    found = formats.plan_format(801, 2405, 2501, 0.43, 0.45, 0.6, 0.62)
    assert [c.name for c in found] == ["block", "leaf"] and not found[0].uncertain and "recommended" in formats.to_json(found)
    assert formats.plan_format(100, 100, 100, 0.7, 0.7)[0].uncertain and not formats.plan_format(100, 100, 100, 1.45, 1.48)[0].feasible
    axes, kinds = list("xyzxyz"), ["random"] * 3 + ["continuous"] * 3
    plan = formats.plan_phases
    assert plan([100, 200, 300, 50, 80, 70], axes, kinds, 1000) == [[0, 1, 2, 3, 4, 5]]
    assert plan([300, 300, 300, 60, 60, 60], axes, kinds, 400) == [[0, 3], [1], [2], [4, 5]]
    assert plan([100, 120, 130, 50, 80, 70], axes, kinds, 150) == [[0, 3], [1], [2], [4, 5]] and plan([], [], [], 1) == []


def test_scores(spark):
    times = spark.createDataFrame([("x", "random", 4.0), ("x", "continuous", 2.0), ("z", "random", 9.0)], "axis string, type string, seconds double")
    assert scores.composite(times).first()[:] == (3.0, None, 9.0, 6.0)
    assert scores.composite_sixth(times).first().t_composite == 2.5
    assert [scores.storage_points(r) for r in (0.4, 1.5, 1.51, 1.6, 1.61, 9.0)] == [20, 20, 19, 19, 18, 0]
    one = spark.createDataFrame([("x", 1.0)], "g string, t double")
    assert scores.summary(one, "g", seconds="t").first().cv == 0.0


def test_statistics(spark):
    rng = np.random.default_rng(3)
    data = np.sort(rng.integers(0, 60, 501)).astype(float)
    df = spark.createDataFrame([(float(x), int(k % 3)) for k, x in enumerate(data)], "v double, g int")
    got = stats.ranked(df, "v", {"a": stats.clamped(0.95), "b": stats.lower(0.5), "c": "0", **stats.PROBE}).first()
    assert got[:] == (data[475], data[250], data[0], data[250], data[50], data[450])
    by = {r.g: r.median for r in stats.ranked(df, "v", stats.PROBE, "g").collect()}
    assert by == {g: data[g::3][len(data[g::3]) // 2] for g in range(3)}
    cells = spark.createDataFrame([(0, 0, z, v) for z, v in enumerate([1.0, 2.0, NAN, 4.0, 0.0, INF, 1e-40])], "x long, y long, z long, v float")
    f = stats.fractions(cells).first()
    assert (f.zero, f.non_finite) == (1 / 7, 2 / 7)
    assert stats.neighbour_correlation(cells, "z").first()[:] == (2, 0.0)
    sample = spark.createDataFrame([(float(k % 3 + 1),) for k in range(90)], "v double")
    low, high = stats.bootstrap_mean(sample, "v").first()
    assert 1.5 < low < 2 < high < 2.5 and tuple(stats.bootstrap_mean(sample.limit(0), "v").first()) == (None, None)
    r = stats.ratio_interval(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double"), "a", "b").first()
    assert abs(r.ratio - 4 / 6) < 1e-12 and r.low >= 0


def test_task_files():
    text = "# all\ncommand = slice\ninput=a.raw\nnx=1 # one\nverbose = yes\nquiet = off\n---\ncommand=info\ninput=b\n"
    assert cli.parse_tasks(text) == [["slice", "--input", "a.raw", "--nx", "1", "--verbose"], ["info", "--input", "b"]]
    with pytest.raises(ValueError):
        cli.parse_tasks("input=a")


def test_windows_take_the_whole_table(spark):
    sf, fold = "/root/testdata/sf0.001", extents.fold_windows
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey % 10 as f", "l_partkey % 500 * 100 as o", "cast(l_quantity as bigint) * 2 + 20 as s").collect()
    ordered = {f: sorted(((r.o, r.s) for r in lines if r.f == f), key=lambda b: (b[0], -b[1])) for f in {r.f for r in lines}}
    want = sorted((f, *w) for f, blocks in ordered.items() for w in fold(blocks, 4096, 64))
    got = sorted(tuple(r) for r in queries.queries()["merge_windows"](spark, sf).collect())
    assert got == want and sum(r[3] for r in got) == len(lines)


def test_trimmed_mean_of_a_whole_table(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    for column in ("l_quantity", "l_extendedprice"):
        v = sorted(r[0] for r in lines.select(column).collect())
        kept = v[len(v) // 10 : len(v) - len(v) // 10]
        out = stats.trimmed_mean(lines, column)
        assert out.first().mean == pytest.approx(sum(kept) / len(kept), rel=1e-12)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan  # no window sorts all rows in one task
    some = lambda *v: stats.trimmed_mean(spark.createDataFrame([(x,) for x in v], "t double"), "t").first().mean
    assert some() is None and some(None, 3.0) == 3.0 and some(*map(float, range(10))) == 4.5 and some(*[1.0] * 15, 100.0, None) == 1.0
