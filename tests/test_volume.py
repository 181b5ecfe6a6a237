import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelspark.functions import address
from voxelspark.meta import PLANE, VolumeMeta
from voxelspark.operators import leaves, replicas, verify
from voxelspark.operators.volume import Volume, read_volume
from voxelspark.sources import generate, rawvol, sinks

SHAPES = [(5, 7, 11), (17, 9, 13)]


def block(shape):
    x, y, z = np.meshgrid(*map(np.arange, shape), indexing="ij")
    return (x * 10000 + y * 100 + z).astype(np.float32)


def meta_of(shape):
    return VolumeMeta(*shape, (4, 4, 4), (2, 2, 2))


def both(spark, shape):
    """The volume as voxels and as traces."""
    v = generate.decimal(spark, meta_of(shape))
    traces = v.cells().groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "v"))), lambda s: s["v"]).alias("values"))
    return [v, Volume(v.meta, traces=traces)]


@pytest.mark.parametrize("shape", SHAPES)
def test_slices_lines_ranges(spark, shape):
    data = block(shape)
    for v in both(spark, shape):
        for axis in "xyz":
            k = "xyz".index(axis)
            n = shape[k]
            got = v.slice(axis, n - 1).orderBy("out_idx").collect()
            assert [r.out_idx for r in got] == list(range(data.size // n))
            assert np.array_equal([r.v for r in got], data.take(n - 1, axis=k).ravel())
            a, b = PLANE[axis]
            i, j = shape["xyz".index(a)] // 2, shape["xyz".index(b)] - 1
            at = {a: i, b: j, axis: slice(None)}
            assert np.array_equal([r.v for r in v.line(axis, i, j).orderBy("i").collect()], data[at["x"], at["y"], at["z"]])
            part = v.slice_range(axis, 1, 3)
            assert part.count() == 3 * data.size // n and part.agg(F.min(axis), F.max(axis)).first()[:] == (1, 3)
            for bad in (-1, n):
                with pytest.raises(IndexError):
                    v.slice(axis, bad)
        assert np.array_equal([r.v for r in v.full().orderBy("idx").collect()], data.ravel())


def test_batch_and_bounds(spark):
    shape = (9, 8, 7)
    data = block(shape)
    rows = [("x", "random", 0, 3), ("x", "random", 1, 3), ("z", "continuous", 0, 6), ("y", "random", 0, 0)]
    asked = spark.createDataFrame(rows, "axis string, type string, seq int, index long")
    for v in both(spark, shape):
        plan = v.batch(asked)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        got = v.batch(asked).orderBy("axis", "type", "seq", "out_idx").collect()
        for axis, kind, seq, index in rows:
            mine = [r.v for r in got if (r.axis, r.type, r.seq) == (axis, kind, seq)]
            assert np.array_equal(mine, data.take(index, axis="xyz".index(axis)).ravel())
        with pytest.raises(Exception, match="outside the volume"):
            v.batch(spark.createDataFrame([("x", "random", 0, 9)], asked.schema)).collect()
    assert both(spark, shape)[0].batch(asked.limit(0)).count() == 0


def test_stored_table_prunes_and_replicas_agree(spark, tmp_path):
    v = generate.decimal(spark, meta_of((20, 12, 10)))
    v.write(f"{tmp_path}/base", files=4)
    with pytest.raises(Exception, match="already exists"):
        v.write(f"{tmp_path}/base")
    base = read_volume(spark, f"{tmp_path}/base", v.meta)
    plan = base.slice("x", 13)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(x_leaf,6)" in plan
    v.write(f"{tmp_path}/z", by="z", files=4)
    z = read_volume(spark, f"{tmp_path}/z", v.meta)
    for axis in "xyz":
        assert verify.same(v.slice(axis, 5), base.slice(axis, 5)) and verify.same(v.slice(axis, 5), z.slice(axis, 5))
    every = replicas.Replica("x", Volume(v.meta, voxels=replicas.planes(v, "x", 3)), 3)
    asked = spark.createDataFrame([("x", "random", k, i) for k, i in enumerate((0, 3, 4, 3, 19))] + [("z", "random", 0, 2)], "axis string, type string, seq int, index long")
    routed = replicas.batch(base, [every, replicas.Replica("z", z)], asked)
    assert verify.same(routed.drop("replica"), base.batch(asked))
    assert {(r["index"], r.replica) for r in routed.select("index", "replica").where("axis = 'x'").distinct().collect()} == {(0, 0), (3, 0), (4, -1), (19, -1)}
    assert not replicas.usable(None, "x") and not replicas.usable(asked, "x") and replicas.usable(v.cells(), "x")
    assert replicas.may_append(1 << 20, 9 << 20) and not replicas.may_append(100 << 20, 150 << 20) and replicas.may_append(100 << 20, 150 << 20, True)


def test_raw_files(spark, tmp_path):
    meta = meta_of((6, 5, 9))
    data = block((6, 5, 9))
    data[1, 2, 3], data[2, 0, 0], data[3, 3, 3], data[0, 0, 0] = np.nan, np.inf, -0.0, 1e-42
    data.tofile(f"{tmp_path}/a.raw")
    for slab in (1, 400, 1 << 20):
        v = rawvol.read_raw(spark, f"{tmp_path}/a.raw", meta, slab)
        got = np.array([r.v for r in v.full().orderBy("idx").collect()], np.float32)
        assert got.tobytes() == data.tobytes()
    # what one query leaves out the next one has
    for _ in range(2):
        assert v.slice("x", 4).count() == 45 and v.traces.count() == 30 and v.slice("y", 2).count() == 54 and v.traces.count() == 30
    assert [r.v for r in v.line("z", 4, 2).orderBy("i").collect()] == data[4, 2].tolist()
    assert [r.v for r in v.line("x", 3, 7).orderBy("i").collect()] == data[:, 3, 7].tolist() and v.slice_range("y", 1, 3).count() == 162
    reader = rawvol.RawVolumeReader({"path": f"{tmp_path}/a.raw", "nx": "6", "ny": "5", "nz": "9", "x_low": "2", "x_high": "3", "y_low": "1", "y_high": "1"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    rawvol.restore(v, f"{tmp_path}/b.raw", files=3)
    assert open(f"{tmp_path}/b.raw", "rb").read() == data.tobytes()
    with pytest.raises(FileExistsError):
        rawvol.restore(v, f"{tmp_path}/b.raw")
    with pytest.raises(Exception, match="bytes"):
        rawvol.read_raw(spark, f"{tmp_path}/a.raw", meta_of((6, 5, 8))).full().collect()
    gap = Volume(meta, voxels=v.cells().where("not (x = 2 and y = 2 and z = 2)"))
    with pytest.raises(Exception, match="missing or repeated|whole volume"):
        rawvol.write_raw(gap, f"{tmp_path}/gap", 2)
    asked = spark.createDataFrame([("x", "random", 0, 1), ("z", "continuous", 2, 8)], "axis string, type string, seq int, index long")
    files = {r.path.rsplit("/", 1)[1]: r.cells for r in sinks.write_slices(v.batch(asked), f"{tmp_path}/out").collect()}
    assert files == {"slice_x_random_000.dat": 45, "slice_z_continuous_002.dat": 30}
    assert np.fromfile(f"{tmp_path}/out/slice_z_continuous_002.dat", "<f4").tobytes() == data[:, :, 8].tobytes()
    known = {b"\0\0\0\0": "zeros", data.tobytes()[:8]: "mine"}
    assert [r.format for r in rawvol.detect(spark, f"{tmp_path}/a.raw", known).collect()] == ["mine"]


@pytest.mark.parametrize("order", ["zyx", "yzx"])
def test_leaves_round_trip(spark, order):
    meta = VolumeMeta(9, 7, 13, (8, 8, 8), (4, 4, 4))
    v = generate.decimal(spark, meta)
    if order == "zyx":
        packed = leaves.pack(meta, v.cells())
        assert packed.agg(F.sum(F.bit_count("mask"))).first()[0] == meta.cells
        assert verify.same(leaves.unpack(meta, packed), v.cells())
    at = address.block_coords(meta, "sb_id", order)
    rows = v.cells().select("x", "y", "z", address.block_id(meta, order).alias("sb_id"))
    assert rows.where((at["x"] != address.block(meta, "x")) | (at["y"] != address.block(meta, "y")) | (at["z"] != address.block(meta, "z"))).isEmpty()


def test_generators(spark):
    meta = VolumeMeta(4, 5, 6)
    one = generate.uniform(spark, meta, 7).cells()
    assert verify.same(one, generate.uniform(spark, meta, 7).cells().repartition(3))
    assert one.where("v < 0 or v > 1").isEmpty() and one.select("v").distinct().count() > 100
    rows = {(r.x, r.y, r.z): r.v for r in generate.blocky(spark, VolumeMeta(9, 9, 33), 0).cells().collect()}
    assert rows[0, 0, 0] == 0.0 and rows[8, 8, 32] == (13 + 7 + 3) / 32


def test_sampled_planes(spark):
    for v in both(spark, (6, 5, 9)):
        assert v.sampled_planes([1, 4], [(0, 2), (5, 6)]).count() == 2 * 5 * 3 and v.sampled_planes([0]).count() == 45
        for bad in (([6], None), ([0], [(3, 10)])):
            with pytest.raises(IndexError):
                v.sampled_planes(*bad)


@pytest.mark.parametrize("held", [6 * 5 * 9 - 18, 6 * 5 * 9 - 20, 6 * 5 * 9 - 44])
def test_raw_file_that_ends_inside_the_last_plane(spark, tmp_path, held):
    data = block((6, 5, 9)).ravel()[:held]
    meta = VolumeMeta(6, 5, 9, (4, 4, 4), (2, 2, 2), held)
    whole = generate.decimal(spark, meta_of((6, 5, 9)))
    v = Volume(meta, voxels=whole.cells().where(address.linear(meta) < held))
    rawvol.restore(v, f"{tmp_path}/a.raw", files=3)
    assert open(f"{tmp_path}/a.raw", "rb").read() == data.tobytes()
    for slab in (1, 400, 1 << 20):
        raw = rawvol.read_raw(spark, f"{tmp_path}/a.raw", meta, slab)
        assert [r[:] for r in raw.full().orderBy("idx").collect()] == list(enumerate(data.tolist()))
    # neither a cell too few nor one too many passes, and the shape alone asks for every cell
    for wrong in (v.cells().where("not (x = 2 and y = 2 and z = 2)"), v.cells().where("x + y + z > 0"), whole.cells()):
        with pytest.raises(Exception, match="missing or repeated|whole volume"):
            rawvol.write_raw(Volume(meta, voxels=wrong), f"{tmp_path}/wrong", 2)
    shifted = whole.cells().where(address.linear(meta).between(1, held))
    with pytest.raises(Exception, match="whole volume"):
        rawvol.write_raw(Volume(meta, voxels=shifted), f"{tmp_path}/shifted", 2)
    with pytest.raises(Exception, match="bytes"):
        rawvol.read_raw(spark, f"{tmp_path}/a.raw", meta_of((6, 5, 9))).full().collect()
    with pytest.raises(ValueError, match="last plane"):
        VolumeMeta(6, 5, 9, held=5 * 5 * 9)


def test_slices_and_lines_where_the_last_plane_ends(spark, tmp_path):
    held = 6 * 5 * 9 - 20  # plane 5 has two traces and seven cells of a third
    meta = VolumeMeta(6, 5, 9, (4, 4, 4), (2, 2, 2), held)
    v = Volume(meta, voxels=generate.decimal(spark, meta_of((6, 5, 9))).cells().where(address.linear(meta) < held))
    rawvol.restore(v, f"{tmp_path}/a.raw")
    raw = rawvol.read_raw(spark, f"{tmp_path}/a.raw", meta)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for axis, index in [("x", 5), ("x", 0), ("y", 2), ("y", 4), ("z", 6), ("z", 8)]:
        assert same(raw.slice(axis, index), v.slice(axis, index)), (axis, index)
        assert same(raw.slice_range(axis, index - 1 if index else 0, 2), v.slice_range(axis, index - 1 if index else 0, 2)), (axis, index)
    for axis, first, second in [("z", 5, 2), ("z", 5, 3), ("z", 5, 1), ("x", 2, 7), ("x", 2, 6), ("y", 5, 8), ("y", 5, 6)]:
        assert same(raw.line(axis, first, second), v.line(axis, first, second)), (axis, first, second)
    assert [r.i for r in raw.line("z", 5, 2).orderBy("i").collect()] == list(range(7)) and raw.line("z", 5, 3).isEmpty()
    asked = spark.createDataFrame([("x", "random", 0, 5), ("y", "random", 0, 2), ("z", "random", 0, 8), ("z", "continuous", 0, 6)], "axis string, type string, seq int, index long")
    assert same(raw.batch(asked), v.batch(asked)) and raw.batch(asked.where("axis = 'z'")).count() == 27 + 28
    assert same(raw.sampled_planes([0, 5], [(5, 9)]), v.sampled_planes([0, 5], [(5, 9)]))


def test_size_of_a_raw_file_that_ends_inside_the_last_plane(spark, tmp_path):
    shape = (6, 5, 9)
    meta = VolumeMeta(*shape, held=6 * 5 * 9 - 20)
    block(shape).ravel()[: meta.held].tofile(f"{tmp_path}/a.raw")
    sizes = lambda m: rawvol.sizes(spark, f"{tmp_path}/a.raw", m).first()[1:]
    assert sizes(meta) == (1000, True) and sizes(VolumeMeta(*shape)) == (1000, False)
    assert sizes(VolumeMeta(*shape, held=meta.held - 1)) == sizes(VolumeMeta(*shape, held=meta.held + 1)) == (1000, False)


def test_pieces_of_a_raw_file_are_written_once(spark, tmp_path):
    v = generate.decimal(spark, VolumeMeta(6, 5, 9))
    spark.sparkContext.setJobGroup("pieces", "")
    paths = rawvol.write_raw(v, f"{tmp_path}/a", 4)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    # a sample of the cells for their ranges, the shuffle and one run of the writing tasks
    assert len(paths) == 4 and len(told.getJobIdsForGroup("pieces")) == 3
    assert sum(os.path.getsize(p) for p in paths) == v.meta.bytes
