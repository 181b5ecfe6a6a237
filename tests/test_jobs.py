import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelspark import api, cli
from voxelspark.functions.values import ErrorPolicy
from voxelspark.meta import VolumeMeta
from voxelspark.operators import codec, leaves, probe, verify
from voxelspark.sources import generate, rawvol
from voxelspark.streaming.serve import serve

META = VolumeMeta(12, 10, 9, (4, 4, 4), (2, 2, 2))


def raw(tmp_path):
    data = np.random.default_rng(0).standard_normal((12, 10, 9)).astype(np.float32)
    data.tofile(tmp_path / "a.raw")
    return data, f"{tmp_path}/a.raw"


def test_convert_benchmark_verify(spark, tmp_path):
    data, path = raw(tmp_path)
    api.convert(spark, path, META, f"{tmp_path}/out", ("z",))
    base, copies = api.open_converted(spark, f"{tmp_path}/out", META, ("z",))
    assert api.check(rawvol.read_raw(spark, path, META), base).first().passed
    asked = spark.createDataFrame([("x", "random", 0, 3), ("z", "random", 0, 8), ("z", "continuous", 0, 1)], "axis string, type string, seq int, index long")
    got = api.benchmark(asked, api.reader(base, copies), 3 * META.bytes, META.bytes).first()
    assert got.t_composite > 0 and got.t_y is None and got.storage_score == 5
    assert {c.name for c in api.plan(base)} == {"block", "leaf"}
    assert data.shape == META.dims


def test_encoded_table_and_probes(spark, tmp_path):
    _, path = raw(tmp_path)
    meta = VolumeMeta(12, 10, 9, (8, 8, 8), (4, 4, 4))
    cells = rawvol.read_raw(spark, path, meta).cells()
    codec.write_encoded(meta, cells, f"{tmp_path}/enc")
    back = leaves.unpack(meta, codec.decode(spark.read.parquet(f"{tmp_path}/enc")))
    assert verify.summary(verify.paired(cells, back), ErrorPolicy()).first().passed
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.raw", "enc"]
    with pytest.raises(ValueError, match="error bound"):
        codec.write_encoded(meta, cells.where("x > 0").union(cells.where("x = 1").withColumn("x", F.lit(99).cast("long"))), f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists()
    smooth = generate.smooth(spark, VolumeMeta(20, 9, 9, (8, 8, 8), (4, 4, 4))).cached()
    rows = probe.block_ratios(smooth, slabs=3).collect()
    assert len(rows) == 3 * 2 * 2 and all(r.raw == 2048 and r.packed <= 2048 and r.compressed == (r.packed < 2048) for r in rows)
    planes = probe.plane_probe(smooth, "y").groupBy("index").sum("blocks").collect()
    assert len(planes) == 6 and all(r[1] == 5 * 3 for r in planes)
    assert probe.probe_depths(meta) == [0, 1, 2, 5, 8, 9, 11] and probe.slab_starts(meta, 9) == [0, 1]
    assert probe.leaf_probe(smooth, 20).count() < 45


def test_command_line(spark, tmp_path, capsys):
    data, path = raw(tmp_path)
    dims = ["--nx", "12", "--ny", "10", "--nz", "9"]
    assert cli.main(["convert", "--input", path, "--output", f"{tmp_path}/out", *dims]) == 0
    assert cli.main(["verify", "--input", f"{tmp_path}/out", "--other", path, *dims]) == 0
    assert cli.main(["slice", "--input", path, "--axis", "z", "--index", "2", "--output", f"{tmp_path}/s", *dims]) == 0
    got = spark.read.parquet(f"{tmp_path}/s").orderBy("out_idx").collect()
    assert np.array_equal([r.v for r in got], data[:, :, 2].ravel())
    (tmp_path / "tasks").write_text(f"command=restore\ninput={tmp_path}/out\noutput={tmp_path}/b.raw\nnx=12\nny=10\nnz=9\n")
    assert cli.main(["--config", str(tmp_path / "tasks"), "--dry-run"]) == 0 and cli.main(["--config", str(tmp_path / "tasks")]) == 0
    assert (tmp_path / "b.raw").read_bytes() == data.tobytes()
    assert cli.main([]) == 2


def test_streamed_requests(spark, tmp_path):
    _, path = raw(tmp_path)
    volume = rawvol.read_raw(spark, path, META)
    asked = spark.createDataFrame([("x", "random", 0, 3), ("y", "random", 1, 9)], "axis string, type string, seq int, index long")
    asked.write.parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/asked")
    for _ in range(2):
        serve(stream, volume, f"{tmp_path}/answers", f"{tmp_path}/state").awaitTermination()
    assert verify.same(spark.read.parquet(f"{tmp_path}/answers").drop("batch"), volume.batch(asked))
