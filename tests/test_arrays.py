"""Arrays in files: any layout and type, split files, archives, ranges of frames."""

import numpy as np
import pytest

from ensemblar.sources.arrays import read_arrays, write_files


def expected(x, first=0, last=1 << 40):
    return sorted((c, f, float(v)) for (c, f), v in np.ndenumerate(np.atleast_2d(x)) if v and first <= f <= last)


def got(df):
    return sorted((r.cell, r.frame, r.value) for r in df.collect())


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "i2", "?", "u1"])
def test_layouts_in_small_partitions(spark, tmp_path, order, kind):
    r = np.random.default_rng(1)
    x = np.asarray((r.integers(-3, 4, (7, 50)) * (r.random((7, 50)) < 0.3)).clip(0 if kind in "?u1" else -3), dtype=kind, order=order)
    np.save(tmp_path / "a.npy", x)
    d = read_arrays(spark, f"{tmp_path}/*.npy", partition_bytes=64)
    assert got(d) == expected(x) and d.rdd.getNumPartitions() > 3
    assert got(read_arrays(spark, f"{tmp_path}/a.npy", first=10, last=20)) == expected(x, 10, 20)


def test_archives(spark, tmp_path):
    x, y = np.eye(9, 30), np.arange(300.0).reshape(3, 100)
    np.savez(tmp_path / "stored.npz", other=np.zeros(3), x=x, y=y)
    np.savez_compressed(tmp_path / "packed.npz", x=x, y=y)
    for name, parts in (("stored", 38), ("packed", 1)):
        d = read_arrays(spark, f"file://{tmp_path}/{name}.npz", "y", partition_bytes=64)
        assert got(d) == expected(y) and d.rdd.getNumPartitions() == parts
    with pytest.raises(Exception, match="no array z"):
        read_arrays(spark, f"{tmp_path}/stored.npz", "z").collect()


def test_vectors_empty_arrays_and_many_files(spark, tmp_path):
    np.save(tmp_path / "p5_a.npy", np.array([0, 2, 0, 3]))
    np.save(tmp_path / "p5_b.npy", np.zeros((0, 4)))
    np.save(tmp_path / "p5_c.npy", np.zeros((2, 2)))
    d = read_arrays(spark, f"{tmp_path}/p5_*.npy")
    assert [(r.path.rsplit("/", 1)[1], r.cell, r.frame, r.value) for r in d.orderBy("frame").collect()] == [("p5_a.npy", 0, 1, 2.0), ("p5_a.npy", 0, 3, 3.0)]
    np.save(tmp_path / "bad.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="one or two dimensions"):
        read_arrays(spark, f"{tmp_path}/bad.npy").collect()


def test_written_files(spark, tmp_path):
    write_files(spark.createDataFrame([("a.bin", bytearray(b"12")), ("b.bin", bytearray(b""))], "name string, content binary"), f"file://{tmp_path}/out")
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()) == [("a.bin", b"12"), ("b.bin", b"")]


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(300):
        np.save(tmp_path / f"{k}.npy", np.full((1, 2), k + 1))
    d = read_arrays(spark, f"{tmp_path}/*.npy")
    assert 1 < d.rdd.getNumPartitions() < 10  # shares of 4 MB, 64 KB for each file
    assert sorted((int(r.path.rsplit("/", 1)[1][:-4]), r.frame, r.value) for r in d.collect()) == [(k, f, k + 1.0) for k in range(300) for f in range(2)]
