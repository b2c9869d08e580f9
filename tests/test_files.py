"""Files grow in number with bytes, not with sessions."""

import glob

from pyspark.sql import functions as F

from ensemblar.plans import QUERIES
from ensemblar.sources import io as S


def test_sessions_share_files(spark, tmp_path):
    d = spark.range(3000).select((F.col("id") % 3).cast("int").alias("age"), F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("session_id"), "id")
    d = d.unionByName(spark.createDataFrame([(None, "s1", 3000), (1, None, 3001), (1, "", 3002)], d.schema))
    S.write_dataset(d, f"{tmp_path}/d", ["age"], within=["session_id"])
    back = spark.read.parquet(f"{tmp_path}/d")
    assert sorted(map(repr, back.select(*d.columns).collect())) == sorted(map(repr, d.collect()))
    files = glob.glob(f"{tmp_path}/d/age=*/*.parquet")
    # a folder for each session made 600 of them
    assert len(files) <= 8 and len(glob.glob(f"{tmp_path}/d/age=*")) == 4
    for f in files:
        s = [x.session_id for x in spark.read.parquet(f).collect()]
        assert s == sorted(s, key=lambda x: (x is not None, x))


def test_dataset_of_sessions(spark):
    d = QUERIES["s9_write_dataset"](spark, "/root/testdata/sf0.01")
    assert d.count() == 75 and len(d.inputFiles()) <= 8


def test_texts_share_files(spark, tmp_path):
    texts = {f"s{k}": f"#PARAM#\nn 3\n#CELL_ASSEMBLIES#\nSCA_cluster:{k} {k + 1}\r\nsingle_sce_in_ca:0:{k} {k + 7}\n#END#\nSCA_cluster:99" for k in range(20)}
    for name, x in texts.items():
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f"{name}.txt").write_bytes(x.encode())
    S.write_dataset(spark.createDataFrame([*texts.items()], "file string, value string").coalesce(1), f"{tmp_path}/rows")
    of = lambda d: sorted((r.file.rsplit("/", 1)[-1].removesuffix(".txt"), *r[1:]) for r in d.collect())
    one, rows = S.read_lines(spark, f"{tmp_path}/one"), S.read_lines(spark, f"{tmp_path}/rows", "parquet")
    assert of(one) == of(rows) and one.count() == 140
    for a, b in zip(S.parse_assemblies(one), S.parse_assemblies(rows), strict=True):
        assert of(a) == of(b) and a.count() == 40


def test_assemblies_come_from_few_files(spark):
    for name in ("s6_read_assemblies", "s7_read_sequence_results", "s7b_parse_best_order"):
        d = QUERIES[name](spark, "/root/testdata/sf0.01")
        # one for each of the 375 sessions
        assert d.select("file").distinct().count() == 375 and len(set(d.inputFiles())) <= 8
