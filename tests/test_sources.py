import struct
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.util import exact, frame, rows, vectors
from vecspark.operators import hnsw, ivf, linear
from vecspark.operators.knn import as_queries
from vecspark.sources import indexes
from vecspark.sources import vectors as files
from vecspark.streaming import ingest

X = vectors(50, 6)


def table(df):
    return {r["vec_id"]: list(r["embedding"]) for r in df.collect()}


@pytest.mark.parametrize("per_file", [7, 1000])
def test_vector_files(spark, tmp_path, per_file):
    v = frame(spark, X)
    files.write_vecs(v, f"file:{tmp_path}/f", rows_per_file=per_file)
    assert table(files.read_fvecs(spark, str(tmp_path / "f"))) == table(v)
    files.write_vecs(v, str(tmp_path / "b"), rows_per_file=per_file, bare=True)
    assert table(files.read_bin(spark, str(tmp_path / "b"), 6)) == table(v)
    assert [r["value"] for r in files.read_floats(spark, str(tmp_path / "b")).orderBy("pos").collect()] == X.ravel().tolist()
    ids = v.withColumn("embedding", F.array(F.col("vec_id") * 2, F.lit(-1)).cast("array<int>"))
    files.write_vecs(ids, str(tmp_path / "i"), "<i4", per_file)
    assert table(files.read_ivecs(spark, str(tmp_path / "i"))) == {i: [2 * i, -1] for i in range(50)}


def test_vector_files_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    """A mount point is followed; where pyarrow does not know the store, files pass through the driver."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    v = frame(spark, X)
    files.write_vecs(v, "viewfs://files/in/a", rows_per_file=7)
    assert table(files.read_fvecs(spark, "viewfs://files/in/a")) == table(v)
    monkeypatch.setattr("pyarrow.fs.FileSystem", types.SimpleNamespace(from_uri=int))  # raises ValueError
    assert files.write_vecs(v, "viewfs://files/in/b", rows_per_file=7) == 8
    assert table(files.read_fvecs(spark, "viewfs://files/in/b")) == table(v)


def test_layout_is_as_published(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(struct.pack("<i3fi3f", 3, 1, 2, 3, 3, 4, 5, 6))
    assert table(files.read_fvecs(spark, str(tmp_path / "x.fvecs"))) == {0: [1, 2, 3], 1: [4, 5, 6]}
    assert files.encode_vecs(np.array([[1, 2, 3], [4, 5, 6]], np.float32), "<f4") == (tmp_path / "x.fvecs").read_bytes()
    book = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    files.write_codebook(spark, str(tmp_path / "c.fdat"), book)
    assert (tmp_path / "c.fdat").read_bytes()[:12] == struct.pack("<3i", 2, 3, 2)
    assert (files.read_codebook(spark, str(tmp_path / "c.fdat")) == book).all()
    for bad in (b"\x03\0\0\0", struct.pack("<i2fi2f", 2, 1, 2, 9, 3, 4), struct.pack("<i", 0)):
        with pytest.raises(files.FormatError):
            files.decode_vecs(bad, "<f4")
    with pytest.raises(files.FormatError):
        files.decode_codebook(struct.pack("<3i", 2, 3, 2))
    assert files.decode_vecs(b"", "<f4").shape == (0, 0)


def test_generators(spark):
    a = files.generate(spark, 3000, 20, "gauss", 4)
    assert table(a.filter("vec_id < 50")) == table(files.generate(spark, 50, 20, "gauss", 4).repartition(3))
    m = np.array(list(table(a).values()))
    assert abs(m.mean()) < 0.02 and abs(m.std() - 1) < 0.02 and files.shape(a) == (3000, 20)
    u = np.array(list(table(files.generate(spark, 1000, 20, "uniform", 4)).values()))
    assert -1 <= u.min() < -0.98 and 0.98 < u.max() <= 1
    base, asked = files.split_queries(a, 200)
    assert files.shape(base) == (2800, 20) and sorted(table(asked)) == list(range(200))
    with pytest.raises(ValueError):
        files.generate(spark, 1, 1, "other")


def test_stored_indexes(spark, tmp_path):
    v = frame(spark, X)
    q = as_queries(v.filter("vec_id < 3"))
    want = exact(X, [(i, X[i]) for i in range(3)], 5)
    centres = linear.kmeans(v, 4, 3)
    indexes.save_ivf(ivf.assign(v, centres), centres, str(tmp_path / "ivf"))
    filed, back = indexes.load_ivf(spark, str(tmp_path / "ivf"))
    assert (back == centres).all() and rows(ivf.search_sql(filed, q, back, 4, 5, 6)) == want
    index = hnsw.build(v, hnsw.Build(m=6, width=40), 2)
    indexes.save_hnsw(index, str(tmp_path / "hnsw"))
    assert rows(hnsw.search(indexes.load_hnsw(spark, str(tmp_path / "hnsw")), q, 5, hnsw.Search(ef=100))) == want
    indexes.save_vectors(v, str(tmp_path / "all"))
    assert table(indexes.load_vectors(spark, str(tmp_path / "all"))) == table(v)
    v.limit(3).write.mode("append").parquet(str(tmp_path / "all" / "vectors"))
    with pytest.raises(indexes.IndexError_):
        indexes.load_vectors(spark, str(tmp_path / "all"))
    runs = spark.createDataFrame([("a", 1, 0.5)], "method string, setting int, recall double")
    indexes.append_results(runs, str(tmp_path / "log"))
    indexes.append_results(runs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stream(spark, tmp_path):
    v = frame(spark, X)
    source = tmp_path / "in"
    start = lambda: ingest.ingest(spark.readStream.schema(v.schema).parquet(str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    v.filter("vec_id < 30").write.parquet(str(source))
    start()
    q = as_queries(v.filter("vec_id < 2"))
    asked = [(i, X[i]) for i in range(2)]
    assert rows(ingest.search(spark, str(tmp_path / "t"), q, 4)) == exact(X[:30], asked, 4)
    v.filter("vec_id >= 30").write.mode("append").parquet(str(source))
    start()
    spark.createDataFrame([(0, None), (1, X[40].tolist())], v.schema).write.mode("append").parquet(str(source))
    start()
    changed, ids = X.copy(), list(range(1, 50))
    changed[1] = X[40]
    assert rows(ingest.search(spark, str(tmp_path / "t"), q, 4)) == exact(changed[ids], asked, 4, ids)
    ingest.compact(spark, str(tmp_path / "t"), str(tmp_path / "t2"))
    assert rows(ingest.search(spark, str(tmp_path / "t2"), q, 4)) == exact(changed[ids], asked, 4, ids)
    old = hnsw.build(frame(spark, X, range(100, 150)), hnsw.Build(m=6, width=40), 1)
    both = ingest.search(spark, str(tmp_path / "t2"), q, 4, lambda a, k: hnsw.search(old, a, k, hnsw.Search(ef=100)))
    assert rows(both) == exact(np.vstack([changed[ids], X]), asked, 4, [*ids, *range(100, 150)])


def test_large_files_are_split(spark, tmp_path, monkeypatch):
    x = vectors(300, 10)
    for number, part in enumerate((x[:170], x[170:])):
        (tmp_path / f"v{number}").write_bytes(files.encode_vecs(part, "<f4"))
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "b").write_bytes(x.tobytes())
    whole = {r["vec_id"]: r["embedding"] for r in files.read_fvecs(spark, str(tmp_path / "v*")).collect()}
    monkeypatch.setattr(files, "WHOLE", 100)
    split = {r["vec_id"]: r["embedding"] for r in files.read_fvecs(spark, str(tmp_path / "v*")).collect()}
    assert whole == split and len(split) == 300 and np.allclose(split[299], x[299])
    bare = {r["vec_id"]: r["embedding"] for r in files.read_bin(spark, str(tmp_path / "bare"), 10).collect()}
    assert bare == split
    (tmp_path / "bad").write_bytes(files.encode_vecs(x, "<f4")[:-3])
    with pytest.raises(files.FormatError):
        files.read_fvecs(spark, str(tmp_path / "bad"))


def test_graph_files_and_curves(spark, tmp_path):
    x = vectors(120, 8)
    index = hnsw.build(frame(spark, x), hnsw.Build(m=5, width=30), 2).cache()
    assert indexes.write_graph_files(index, f"file://{tmp_path}/graph", 5, 30) == 2
    back = indexes.read_graph_file(spark, f"{tmp_path}/graph", 8)
    plain = lambda f: {r["vec_id"]: (r["embedding"], [sorted(n) for n in r["links"]]) for r in f.collect()}
    assert plain(back) == plain(index) and hnsw.integrity(back).count() == 0
    with pytest.raises(indexes.FormatError):
        indexes.decode_graph(b"x" * 200, 8)
    (tmp_path / "a.log").write_text("10 0.1 5 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\nagain\n||| note aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\n100 95.5 1500.0 aaaaaaaaaaaaaaaaaaaaaaaaaaa\n200 99.0 2500.0 aaaaaaaaaaaaaaaaaaaaaaaaaaa\n")
    got = [(r["setting"], r["recall"], r["ms"]) for r in indexes.read_curve(spark, str(tmp_path / "a.log")).orderBy("pos").collect()]
    assert got == [("100", 95.5, 1.5), ("200", 99.0, 2.5)]


def test_inserted_and_moved_nodes_keep_the_graph_sound(spark):
    x = vectors(260, 12)
    how = hnsw.Build(m=6, width=40)
    index = hnsw.build(frame(spark, x[:150]), how, 2)
    for lo in range(150, 250, 50):
        more = np.vstack([x[lo : lo + 50], x[250:260]])
        index = hnsw.insert(index, frame(spark, more, [*range(lo, lo + 50), *range(lo - 120, lo - 110)]), how, 2).cache()
        assert hnsw.integrity(index).count() == 0
    now = x[:250].copy()
    now[30:40] = now[80:90] = x[250:260]
    queries = [(i, now[i]) for i in (0, 33, 85, 160, 249)]
    asked = frame(spark, np.array([q[1] for q in queries]), [q[0] for q in queries])
    assert rows(hnsw.search(index, as_queries(asked), 10, hnsw.Search(ef=300))) == exact(now, queries, 10)
