import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vecspark.plans import queries as vectors

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
HEADLINE = ["knn_exact", "knn_seeded_pca", "knn_seeded_opq", "ivf_search", "ivf_recall", "pq_refine_recall", "kmeans_cells", "pca_spectrum", "dco_ads", "hnsw_full_width", "hnsw_update", "hnsw_pq_qeo", "hnsw_finger", "hnsw_two_hops", "finger_edges", "prune_summary", "fvecs_round_trip", "stream_ingest_and_search"]


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str([norm(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", HEADLINE)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{DATA}/embeddings.parquet')")
    df = vectors.QUERIES[name](spark, DATA)
    want = con.sql(vectors.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [list(want.columns).index(c) for c in names]
    assert sorted(tuple(norm(x) for x in r) for r in df.select(*names).collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() == 250


def test_the_rest_stands_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(vectors.QUERIES)), "0", "False", "True"], said.stderr


#: Queries that write files of their own.
WRITE_FILES = ["fvecs_round_trip", "floats_round_trip", "hnsw_graph_file", "bin_round_trip", "ivecs_round_trip"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", WRITE_FILES)
def test_files_are_written_on_a_cluster_whose_checkpoint_folder_has_no_scheme(spark, monkeypatch, name):
    assert "://" not in spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    test_queries_match_their_sql(spark, name)
