"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from residua.plans import catalogue, sources
from residua.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    assert differences(catalogue.queries()[name](spark, SMALL), con, catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The embeddings with positions around and far beyond four and five columns."""
    at = str(tmp_path_factory.mktemp("far"))
    ids = spark.createDataFrame([(i, 9_960 + i) for i in range(60)] + [(60 + i, 99_990 + 7 * i) for i in range(20)], "vec_id long, at long")
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").join(ids, "vec_id")
    rows.withColumn("vec_id", F.col("at")).drop("at").write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["atoms_fixed_width", "atoms_all_models", "ca_bfactors", "distinct_keys", "fixed_width_defaults"])
def test_far_positions(spark, far, name):
    assert differences(catalogue.queries()[name](spark, far[0]), far[1], catalogue.oracle_sql()[name]) == ""


def test_files_hold_all_positions(spark, far):
    got = sources._whole(sources.structures.read_atoms(sources.structure_files(Tables(spark, far[0])), "file")).agg(F.countDistinct("res_id"), F.max("res_id")).first()
    assert tuple(got) == (80, 100_123)


def test_exclusion_lists_are_bounded(spark, tmp_path):
    spark.range(5000).selectExpr("id AS doc_id", "0 AS quality", "CAST(id % 2 AS INT) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    t = Tables(spark, str(tmp_path))
    assert sources.exclusion_lists(t).agg(F.max(F.length("doc"))).first()[0] < 10_000
    assert sources.load_exclusions(t).count() == 5000
