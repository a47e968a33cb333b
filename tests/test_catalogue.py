import os
import shutil
import subprocess
import sys

import pytest
from oracle import DATA, assert_same

from strataq.plans import catalogue

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, name):
    ordered = name in ("limit_ordered", "segment_limit")
    assert_same(catalogue.queries()[name](spark, f"{DATA}/{SF}"), catalogue.oracle_sql()[name], SF, ordered)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_filter_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = catalogue.queries()["pred_and3"](spark, f"{DATA}/{SF}")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,750)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_round_trip_of_a_table_behind_a_shuffle(spark):
    """sf0.1 has enough orders that the writer's jobs coalesce the sort differently."""
    assert_same(catalogue.queries()["roundtrip_all"](spark, f"{DATA}/sf0.1"), catalogue.oracle_sql()["roundtrip_all"], "sf0.1")


def test_the_rest_stands_without_the_operators_for_training_data(tmp_path):
    """A copy without the subpackage and the pipeline still has all engine queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/strataq", tmp_path / "strataq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(catalogue.queries()))] * 2, done.stderr
