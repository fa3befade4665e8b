"""The checkpoint folder comes from the session; netlens never replaces a configured one."""

import pytest

from netlens.session import checkpoint_dir


def test_checkpoint_dir_is_the_configured_one(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    got = checkpoint_dir(spark)
    if base:
        assert got == base  # the cluster's shared folder, stable across restarts
    assert checkpoint_dir(spark) == got


def test_reliable_checkpoint_cuts_lineage(spark):
    checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count()
    cp = df.checkpoint(eager=True)
    assert "Exchange" not in cp._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["count"] for r in cp.collect()) == [14, 14, 14, 14, 14, 15, 15]


def test_unset_checkpoint_setting_gets_a_stable_scratch_folder(tmpdir_path):
    """Without spark.checkpoint.dir (an empty conf folder): a scratch folder, the same on
    every call, given to the context so checkpoint() works. Runs in its own process."""
    import os
    import subprocess
    import sys
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from netlens.session import checkpoint_dir\n"
        "a = checkpoint_dir(s); b = checkpoint_dir(s)\n"
        "assert a == b and s.conf.get('spark.checkpoint.dir', None) in (None, '')\n"
        "assert s.range(5).groupBy().count().checkpoint().first()[0] == 5\n"
        "print('OK', a)\n"
    ) % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_CONF_DIR=tmpdir_path)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "OK" in out.stdout, out.stderr[-2000:]


def test_no_local_folder_off_a_local_master(monkeypatch):
    """Executors elsewhere would not share it."""
    class Context:
        master, applicationId = "spark://host:7077", "app-none"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
