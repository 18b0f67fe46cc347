import os
import subprocess
import sys

import pytest

from headwater import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def python(*args, submit=None):
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")} | ({"PYSPARK_SUBMIT_ARGS": submit} if submit else {})
    done = subprocess.run([sys.executable, *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_settings_given_from_outside_stay():
    code = "from headwater.session import get_session; s = get_session(); print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.session.timeZone'), s.sparkContext.appName)"
    assert python("-c", code, submit="--master local[3] --name given --conf spark.sql.shuffle.partitions=7 pyspark-shell").split() == ["local[3]", "7", "UTC", "given"]
    os.environ["BENCH_CPUS"] = "2"
    try:
        assert python("-c", code).split() == ["local[2]", "2", "UTC", "headwater"]
    finally:
        del os.environ["BENCH_CPUS"]


def test_command_line(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("CREATE VIEW s.v AS SELECT a.x FROM s.a a\nGO\nCREATE PROCEDURE s.p AS BEGIN INSERT INTO s.t (x) SELECT x FROM s.v; END")
    assert "--dialect" in python("run.py", "--help") and "--dialect" in python("-m", "headwater", "--help")
    python("run.py", "--dialect", "mssql", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), submit="--master local[2] --conf spark.ui.enabled=false pyspark-shell")
    assert {"statements", "table_edges", "routines"} <= set(os.listdir(tmp_path / "out"))


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        sparkContext, conf = Context(), spark.conf

    monkeypatch.setattr(scratch, "SHARED_DIR", "spark.headwater.not.set")
    with pytest.raises(RuntimeError, match="all executors share"):
        scratch.shared_dir(Session())
    assert scratch.is_local("local[4]") and not scratch.is_local("local-cluster[2,1,1024]")


def test_scratch_tables_are_dropped_when_replaced(spark):
    s = scratch.Scratch(spark, "test")
    a = s.save(spark.range(3))
    path = a._scratch_path.removeprefix("file://")
    b = s.replace(a, a.withColumn("x", a["id"]))
    assert b.count() == 3 and not os.path.exists(path)
