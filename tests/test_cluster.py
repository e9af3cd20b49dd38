import importlib.util
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from svlattice.session import cut_lineage


def test_two_executors(tmp_path, sf):
    """Sinks, checkpoints and Python workers where driver and executors are separate processes."""
    here, home = Path(__file__).parent, tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(here.parent), "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(here / "cluster_run.py"), str(tmp_path), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "cluster run done" in done.stdout, done.stderr[:6000]


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=dict, master="local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut_lineage(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))
