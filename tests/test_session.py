"""The shared folder, and the package on the workers."""

import os
import subprocess
import sys

import pytest

from platewise import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Context:
    applicationId = "app"

    def __init__(self, master):
        self.master = master

    def getConf(self):
        return Conf()

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.path = path


class Session:
    def __init__(self, master):
        self.sparkContext, self.conf = Context(master), Conf()


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("local-cluster[2,1,1024]"))
    assert os.path.isdir(session.shared_dir(Session("local[2]")))


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from platewise.session import configure, local_session
spark = configure(local_session(2))
from platewise.functions.special import chisq_pvalue
from pyspark.sql import functions as F
p = spark.range(3).select(chisq_pvalue(F.col("id") + 1.0, F.lit(2.0)).alias("p")).collect()
assert abs(p[0].p - 0.6065306597126334) < 1e-12, p
print("fine")
"""


def test_workers_get_the_package_from_any_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_draws_are_exact_at_any_size():
    import numpy as np

    from platewise.operators.stats import _draw_hypergeometric, poisson_edges

    rng = np.random.default_rng(0)
    for good, bad, n in ((5, 7, 4), (40, 3, 20), (10**12, 3 * 10**12, 10**6)):
        x = np.array([_draw_hypergeometric(rng, good, bad, n) for _ in range(3000)])
        share = good / (good + bad)
        sd = (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5
        assert abs(x.mean() - n * share) < 5 * sd / 3000**0.5 and abs(x.std() / sd - 1) < 0.1
        assert x.min() >= max(0, n - bad) and x.max() <= min(good, n)
    edges = poisson_edges()
    assert len(edges) > 15 and 0 < 1 - edges[-1] < 1e-15
