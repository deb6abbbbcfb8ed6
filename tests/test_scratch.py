import os
import tempfile
from types import SimpleNamespace

import pytest

from korrel.scratch import Scratch, shared_dir


def test_tables_are_written_below_the_shared_folder(spark):
    scratch = Scratch(spark)
    assert scratch.root.startswith(shared_dir(spark) + "/")
    kept = scratch.keep(spark.range(5).repartition(2), "numbers")
    path = os.path.dirname(kept.inputFiles()[0].removeprefix("file:")).replace("//", "")
    path = path if path.startswith("/") else "/" + path
    assert kept.count() == 5 and os.path.isdir(path)
    empty = scratch.keep(spark.range(0), "none")
    assert empty.count() == 0 and empty.columns == ["id"]
    other = scratch.keep(spark.range(3), "numbers")
    scratch.drop(kept)
    assert not os.path.exists(path) and other.count() == 3
    scratch.drop(spark.range(3))
    scratch.release()


def test_bucketed_tables_are_there_too(spark):
    scratch = Scratch(spark)
    name = scratch.bucketed(spark.range(20).repartition(3, "id"), "numbers", 3, ["id"], ["id"])
    root = scratch.root.removeprefix("file:").lstrip("/")
    assert spark.table(name).count() == 20 and all(f.removeprefix("file:").lstrip("/").startswith(root) for f in spark.table(name).inputFiles())
    plan = spark.table(name).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    scratch.drop_table(name)
    assert not spark.catalog.tableExists(name) and not list(os.scandir("/" + root))


def stub(master, application, checkpoint=None, **conf):
    context = SimpleNamespace(master=master, applicationId=application, getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)), sparkContext=context)


def test_only_local_sessions_may_lack_the_setting():
    at = "hdfs://there/shared"
    assert shared_dir(stub("yarn", "a", spark_checkpoint_dir=at + "/")) == at == shared_dir(stub("yarn", "b", at))
    for master in ("local", "local[1]", "local[*]"):
        made = shared_dir(stub(master, master))
        assert made.startswith(f"file://{tempfile.gettempdir()}/korrel-") and made == shared_dir(stub(master, master))
    for master in ("local-cluster[1,1,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(stub(master, master))
