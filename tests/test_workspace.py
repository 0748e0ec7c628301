"""The shared folder comes from the session; a temporary one is for a local master only."""

from types import SimpleNamespace

import pytest

from lakeload.workspace import new_folder, shared_root, stage


def session(setting, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="app-1")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_folder_follows_the_setting():
    assert shared_root(session("s3a://shared/tmp/", "spark://m")) == "s3a://shared/tmp"
    assert new_folder(session("hdfs:///c", "yarn"), "x").startswith("hdfs:///c/lakeload/app-1/x-")
    assert "lakeload-" in shared_root(session(None, "local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(None, "yarn"))


def test_staged_table_is_what_was_given(spark):
    df = spark.range(5).selectExpr("id", "named_struct('a', id, 'b', 'x') AS s", "array(id) AS l")
    staged = stage(df, "t")
    assert staged.dtypes == df.dtypes and sorted(staged.collect()) == sorted(df.collect())
    assert stage(df.limit(0), "t").count() == 0
