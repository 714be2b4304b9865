"""The shared folder comes from the session and from nowhere else."""

from types import SimpleNamespace

import pytest

from tallybook.session import clear_staged, exists, shared_dir, stage


def test_shared_folder_must_be_named():
    nameless = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(nameless)


def test_staged_folders_can_be_cleared(spark):
    staged = stage(spark.range(3), "test")
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    assert staged.count() == 3 and exists(spark, folder)
    clear_staged(spark)
    assert not exists(spark, folder)
