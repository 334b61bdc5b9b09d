import gc
import os
import time
from types import SimpleNamespace

import pytest

from tidecue.session import cut, ensure_checkpoint_dir, scratch_folder


def files(folder):
    return sum(len(names) for _, _, names in os.walk(folder.removeprefix("file:")))


def settled(spark, folder, most=0):
    """Files left once the cleaner has nothing more to remove."""
    before = -1
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        now = files(folder)
        if now == before and now <= most:
            break
        before = now
    return now


def test_checkpoints_are_removed_when_nothing_needs_them(spark):
    folder = ensure_checkpoint_dir(spark)
    kept = cut(spark.range(10).repartition(3))
    before = settled(spark, folder, 1_000)
    dropped = cut(spark.range(1000).repartition(4))
    assert files(folder) > before
    del dropped
    assert settled(spark, folder, before) <= before and kept.count() == 10


def test_no_folder_of_one_machine_on_a_cluster():
    conf = SimpleNamespace(set=lambda *_: None)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(conf=lambda: conf, getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), master="local-cluster[3,2,1024]")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_scratch_folders_lie_beside_checkpoints(spark):
    a, b = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert a != b and a.startswith(ensure_checkpoint_dir(spark))
