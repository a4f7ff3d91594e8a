"""The folder for intermediate tables."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from finality.llm import shared


def session(master: str, **settings: str) -> SimpleNamespace:
    reader = SimpleNamespace(get=lambda key, default="": settings.get(key.replace(".", "_"), default))
    return SimpleNamespace(conf=reader, sparkContext=SimpleNamespace(master=master, getConf=lambda: reader))


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    monkeypatch.setattr(shared, "ship", lambda spark: None)
    monkeypatch.setattr(shared, "small_batches", lambda spark: None)
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master), "t")
    named = shared.shared_folder(session("yarn", spark_checkpoint_dir="hdfs:///shared/"), "t")
    assert named.startswith("hdfs:///shared/t-")
    for master in ("local", "local[8]", "local[*]"):
        assert shared.shared_folder(session(master), "t").startswith("file:///")
