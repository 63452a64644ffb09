from __future__ import annotations

from pathlib import Path

import pytest

from vesselspark import tables


class Session:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_folder(spark, monkeypatch):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        tables.shared_dir(Session)
    monkeypatch.setattr(Session.sparkContext, "master", "local[2]")
    assert Path(tables.shared_dir(Session)).is_dir() and tables.shared_dir(Session) == tables.shared_dir(Session)


def test_scratch(spark):
    df = spark.range(100).selectExpr("id % 7 as k").groupBy("k").count()
    before = spark.conf.get(tables.CLEANUP)
    with tables.scratch() as written:
        gone, kept = tables.write_table(df), tables.write_table(df)
        written.remove(kept)
    folder = Path(tables.shared_dir(spark))
    assert kept.count() == 7 and spark.conf.get(tables.CLEANUP) == before
    names = {p.name for p in folder.iterdir()}
    assert Path(kept.__dict__["_written_to"]).name in names and Path(gone.__dict__["_written_to"]).name not in names
    tables.drop_table(kept)
    assert Path(kept.__dict__["_written_to"]).name not in {p.name for p in folder.iterdir()}
