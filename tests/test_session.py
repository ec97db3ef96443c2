import os

import pytest

from tablewright import session


def test_shared_folder_is_the_one_the_session_names(spark, tmp_path, monkeypatch):
    conf, named = type(spark.conf), {"spark.checkpoint.dir": str(tmp_path)}
    real = conf.get
    monkeypatch.setattr(conf, "get", lambda self, key, *default: named.get(key) or real(self, key, *default))
    assert session.shared_folder(spark) == str(tmp_path)
    df = session.written(spark.range(5), "kept")
    assert df.count() == 5 and any(name.startswith("kept-") for name in os.listdir(tmp_path))
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_a_cluster_must_name_its_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_configure_sets_what_operators_rely_on(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    session.configure(spark)
    assert {k: spark.conf.get(k) for k in session.RUNTIME_SETTINGS} == session.RUNTIME_SETTINGS
