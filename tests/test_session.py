"""The shared folder: what is deleted there, and when it must be set."""

from pathlib import Path

import pytest

from vecloom import session


def there(df):
    return Path(df._stored_at.removeprefix("file:")).exists()


def test_scratch_deletes_all_but_what_is_kept(spark):
    with session.Scratch(spark) as outer:
        with session.Scratch(spark) as inner:
            a, b, c = (session.materialize(spark.range(3), "t") for _ in range(3))
            inner.drop(b)
            assert there(a) and not there(b)
            inner.keep(c)
        assert not there(a) and there(c) and c.count() == 3
    assert not there(c)
    with session.Scratch(spark) as outer:
        d = outer.keep(session.materialize(spark.range(2), "t"))
    assert d.count() == 2


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, environment = "spark://host:7077", {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Cluster)
