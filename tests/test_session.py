import pytest

from chunkloom import session


def test_shared_folder_follows_the_setting_or_is_one_of_its_own(spark, monkeypatch):
    set_to = session._setting(spark)
    path = session.shared_dir(spark, "x")
    assert path.startswith(set_to or session._own_base(spark.sparkContext.applicationId)) and path != session.shared_dir(spark, "x")
    own = session._own_base(spark.sparkContext.applicationId)
    monkeypatch.setattr(session, "_setting", lambda _: None)
    assert session.shared_dir(spark, "y").startswith(own + "/y-")
    monkeypatch.setattr(session, "_setting", lambda _: own + "/set")
    assert session.shared_dir(spark, "z").startswith(own + "/set/z-")


def test_a_cluster_without_a_shared_folder_raises(spark, monkeypatch):
    monkeypatch.setattr(session, "_setting", lambda _: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(spark, "x")


def test_materialised_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "é", None)], "a bigint, `b.c` string, d binary")
    got = session.materialize(df, "t")
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert session.materialize(df.limit(0), "t").count() == 0


def test_workers_get_the_package(spark, tmp_path):
    """From another folder, without the package on the path of workers."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from chunkloom.session import build_session\n"
        "s = build_session('ship', 'local[2]', spark__driver__memory='1g')\n"
        "print('ROWS', e.queries()['cdc_chunks'](s, sys.argv[2]).count())\n"
    )
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(session.__file__))), data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
