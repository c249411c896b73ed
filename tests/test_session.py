import os

from pagelens import session


def test_written_tables_and_scratch(spark):
    table = session.written(spark.range(5), "numbers")
    assert table.count() == 5
    root = session.scratch_root(spark)
    local = root.removeprefix("file:")
    assert root.startswith(session.shared_dir(spark)) and os.path.isdir(local)
    path = session.scratch_path(spark, "x")
    assert path != session.scratch_path(spark, "x")
    session.drop_scratch(spark)
    assert not os.path.exists(local)


def test_shared_dir_is_the_named_folder_or_in_the_warehouse():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.sql.warehouse.dir": "hdfs://x/warehouse/"})

    assert session.shared_dir(Session()) == "hdfs://x/warehouse/pagelens-scratch"
    Session.conf = Conf({"spark.checkpoint.dir": "hdfs://x/shared"})
    assert session.shared_dir(Session()) == "hdfs://x/shared"


def test_small_sides_are_checked(spark):
    assert session.small_side(spark.range(5), "few").count() == 5
    plan = spark.range(9).join(session.small_side(spark.range(5), "many", 3), "id")
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()
