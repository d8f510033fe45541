import pytest

from rillworks import storage


def test_clean_drops_tables_and_files(spark):
    before = len(storage._kept)
    name = storage.bucketed(spark.range(10), "kept", 2, ["id"], ["id"])
    assert spark.table(name).count() == 10
    storage.stored(spark.range(3), "rows")
    storage.clean(before)
    assert not spark.catalog.tableExists(name) and len(storage._kept) == before


def test_scope_keeps_what_was_there(spark):
    kept = storage.stored(spark.range(3), "outer")
    with storage.scope():
        inner = storage.stored(spark.range(4), "inner")
        assert inner.count() == 4
    assert kept.count() == 3


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())


@pytest.mark.parametrize(("master", "folder", "refused"), [("spark://host:7077", "file:{cwd}/spark-warehouse", True), ("spark://host:7077", None, True), ("yarn", "hdfs://x/warehouse", False), ("local-cluster[2,1,1024]", "/shared/warehouse", False), ("local[4]", "file:{cwd}/spark-warehouse", False)])
def test_no_table_in_a_folder_of_the_driver(master, folder, refused):
    import os

    found = folder and folder.format(cwd=os.getcwd())
    session = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, key, default: found})(), "sparkContext": type("Context", (), {"master": master})()})()
    if refused:
        with pytest.raises(ValueError, match="warehouse"):
            storage.shared_warehouse(session)
    else:
        assert storage.shared_warehouse(session) == found


def test_tables_need_no_warehouse_of_their_own(spark, monkeypatch):
    def refused(_):
        raise ValueError("spark.sql.warehouse.dir")

    monkeypatch.setattr(storage, "shared_warehouse", refused)  # as on a cluster whose session names a checkpoint folder only
    before = len(storage._kept)
    name = storage.bucketed(spark.range(100), "placed", 4, ["id"], ["id"])
    where = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    assert where.removeprefix("file:") == f"{storage.shared_dir(spark).removeprefix('file:')}/{name}"
    assert "Exchange" not in spark.table(name).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    storage.clean(before)
    assert not storage.children(spark, where)
