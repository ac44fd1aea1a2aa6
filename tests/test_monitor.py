from datetime import datetime, timedelta

from lexweave.streaming import monitor
from lexweave.streaming.changefeed import stream_of
from lexweave.streaming.upserts import Upserts


def test_rates(spark, tmp_path):
    path, t0 = str(tmp_path / "feed"), datetime(2024, 1, 1)
    schema = "kind string, received_at timestamp"
    spark.createDataFrame([("add", t0), ("Added", t0 + timedelta(hours=3)), ("remove", t0 + timedelta(days=1))], schema).coalesce(1).write.parquet(path)
    go = lambda: monitor.run_to_files(monitor.change_rates(stream_of(spark, path), delay="2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    spark.createDataFrame([("add", t0 + timedelta(hours=5)), ("stay", t0 + timedelta(days=9))], schema).coalesce(1).write.mode("append").parquet(path)
    go()
    spark.createDataFrame([("add", t0 + timedelta(hours=6)), ("stay", t0 + timedelta(days=20))], schema).coalesce(1).write.mode("append").parquet(path)
    go()
    got = {(str(r.start)[:10], r.kind): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("2024-01-01", "add")] == 3 and got[("2024-01-02", "remove")] == 1  # the row six hours in came after the window had closed


def test_keep_fresh(spark, tmp_path):
    path, schema = str(tmp_path / "files"), "k string, h string, sequence bigint, gone boolean"
    layer = Upserts(spark, f"file://{tmp_path}/layer", ["k"])
    built = []

    def build(t):
        built.extend(r.k for r in t.collect())
        return t.selectExpr("k", "h", "k || h AS made")

    def go(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        monitor.keep_fresh(stream_of(spark, path), layer, "h", build, str(tmp_path / "cp"), "gone")
        return sorted(r.made for r in monitor.fresh_rows(layer).collect())

    assert go(("a", "1", 1, False), ("b", "0", 1, None), ("b", "1", 2, False)) == ["a1", "b1"]
    assert go(("a", "1", 3, False), ("b", "2", 3, False), ("b", "x", 1, False), ("c", "1", 3, False)) == ["a1", "b2", "c1"]
    assert sorted(set(built)) == ["a", "b", "c"] and built.count("a") == 1
    assert go(("a", "9", 2, False), ("c", None, 4, True)) == ["a1", "b2"]  # an older state, and a deletion
    assert go(("c", "1", 2, False)) == ["a1", "b2"]  # the tombstone stands against what is older
    before = {tuple(r) for r in layer.current().collect()}
    layer.compact()
    assert {tuple(r) for r in layer.current().collect()} == before and len(layer._live()) == 1
    assert go(("c", "1", 5, False), ("a", "1", 6, True)) == ["b2", "c1"]


def test_one_file_of_a_folder(spark, tmp_path):
    """Only the file itself is read, whatever signs its name has and whatever lies beside it."""
    import pandas as pd

    for name in ("a[1]{x}.parquet", "a[1]{x}.parquet.bak", "a1x.parquet"):
        pd.DataFrame({"kind": [name], "received_at": [datetime(2024, 1, 1)]}).to_parquet(tmp_path / name, coerce_timestamps="us")
    q = "file://" + str(tmp_path)
    reader = stream_of(spark, f"{q}/a1x.parquet")
    monitor.run_to_files(reader, str(tmp_path / "o"), str(tmp_path / "c"))
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["a1x.parquet"]
