"""Readers, writers, storage and streams."""

import datetime as dt

from pyspark.sql import functions as F

from skeinwork.sources import readers, writers
from skeinwork.storage import Stash, shared_root
from skeinwork.streaming import windows


def test_csv_encodings(spark, tmp_path):
    for encoding in ("utf-8", "gbk", "cp1252"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes('videolink,mediacaption\nx,"a, ""b""\nc"\ny,é\n'.encode(encoding))
        rows = readers.read_csv(spark, str(path), encoding=encoding).collect()
        assert [r["mediacaption"] for r in rows] == ['a, "b"\nc', "é"]
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\xfe\xfa\n")
    assert readers.probe_encoding(spark, str(tmp_path / "utf-8.csv")) == "utf-8"
    assert readers.probe_encoding(spark, str(tmp_path / "bad.csv")) in ("cp1252", "iso-8859-1")


def test_comments_json_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"postId":"1","commentId":"a"}\nnot json\n{"postId":"","commentId":"b"}\n{"commentId":"c"}\n')
    assert [r["commentId"] for r in readers.read_comments(spark, str(tmp_path / "c.json")).collect()] == ["a"]


def test_url_map_words_labels(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1,http://a,b\nnothing\n1,http://c\n2, http://d\n")
    assert {tuple(r) for r in readers.read_url_map(spark, str(tmp_path / "m.txt")).collect()} == {("1", "http://c"), ("2", "http://d")}
    (tmp_path / "w.txt").write_text(" Rat\nrat\n\nshut up\n")
    assert {r["word"] for r in readers.read_words(spark, str(tmp_path / "w.txt")).collect()} == {"rat", "shut up"}
    (tmp_path / "l.json").write_text('{"media_session_1": 1, "media_session_2": 0}')
    (tmp_path / "r.json").write_text('[{"post_id": "session_3", "is_bullying": 1}]')
    assert {tuple(r) for r in readers.read_label_map(spark, str(tmp_path / "l.json")).collect()} == {("media_session_1", 1), ("media_session_2", 0)}
    assert {tuple(r) for r in readers.read_label_map(spark, str(tmp_path / "r.json")).collect()} == {("session_3", 1)}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", 3), ("s1", "b", 2), ("s2", "c", 5)], "session_id string, subgraph_id string, total_nodes int")
    for kind in ("parquet", "json", "csv", "orc"):
        writers.save(df, f"{tmp_path}/{kind}", kind)
        assert readers.load(spark, f"{tmp_path}/{kind}", kind).count() == 3
    for bad in (lambda: writers.save(df, f"{tmp_path}/x", "pickle"), lambda: readers.load(spark, f"{tmp_path}/x", "pickle")):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass
    writers.save_by_session(df, f"{tmp_path}/sessions")
    assert {r["subgraph_id"] for r in readers.read_session(spark, f"{tmp_path}/sessions", "s1").collect()} == {"a", "b"}
    assert {r["session_id"]: (r["subgraphs"], r["min_size"]) for r in writers.subgraph_index(df).collect()} == {"s1": (2, 2), "s2": (1, 5)}
    assert [r["session_id"] for r in writers.missing_sessions(df, df.where("session_id = 's1'")).collect()] == ["s2"]
    nodes = spark.createDataFrame([("user", 1)], "type string, id int")
    edges = spark.createDataFrame([("posts", 1, 2)], "rel string, src int, dst int")
    writers.save_graph(nodes, edges, f"{tmp_path}/graph")
    assert spark.read.parquet(f"{tmp_path}/graph/edges").where("rel = 'posts'").count() == 1


def test_stash(spark):
    stash = Stash(spark, "test")
    df = stash.put(spark.range(5))
    assert df.count() == 5 and stash.base.startswith(shared_root(spark))
    stash.close()


def test_windows_batch_and_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "u", k, 1.0) for m, k in ((0, "a"), (30, "a"), (70, "b"), (200, "a"))]
    df = spark.createDataFrame(rows, "ts timestamp, user string, kind string, value double")
    batch = {(r["start"], r["kind"]): r["n"] for r in windows.tumbling(df, "ts", "1 hour", "kind", "value").collect()}
    assert batch == {(t, "a"): 2, (t + dt.timedelta(hours=1), "b"): 1, (t + dt.timedelta(hours=3), "a"): 1}
    assert windows.sliding(df, "ts", "1 hour", "30 minutes", "kind", "value").count() == 8 - 1
    assert windows.sessions(df, "ts", "45 minutes", "user").count() == 2
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = windows.tumbling(stream, "ts", "1 hour", "kind", "value", "10 minutes").writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT * FROM windows_out").count() == 2
    totals = windows.running_totals(stream.withColumn("score", F.lit(0.5)), "user", "score").writeStream.format("memory").queryName("totals_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").start()
    totals.processAllAvailable()
    totals.stop()
    assert spark.sql("SELECT comments, above FROM totals_out").first() == (4, 4)
