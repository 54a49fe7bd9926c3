import json

import pytest
from pyspark.sql import functions as F

from textquarry.schema import SchemaError
from textquarry.sources import readers, sinks
from textquarry.streaming import serving, windows

BODY = {"text": "hello", "entities": ["name"]}


def test_line_files_keep_what_is_not_blank(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n \t \ntwo\n", encoding="utf-8")
    assert [r["text"] for r in readers.line_file(spark, str(tmp_path)).collect()] == ["  one ", "two"]
    assert readers.whole_files(spark, str(tmp_path)).first()["text"].startswith("  one")


def test_json_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"labels": ["a", "b"], "true_label": "a", "exercise": "e"}]))
    assert readers.label_sets(spark, str(tmp_path / "c.json")).first()["labels"] == ["a", "b"]


def test_requests_are_checked_in_order(spark):
    cases = [
        (json.dumps(BODY), "application/json", 200, None),
        (json.dumps(BODY), None, 200, None),
        (json.dumps(BODY | {"model": "other"}), "application/json", 422, "model"),
        (json.dumps(BODY | {"text": "  "}), "application/json", 422, "text"),
        (json.dumps(BODY | {"threshold": 1.5}), "application/json", 422, "threshold"),
        (json.dumps(BODY | {"overlap": "sideways"}), "application/json", 422, "overlap"),
        (json.dumps({"text": "t"}), "application/json", 422, "schema"),
        (json.dumps({"text": "t", "classify": ["oops"]}), "application/json", 422, "schema"),
        (json.dumps({"text": "t", "relations": ["r"]}), "application/json", 422, "schema"),
        (json.dumps(BODY | {"bogus": 1}), "application/json", 422, "body"),
        ("{nope", "application/json", 422, "body"),
        (json.dumps(BODY), "text/plain", 422, "Content-Type"),
        (json.dumps({"text": "x" * (2 << 20), "entities": ["a"]}), "application/json", 422, "body"),
        (json.dumps(BODY), "application/vnd.api+json; charset=utf-8", 200, None),
        (json.dumps(BODY), "application/jsonfoo", 422, "Content-Type"),
        *[(json.dumps(BODY | change), "application/json", 422, "body") for change in ({"text": 5}, {"text": None}, {"threshold": "high"}, {"threshold": None}, {"entities": [1]}, {"entities": None}, {"entities": ["a", None]}, {"entities": "a"}, {"spans": 1}, {"max_words": -1}, {"max_words": 1.5}, {"model": 3})],
        *[(json.dumps(BODY | change), "application/json", 200, None) for change in ({"model": None, "overlap": None, "max_words": None}, {"threshold": 1}, {"threshold": 0}, {"max_words": 7}, {"relations": []}, {"overlap": "Keep-Longest"})],
        (json.dumps({k: v for k, v in BODY.items() if k != "text"}), "application/json", 422, "body"),
        ("[1]", "application/json", 422, "body"),
    ]
    df = spark.createDataFrame([(i, b, t) for i, (b, t, *_) in enumerate(cases)], "doc_id long, body string, content_type string")
    out = {r["doc_id"]: r for r in readers.validated_requests(df, models=["multi"], supports=["entities", "classify"]).collect()}
    for i, (_, _, status, param) in enumerate(cases):
        assert out[i]["status"] == status, cases[i]
        assert (out[i]["error"]["param"] if out[i]["error"] else None) == param, cases[i]
        assert status == 200 or (out[i]["error"]["code"], out[i]["error"]["type"]) == (422, "invalid_request_error")
    hints = {"model": "Loaded model is 'multi'", "text": "must not be empty", "threshold": "between 0 and 1", "overlap": "unknown overlap_policy", "Content-Type": "application/json"}
    assert all(hints[r["error"]["param"]] in r["error"]["message"] for r in out.values() if r["error"] and r["error"]["param"] in hints)


def test_checkpoints_are_picked():
    assert readers.pick_checkpoint("p", "a", {"a": "x"}, "a") == "p"
    assert readers.pick_checkpoint(None, None, {"a": "x"}, "a") == "x"
    with pytest.raises(SchemaError):
        readers.pick_checkpoint(None, "b", {"a": "x"}, "a")


def test_sinks(spark):
    docs = spark.createDataFrame([(1, "a\tb\nc")], "doc_id long, text string")
    scored = spark.createDataFrame([(1, "t", "x", 0, 0.25), (1, "t", "y", 1, 0.75)], "doc_id long, task string, label string, ix int, score double")
    assert {r["line"] for r in sinks.tsv_rows(docs, scored).collect()} == {"a b c\tt\tx\t0.2500", "a b c\tt\ty\t0.7500"}
    assert sinks.classification_lines(docs, scored, False, 0.5).first()["line"] == "a b c\tt: x (0.250), *y (0.750)"
    assert sinks.classification_lines(docs, scored, False, 0.5, show_all=False).first()["line"] == "a b c\tt: y (0.750)"
    assert json.loads(sinks.json_array(scored, "ix").first()["value"])[1]["label"] == "y"


def test_requests_are_served_as_a_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.jsonl").write_text("\n".join([json.dumps(BODY), "{nope", json.dumps(BODY | {"text": "bye"})]))
    answer = lambda df: df.select(F.col("request.text").alias("text"))
    q = serving.serve(serving.request_stream(spark, str(inbox)), answer, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert {r["text"] for r in spark.read.json(str(tmp_path / "out/answers")).collect()} == {"hello", "bye"}
    assert spark.read.json(str(tmp_path / "out/errors")).first()["status"] == 422


def test_windows_agree_between_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = windows.hourly_counts(stream, "3650 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["window"]["start"], r["event_type"], r["n"]) for r in windows.hourly_counts(events).collect()}
    got = spark.table("hours").select(F.col("window.start").cast("timestamp_ntz").alias("s"), "event_type", "n").collect()
    assert {(r["s"], r["event_type"], r["n"]) for r in got} == want


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_texts_from_an_open_stream(spark):
    import io

    assert [r["text"] for r in readers.stdin_lines(spark, io.StringIO(" a\n\n  \nb\n")).orderBy("doc_id").collect()] == [" a", "b"]
    assert readers.stdin_text(spark, io.StringIO("a\nb")).first()["text"] == "a\nb"


def test_differences():
    from textquarry.functions.diff import differences

    a = {"x": [1, 2.0, {"y": "s"}], "z": None}
    assert not list(differences(a, {"x": [1.00001, 2, {"y": "s"}], "z": None}))
    assert [p for p, *_ in differences(a, {"x": [1, 3, {"y": "t"}], "w": 1})] == [".x[1]", ".x[2].y", ".z", ".w"]


def test_state_of_each_user_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = serving.last_events(stream).writeStream.format("memory").queryName("lasts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["user_id"]: (r["last"], r["n"]) for r in spark.table("lasts").collect()}
    from textquarry.queries import events_last6

    want = {r["user_id"]: r["last"] for r in events_last6(spark, "/root/testdata/sf0.001").collect()}
    assert {u: x for u, (x, _) in got.items()} == want and sum(n for _, n in got.values()) == events.count()
