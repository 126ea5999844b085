import json

from textloom.streaming import ingest


def test_ingest_resumes_and_replaces(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in rows))
    put("a.json", [(1, "one two. three"), (2, "x")])
    run = lambda: ingest.passage_batches(ingest.stream_documents(spark, str(src)), out, ck).awaitTermination()
    run()
    put("b.json", [(2, "y z")])
    run()
    run()
    assert sorted((r.id, r.content) for r in ingest.latest(spark, out).collect()) == [(1, "one two. three"), (2, "y z")]


def test_windows_and_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.query_windows(events, "ts", "event_type").selectExpr("sum(n)").first()[0] == events.count()
    s = ingest.sessions(events, "user_id", "ts")
    assert s.selectExpr("sum(n)").first()[0] == events.count()
