"""Scans, sinks and streams over small files."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofmill.sources import evidence, histories, sinks
from proofmill.streaming import results


def lme(**other):
    row = {
        "question_id": "q1", "question_type": "t", "question": "?", "answer": 3, "question_date": "2023/05/30 (Tue) 10:00", "answer_session_ids": ["s2"],
        "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/21 (Sun) 08:00", "2023/05/20 (Sat) 02:21"],
        "haystack_sessions": [[{"role": "user", "content": "a", "has_answer": False}], [{"role": "assistant", "content": "b"}]],
    }
    return {**row, **other}


def test_rows_are_checked_and_ordered(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([lme(), lme(question_id="q2", haystack_dates=["2023/05/21 (Sun) 08:00"]), lme(question_id="q1", answer="x", answer_session_ids=["zz"])]))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    rows = histories.read_rows(spark, str(path), digest).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [1, 2, 3] and [r.answer for r in rows] == ["3", "3", "x"]
    assert [s.session_id for s in rows[0].sessions] == ["s2", "s1"] and rows[0].violations == []
    assert "unaligned" in rows[1].violations and rows[2].violations == ["unresolved_answer"]
    assert [r.question_id for r in histories.duplicate_questions(histories.read_rows(spark, str(path))).collect()] == ["q1"]
    with pytest.raises(Exception, match="checksum mismatch"):
        histories.read_rows(spark, str(path), "0" * 64).collect()


def test_conversations_of_three_shapes(spark, tmp_path):
    turn = lambda i, **x: {"id": i, "role": "user", "content": f"c{i}", **x}
    rows = [{"conversation_id": 7, "user_profile": {"user_info": "u"}, "chat": [[turn(1)], turn(2, time_anchor="March-15-2024"), {"plan": [{"time_anchor": None, "turns": [[turn(3), turn(4)], turn(5)]}]}]}]
    path = tmp_path / "beam.json"
    path.write_text(json.dumps(rows))
    dated = histories.dated_sessions(histories.read_conversations(spark, str(path)))
    got = {r.session: (len(r.turns), r.donor_session, r.event_time.year) for r in dated.collect()}
    assert got == {0: (1, 1, 2024), 1: (1, 1, 2024), 2: (3, 1, 2024)}
    lines = [r.content for r in histories.session_messages(dated).orderBy("session", "place").collect()]
    assert lines[0] == "[Turn 1] User: c1" and lines[1] == "[March-15-2024 | Turn 2] User: c2" and len(lines) == 5


def test_records_shards_maps_and_pages(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "a.json").write_text('{"schema_name":"attempt","schema_version":1,"id":"x"}\n{"schema_name":"other","schema_version":1}\n')
    parts = evidence.read_records(spark, str(folder), {("attempt", 1): "id string"})
    assert [r.id for r in parts["attempt", 1].collect()] == ["x"] and parts["", 0].count() == 1

    shard = tmp_path / "shards" / "s.json.gz"
    shard.parent.mkdir()
    shard.write_bytes(gzip.compress(b'{"k": 1}\n{"k": 2}\n'))
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"file": "s.json.gz", "sha256": hashlib.sha256(shard.read_bytes()).hexdigest(), "count": 2, "arm": "a", "dataset": "d"}))
    got = evidence.read_shards(spark, str(manifest), str(shard.parent), "k long").collect()
    assert sorted((r.k, r.mismatch) for r in got) == [(1, False), (2, False)]

    saved = tmp_path / "results.json"
    saved.write_text('{"b": {"s": 1}, "a": {"s": 2}, "z": {"s": 3}}')
    order = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ordinal long")
    rows = evidence.read_result_map(spark, str(saved), "struct<s:long>", order, "id", "ordinal").collect()
    assert {(r.id, r.unknown) for r in rows} == {("a", False), ("b", False), ("z", True)}

    pages = spark.createDataFrame([(1, [("p",), ("q",)], 3, "c"), (2, [("q",)], 3, None)], "page long, points array<struct<id:string>>, total long, cursor string")
    points, codes = evidence.concatenate_pages(pages, "points", "total", "cursor", "id")
    assert points.count() == 3 and [r.code for r in codes.collect()] == ["duplicate_id"]


def test_snapshots_and_external(spark, tmp_path):
    for name, provider in (("a", "p1"), ("b", "p1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "snapshot.json").write_text(json.dumps({"provider": provider}))
    _, wrong = evidence.discover_snapshots(spark, str(tmp_path), ["p1", "p2"])
    assert {(r.provider, r.n) for r in wrong.collect()} == {("p1", 2), ("p2", 0)}
    path = tmp_path / "ext.json"
    path.write_text('{"cases": [{"case_id": "1", "category": "c", "verdict": true, "context_tokens": 5, "retrieval_time_ms": 1.25}]}')
    assert str(evidence.read_external(spark, str(path)).collect()[0].retrieval_time_ms) == "1.250000"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v long")
    path = str(tmp_path / "results")
    sinks.append_results(df.where("v < 3"), path, "k")
    sinks.append_results(df.withColumn("v", F.col("v") * 10), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    sinks.write_content_addressed(df, "k", str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    sinks.publish(df, str(tmp_path / "pub"))
    assert sinks.published(spark, str(tmp_path / "pub")) and not sinks.published(spark, str(tmp_path / "no"))
    listed = sinks.export_report({"one": df}, str(tmp_path / "report")).collect()
    assert all(len(r.sha256) == 64 for r in listed)
    sinks.export_json_array(df, str(tmp_path / "array"))
    assert len(json.loads(spark.read.text(str(tmp_path / "array")).collect()[0].value)) == 3


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(folder))
    schema["ts"].dataType = spark.read.parquet(str(folder)).schema["ts"].dataType
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = results.append_stream(results.first_results(stream, "event_id", "ts", "60 days"), str(tmp_path / "out"), "event_id", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    w = results.windowed_latency(stream, "ts", "value", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    w.awaitTermination(120)
    total = spark.sql("SELECT sum(count) AS n FROM latency").collect()[0].n
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_config_and_checksums(tmp_path):
    from proofmill.sources import config

    (tmp_path / "a.json").write_text('{"a": {"b": 1}}')
    assert config.load_config(tmp_path / "a.json") == {"a": {"b": 1}}
    (tmp_path / "b.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeated"):
        config.load_config(tmp_path / "b.json")
    sums = config.checksum_list(f"{hashlib.sha256((tmp_path / 'a.json').read_bytes()).hexdigest()}  a.json\n{'0' * 64} *gone\n")
    assert config.verify_files(tmp_path, sums) == ["gone"]
    with pytest.raises(ValueError, match="checksum line"):
        config.checksum_list("xyz a")


def test_records_of_another_type_are_kept_apart(spark, tmp_path):
    good = {"schema_name": "a", "schema_version": 1, "n": 5}
    lines = [json.dumps(good), json.dumps({**good, "n": "five"}), json.dumps({**good, "schema_version": 2}), '{"schema_name": "a", "schema_version": 1, "n": ', "no json"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    found = evidence.read_records(spark, str(tmp_path), {("a", 1): "n long"})
    assert [r.n for r in found["a", 1].collect()] == [5]
    assert sorted(r.value for r in found["", 0].collect()) == sorted(lines[1:])


def test_a_file_without_a_list_is_refused(spark, tmp_path):
    from proofmill.sources import histories

    (tmp_path / "x.json").write_text('{"question_id": "q"}')
    for reader in (histories.read_rows, histories.read_conversations):
        with pytest.raises(Exception, match="no array"):
            reader(spark, str(tmp_path / "x.json")).collect()


def test_datasets_are_chosen_unique_and_selected(spark, tmp_path):
    from proofmill.sources import histories

    row = {"question_type": "t", "question": "q?", "answer": "a", "question_date": "2023/05/20 (Sat) 02:21", "haystack_session_ids": ["s"], "haystack_dates": ["2023/05/19 (Fri) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x"}]], "answer_session_ids": ["s"]}
    path = str(tmp_path / "d.json")
    (tmp_path / "d.json").write_text(json.dumps([{**row, "question_id": q} for q in "abc"]))
    assert sorted(r.question_id for r in histories.load_histories(spark, "rows", path, selection=["c", "a"]).collect()) == ["a", "c"]
    for kind, chosen in (("other", None), ("rows", ["z"]), ("rows", ["a", "a"])):
        with pytest.raises(ValueError, match="unknown|repeated"):
            histories.load_histories(spark, kind, path, selection=chosen)
    (tmp_path / "e.json").write_text(json.dumps([{**row, "question_id": q} for q in "aab"]))
    with pytest.raises(ValueError, match="more than once"):
        histories.load_histories(spark, "rows", str(tmp_path / "e.json"))


def test_external_files_are_closed(spark, tmp_path):
    case = {"case_id": "1", "category": "c", "verdict": True, "context_tokens": 5, "retrieval_time_ms": 1.25}
    for name, text in {
        "a": json.dumps({"cases": [case, {**case, "case_id": "2"}], "total_cases": 2}), "b": json.dumps({"cases": [{**case, "answer": "x"}, case], "extra": 1}), "c": "not json", "d": json.dumps({"cases": [{**case, "verdict": "yes"}]}),
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((r.path[-6], r.code, r.ref) for r in evidence.external_issues(spark, f"{tmp_path}/*.json").collect())
    assert got == [("b", "case_field", "answer"), ("b", "duplicate", "1"), ("b", "field", "extra"), ("c", "unparsable", None), ("d", "case", "1")]


def test_offset_pages(spark):
    schema = "offset long, limit long, total long, items array<struct<id:string>>"
    page = lambda at, ids, total=5: (at, 2, total, [(i,) for i in ids])
    def codes(pages):
        rows, wrong = evidence.concatenate_offset_pages(spark.createDataFrame(pages, schema), "items", "offset", "limit", "total", "id")
        return rows.count(), sorted(r.code for r in wrong.collect())

    assert codes([page(0, "ab"), page(2, "cd"), page(4, "e")]) == (5, [])
    assert codes([page(0, "ab"), page(2, "c"), page(4, "e", 6)]) == (4, ["count", "count_drift", "offsets", "short_page"])
    assert codes([page(0, "ab"), page(2, "cb"), page(4, "e")]) == (5, ["duplicate_id"])


def test_published_folders_are_replaced_and_verified(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.replace(spark.range(n).coalesce(1), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    root = tmp_path / "run"
    (root / "raw").mkdir(parents=True)
    (root / "raw" / "x.bin").write_bytes(b"abc")
    (root / "a.json").write_text("{}")
    (root / "b.json").write_text("{}")
    assert [r.code for r in sinks.verify_published(spark, str(root)).collect()] == ["unpublished"]
    listed = {r.path: r.kind for r in sinks.publish_with_manifest(spark, str(root)).collect()}
    assert listed == {"raw/x.bin": "raw", "a.json": "record", "b.json": "record"}
    assert sinks.verify_published(spark, str(root)).count() == 0
    (root / "a.json").write_text("[]")
    (root / "b.json").unlink()
    (root / "c.json").write_text("{}")
    assert {r.path: r.code for r in sinks.verify_published(spark, str(root)).collect()} == {"a.json": "changed", "b.json": "missing", "c.json": "extra"}
    sinks.export_pairs(spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "left string, right string, n long"), str(tmp_path / "pairs"), "left", "right")
    assert sorted(p.name for p in (tmp_path / "pairs").glob("pair=*")) == ["pair=a--b", "pair=a--c"]
