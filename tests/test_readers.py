"""Readers and sinks on small files."""

import json

from plantflow.sources import history, readers


def test_readings_json_types(spark, tmp_path):
    lines = [
        {"topic": "a/b", "ts": "2024-01-01T00:00:00Z", "value": "12.5", "unit": "kW"},
        {"topic": "a/c", "ts": "2024-01-01T00:00:00Z", "value": "Active"},
        {"topic": "a/d", "ts": "2024-01-01T00:00:00Z", "value": "fault", "flags": ["fault"]},
        {"value": "1"},
    ]
    (tmp_path / "r.json").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    got = {r.point_uri: r for r in readers.readings_json(spark, str(tmp_path)).collect()}
    assert set(got) == {"urn:point:a/b", "urn:point:a/c", "urn:point:a/d"}
    assert got["urn:point:a/b"].value == 12.5 and got["urn:point:a/c"].value_bool is True
    assert got["urn:point:a/d"].value_text == "fault" and got["urn:point:a/d"].quality == "fault"


def test_readings_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps({"topic": "x", "ts": "2024-01-01T00:00:00Z", "value": "1"}))
    run = readers.readings_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().value == 1.0


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,dis,size\np1,Pump,\np2,,3\n")
    records = readers.records_csv(spark, str(tmp_path / "r.csv"), "id string, dis string, size double")
    got = sorted((r.s, r.p, r.o) for r in readers.record_triples(records).collect())
    assert got == [("p1", "dis", "Pump"), ("p2", "size", "3.0")]
    readers.write_records(records, str(tmp_path / "out"))
    assert spark.read.schema(records.schema).json(str(tmp_path / "out")).count() == 2


def test_tasks_xml(spark, tmp_path):
    task = "<Task><UID>{0}</UID><WBS>{1}</WBS><Name> T{0} </Name><Start>2024-01-0{2}T08:00:00</Start>{3}</Task>"
    link = "<PredecessorLink><PredecessorUID>1</PredecessorUID></PredecessorLink><Milestone>1</Milestone>"
    tasks = task.format(0, "0", 1, "") + task.format(1, "1.1", 2, "") + task.format(2, "1.2", 3, link) + "<Task><UID>3</UID><IsNull>1</IsNull></Task>"
    (tmp_path / "p.xml").write_text(f'<Project xmlns="http://schemas.microsoft.com/project"><Tasks>{tasks}</Tasks></Project>')
    got = readers.tasks_xml(spark, str(tmp_path / "p.xml")).orderBy("code").collect()
    assert [(r.code, r.name, str(r.start), r.milestone, r.predecessors) for r in got] == [("1.1", "T1", "2024-01-02", False, []), ("1.2", "T2", "2024-01-03", True, ["1.1"])]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    from plantflow.streaming import faults

    (tmp_path / "in").mkdir()

    def run(name, minute, value):
        (tmp_path / "in" / name).write_text(json.dumps({"point_uri": "p", "ts": f"2024-01-01T00:0{minute}:00Z", "value": value}))
        rows = spark.readStream.schema("point_uri string, ts timestamp, value double, quality string").json(str(tmp_path / "in"))
        sink = faults.fault_stream(rows, 0.0, 10.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        sink.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return [r.action for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]

    assert run("a.json", 1, 50.0) == ["open"]
    assert run("b.json", 2, 60.0) == ["open"]  # the fault is still open after a restart, and the first reading isn't read again
    assert run("c.json", 3, 5.0) == ["open", "resolve"]


def test_manifest_of_changed_export(spark, tmp_path):
    from plantflow.sources import history as hs

    for name in "abc":
        (tmp_path / f"{name}.bin").write_bytes(name.encode())
    listed = spark.createDataFrame(hs.manifest(spark, str(tmp_path)).collect())
    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").unlink()
    (tmp_path / "d.bin").write_bytes(b"d")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in hs.check_manifest(listed, hs.manifest(spark, str(tmp_path))).collect()}
    assert errors == {"a.bin": "sha256 differs", "b.bin": "missing", "d.bin": "not listed"}


def test_export_is_one_file_a_point_and_month_and_is_checked(spark, tmp_path):
    from datetime import datetime

    rows = [(p, datetime(2024, m, d), float(d)) for p in ("urn:point:a/x", "b") for m in (1, 2) for d in range(1, 9)]
    path = str(tmp_path / "out")
    history.export_history(spark.createDataFrame(rows, "point_uri string, ts timestamp_ntz, value double"), path)
    files = history.export_files(spark, path)
    counts = files.select("point_uri", "month", "rows")
    assert sorted(map(tuple, counts.collect())) == [(p, m, 8) for p in ("b", "urn:point:a/x") for m in ("2024-01", "2024-02")]
    totals = spark.createDataFrame([("b", 16, 2), ("urn:point:a/x", 16, 2)], "point_uri string, rows long, files long")
    fields = files.first().fields
    assert fields.startswith("point_uri string,ts timestamp") and history.check_export(files, counts, totals, fields).count() == 0
    assert {r.error for r in history.check_export(files, counts, totals, "other").collect()} == {"schema differs"}
    spark.createDataFrame([("b", datetime(2024, 1, 20), 1.0)], "point_uri string, ts timestamp_ntz, value double").write.mode("append").parquet(f"{path}/point=b/month=2024-01")
    got = [tuple(r) for r in history.check_export(history.export_files(spark, path), counts, totals, fields).collect()]
    assert got == [("b", "2024-01", "more than one file")]
