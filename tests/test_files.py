"""Readers, sinks and streams over files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parley.sources import readers as R
from parley.sources import sinks as K
from parley.streaming import events as V

SCHEMA = "id long, question string"


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_bad_lines_are_kept_dropped_or_fail(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", [{"id": 1, "question": "é?"}, "{broken", {"id": 2}, "x"])
    kept = R.read_jsonl(spark, path, SCHEMA)
    assert kept.count() == 4 and [tuple(r) for r in R.bad_lines(spark, path, SCHEMA).collect()] == [("a.jsonl", 2, "x")]
    assert sorted(r["id"] for r in R.read_jsonl(spark, path, SCHEMA, "drop").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        R.read_jsonl(spark, path, SCHEMA, "fail").collect()


def test_wrapped_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    assert sorted(r["id"] for r in R.read_wrapped(spark, str(tmp_path), SCHEMA).collect()) == [1, 2, 3]


def test_manifest_of_packed_shards(spark, tmp_path):
    for k in range(2):
        with gzip.open(tmp_path / f"s{k}.jsonl.gz", "wt") as f:
            f.write("\n".join([json.dumps({"id": 10 * k + i}) for i in range(5)] + ["{bad"]))
    (tmp_path / "m.json").write_text(json.dumps({"shards": [{"path": str(tmp_path / f"s{k}.jsonl.gz")} for k in range(2)]}, indent=1))
    rows = R.read_manifest(spark, str(tmp_path / "m.json"), SCHEMA).collect()
    assert len(rows) == 10 and {r["shard"] for r in rows} == {"s0.jsonl.gz", "s1.jsonl.gz"}
    few = R.read_manifest(spark, str(tmp_path / "m.json"), SCHEMA, 2, F.desc("id")).collect()
    assert sorted(r["id"] for r in few) == [3, 4, 13, 14]


def test_splits_by_any_name_and_their_guard(spark, tmp_path):
    for name, k in (("train", 1), ("dev", 2), ("test", 3)):
        lines(tmp_path / f"{name}.jsonl", [{"id": k}])
    rows = R.read_splits(spark, str(tmp_path), "id long")
    assert {(r["id"], r["split"]) for r in rows.collect()} == {(1, "train"), (2, "validation"), (3, "test")}
    log = str(tmp_path / "audit")
    assert R.read_split(rows, "val", "x", 1, log).count() == 1 and R.read_split(rows, "test", "x", 8, log).count() == 1
    with pytest.raises(PermissionError):
        R.read_split(rows, "test", "x", 7, log)
    assert sorted(r["access_granted"] for r in spark.read.parquet(log).collect()) == [False, True, True]


def test_written_lines_have_no_private_columns(spark, tmp_path):
    R.write_jsonl(spark.createDataFrame([(1, "ü", 2)], "id long, q string, _key long"), str(tmp_path / "o"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))) == {"id": 1, "q": "ü"}


def test_digests_and_forbidden_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.GGUF").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in R.file_digests(spark, str(tmp_path)).collect()}
    assert got["a.bin"] == (3, hashlib.sha256(b"abc").hexdigest()) and got["b.GGUF"][0] == 1
    assert [r["path"].rsplit("/", 1)[1] for r in R.forbidden_files(spark, str(tmp_path), [".gguf", ".pt"]).collect()] == ["b.gguf"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "parent long, child string, at long")
    path = str(tmp_path / "children")
    K.replace_children(rows, path, "parent")
    K.replace_children(rows.filter("parent = 1 AND at = 1").withColumn("child", F.lit("z")), path, "parent")
    assert sorted((r["parent"], r["child"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    log = str(tmp_path / "log")
    K.create_from(rows, log)
    K.append(rows.filter("at = 3").withColumns({"child": F.lit("d"), "at": F.lit(9).cast("long")}), log)
    assert {(r["parent"], r["child"]) for r in K.changed_state(spark, log, "parent", "at").collect()} == {(1, "b"), (2, "d")}
    with pytest.raises(Exception):  # noqa: B017
        K.create_from(rows, log)
    with pytest.raises(ValueError):
        K.require_rows(rows, 4)
    with pytest.raises(ValueError):
        K.require_rows(rows, 1, ("other",))
    assert K.with_ids(K.require_rows(rows, 3, ("at",)), "at", "r-%05d").filter("at = 3").first()["record_id"] == "r-00003"


def test_reports(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n long, z string"), spark.createDataFrame([(2, 0.5)], "n long, a double")
    K.write_csv_report([a, b], str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().split() == ["a,n,z", ",1,x", "0.5,2,"]
    K.write_json_report(a.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "json"))
    (part,) = (tmp_path / "json").glob("part-*")
    assert json.loads(part.read_text()) == {"n": 1, "z": "x", "none": None}
    table = a.unionByName(spark.createDataFrame([(0, None)], a.schema)).agg(K.markdown(a, ["n", "z"], [F.col("n")]).alias("t")).first()["t"]
    assert table == "| n | z |\n| --- | --- |\n| 0 | - |\n| 1 | x |"
    one = K.common_columns([(a, {"z": "text"}), (b.withColumnRenamed("a", "sentence"), {"sentence": "text2"})])
    assert one.columns == ["n", "text", "text2"]


def test_stream_of_states_ends_as_the_batch(spark, tmp_path):
    kinds = ["planned", "started", "other", "completed", "aborted"]
    rows = [(i % 4, kinds[(i * 7 + i // 4) % 5], i) for i in range(24)]
    df = spark.createDataFrame(rows, "session long, kind string, at long").select("session", "kind", F.timestamp_seconds("at").alias("ts"))
    for k in range(3):
        df.filter(F.col("ts").cast("long").between(8 * k, 8 * k + 7)).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(str(tmp_path / "in"))
    live = V.live_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "session", "kind")
    query = live.writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in sorted(spark.table("states").collect(), key=lambda r: r["events"]):
        last[r["session"]] = r["state"]
    assert last == {r["session"]: r["state"] for r in V.current_state(df, "session", "kind", "ts").collect()}


def test_pending_uploads_are_parsed_or_fail(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, None)], "id long, body string")
    assert {r["id"]: r["status"] for r in V.parsed(rows, "body", "a int").collect()} == {1: "PARSED", 2: "FAILED", 3: "PENDING"}
