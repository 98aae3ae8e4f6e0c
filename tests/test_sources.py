import json

import pytest
from pyspark.sql import functions as F

from lexspan.functions.ids import point_id
from lexspan.sources import artifacts, readers, writers
from lexspan.sources.vector_store import VectorStore
from lexspan.streaming import encode, trace


def test_ledger_round_trip_and_duplicate_ids(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nline'), ("2", "ê")], "id string, text string")
    writers.write_ledger(df.coalesce(1), str(tmp_path / "ledger"))
    part = next((tmp_path / "ledger").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert {r.id: r.text for r in readers.read_ledger(spark, str(tmp_path / "ledger"), ["1", "2"]).collect()} == {"1": 'a "q"\nline', "2": "ê"}
    df.union(df).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_by_ids(spark, str(tmp_path / "twice"), ["1"])
    df.write.parquet(str(tmp_path / "once"))
    once = readers.read_by_ids(spark, str(tmp_path / "once"), ["1", "9"])
    assert once.count() == 1 and "PushedFilters: [In(id" in once._jdf.queryExecution().executedPlan().toString()


def test_json_lines_keep_unicode_separators(spark, tmp_path):
    df = spark.createDataFrame([("x\u2028y\nz", None)], "text string, other string")
    for ascii_only in (True, False):
        path = str(tmp_path / f"lines-{ascii_only}")
        writers.write_json_lines(df.coalesce(1), path, ascii_only)
        assert readers.read_json_lines(spark, path, "text string, other string").first().text == "x\u2028y\nz"
        raw = next((tmp_path / f"lines-{ascii_only}").glob("part-*")).read_text(encoding="utf-8")
        assert ("\u2028" in raw) != ascii_only and '"other":null' in raw
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"case_id": "1"}, {"case_id": "2"}]}), encoding="utf-8")
    assert readers.read_cases(spark, str(tmp_path / "cases.json")).count() == 2


def test_shards_and_activation(spark, tmp_path):
    build = tmp_path / "build-1"
    writers.write_shards(spark.range(1000).select(F.col("id").cast("string").alias("id")), str(build / "data"), ["id"], 256)
    found = artifacts.file_hashes(spark, str(build))
    assert artifacts.manifest_violations(spark, str(build), found).count() == 0
    assert all(sum(1 for _ in p.open()) <= 256 for p in (build / "data").glob("part-*"))
    artifacts.activate(spark, str(tmp_path), "build-1", found, "r")
    assert artifacts.active_build(str(tmp_path)).name == "build-1"
    wrong = found.withColumn("sha256", F.lit("bad"))
    assert {r.reason for r in artifacts.manifest_violations(spark, str(build), wrong).collect()} == {"hash"}
    for name in ("build-1", "build-2", "../outside"):
        with pytest.raises(ValueError):
            artifacts.activate(spark, str(tmp_path), name, wrong, "r2")
    assert json.loads((tmp_path / "active.json").read_text())["dataset_revision"] == "r"


PAYLOAD = ("struct<article_id:string,document_version_id:string,child_id:string,canonical_text:string,pham_vi:string,current_validity:string,expiry_state:string,"
           "amendment_state:string,source_dataset_revision:string,retrieval_index_candidate:boolean,answer_evidence_enabled:boolean,reported_status_conflict:boolean,"
           "quarantined_related_document_ids:array<string>>")


def test_point_violations(spark):
    def row(vector=(1.0, 2.0), scope="Trung ương", text="t", revision="r"):
        return list(vector), ("a", "v", "c", text, scope, "unverified", "unknown_expiry", "s", revision, True, False, False, [])

    df = spark.createDataFrame([(i, *r) for i, r in enumerate([row(), row((1.0,)), row(scope="Tỉnh"), row(text=" "), row(revision="x")])],
                               f"n int, vector array<double>, payload {PAYLOAD}")
    df = df.withColumn("id", F.concat(point_id("payload.article_id", "payload.document_version_id", "payload.child_id"), F.when(F.col("n") == 9, "x").otherwise("")))
    assert artifacts.point_violations(df.where("n = 0"), 2, "r").count() == 0
    reasons = {r.n: r.reason for r in df.select("n", artifacts.point_violation(2, "r").alias("reason")).collect()}
    assert reasons == {0: None, 1: "invalid vector or payload", 2: "evidence policy", 3: "missing text or revision", 4: "missing text or revision"}
    forged = df.where("n = 0").withColumn("id", F.lit("x"))
    assert [r.reason for r in artifacts.point_violations(forged.union(forged), 2, "r").collect()] == ["identity", "identity", "repeated id"]
    articles = spark.createDataFrame([("a", "other")], "article_id string, document_version_id string")
    assert artifacts.parent_violations(df.where("n = 0"), articles, ["document_version_id"]).first().differs == ["document_version_id"]


def test_resumable_encoding(spark, tmp_path):
    records = spark.range(50).select(F.col("id").cast("string").alias("id"))
    calls = []

    def vectors(df):
        calls.append(1)
        return df.withColumn("vector", F.array(F.lit(1.0)))

    def broken(df):
        if len(calls) == 2:
            raise RuntimeError("lost")
        return vectors(df)

    with pytest.raises(RuntimeError):
        artifacts.encode_shards(records, str(tmp_path), broken, {"input": "x"}, 4, wave=1)
    # A wave that wrote vectors but no ledger row is done again.
    (tmp_path / "vectors" / "shard=3").mkdir()
    result = artifacts.encode_shards(records, str(tmp_path), vectors, {"input": "x"}, 4)
    assert result["resumed"] == 2 and result["written"] == 2 and len(calls) == 3
    made = spark.read.parquet(str(tmp_path / "vectors"))
    assert made.count() == made.select("id").distinct().count() == 50
    assert sum(r.records for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == 50 and artifacts.shard_violations(spark, str(tmp_path)).count() == 0
    made.where("shard = 1").limit(3).write.mode("append").parquet(str(tmp_path / "vectors" / "shard=1"))
    assert [r.shard for r in artifacts.shard_violations(spark, str(tmp_path)).collect()] == [1]
    assert artifacts.encode_shards(records, str(tmp_path), vectors, {"input": "x"}, 4)["written"] == 0
    for context, shards in (({"input": "y"}, 4), ({"input": "x"}, 5)):
        with pytest.raises(ValueError, match="incompatible"):
            artifacts.encode_shards(records, str(tmp_path), vectors, context, shards)


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.create("c-1", 2)
    schema = "id string, vector array<double>, kind string, n int"
    store.upsert("c-1", spark.createDataFrame([("a", [1.0, 0.0], "x", 1), ("a", [9.0, 9.0], "late", 2), ("b", [0.0, 1.0], "y", 3)], schema), "n")
    store.upsert("c-1", spark.createDataFrame([("b", [0.5, 1.0], "z", 1)], schema), "n")
    assert store.points("c-1").count() == 2 and store.get("c-1", "a").first().kind == "x" and store.get("c-1", "b").first().kind == "z"
    assert [r.id for r in store.search("c-1", [1.0, 0.0], limit=5).collect()] == ["a", "b"]
    assert [r.id for r in store.search("c-1", [1.0, 0.0], F.col("kind") == "z").collect()] == ["b"]
    assert store.activate_alias("live", "c-1") is None and store.dimension("live") == 2
    for bad in ([1.0], [float("nan"), 1.0]):
        with pytest.raises(ValueError, match="vector"):
            store.upsert("c-1", spark.createDataFrame([("z", bad, "x", 1)], schema), "n")
    assert store.points("live").count() == 2
    with pytest.raises(ValueError):
        store.search("c-1", [1.0], limit=1)
    store.delete_alias("live")
    store.delete("c-1")
    with pytest.raises(KeyError):
        store.dimension("c-1")


def test_streams_match_the_batch(spark, tmp_path):
    raw = spark.range(20).select(
        F.col("id").cast("string").alias("trace_id"), F.lit("answer").alias("stage"), F.lit("ok").alias("outcome"), F.col("id").cast("double").alias("duration_ms"),
        F.lit("question").alias("query"), F.create_map(F.lit("model_version"), F.lit("m")).alias("provenance"), F.array(F.lit("e")).alias("evidence_ids"),
        F.create_map(F.lit("total_tokens"), F.col("id")).alias("usage"), F.lit("clarify").alias("reason"))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.write.parquet(source)
    for _ in range(2):
        trace.write_redacted(trace.read_events(spark, source, raw.schema), out, state).awaitTermination()
    assert sorted(spark.read.parquet(out).collect(), key=str) == sorted(trace.redact(raw).collect(), key=str)
    vectors, progress = str(tmp_path / "vectors"), str(tmp_path / "progress")
    for count in (20, 40):
        encode.encode_available(spark, source, raw.schema, lambda df: df.select("trace_id"), vectors, progress, 1)
        assert spark.read.parquet(vectors).count() == count
        raw.write.mode("append").parquet(source)


def test_row_index_is_the_place_in_the_input(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for folder, files in (("a", [("2", 3), ("1", 70), ("3", 0)]), ("b", [("1", 5)])):
        (tmp_path / folder).mkdir()
        for name, n in files:
            pq.write_table(pa.table({"x": [f"{folder}{name}-{k}" for k in range(n)]}), tmp_path / folder / f"{name}.parquet", row_group_size=8)
    first, second = readers.read_in_order(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = [r.x for r in sorted(first.collect() + second.collect(), key=lambda r: r.row_index)]
    assert got == [f"a1-{k}" for k in range(70)] + [f"a2-{k}" for k in range(3)] + [f"b1-{k}" for k in range(5)]
    assert sorted(r.row_index for r in first.repartition(3).collect()) == list(range(73))


def test_places_order_rows_as_the_row_index_does(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(40).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("x")).repartition(3).write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / name) for name in ("a", "b")]
    dense, places = readers.read_in_order(spark, *paths), readers.read_with_place(spark, *paths)
    by_index = [r.x for r in dense[0].unionAll(dense[1]).orderBy("row_index").collect()]
    assert [r.x for r in places[0].unionAll(places[1]).orderBy("row_index").collect()] == by_index and len(by_index) == 80
