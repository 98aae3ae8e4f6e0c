"""Manifests, verification, activation and resumable encoding of artifacts.

Pointers and manifests are small files in a shared folder; everything that grows with the
corpus is read and checked by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexspan.functions.classify import CENTRAL_SCOPE
from lexspan.functions.columns import equals, first_reason, is_false, is_true
from lexspan.functions.ids import point_id
from lexspan.functions.text import is_blank
from lexspan.functions.vectors import is_valid_vector


def inside(root: str | Path, name: str) -> Path:
    """A path below the root; names that lead out of it are refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if base not in path.parents:
        raise ValueError(f"path escapes the artifact folder: {name}")
    return path


def write_json_atomic(path: str | Path, value: dict) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(path)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes and sha256 of every data file below a folder, hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", rf"^.*?\Q{Path(folder).name}\E/", "")
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_violations(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Files (file, bytes, sha256) that are missing, of another size or of other content."""
    found = file_hashes(spark, folder).select("file", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    rows = expected.join(found, "file", "left")
    reason = first_reason((F.col("found_sha256").isNull(), "missing"), (F.col("found_bytes") != F.col("bytes"), "size"),
                          (F.col("found_sha256") != F.col("sha256"), "hash"), default=F.lit(None).cast("string"))
    return rows.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def activate(spark: SparkSession, root: str, build: str, expected: DataFrame, revision: str) -> dict:
    """Point to a build once all its files verify; the old pointer stays on any failure."""
    folder = inside(root, build)
    wrong = manifest_violations(spark, str(folder), expected).limit(1).collect() if folder.is_dir() else ["missing build"]
    if wrong:
        raise ValueError(f"incomplete build: {wrong[0]}")
    pointer = {"dataset_revision": revision, "build_dir": build}
    write_json_atomic(Path(root) / "active.json", pointer)
    return pointer


def active_build(root: str) -> Path | None:
    pointer = Path(root) / "active.json"
    return inside(root, json.loads(pointer.read_text(encoding="utf-8"))["build_dir"]) if pointer.is_file() else None


def point_violation(dimension: int, revision: str, prefix: str = "lexspan") -> Column:
    """Why a vector record breaks the contract; NULL when it holds."""
    payload = F.col("payload")
    return first_reason(
        (payload.isNull() | ~is_valid_vector("vector", dimension), "invalid vector or payload"),
        (~equals(payload["pham_vi"], CENTRAL_SCOPE) | ~is_true(payload["retrieval_index_candidate"])
         | ~is_false(payload["answer_evidence_enabled"]) | ~equals(payload["current_validity"], "unverified")
         | ~equals(payload["expiry_state"], "unknown_expiry") | payload["reported_status_conflict"].isNull()
         | payload["amendment_state"].isNull() | payload["quarantined_related_document_ids"].isNull(), "evidence policy"),
        (is_blank(payload["canonical_text"]) | ~equals(payload["source_dataset_revision"], revision), "missing text or revision"),
        (~F.col("id").eqNullSafe(point_id(payload["article_id"], payload["document_version_id"], payload["child_id"], prefix)), "identity"),
        default=F.lit(None).cast("string"))


def point_violations(points: DataFrame, dimension: int, revision: str, prefix: str = "lexspan") -> DataFrame:
    rows = points.select("id", point_violation(dimension, revision, prefix).alias("reason")).where("reason IS NOT NULL")
    repeated = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("reason"))
    return rows.unionByName(repeated)


def parent_violations(points: DataFrame, articles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Points whose article is absent or differs in a field both carry."""
    parents = articles.select("article_id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__found"))
    rows = points.select("id", F.col("payload.article_id").alias("article_id"), *[F.col(f"payload.{f}").alias(f) for f in fields])
    differs = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    joined = rows.join(parents, "article_id", "left")
    return joined.select("id", F.when(F.col("__found").isNull(), F.array(F.lit("article"))).otherwise(differs).alias("differs")).where(
        F.size("differs") > 0)


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


LEDGER = "shard int, records long, digest decimal(38,0)"


def _committed(spark: SparkSession, root: Path) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(str(root / "ledger")) if any((root / "ledger").glob("*.parquet")) else spark.createDataFrame([], LEDGER)


def encode_shards(records: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], context: dict, shards: int, wave: int = 16) -> dict:
    """Encode records into a fixed number of shards and resume where a run stopped.

    The records are scanned once and written by shard, which follows from the id, so shards
    are stable. Then waves of up to ``wave`` shards read only their own part: one
    partitioned write, whose files become visible when it commits, then a ledger row for
    each shard with its records and a digest of their ids. What is missing is the shards
    without a ledger row; a wave that was cut off is written again as a whole. Another
    context in the folder is an error and nothing is written.
    """
    if shards <= 0 or wave <= 0:
        raise ValueError("shards and wave must be positive")
    spark, root, settings = records.sparkSession, Path(folder), {**context, "shards": shards}
    state, staged, vectors = root / "progress.json", str(root / "records"), str(root / "vectors")
    if state.is_file() and json.loads(state.read_text(encoding="utf-8")) != settings:
        raise ValueError("the folder holds an incompatible artifact")
    write_json_atomic(state, settings)
    if not (root / "records" / "_SUCCESS").is_file():
        keyed = records.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        keyed.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(staged)
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    missing = sorted(r["shard"] for r in every.join(_committed(spark, root), "shard", "left_anti").toLocalIterator())
    schema = T.StructType([*records.schema.fields, T.StructField("shard", T.IntegerType())])
    for at in range(0, len(missing), wave):
        now = missing[at:at + wave]
        part = spark.read.schema(schema).parquet(staged).where(F.col("shard").isin(now))
        encoded = encode(part)
        (encoded.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(vectors))
        written = spark.read.schema(encoded.schema).parquet(vectors).where(F.col("shard").isin(now)).groupBy("shard").agg(
            F.count(F.lit(1)).alias("records"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("digest"))
        rows = spark.createDataFrame([(s,) for s in now], "shard int").join(written, "shard", "left")
        rows.select("shard", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest")).coalesce(
            1).write.mode("append").parquet(str(root / "ledger"))
    return {**settings, "resumed": shards - len(missing), "written": len(missing)}


def shard_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Shards whose vectors are not those of their ledger row."""
    root = Path(folder)
    found = spark.read.parquet(str(root / "vectors")).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("d"))
    rows = _committed(spark, root).join(found, "shard", "full")
    same = F.coalesce("n", F.lit(0)).eqNullSafe(F.col("records")) & F.coalesce("d", F.lit(0)).eqNullSafe(F.col("digest"))
    return rows.where(~same).select("shard", "records", F.col("n").alias("found"))
