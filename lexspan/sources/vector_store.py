"""Collections of points as versioned tables: create, upsert, search, get, delete, alias."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexspan.functions.vectors import is_valid_vector
from lexspan.operators import dense
from lexspan.sources.artifacts import inside, require_none, write_json_atomic


class VectorStore:
    """A folder of collections. Points have id, vector and any payload columns; each write
    makes a new version of the table and then moves a small pointer to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def _state_path(self, name: str) -> Path:
        return inside(self.root, name) / "collection.json"

    def _state(self, name: str) -> dict:
        path = self._state_path(self.resolve(name))
        if not path.is_file():
            raise KeyError(f"no collection {name}")
        return json.loads(path.read_text(encoding="utf-8"))

    def create(self, name: str, dimension: int) -> None:
        if dimension <= 0:
            raise ValueError("vector size must be positive")
        write_json_atomic(self._state_path(name), {"dimension": dimension, "version": None})

    def dimension(self, name: str) -> int:
        return self._state(name)["dimension"]

    def points(self, name: str) -> DataFrame | None:
        version = self._state(name)["version"]
        return None if version is None else self.spark.read.parquet(str(inside(self.root, self.resolve(name)) / version))

    def upsert(self, name: str, points: DataFrame, order: str | None = None) -> None:
        """Add or replace points by id. Of a repeated id in the batch the first by ``order``
        counts. Every point is checked before anything is written."""
        state = self._state(name)
        require_none(points.where(~is_valid_vector("vector", state["dimension"])).select("id"), "vector must be finite and of the collection's size")
        if {"reviewed_open_ended", "effective_to_day"} <= set(points.columns):
            require_none(points.where("reviewed_open_ended AND effective_to_day IS NOT NULL").select("id"),
                         "reviewed_open_ended requires effective_to_day to be null")
        if order:
            first = Window.partitionBy("id").orderBy(order)
            points = points.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", order)
        else:
            points = points.dropDuplicates(["id"])
        current = self.points(name)
        if current is not None:
            points = current.join(points.select("id"), "id", "left_anti").unionByName(points, allowMissingColumns=True)
        version = f"v-{uuid.uuid4().hex[:12]}"
        points.write.parquet(str(inside(self.root, self.resolve(name)) / version))
        write_json_atomic(self._state_path(self.resolve(name)), {**state, "version": version})

    def search(self, name: str, vector: list[float], where: Column | None = None, limit: int = 10) -> DataFrame:
        """Nearest points that pass the filter. A choice of filters is one OR condition."""
        if limit <= 0:
            raise ValueError("limit must be positive")
        if len(vector) != self.dimension(name):
            raise ValueError("vector dimension mismatch")
        return dense.search_vector(self.points(name), vector, limit, id_cols=["id"], where=where)

    def get(self, name: str, point: str) -> DataFrame:
        return self.points(name).where(F.col("id") == point)

    def delete(self, name: str) -> None:
        """Take the collection out of use; its files stay until the folder is cleaned."""
        path = self._state_path(name)
        path.replace(path.with_suffix(".deleted"))

    def _aliases(self) -> dict:
        path = self.root / "aliases.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}

    def resolve(self, name: str) -> str:
        return self._aliases().get(name, name)

    def activate_alias(self, alias: str, name: str) -> str | None:
        """Point an alias to a collection; returns the collection it pointed to before."""
        self._state(name)
        aliases = self._aliases()
        before = aliases.get(alias)
        write_json_atomic(self.root / "aliases.json", {**aliases, alias: name})
        return before

    def delete_alias(self, alias: str) -> None:
        write_json_atomic(self.root / "aliases.json", {k: v for k, v in self._aliases().items() if k != alias})
