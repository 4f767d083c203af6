"""A note store of Parquet tables: notes, chunks and meta."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index

NOTES = (
    "path string, folder string, mtime bigint, created bigint, title string, description string, tags array<string>, tier string, body_vec array<float>, "
    "desc_vec array<float>, body_dim int, indexed_at bigint"
)
CHUNKS = "path string, chunk_index int, content string, vec array<float>"
META = "key string, value string"
VERSION = "3"


@dataclass
class Store:
    """Tables under a folder. A write goes to a new version folder; the pointer to it is replaced last, so that readers see one whole version."""

    spark: SparkSession
    folder: str
    read_only: bool = False

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        """The newest finished version of a table, 0 if there is none."""
        fs, path = self._fs(f"{self.folder}/{name}")
        if not fs.exists(path):
            return 0
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(x[1:]) for x in found if x.startswith("v") and x[1:].isdigit() and fs.exists(self._fs(f"{self.folder}/{name}/{x}/_SUCCESS")[1])]
        return max(done, default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        v = self.version(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{v}") if v else self.spark.createDataFrame([], schema)

    def write(self, name: str, table: DataFrame, rows_per_file: int = 1_000_000) -> int:
        if self.read_only:
            raise PermissionError("the store was opened for reading only")
        v = self.version(name) + 1
        table.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.folder}/{name}/v{v}")
        return v

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        newest = self.version(name)
        for v in range(1, newest - keep + 1):
            fs, path = self._fs(f"{self.folder}/{name}/v{v}")
            fs.delete(path, True)

    def notes(self) -> DataFrame:
        return self.read("notes", NOTES)

    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNKS)

    def open(self) -> Store:
        """Check the schema's version: a newer one is refused; orphan chunks go."""
        stored = self.meta("schema_version")
        if stored and stored.isdigit() and int(stored) > int(VERSION):
            raise ValueError(f"the store has schema {stored}, this engine knows {VERSION}")
        if not self.read_only:
            if stored != VERSION:
                self.set_meta("schema_version", VERSION)
            lost = index.orphans(self.chunks(), self.notes())
            if not lost.isEmpty():
                self.write("chunks", index.prune_orphans(self.chunks(), self.notes()))
        return self

    def upsert(self, notes: DataFrame, chunks: DataFrame) -> None:
        """Replace notes and all their chunks."""
        self.write("notes", index.upsert(self.notes(), notes))
        self.write("chunks", index.upsert(self.chunks(), chunks))

    def delete(self, gone: DataFrame) -> None:
        self.write("notes", index.delete(self.notes(), gone))
        self.write("chunks", index.delete(self.chunks(), gone))

    def clear(self) -> None:
        """Empty notes and chunks; of the meta table the schema, the bootstrap mark and the weights stay."""
        self.write("notes", index.clear(self.notes()))
        self.write("chunks", index.clear(self.chunks()))
        self.write("meta", self.read("meta", META).filter(F.col("key").isin("schema_version", "bootstrapped") | F.col("key").startswith("weight")))

    def meta(self, key: str) -> str | None:
        row = self.read("meta", META).filter(F.col("key") == key).first()
        return row.value if row else None

    def set_meta(self, key: str, value: str | None) -> None:
        kept = self.read("meta", META).filter(F.col("key") != key)
        self.write("meta", kept if value is None else kept.unionByName(self.spark.createDataFrame([(key, value)], META)))
