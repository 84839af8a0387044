"""Taxonomy files as a table: ``spark.read.format("taxonomy").load(path)``.

A taxonomy is a YAML list of entries with a ``name``, or a mapping that has the
list under a section (``intents`` unless the option ``section`` says otherwise).
``path`` is a file or a folder; every file is a partition, parsed by the task
that reads it, so a folder of many taxonomies is a distributed scan.  Files are
opened through pyarrow's file systems: local and shared folders, HDFS, S3, GCS.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, position int, name string, attributes map<string, string>"
ENDINGS = (".yaml", ".yml", ".txt")


def entries(text: str, section: str, path: str) -> list[dict]:
    """The named entries of a taxonomy text; anything else is refused."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a taxonomy needs PyYAML") from missing
    found = yaml.safe_load(text)
    listed = found.get(section) if isinstance(found, dict) else found
    if not isinstance(listed, list) or not all(isinstance(e, dict) and "name" in e for e in listed):
        raise ValueError(f"{path} has no list of named {section}")
    return listed


def _file_system(path: str):
    """(file system, path within it) of an address or a plain local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


class TaxonomyFile(InputPartition):
    def __init__(self, root: str, path: str):
        super().__init__((root, path))


class TaxonomyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("the taxonomy source needs a path")
        self.section = options.get("section", "intents")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _file_system(self.root)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [TaxonomyFile(self.root, path)]
        if info.type != fs.FileType.Directory:
            raise ValueError(f"{self.root} does not exist")
        found = [
            f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True))
            if f.type == fs.FileType.File and f.base_name.endswith(ENDINGS)
            and not f.base_name.startswith((".", "_"))
        ]
        return [TaxonomyFile(self.root, f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, path = partition.value
        with _file_system(root)[0].open_input_stream(path) as stream:
            text = stream.read().decode()
        name = path.rsplit("/", 1)[-1]
        for position, entry in enumerate(entries(text, self.section, path)):
            rest = {str(k): str(v) for k, v in entry.items() if k != "name" and v is not None}
            yield name, position, str(entry["name"]), rest


class TaxonomySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "taxonomy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TaxonomyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TaxonomySource)


def read(spark: SparkSession, path: str, section: str = "intents") -> DataFrame:
    """(file, position, name, attributes) of the taxonomy files at ``path``."""
    register(spark)
    return spark.read.format("taxonomy").option("section", section).load(path)


def write(spark: SparkSession, names: DataFrame, path: str, section: str = "intents") -> None:
    """Write (name), a small table, as one taxonomy file, in the order of the names."""
    # A JSON object is a YAML mapping, whatever the name holds.
    entry = F.concat(F.lit("  - "), F.to_json(F.struct("name")))
    lines = names.where("name is not null").select(entry.alias("value"), "name")
    head = spark.createDataFrame([(f"{section}:", None)], "value string, name string")
    ordered = head.unionByName(lines).orderBy(F.col("name").asc_nulls_first()).select("value")
    ordered.coalesce(1).write.mode("overwrite").text(path)
