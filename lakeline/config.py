"""Reader options, store targets and the job configuration file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql.types import StructType

#: Text timestamps written by this package keep microseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class CsvOptions:
    """How a CSV file is laid out. Without a schema the types are inferred in an extra pass."""

    header: bool = True
    delimiter: str = ";"
    infer_schema: bool = True
    schema: StructType | None = None
    encoding: str = "UTF-8"


@dataclass(frozen=True)
class Target:
    """A store, by Spark format name and options. Options may hold secrets: not shown."""

    format: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)
    schema: StructType | None = None

    @classmethod
    def load(cls, path: str) -> Target:
        """A target from a JSON or YAML file with ``format``, ``options`` and, for a
        collection, a ``schema`` in DDL form."""
        found = _read_mapping(Path(path))
        schema = StructType.fromDDL(found["schema"]) if found.get("schema") else None
        options = {key: str(value) for key, value in found.get("options", {}).items()}
        return cls(found["format"], options, schema)

    @property
    def path(self) -> str | None:
        return self.options.get("path")

    def named(self, name: str) -> Target:
        """The same store, another collection, table or directory."""
        options = dict(self.options)
        if self.path is not None:
            options["path"] = f"{self.path.rstrip('/')}/{name}"
        else:
            options["dbtable" if self.format == "jdbc" else "collection"] = name
        return replace(self, options=options)


class DocTarget(Target):
    """A document collection: a document store, or files of JSON lines."""

    @classmethod
    def mongo(cls, uri: str, database: str, collection: str, **options: str) -> DocTarget:
        """Options of the public MongoDB connector, which must be on the class path."""
        return cls(
            "mongodb",
            {"connection.uri": uri, "database": database, "collection": collection, **options},
        )

    @classmethod
    def json_files(cls, path: str, schema: StructType | None = None) -> DocTarget:
        return cls(
            "json",
            {
                "path": path,
                "timestampFormat": TIMESTAMP_FORMAT,
                "timestampNTZFormat": TIMESTAMP_FORMAT,
            },
            schema,
        )


class TableTarget(Target):
    """A relational table, or columnar files in its place."""

    @classmethod
    def jdbc(cls, url: str, table: str, **options: str) -> TableTarget:
        """A database table. ``partitionColumn``, ``lowerBound``, ``upperBound`` and
        ``numPartitions`` together let many tasks read it."""
        return cls("jdbc", {"url": url, "dbtable": table, **options})

    @classmethod
    def parquet_files(cls, path: str) -> TableTarget:
        return cls("parquet", {"path": path})


# The keys of the configuration file and the fields they fill.
_FILE_KEYS = {
    "url": "url",
    "database": "database",
    "collection": "collection",
    "delimiter": "delimiter",
    "header": "header",
    "inferSchema": "infer_schema",
    "arquivo_entrada": "input_path",
}


@dataclass(frozen=True)
class JobConfig:
    """Settings of the enrolment job. Addresses and paths have no built-in default."""

    url: str | None = field(default=None, repr=False)
    # Where the students go.
    database: str = "discentes_2024"
    collection: str = "discentes"
    delimiter: str = ";"
    header: bool = True
    infer_schema: bool = True
    input_path: str | None = None

    @classmethod
    def load(cls, path: str, defaults: JobConfig | None = None) -> JobConfig:
        """The whole file when there is one, else the defaults. A partial file is an error."""
        file = Path(path)
        if not file.exists():
            return defaults or cls()
        found = _read_mapping(file)
        missing = sorted(set(_FILE_KEYS) - set(found))
        unknown = sorted(set(found) - set(_FILE_KEYS))
        if missing or unknown:
            raise ValueError(f"{path}: missing keys {missing}, unknown keys {unknown}")
        return cls(**{_FILE_KEYS[key]: value for key, value in found.items()})

    def csv(self) -> CsvOptions:
        return CsvOptions(self.header, self.delimiter, self.infer_schema)

    def documents(self, collection: str | None = None) -> DocTarget:
        if not self.url:
            raise ValueError("the document store's url must come from the caller")
        return DocTarget.mongo(self.url, self.database, collection or self.collection)


def _read_mapping(file: Path) -> dict:
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as err:
            raise ImportError(f"PyYAML is needed to read {file}; a .json file works without") from err
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{file}: expected a mapping of settings")
    return found
