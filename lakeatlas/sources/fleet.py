"""Catalogues of a fleet of database servers as the data source ``catalogues``: tasks by server, filters pushed to it.

Option ``relation`` is tables, columns, fks or indexes; the rows come from one of

* ``path``: a folder of landed row sets, JSON lines in ``<path>/<relation>/**/*.json`` or ``*.json.gz``, which collectors write.
  Files are packed into tasks of at most ``taskBytes`` (16 MB, of compressed ones 2 MB); a larger one has its own.
* ``servers``, a JSON list with an object of connection arguments for each server, and ``connector``, ``module:function``,
  which takes them by name in the task and gives a DB-API connection. ``mark`` is the driver's parameter mark (``%s``).

``=`` and ``IN`` on texts go into the statement or are tried line by line before rows become Arrow; Spark tries them again,
so a server whose collation ignores case gives no row too many. A field that is absent or null is null. A line that is no
JSON object fails the read. An empty folder or list gives no rows. Each task reads its own files or server only, so a lost
executor costs these again.
"""

from __future__ import annotations

import importlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import IntegerType, StructType

from .catalogue import COLUMN_ROWS, FK_ROWS, INDEX_ROWS, TABLE_ROWS

#: The row sets; those of tables also say what kind of table each is, for views are landed too.
RELATIONS = {"tables": TABLE_ROWS + ", table_type STRING", "columns": COLUMN_ROWS, "fks": FK_ROWS, "indexes": INDEX_ROWS}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SYSTEM = "table_schema NOT IN ('information_schema', 'mysql', 'performance_schema', 'sys')"
_STATEMENTS = {
    "tables": f"SELECT table_schema AS schema_id, table_name, table_comment, table_type FROM information_schema.tables WHERE {_SYSTEM}",
    "columns": f"SELECT table_schema AS schema_id, table_name, ordinal_position AS ordinal, column_name, data_type, column_type, is_nullable, column_key, coalesce(column_default, '') AS column_default, extra, column_comment FROM information_schema.columns WHERE {_SYSTEM}",
    "fks": f"SELECT table_schema AS schema_id, table_name, column_name, referenced_table_name AS ref_table FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL AND {_SYSTEM}",
    "indexes": f"SELECT table_schema AS schema_id, table_name, index_name, non_unique, seq_in_index AS seq, column_name FROM information_schema.statistics WHERE index_name <> 'PRIMARY' AND {_SYSTEM}",
}
BATCH = 4096
#: What a compressed file counts for, in bytes of JSON for each of its own.
UNPACKED = 8


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Server(InputPartition):
    arguments: dict


def _pushable(f: Filter, schema: StructType) -> tuple[str, list[str]] | None:
    """The column and the texts that ``f`` allows, if it is = or IN on a text."""
    values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
    if not values or len(f.attribute) != 1 or f.attribute[0] not in schema.names:
        return None
    return (f.attribute[0], values) if all(isinstance(v, str) for v in values) else None


class _Reader(DataSourceReader):
    def __init__(self, relation: str, schema: StructType):
        self.relation, self.schema = relation, schema
        self.allowed: list[tuple[str, list[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        self.allowed = [p for p in (_pushable(f, self.schema) for f in filters) if p]
        return filters

    def batches(self, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, IntegerType) else pa.string()) for f in self.schema.fields])
        held: list[dict] = []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, fields)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, fields)


class LandedReader(_Reader):
    def __init__(self, relation: str, schema: StructType, path: str, task_bytes: int):
        super().__init__(relation, schema)
        self.path, self.task_bytes = path.rstrip("/"), task_bytes

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileSystem

        fs, base = FileSystem.from_uri(f"{self.path}/{self.relation}")
        files = (f for f in fs.get_file_info(FileSelector(base, allow_not_found=True, recursive=True)) if f.is_file)
        found = sorted((f.path, f.size * (UNPACKED if f.path.endswith(".gz") else 1)) for f in files if f.path.endswith((".json", ".json.gz")))
        packs: list[Files] = []
        room = 0
        for path, size in found:
            if not packs or size > room:
                packs.append(Files([]))
                room = self.task_bytes
            packs[-1].paths.append(path)
            room -= size
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.batches(self._rows(partition.paths))

    def _rows(self, paths: list[str]) -> Iterator[dict]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.path)
        allowed = [(c, set(v)) for c, v in self.allowed]
        for path in paths:
            with io.TextIOWrapper(fs.open_input_stream(path), encoding="utf-8") as lines:
                for n, line in enumerate(lines, 1):
                    if not line.strip():
                        continue
                    try:
                        row = json.loads(line)
                    except ValueError:
                        row = None
                    if not isinstance(row, dict):
                        raise ValueError(f"{path}, line {n}: no JSON object")
                    if all(row.get(c) in v for c, v in allowed):
                        yield row


class ServerReader(_Reader):
    def __init__(self, relation: str, schema: StructType, servers: list[dict], connector: str, mark: str):
        super().__init__(relation, schema)
        self.servers, self.connector, self.mark = servers, connector, mark

    def partitions(self) -> list[InputPartition]:
        return [Server(s) for s in self.servers] or [Server({})]

    def statement(self) -> tuple[str, list[str]]:
        """The statement with a mark for each text that is allowed, and these texts."""
        tests = " AND ".join(f"{c} IN ({', '.join([self.mark] * len(v))})" for c, v in self.allowed)
        sql = _STATEMENTS[self.relation]
        return (f"SELECT * FROM ({sql}) q WHERE {tests}" if tests else sql), [x for _, v in self.allowed for x in v]

    def read(self, partition: Server) -> Iterator[pa.RecordBatch]:
        return self.batches(self._rows(partition.arguments))

    def _rows(self, arguments: dict) -> Iterator[dict]:
        if not arguments:
            return
        module, _, function = self.connector.partition(":")
        connection = getattr(importlib.import_module(module), function)(**arguments)
        try:
            cursor = connection.cursor()
            cursor.execute(*self.statement())
            names = [d[0].lower() for d in cursor.description]
            while got := cursor.fetchmany(BATCH):
                for values in got:
                    yield dict(zip(names, values))
        finally:
            connection.close()


class Catalogues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogues"

    @property
    def relation(self) -> str:
        relation = self.options.get("relation", "")
        if relation not in RELATIONS:
            raise ValueError(f"relation must be one of {', '.join(RELATIONS)}")
        return relation

    def schema(self) -> str:
        return RELATIONS[self.relation]

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        if ("path" in o) == ("servers" in o):
            raise ValueError("either path or servers must be given")
        if "path" in o:
            return LandedReader(self.relation, schema, o["path"], int(o.get("taskBytes", 16 << 20)))
        if "connector" not in o:
            raise ValueError("servers need a connector")
        return ServerReader(self.relation, schema, json.loads(o["servers"]), o["connector"], o.get("mark", "%s"))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("catalogues")`` known to the session, with its filters pushed."""
    spark.dataSource.register(Catalogues)
    spark.conf.set(PUSHDOWN, "true")


def row_sets(spark: SparkSession, **options: str) -> dict[str, DataFrame]:
    """The four row sets of a fleet, as ``catalogue_from_rows`` takes them: base tables only, views are left out of the tables."""
    register(spark)
    got = {r: spark.read.format("catalogues").options(relation=r, **options).load() for r in RELATIONS}
    return {**got, "tables": got["tables"].where("table_type = 'BASE TABLE'").drop("table_type")}


def land(row_sets_: dict[str, DataFrame], path: str, servers: int = 32) -> None:
    """Land row sets as the collectors do: in each relation's folder a compressed file for each server, which holds whole schemas."""
    for relation, rows in row_sets_.items():
        by = rows.selectExpr("*", f"pmod(hash(schema_id), {servers}) AS server").repartition(servers, "server")
        by.write.partitionBy("server").json(f"{path}/{relation}", compression="gzip")
