"""Catalog providers: where a table's DDL comes from."""

from __future__ import annotations

from abc import ABC, abstractmethod
from importlib.metadata import entry_points

from pyspark.sql import SparkSession


class CatalogError(Exception):
    """A catalog cannot be used or does not answer."""


class Catalog(ABC):
    """A provider. get_ddl_batch gives "ERROR: ..." for tables that fail."""

    name = ""

    def configure(self, **options) -> None:
        """Take settings; unknown ones are ignored."""

    @abstractmethod
    def get_ddl(self, table: str) -> str:
        """CREATE statement of a table. Raises CatalogError."""

    def get_ddl_batch(self, tables: list[str]) -> dict[str, str]:
        out = {}
        for t in tables:
            try:
                out[t] = self.get_ddl(t)
            except Exception as e:
                out[t] = f"ERROR: {e}"
        return out


class SparkCatalog(Catalog):
    """The session's own catalog."""

    name = "spark"

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()

    def get_ddl(self, table: str) -> str:
        try:
            return self.spark.sql(f"SHOW CREATE TABLE {table}").first()[0]
        except Exception as first:
            try:
                columns = self.spark.catalog.listColumns(table)  # temporary views have no CREATE statement
            except Exception:
                raise CatalogError(str(first).splitlines()[0]) from first
            return f"CREATE TABLE {table} ({', '.join(f'`{c.name}` {c.dataType}' for c in columns)})"


class DatabricksCatalog(Catalog):
    """A SQL warehouse reached through the vendor's SDK; needs it installed, and a warehouse_id."""

    name = "databricks"

    def __init__(self):
        self.options: dict[str, str] = {}
        self._client = None

    def configure(self, **options) -> None:
        self.options = {k: v for k, v in options.items() if v}
        if not self.options.get("warehouse_id"):
            raise CatalogError("warehouse_id is required")

    def client(self):
        if self._client is None:
            try:
                from databricks.sdk import WorkspaceClient
            except ImportError as e:
                raise CatalogError("databricks-sdk is not installed") from e
            self._client = WorkspaceClient(**{k: self.options[k] for k in ("profile", "host", "token") if k in self.options})
        return self._client

    def get_ddl(self, table: str) -> str:
        if not self.options.get("warehouse_id"):
            raise CatalogError("configure() has not been called")
        done = self.client().statement_execution.execute_statement(statement=f"SHOW CREATE TABLE {table}", warehouse_id=self.options["warehouse_id"], wait_timeout="30s")
        rows = getattr(getattr(done, "result", None), "data_array", None)
        if not rows:
            raise CatalogError(f"no DDL for {table}")
        return rows[0][0]


class Registry:
    """Things by name: registered ones, and entry points of a group."""

    def __init__(self, kind: str, group: str, built_in: dict[str, type]):
        self.kind, self.group, self.built_in = kind, group, built_in
        self.own: dict[str, type] = {}

    def register(self, name: str, maker: type) -> None:
        self.own[name] = maker

    def clear(self) -> None:
        self.own = {}

    def names(self) -> list[str]:
        return sorted({*self.built_in, *self.own, *(e.name for e in entry_points(group=self.group))})

    def get(self, name: str, *args):
        maker = self.own.get(name) or self.built_in.get(name) or next((e.load() for e in entry_points(group=self.group) if e.name == name), None)
        if maker is None:
            raise KeyError(f"Unknown {self.kind} '{name}'. Available: {', '.join(self.names())}")
        return maker(*args)


catalogs = Registry("catalog", "lineora.catalogs", {"spark": SparkCatalog, "databricks": DatabricksCatalog})
