"""A data source that follows an issue host's cursors: ``spark.read.format("issue-connection")``.

One connection is one sequential partition, since each page names the next. What is sent
and how is the business of a transport that the caller names: a function ``(query,
variables) -> data`` as ``module:name``, importable where tasks run. Only queries are
sent. A lost executor reads the connection from its start again.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.plans.staging import stage
from quillon.sources.host_pages import HostPages, refuse_writes
from quillon.sources.trackers import SourceError

FORMAT = "issue-connection"
PAGE_SIZE = 50


def transport_of(named: str) -> Callable[[str, dict], dict]:
    module, _, name = named.partition(":")
    if not module or not name:
        raise SourceError("a transport is named module:function")
    return getattr(importlib.import_module(module), name)


class ConnectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        missing = [key for key in ("connection", "query", "transport") if not options.get(key)]
        if missing:
            raise SourceError(f"the source needs {', '.join(missing)}")
        self.connection, self.transport = options["connection"], options["transport"]
        self.query = refuse_writes(options["query"])
        self.size = int(options.get("pagesize") or options.get("pageSize") or PAGE_SIZE)
        self.variables = json.loads(options.get("variables") or "{}")
        if self.size < 1 or not isinstance(self.variables, dict):
            raise SourceError("the page size must be positive and the variables an object")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _page(self, send: Callable[[str, dict], dict], cursor: str | None) -> tuple[list[dict], str | None]:
        """The nodes of the page after ``cursor``, and the cursor of the next one if there is one."""
        sent = send(self.query, {**self.variables, "first": self.size, "after": cursor})
        found = sent.get(self.connection) if isinstance(sent, dict) else None
        nodes, info = (found.get("nodes"), found.get("pageInfo")) if isinstance(found, dict) else (None, None)
        if not isinstance(nodes, list) or not isinstance(info, dict) or not all(isinstance(n, dict) for n in nodes):
            raise SourceError(f"a page holds no {self.connection} connection")
        if not info.get("hasNextPage"):
            return nodes, None
        after = info.get("endCursor")
        if not isinstance(after, str) or not after:
            raise SourceError(f"a page of {self.connection} has no end cursor")
        if after == cursor:
            raise SourceError(f"the cursor of {self.connection} did not advance")
        return nodes, after

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        send, cursor, more = transport_of(self.transport), None, True
        while more:
            nodes, cursor = self._page(send, cursor)
            yield from ((json.dumps(node, ensure_ascii=False),) for node in nodes)
            more = cursor is not None


class ConnectionSource(DataSource):
    """Options: ``connection``, ``query``, ``transport``, and ``pageSize`` and ``variables`` (JSON) if need be."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "node string"

    def reader(self, schema) -> ConnectionReader:
        return ConnectionReader(dict(self.options))


def connection(spark: SparkSession, name: str, query: str, transport: str, variables: dict | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """``node`` of all pages of a connection, fetched once and staged."""
    spark.dataSource.register(ConnectionSource)
    options = {"connection": name, "query": query, "transport": transport, "pageSize": page_size, "variables": json.dumps(variables or {})}
    return stage(spark.read.format(FORMAT).options(**options).load(), "connection")


class HostConnections(HostPages):
    """The records of one team as ``HostPages`` gives them, fetched through a transport.

    ``queries`` are the texts for the connections ``issues`` and ``issueRelations``.
    """

    def __init__(self, spark: SparkSession, organization: str, team_id: str, queries: dict[str, str], transport: str, page_size: int = PAGE_SIZE) -> None:
        super().__init__(spark, organization, team_id, [], [])
        self.queries, self.transport, self.page_size = queries, transport, page_size
        self._fetched: dict[str, DataFrame] = {}

    def nodes(self, name: str) -> DataFrame:
        if name not in self._fetched:
            variables = {"teamId": self.team_id} if name == "issues" else {}
            self._fetched[name] = connection(self.spark, name, self.queries[name], self.transport, variables, self.page_size)
        return self._fetched[name]
