"""Run state in SQLite on the driver: locks, the version ledger, and times of success."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .version import Version

_TABLES = """
CREATE TABLE IF NOT EXISTS locks (node TEXT PRIMARY KEY, holder TEXT, acquired REAL, expires REAL);
CREATE TABLE IF NOT EXISTS versions (module TEXT, major INTEGER, version TEXT, updated REAL, PRIMARY KEY (module, major));
CREATE TABLE IF NOT EXISTS runs (module TEXT, version TEXT, succeeded REAL, PRIMARY KEY (module, version));
CREATE TABLE IF NOT EXISTS tables (module TEXT, name TEXT, succeeded REAL, PRIMARY KEY (module, name));
"""


class StateStore:
    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self._open() as c:
            c.executescript(_TABLES)

    @contextmanager
    def _open(self) -> Iterator[sqlite3.Connection]:
        c = sqlite3.connect(self.path, timeout=30, isolation_level=None)
        c.execute("PRAGMA journal_mode=WAL")
        try:
            yield c
        finally:
            c.close()

    def acquire(self, node: str, holder: str, ttl: float = 3600.0) -> bool:
        """Take a lock that is free or has run out; a live one is refused even to its holder."""
        now = time.time()
        with self._open() as c:
            c.execute("BEGIN IMMEDIATE")
            live = c.execute("SELECT 1 FROM locks WHERE node = ? AND expires > ?", (node, now)).fetchone()
            if not live:
                c.execute("INSERT OR REPLACE INTO locks VALUES (?, ?, ?, ?)", (node, holder, now, now + ttl))
            c.execute("COMMIT")
        return not live

    def renew(self, node: str, holder: str, ttl: float = 3600.0) -> bool:
        with self._open() as c:
            return c.execute("UPDATE locks SET expires = ? WHERE node = ? AND holder = ?", (time.time() + ttl, node, holder)).rowcount == 1

    def release(self, node: str, holder: str) -> None:
        with self._open() as c:
            c.execute("DELETE FROM locks WHERE node = ? AND holder = ?", (node, holder))

    def version(self, module: str, major: int) -> str | None:
        with self._open() as c:
            row = c.execute("SELECT version FROM versions WHERE module = ? AND major = ?", (module, major)).fetchone()
        return row[0] if row else None

    def record_version(self, module: str, version: str) -> None:
        """Only ever upwards within a major."""
        new = Version.parse(version)
        with self._open() as c:
            c.execute("BEGIN IMMEDIATE")
            row = c.execute("SELECT version FROM versions WHERE module = ? AND major = ?", (module, new.major)).fetchone()
            if not row or Version.parse(row[0]) <= new:
                c.execute("INSERT OR REPLACE INTO versions VALUES (?, ?, ?, ?)", (module, new.major, version, time.time()))
            c.execute("COMMIT")

    def record_success(self, module: str, version: str) -> None:
        with self._open() as c:
            c.execute("INSERT OR REPLACE INTO runs VALUES (?, ?, ?)", (module, version, time.time()))

    def record_table(self, module: str, table: str) -> None:
        with self._open() as c:
            c.execute("INSERT OR REPLACE INTO tables VALUES (?, ?, ?)", (module, table, time.time()))

    def last_success(self, module: str, version: str) -> float | None:
        """When this version of the module was last run to its end."""
        with self._open() as c:
            row = c.execute("SELECT succeeded FROM runs WHERE module = ? AND version = ?", (module, version)).fetchone()
        return row[0] if row else None

    def ledger(self, spark: SparkSession) -> DataFrame:
        """module, major, version: the newest version run of each major."""
        with self._open() as c:
            rows = c.execute("SELECT module, major, version FROM versions ORDER BY 1, 2").fetchall()
        return spark.createDataFrame(rows, "module string, major int, version string")
