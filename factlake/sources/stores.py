"""Where a lake's log lives: small named texts, of which a name is taken once.

``put`` is the commit point of a lake: it makes a name with its whole text, or tells that the name is there. On a file system
that is a rename which fails if the target exists (HDFS and local disks have it; plain object stores don't); a database does
it by a primary key, for lakes whose data is in such a store.
"""

from __future__ import annotations

import re
import uuid
from typing import Protocol

from pyspark.sql import SparkSession

TABLE = "lake_log"


class LogStore(Protocol):
    def put(self, name: str, text: str) -> bool:
        """Whether this call made the name: false if it was there."""

    def get(self, name: str) -> str: ...

    def has(self, name: str) -> bool: ...

    def names(self) -> list[str]: ...

    def drop(self, name: str) -> None: ...


class Folder:
    """Files in a folder below a root, on any Hadoop file system whose rename refuses an existing target."""

    def __init__(self, spark: SparkSession, root: str, folder: str = "_log"):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), folder
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")

    def fs(self):
        return self.path("").getFileSystem(self.conf)

    def prepare(self) -> None:
        self.fs().mkdirs(self.path(self.folder))

    def put(self, name: str, text: str) -> bool:
        draft = self.path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        stream = self.fs().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs().getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self.path(f"{self.folder}/{name}"), options)
        except Exception as error:
            self.fs().delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def get(self, name: str) -> str:
        stream = self.fs().open(self.path(f"{self.folder}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return self.fs().exists(self.path(f"{self.folder}/{name}"))

    def names(self) -> list[str]:
        where = self.path(self.folder)
        if not self.fs().exists(where):
            return []
        found, files = [], self.fs().listFiles(where, False)
        while files.hasNext():
            found.append(files.next().getPath().getName())
        return [n for n in found if not n.startswith(".")]

    def drop(self, name: str) -> None:
        self.fs().delete(self.path(f"{self.folder}/{name}"), False)


class Database:
    """Rows of a table behind a JDBC URL, keyed by lake and name. ``options``: url, driver, user and password, as of postgres_options()."""

    def __init__(self, spark: SparkSession, options: dict[str, str], lake: str, table: str = TABLE):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
            raise ValueError(f"bad table name {table!r}")
        self.spark, self.options, self.lake, self.table = spark, dict(options), lake, table

    def _connection(self):
        jvm = self.spark.sparkContext._jvm
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"])
        settings = jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in self.options:
                settings.setProperty(name, self.options[name])
        return jvm.java.sql.DriverManager.getConnection(self.options["url"], settings)

    def _run(self, sql: str, *values: str, rows: bool = False):
        connection = self._connection()
        try:
            statement = connection.prepareStatement(sql)
            for i, value in enumerate(values):
                statement.setString(i + 1, value)
            if not rows:
                return statement.executeUpdate()
            found, out = statement.executeQuery(), []
            while found.next():
                out.append(found.getString(1))
            return out
        finally:
            connection.close()

    @staticmethod
    def _state(error: Exception) -> str:
        """The SQL state of a JDBC error, or nothing."""
        cause = getattr(error, "java_exception", None)
        try:
            return cause.getSQLState() or "" if cause is not None else ""
        except Exception:
            return ""

    def prepare(self) -> None:
        """Make the table, unless it is there."""
        text = "TEXT" if "postgresql" in self.options["url"] else "CLOB"
        try:
            self._run(f"SELECT name FROM {self.table} WHERE lake = ? AND name = ?", self.lake, "", rows=True)
        except Exception:
            self._run(f"CREATE TABLE {self.table} (lake VARCHAR(500) NOT NULL, name VARCHAR(200) NOT NULL, body {text} NOT NULL, PRIMARY KEY (lake, name))")

    def put(self, name: str, text: str) -> bool:
        try:
            self._run(f"INSERT INTO {self.table} (lake, name, body) VALUES (?, ?, ?)", self.lake, name, text)
        except Exception as error:
            if self._state(error).startswith("23"):  # a constraint: the key is there
                return False
            raise
        return True

    def get(self, name: str) -> str:
        found = self._run(f"SELECT body FROM {self.table} WHERE lake = ? AND name = ?", self.lake, name, rows=True)
        if not found:
            raise FileNotFoundError(name)
        return found[0]

    def has(self, name: str) -> bool:
        return bool(self._run(f"SELECT name FROM {self.table} WHERE lake = ? AND name = ?", self.lake, name, rows=True))

    def names(self) -> list[str]:
        return self._run(f"SELECT name FROM {self.table} WHERE lake = ?", self.lake, rows=True)

    def drop(self, name: str) -> None:
        self._run(f"DELETE FROM {self.table} WHERE lake = ? AND name = ?", self.lake, name)


def ensure_database(store: Database, name: str, owner: str | None = None) -> bool:
    """Make a PostgreSQL database through a store that is connected as an administrator; whether it was made."""
    for x in (name, owner):
        if x is not None and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$-]*", x):
            raise ValueError(f"bad name {x!r}")
    if store._run("SELECT datname FROM pg_database WHERE datname = ?", name, rows=True):
        return False
    store._run(f'CREATE DATABASE "{name}"' + (f' OWNER "{owner}"' if owner else ""))
    return True
