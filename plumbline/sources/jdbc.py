"""Writes to a database that are applied once, however often they are tried."""

from __future__ import annotations

from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A table of the database that remembers writes: their id, when and how many rows.
STATUS_TABLE = "plumbline_writes"
#: SQL states of a table that is there already, and of a key that repeats.
TABLE_EXISTS, KEY_REPEATS = ("X0Y32", "42P07", "42S01"), "23505"


class _Connection:
    """One transaction; rolled back unless it is committed."""

    def __init__(self, spark: SparkSession, url: str, driver: str | None, properties: dict[str, str]) -> None:
        jvm = spark._jvm
        if driver:
            jvm.java.lang.Class.forName(driver)
        given = jvm.java.util.Properties()
        for k, v in properties.items():
            given.setProperty(k, v)
        self.connection = jvm.java.sql.DriverManager.getConnection(url, given)
        self.connection.setAutoCommit(False)

    def __enter__(self) -> _Connection:
        return self

    def __exit__(self, *_: Any) -> None:
        self.connection.rollback()
        self.connection.close()

    def run(self, sql: str, *values: Any) -> int:
        statement = self.connection.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                statement.setObject(i, v)
            return statement.executeUpdate()
        finally:
            statement.close()

    def count(self, sql: str, *values: Any) -> int:
        statement = self.connection.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                statement.setObject(i, v)
            rows = statement.executeQuery()
            rows.next()
            return rows.getLong(1)
        finally:
            statement.close()

    def commit(self) -> None:
        self.connection.commit()


def _state(error: Exception) -> str:
    cause = getattr(error, "java_exception", None)
    return cause.getSQLState() if cause is not None and hasattr(cause, "getSQLState") else ""


def _ensured(connection: _Connection, status: str) -> None:
    try:
        connection.run(f"CREATE TABLE {status} (write_id VARCHAR(200) NOT NULL PRIMARY KEY, done_at TIMESTAMP NOT NULL, moved BIGINT NOT NULL)")
        connection.commit()
    except Exception as e:
        connection.connection.rollback()
        if _state(e) not in TABLE_EXISTS:
            raise


def _dropped(connection: _Connection, table: str) -> None:
    try:
        connection.run(f"DROP TABLE {table}")
        connection.commit()
    except Exception:  # it may be gone already; its name belongs to this write alone
        connection.connection.rollback()


def write_once(df: DataFrame, url: str, table: str, write_id: str, driver: str | None = None, status: str = STATUS_TABLE, **properties: str) -> bool:
    """Append rows to a database table unless the write of this id was applied before; tells whether it was applied now.

    Tasks write to a staging table of the write, in parallel and as often as they
    are retried or run twice. One transaction then records the id and moves the
    rows, so that either both are there or neither is: a write that failed
    before its commit starts again, one that failed after it is not repeated. Of
    two that run at once the id's key lets one through. The table is made with
    the columns of the rows if it is not there.
    """
    spark = df.sparkSession
    options = properties | ({"driver": driver} if driver else {})
    stage = f"{table}_stage_{sha256(write_id.encode()).hexdigest()[:12]}"
    with _Connection(spark, url, driver, properties) as connection:
        _ensured(connection, status)
        if connection.count(f"SELECT count(*) FROM {status} WHERE write_id = ?", write_id):
            _dropped(connection, stage)
            return False
    df.limit(0).write.jdbc(url, table, "append", options)
    df.write.jdbc(url, stage, "overwrite", options)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    with _Connection(spark, url, driver, properties) as connection:
        try:
            connection.run(f"INSERT INTO {status} (write_id, done_at, moved) VALUES (?, CURRENT_TIMESTAMP, 0)", write_id)
        except Exception as e:
            if _state(e) == KEY_REPEATS:
                return False
            raise
        moved = connection.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
        connection.run(f"UPDATE {status} SET moved = {int(moved)} WHERE write_id = ?", write_id)
        connection.commit()
        _dropped(connection, stage)
    return True


def forget_writes(spark: SparkSession, url: str, hours: int = 24, driver: str | None = None, status: str = STATUS_TABLE, **properties: str) -> int:
    """Remove the ids of writes that were applied more than some hours ago, and tell how many."""
    before = spark._jvm.java.sql.Timestamp(spark._jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000)
    with _Connection(spark, url, driver, properties) as connection:
        _ensured(connection, status)
        gone = connection.run(f"DELETE FROM {status} WHERE done_at < ?", before)
        connection.commit()
    return gone
