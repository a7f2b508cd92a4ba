"""Query results as DataFrames."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT = 10_000
SCHEMES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "mysql", "mongodb": "mongodb", "mongodb+srv": "mongodb", "snowflake": "snowflake", "databricks": "databricks", "sqlite": "sqlite", "mock": "mock"}
MOCK = {
    "customers": ([(1, "Amal Example", "784-1990-1234567-1", "amal@example.com", "+971501112233", "AE070331234567890123456"), (2, "Ben Sample", "784-1985-7654321-2", "ben@example.org", "0502223344", "GB82WEST12345698765432"), (3, "Amal Example", "784-1990-1234567-1", "amal@example.com", "+971501112233", "AE070331234567890123456")], "id int, name string, emirates_id string, email string, phone string, iban string"),
    "empty": ([], "id int"),
    "leaky": ([(1, "DB_PASSWORD=not-a-real-one", "postgresql://u:p@db.example.com/x")], "id int, config string, db string"),
}


def infer_driver(connection: str) -> str:
    """The kind of database a connection string names."""
    if m := re.match(r"jdbc:(\w+):", connection, re.I):
        return SCHEMES.get(m[1].lower(), m[1].lower())
    if connection == ":memory:" or re.search(r"\.(db|sqlite3?)$", connection, re.I):
        return "sqlite"
    if m := re.match(r"([a-z][a-z0-9+.-]*):", connection, re.I):
        if m[1].lower() in SCHEMES:
            return SCHEMES[m[1].lower()]
    raise ValueError("no driver for this connection string")


def limited(sql: str, limit: int | None) -> str:
    """The query as a derived table with a row cap, if there is one."""
    bare = sql.strip().rstrip(";").strip()
    return f"SELECT * FROM ({bare}) AS capped LIMIT {limit}" if isinstance(limit, int) and limit > 0 else bare


def jdbc_url(connection: str) -> tuple[str, dict[str, str]]:
    """A URL that JDBC drivers take, and user and password apart from it."""
    if connection.lower().startswith("jdbc:"):
        return connection, {}
    kind = infer_driver(connection)
    if kind == "sqlite":
        return f"jdbc:sqlite:{connection.removeprefix('sqlite://')}", {}
    parts = urlsplit(connection)
    name = {"postgres": "postgresql"}.get(kind, kind)
    own = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v is not None}
    return f"jdbc:{name}://{parts.netloc.rpartition('@')[2]}{parts.path}" + (f"?{parts.query}" if parts.query else ""), own


def read(spark: SparkSession, connection: str, query: str, limit: int | None = DEFAULT_LIMIT, **options: str) -> DataFrame:
    """Run a query; the cap is part of the SQL, so the database applies it."""
    kind = infer_driver(connection)
    if kind == "mock":
        rows, schema = MOCK[connection.partition(":")[2].strip("/") or "customers"]
        df = spark.createDataFrame(rows, schema)
        return df.limit(limit) if limit else df
    if kind == "mongodb":
        spec = json.loads(query)
        df = spark.read.format("mongodb").option("connection.uri", connection).option("collection", spec["collection"]).load()
        caps = [x for x in (limit, spec.get("limit")) if x]
        return df.limit(min(caps)) if caps else df
    url, own = jdbc_url(connection)
    return spark.read.format("jdbc").option("url", url).option("query", limited(query, limit)).options(**own | options).load()
