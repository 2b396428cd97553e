"""Run a query in Spark and its SQL in DuckDB on the same tables."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE",
}


def types_differ(df, connection, sql):
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    duck = {row[0]: row[1] for row in described}
    return {
        f.name: (f.dataType.simpleString(), duck.get(f.name))
        for f in df.schema.fields
        if SPARK_TO_DUCK.get(f.dataType.simpleString()) != duck.get(f.name)
    }
