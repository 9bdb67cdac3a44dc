"""Compare a registered query with its SQL counterpart: names, types, row count and every value."""
from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def differences(df, connection, sql: str) -> list[str]:
    """Empty when the Spark result and the SQL result agree."""
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    kinds = {d[0]: str(d[1]) for d in expected.description}
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for field in df.schema.fields:
        wanted = SAME_TYPE.get(field.dataType.simpleString(), "?")
        if wanted != kinds[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}")
    order = sorted(names)
    ours = Counter(tuple(_plain(row[c]) for c in order) for row in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in expected.fetchall())
    if ours != theirs:
        found.append(f"{sum(ours.values())} rows against {sum(theirs.values())}")
        found += [f"only Spark {n}x: {dict(zip(order, row))}" for row, n in list((ours - theirs).items())[:3]]
        found += [f"only SQL {n}x: {dict(zip(order, row))}" for row, n in list((theirs - ours).items())[:3]]
    return found
