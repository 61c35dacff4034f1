"""A DB-API connection whose ``information_schema`` is an SQLite file, for the data source's tests."""

import sqlite3


def connect(path):
    connection = sqlite3.connect(":memory:")
    connection.execute("ATTACH ? AS information_schema", (path,))
    return connection
