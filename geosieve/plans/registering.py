"""Where the plan modules put their queries and the SQL they are checked against."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
