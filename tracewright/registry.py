"""Where queries and the SQL of the same rows are kept."""

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return keep
