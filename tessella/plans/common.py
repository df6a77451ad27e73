"""Registering a query with its SQL over the views."""

from __future__ import annotations

from .registry import register
from .views import oracle, view


def query(name: str, sql: str | None = None):
    """Decorator for f(V), V(name) giving a table or view."""

    def keep(f):
        def run(spark, sf_dir):
            return f(lambda n: view(spark, sf_dir, n))

        run.__name__ = name
        run.__doc__ = f.__doc__
        register(name, oracle(sql) if sql else None)(run)
        return f

    return keep
