"""Arrow UDFs that are bound to a session when they are called, not when the module is imported."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def arrow_udf(return_type: str):
    def wrap(fn):
        @wraps(fn)
        def call(*columns):
            return F.pandas_udf(fn, return_type)(*columns)

        return call

    return wrap
