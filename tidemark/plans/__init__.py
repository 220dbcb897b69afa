"""Registered queries over the given tables, each next to an independent SQL form.

A module has ``QUERIES`` (name to a function of session and folder) and
``ORACLE`` (name to SQL). The SQL says the same thing another way: plain window
frames, as-of joins and sorted scans instead of the library's operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import drift, features, governance, quality, serving, store, streams, training

MODULES = (features, store, quality, drift, serving, governance, streams, training)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
