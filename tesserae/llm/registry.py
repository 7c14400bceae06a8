"""The queries of the corpus operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("audit", "lines", "bpe", "chat", "minhash", "mtree", "neighbours", "packing", "suffixes", "toxicity", "trie", "warc", "windows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"tesserae.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"tesserae.llm.{name}"), "ORACLES", {})
    return found
