"""Delimited text as a table, from files or from bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _options(sep: str, has_header: bool) -> dict[str, object]:
    return {"sep": sep, "header": has_header, "quote": '"', "escape": '"', "nullValue": "NA", "inferSchema": True}


def read_csv(spark: SparkSession, path: str, sep: str = ",", has_header: bool = True) -> DataFrame:
    """Types are inferred, double quotes enclose (two are one of them), and NA is null in every column."""
    return spark.read.csv(path, **_options(sep, has_header))


def _records(text: str) -> Iterator[str]:
    """Lines, which CR LF, LF or CR end; within quotes these are part of a record, as they are. Empty lines are none, and one of blanks is a field."""
    held, inside = [], False
    parts = re.split("(\r\n|\n|\r)", text)
    for line, end in zip(parts[::2], [*parts[1::2], ""], strict=True):
        held.append(line)
        inside ^= line.count('"') % 2 == 1
        if inside:
            held.append(end)
            continue
        record = "".join(held)
        if record:
            yield record if record.strip() else f'"{record}"'
        held = []
    if held:
        yield "".join(held)


def frame_from_csv_bytes(spark: SparkSession, data: bytes, sep: str = ",", has_header: bool = True) -> DataFrame:
    """The same for bytes that the driver holds, such as a downloaded annotation; Spark parses the lines and infers the types."""
    records = list(_records(data.decode("utf-8-sig")))
    if not records:
        raise ValueError("there is no line")
    return spark.read.csv(spark.sparkContext.parallelize(records), **_options(sep, has_header), multiLine=True)
