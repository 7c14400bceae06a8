"""Annotations of genes from public resources: download, reshaping and a network of gene sets."""

from __future__ import annotations

import urllib.request
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.csv import frame_from_csv_bytes

#: Licences that a resource can be asked for.
LICENSES = ("academic", "commercial", "nonprofit")
#: Fixed value: the name of the resource of cell types.
PANGLAODB = "panglaodb"
#: The columns that are reshaped, and those that are dropped if they are there.
KEYS, LABEL, VALUE, DROPPED = ("genesymbol", "record_id"), "label", "value", ("record_id", "entity_type", "_entity_type")


def download_resource(url: str) -> bytes:
    """The body of an HTTP answer; an error status is an error."""
    with urllib.request.urlopen(url) as answer:
        return answer.read()


def check_license(license: str) -> str:
    if license.lower() not in LICENSES:
        raise ValueError(f"a licence is one of {', '.join(LICENSES)}")
    return license.lower()


def load_resource(spark: SparkSession, url: str, name: str, license: str, tax_id: str | None = None) -> DataFrame:
    """A named resource from a service at url, reshaped; url has places {name} and {license}."""
    where = url.format(name=name, license=check_license(license))
    return reshape(frame_from_csv_bytes(spark, download_resource(where), sep="\t"), tax_id)


def reshape(rows: DataFrame, tax_id: str | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """A row for each gene and record, with a column for each label; labels given spare a pass to find them.

    With tax_id, rows of another ncbi_tax_id are left out if there is such a label."""
    wide = rows.select(*KEYS, LABEL, VALUE).groupBy(*KEYS).pivot(LABEL, list(labels) if labels else None).agg(F.min(VALUE))
    if tax_id is not None and "ncbi_tax_id" in wide.columns:
        wide = wide.where(F.col("ncbi_tax_id").cast("string") == str(tax_id))
    return wide.drop(*DROPPED)


def network(rows: DataFrame, source: str = "cell_type", target: str = "genesymbol", features: DataFrame | None = None, tmin: int = 0) -> DataFrame:
    """source, target and weight 1 of pairs without nulls whose target is one of features (var_name), of sources with at least tmin of them."""
    pairs = rows.select(F.col(source).alias("source"), F.col(target).alias("target")).dropna().distinct()
    if features is not None:
        pairs = pairs.join(features.select(F.col("var_name").alias("target")).distinct(), "target", "left_semi")
    enough = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tmin).select("source")
    return pairs.join(enough, "source", "left_semi").select("source", "target", F.lit(1.0).alias("weight"))


def panglaodb_network(spark: SparkSession, url: str, license: str, tax_id: str | None = None, features: DataFrame | None = None, tmin: int = 0) -> DataFrame:
    """The network of cell types and their marker genes from the resource of that name, in one call."""
    return network(load_resource(spark, url, PANGLAODB, license, tax_id), "cell_type", "genesymbol", features, tmin)
