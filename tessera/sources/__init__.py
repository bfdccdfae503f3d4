"""Images, datasets, CSV and text in and out, and adapters over relational tables."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_image(spark: SparkSession, path: str | None) -> DataFrame:
    """(x, y, value) for each pixel of an image: 1-based, x fastest, grey in [0, 1]; alpha is dropped, colours become luminance."""
    if not path:
        raise ValueError("an image path is needed")
    img = spark.read.format("image").load(path).select("image.*")
    # modes 0, 16, 24: 1, 3 or 4 bytes a pixel, in the order blue, green, red, alpha
    n = F.col("nChannels")
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, pos * nChannels + {k + 1}, 1)")), 16, 10).cast("double") / 255
    pixels = img.select("width", "nChannels", "data", F.posexplode(F.sequence(F.lit(1), F.col("width") * F.col("height"))).alias("pos", "_n"))
    grey = F.when(n >= 3, 0.3 * byte(2) + 0.59 * byte(1) + 0.11 * byte(0)).otherwise(byte(0))
    return pixels.select((F.col("pos") % F.col("width") + 1).cast("int").alias("x"), (F.floor(F.col("pos") / F.col("width")) + 1).cast("int").alias("y"), grey.alias("value"))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A dataset: a folder with one Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if "cells" in out:
        require(out["cells"], "cell_id", "cluster")
    return out


def output_name(path: str, suffix: str, extension: str = ".parquet") -> str:
    """The path without its extension, with suffix and extension."""
    return re.sub(r"\.[^./]*$", "", path) + suffix + extension


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls as NA."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_text(lines: list[str], path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def make_folder(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def list_outputs(path: str, pattern: str = "*") -> list[str]:
    """Names in a folder that match a shell pattern, sorted."""
    return sorted(fnmatch.filter(os.listdir(path), pattern)) if os.path.isdir(path) else []


def starting_with(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """The columns whose names begin with a prefix, and those of `keep` before them."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def resolve_k(cells: DataFrame, k: int | None = None, stored: int | None = None) -> int:
    """The number of classes: as given, else as stored, else the number of distinct labels."""
    return k or stored or cells.select(F.count_distinct("cluster")).first()[0]


def pixels(events: DataFrame) -> DataFrame:
    """An event table as a pixel table of 100 columns; the type plays the intensity cluster."""
    return events.select("event_id", (F.col("event_id") % 100 + 1).cast("int").alias("x"), (F.floor(F.col("event_id") / 100) + 1).cast("int").alias("y"), F.least(F.col("value") / 100, F.lit(1.0)).alias("value"), "event_type")


def cells(embeddings: DataFrame) -> DataFrame:
    """A vector table as cells: the first two components are the coordinates."""
    return embeddings.select(F.col("vec_id").alias("cell_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("cluster"))


def expression(embeddings: DataFrame) -> DataFrame:
    """A vector table as counts: each component a gene, zeros kept."""
    long = embeddings.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("cluster"), F.posexplode("embedding").alias("p", "e"))
    return long.select("cell_id", "cluster", (F.col("p") + 1).alias("gene_id"), F.floor(F.greatest(F.col("e").cast("double"), F.lit(0.0)) * 100).cast("long").alias("count"))
