"""Writing: layers partitioned by tile, text documents and JSON parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_layers(cells: DataFrame, path: str, tile: int = 1024) -> None:
    """Layers as Parquet by tile (tr, tc); readers of a box prune by them. Doubles become floats; commits are atomic."""
    floats = {f.name: F.col(f.name).cast("float") for f in cells.schema.fields if f.dataType.typeName() == "double"}
    tiled = cells.withColumns(floats).withColumns({"tr": F.expr(f"r div {tile}"), "tc": F.expr(f"c div {tile}")})
    tiled.repartition("tr", "tc").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tr", "tc").parquet(path)


def read_layers(spark, path: str, box: tuple[int, int, int, int] | None = None, tile: int = 1024) -> DataFrame:
    """Layers of a box of cells (r0, c0, r1, c1), all of them without; only its tiles are opened."""
    df = spark.read.parquet(path)
    if box:
        r0, c0, r1, c1 = box
        df = df.where(f"tr between {r0 // tile} and {r1 // tile} and tc between {c0 // tile} and {c1 // tile} and r between {r0} and {r1} and c between {c0} and {c1}")
    return df.drop("tr", "tc")


def write_document(lines: DataFrame, order: Column, text: str, path: str, head: str, tail: str) -> None:
    """One text file: head, the lines in order, tail. For documents that a person opens; parts of any size go to write_parts."""
    spark = lines.sparkSession
    edge = lambda n, s: spark.createDataFrame([(n, None, s)], "part int, o string, value string")
    body = lines.select(F.lit(1).alias("part"), order.cast("string").alias("o"), F.col(text).alias("value"))
    edge(0, head).unionByName(body).unionByName(edge(2, tail)).orderBy("part", "o").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_parts(parts: Mapping[str, DataFrame], path: str) -> None:
    """Each part of a document as JSON lines in a folder of its own."""
    for name, df in parts.items():
        df.select("json").withColumnRenamed("json", "value").write.mode("overwrite").text(f"{path}/{name}")
