"""Reading layers: boxes pushed to the scan, optional columns, unions of tiles, paged services as a Python data source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def pick_field(columns: Sequence[str], *wanted: str) -> str | None:
    """The first column whose lower-cased name holds one of the wanted parts, parts in order of preference."""
    for w in wanted:
        for c in columns:
            if w.lower() in c.lower():
                return c
    return None


def clipped(df: DataFrame, box: tuple[float, float, float, float], names: Sequence[str] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """Features whose box meets `box`; plain comparisons, so that Parquet skips row groups by them."""
    x0, y0, x1, y1 = (F.col(n) for n in names)
    return df.where((x1 >= box[0]) & (y1 >= box[1]) & (x0 <= box[2]) & (y0 <= box[3]))


def with_optional(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df with the columns (name to type) that it lacks as nulls, so that what follows stays total."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Tiles or sources one after the other; columns that some lack are null there."""
    out = parts[0].select("*")
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_valid_wins(tiles: DataFrame, value: str, order: Column) -> DataFrame:
    """(r, c, value): of overlapping tiles (r, c, ..) the first that covers a cell."""
    w = Window.partitionBy("r", "c").orderBy(order)
    return tiles.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("r", "c", value)


def unmixed(mean: Column, valid: Column, nodata: float) -> Column:
    """A mean that nodata got into, without it; null where less than half was valid."""
    return F.when(valid >= 0.5, (mean - (1 - valid) * nodata) / valid)


def tile_ids(x0: float, y0: float, x1: float, y1: float, size: float) -> list[tuple[int, int]]:
    """Tiles of an index grid that a box touches."""
    return [(i, j) for i in range(int(x0 // size), int(x1 // size) + 1) for j in range(int(y0 // size), int(y1 // size) + 1)]


def harvest(spark: SparkSession, path: str, zone: str, years: int = 5) -> DataFrame:
    """The last years of a zone from a harvest CSV: zero-padded zones, rows of all weapons only; a byte-order mark does no harm."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = with_optional(df, {"Engins": "string"}).where(F.when(F.length("Zone") < 2, F.lpad("Zone", 2, "0")).otherwise(F.col("Zone")) == zone.zfill(2)).where(F.col("Engins").isNull() | F.col("Engins").isin("", "Tous"))
    return df.orderBy(F.desc("Annee")).limit(years).withColumn("total", F.col("Total_general").try_cast("int"))


def effort(text: Column) -> list[Column]:
    """Success, hunters and density out of a report's running text."""
    t = F.lower(F.regexp_replace(text, "[ \\t\\n\\u00a0]+", " "))
    found = lambda p: F.nullif(F.replace(F.replace(F.regexp_extract(t, p, 1), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), F.lit(""))
    # a number beside the word that tells what it is, no more than a few words apart
    success, hunters, density = found("succ.s de chasse(?: [a-z]+){0,5} (\\d+) ?%"), found("((?:\\d+ )+)chasseurs"), found("densit.(?: [a-z]+){0,5} (\\d+(?:,\\d+)?) orignal")
    return [success.try_cast("int").alias("success_pct"), hunters.try_cast("int").alias("hunters"), density.try_cast("double").alias("density")]


class NoCoverage(Exception):
    """A service's answer that the box lies outside what it covers."""


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.names = [f.name for f in schema.fields]
        self.options = dict(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(i) for i in range(int(self.options.get("pages") or self.options.get("lanes", "1")))]

    def _fetched(self, fetch: Callable[[int, int], list[dict]], number: int, size: int) -> list[dict]:
        tries = int(self.options.get("tries", "3"))
        for n in range(tries):
            try:
                return fetch(number, size)
            except NoCoverage:
                if number >= int(self.options.get("lanes", "1")):
                    raise  # it had rows before, so this is a failure
                return []
            except OSError:
                if n + 1 == tries:
                    raise
                time.sleep(0.1 * 2**n)
        return []

    def read(self, partition: Page) -> Iterator[tuple]:
        from importlib import import_module

        module, _, name = self.options["fetch"].rpartition(".")
        fetch = getattr(import_module(module), name)
        size, lanes = int(self.options.get("page_size", "1000")), int(self.options.get("lanes", "1"))
        ends = time.monotonic() + float(self.options.get("budget_s", "inf"))
        number = partition.number
        while True:
            rows = self._fetched(fetch, number, size)
            for row in rows:
                yield tuple(row.get(k) if not isinstance(row.get(k), (dict, list)) else json.dumps(row[k]) for k in self.names)
            if self.options.get("pages") or len(rows) < size:
                return
            if time.monotonic() > ends:
                raise TimeoutError("the service did not end within its budget; nothing of it is kept")
            number += lanes


class PagedSource(DataSource):
    """Pages of a feature service. Options: fetch (dotted name of a function of page and page size that gives rows as dicts), page_size, tries, and either pages (a partition each) or lanes.

    Each of the lanes reads every lanes-th page up to its first short one, so the number of pages need not be known. A page that keeps
    failing, or a lane that is not through after budget_s seconds, fails the read: a pull is whole or not at all. Where the
    first page of a lane is answered by NoCoverage, the lane has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def read_pages(spark: SparkSession, schema: str, fetch: str, pages: int | None = None, page_size: int = 1000, lanes: int = 4, budget_s: float | None = None) -> DataFrame:
    spark.dataSource.register(PagedSource)
    out = spark.read.format("paged_features").schema(schema).option("fetch", fetch).option("page_size", page_size)
    out = out.option("lanes", lanes) if pages is None else out.option("pages", pages)
    return (out if budget_s is None else out.option("budget_s", budget_s)).load()


# Values of a tag that make a feature one of a named kind; None stands for any value.
FEATURES = {
    "roads": {"highway": ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "track", "service")},
    "trails": {"highway": ("path", "footway", "bridleway", "cycleway")},
    "rail": {"railway": ("rail", "narrow_gauge", "light_rail")},
    "waterways": {"waterway": ("river", "stream", "canal", "tidal_channel", "rapids")},
    "waterbodies": {"natural": ("water",), "landuse": ("reservoir",)},
    "builtup": {"landuse": ("residential", "farmland", "farmyard", "industrial", "commercial", "retail", "quarry", "cemetery", "allotments", "village_green", "recreation_ground"), "building": None, "leisure": ("park", "golf_course")},
}


def is_feature(kind: str, tag: Callable[[str], Column]) -> Column:
    """Whether the tags of a feature (a column by tag name) make it one of a kind of FEATURES; a filter that Parquet can push down."""
    out = F.lit(False)
    for name, values in FEATURES[kind].items():
        out = out | (tag(name).isNotNull() if values is None else F.coalesce(tag(name).isin(*values), F.lit(False)))
    return out


def season(today: Column, back: int = 3) -> Column:
    """Growing seasons (starts, ends) newest first, none that has not begun; ends are capped at today."""
    years = F.sequence(F.year(today), F.year(today) - back, F.lit(-1))
    windows = F.transform(years, lambda y: F.struct(F.make_date(y, F.lit(6), F.lit(15)).alias("starts"), F.least(F.make_date(y, F.lit(9), F.lit(20)), today).alias("ends")))
    return F.filter(windows, lambda w: w["starts"] <= today)
