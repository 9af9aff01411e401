"""Plans of several sites and windows folded into one, and documents made of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.geo import kml_colour
from cellweave.operators.zonal import global_rank


def letters(n: Column) -> Column:
    """A, B, .. Z, then AA, AB, .. for 1, 2, .."""
    one = lambda i: F.char((i + 65).cast("int"))
    return F.when(n <= 26, one(n - 1)).otherwise(F.concat(one(F.floor((n - 27) / 26)), one(F.pmod(n - 27, F.lit(26)))))


def merge_areas(areas: DataFrame) -> DataFrame:
    """areas (site, win, rank, area_km2, habitat, camp) of all plans: site_rank is the old rank, rank the new one over all, camp a letter that no two plans share."""
    worth = -(F.coalesce("area_km2", F.lit(0.0)) * F.coalesce("habitat", F.lit(0.0)))
    camps = areas.select("site", "win", "camp").where("camp is not null").distinct()
    camps = global_rank(camps, ["site", "win", "camp"], "_n").withColumn("letter", letters(F.col("_n"))).drop("_n")
    out = areas.withColumn("site_rank", F.col("rank")).withColumn("_worth", worth)
    out = global_rank(out, ["_worth", "site", "win", "site_rank"], "rank").withColumn("rank", F.col("rank").cast("int")).drop("_worth")
    return out.join(camps, ["site", "win", "camp"], "left").drop("camp").withColumnRenamed("letter", "camp")


def rollup(areas: DataFrame, plans: DataFrame, by: str) -> DataFrame:
    """(by, ok, areas, best_habitat, total_km2, best_rank) of each site or window of plans (site, win, ok)."""
    a = areas.groupBy(by).agg(F.count(F.lit(1)).alias("areas"), F.round(F.max("habitat"), 3).alias("best_habitat"), F.round(F.sum("area_km2"), 1).alias("total_km2"), F.min("rank").alias("best_rank"))
    p = plans.groupBy(by).agg(F.bool_or("ok").alias("ok"))
    return p.join(a, by, "left").withColumn("areas", F.coalesce("areas", F.lit(0).cast("long")))


def xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def gpx_points(name: Column, lat: Column, lon: Column) -> Column:
    return F.format_string('<wpt lat="%s" lon="%s"><name>%s</name></wpt>', lat.cast("string"), lon.cast("string"), xml(name))


def gpx_track(name: Column, line: Column) -> Column:
    """A track from an array of structs (lon, lat)."""
    pts = F.transform(line, lambda p: F.format_string('<trkpt lat="%s" lon="%s"/>', p["lat"].cast("string"), p["lon"].cast("string")))
    return F.concat(F.lit("<trk><name>"), xml(name), F.lit("</name><trkseg>"), F.array_join(pts, ""), F.lit("</trkseg></trk>"))


def kml_placemark(name: Column, colour: Column, lon: Column, lat: Column) -> Column:
    return F.format_string("<Placemark><name>%s</name><Style><IconStyle><color>%s</color></IconStyle></Style><Point><coordinates>%s,%s</coordinates></Point></Placemark>", xml(name), kml_colour(colour), lon.cast("string"), lat.cast("string"))


def geojson_feature(geometry: str, coords: Column, properties: Column) -> Column:
    """A feature with coordinates rounded to five places."""
    pairs = F.transform(coords, lambda p: F.format_string("[%s,%s]", F.round(p["lon"], 5).cast("string"), F.round(p["lat"], 5).cast("string")))
    inner = F.array_join(pairs, ",")
    shape = {"Point": inner, "LineString": F.concat(F.lit("["), inner, F.lit("]")), "Polygon": F.concat(F.lit("[["), inner, F.lit("]]"))}[geometry]
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{geometry}","coordinates":'), shape, F.lit('},"properties":'), F.to_json(properties), F.lit("}"))


def contract(meta: Column, **parts: DataFrame) -> dict[str, DataFrame]:
    """One JSON row a part, so that documents of any size are written by parallel tasks: {name: DataFrame(json)}."""
    return {k: d.select(F.to_json(F.struct(*d.columns)).alias("json")) for k, d in parts.items()} | ({"meta": meta} if isinstance(meta, DataFrame) else {})


def methodology(weights: DataFrame) -> DataFrame:
    """(text): terms (name, weight) by weight, largest first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name")))
    return weights.agg(F.array_join(F.transform(rows, lambda x: F.format_string("%s %d%%", x["name"], F.round(-x["w"] * 100).cast("int"))), ", ").alias("text"))


# The lists of a document that are laid end to end when plans are folded into one.
LIST_KEYS = (
    "areas", "waypoints", "routes", "camps", "hunt_zones", "browse_zones", "refuge_zones", "funnel_zones", "feed_edge_zones", "burn_zones", "cut_zones", "wetland_zones", "beaver_ponds", "tenure_zones",
    "browse_cut_zones", "browse_burn_zones", "browse_stand_zones", "browse_lc_zones",
)


def merge_lists(items: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, site, win, pos, json) of all plans that worked: items (site, win, key, pos, json) of LIST_KEYS, each tagged with its plan. pos counts on over the plans of a key.

    Offsets come from one row a plan and key, so no list is ever in one task.
    """
    mine = items.where(F.col("key").isin(*LIST_KEYS)).join(plans.where("ok").select("site", "win"), ["site", "win"])
    sizes = mine.groupBy("key", "site", "win").agg((F.max("pos") + 1).alias("_n"))
    before = Window.partitionBy("key").orderBy("site", "win").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return mine.join(sizes, ["key", "site", "win"]).select("key", "site", "win", (F.col("pos") + F.col("_off")).alias("pos"), "json")


def scaffolding(plans: DataFrame) -> DataFrame:
    """(site, win) of the first plan that worked: it gives what is not a list, since verdicts of several places cannot be merged."""
    return plans.where("ok").orderBy("site", "win").limit(1).select("site", "win")


def brief(areas: DataFrame, sites: DataFrame) -> DataFrame:
    """(area, lines): Markdown of areas (area, km2, score, band, reasons) with their sites (area, legend) by kind."""
    kinds = sites.groupBy("area", "legend").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("area").agg(F.array_sort(F.collect_list(F.format_string("- %s: %d", "legend", "n"))).alias("k"))
    head = F.format_string("## Area %d: %.1f km2, score %.2f (%s)", "area", "km2", "score", "band")
    rest = F.transform(F.filter("reasons", lambda x: x.isNotNull()), lambda x: F.concat(F.lit("- "), x))
    return areas.join(kinds, "area", "left").select("area", F.array_join(F.concat(F.array(head), rest, F.coalesce("k", F.array().cast("array<string>"))), "\n").alias("lines"))
