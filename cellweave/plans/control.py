"""Control tables of a service: products of sites and windows, admission, kept artefacts, revisions, notes by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most sites and windows of a request, and runs at a time (fixed values).
MOST_SITES, MOST_WINDOWS, MOST_RUNS = 4, 4, 2


#: Revisions of the engine that are shown with a plan at most.
MOST_REVISIONS = 10_000


def plan_grid(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """(request, site, win, plan): each of the first sites with each of the first windows of its request, numbered from 1. sites (request, site), windows (request, win)."""
    w = lambda by: Window.partitionBy("request").orderBy(by)
    s = sites.withColumn("_n", F.row_number().over(w("site"))).where(F.col("_n") <= MOST_SITES).drop("_n")
    t = windows.withColumn("_n", F.row_number().over(w("win"))).where(F.col("_n") <= MOST_WINDOWS).drop("_n")
    return s.join(t, "request").withColumn("plan", F.row_number().over(Window.partitionBy("request").orderBy("site", "win")))


def counts_by_key(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, counts): a map from each value of key to its rows, in order of the key; null keys are not counted."""
    n = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_n")))).alias("counts"))


def admitted(requests: DataFrame, running: DataFrame, most: int = MOST_RUNS) -> DataFrame:
    """requests (host, user, draining, ..) with answer and retry_s: 401 without a user, 503 while the host drains or has `most` runs (host, state), else 202."""
    busy = running.where("state = 'running'").groupBy("host").agg(F.count(F.lit(1)).alias("_busy"))
    full = F.coalesce("_busy", F.lit(0)) >= most
    code = F.when(F.col("user").isNull(), 401).when(F.coalesce("draining", F.lit(False)) | full, 503).otherwise(202)
    wait = F.when(F.col("user").isNull(), F.lit(None)).when(F.coalesce("draining", F.lit(False)), 120).when(full, 180)
    return requests.join(busy, "host", "left").withColumns({"answer": code, "retry_s": wait.cast("int")}).drop("_busy")


def kept_plans(artefacts: DataFrame, budget: float) -> DataFrame:
    """(store, plan, bytes, kept) of artefacts (store, plan, name, bytes, used): whole plans go, the least recently used first, until a store fits its budget."""
    plans = artefacts.groupBy("store", "plan").agg(F.sum("bytes").alias("bytes"), F.max("used").alias("_used"))
    newer = Window.partitionBy("store").orderBy(F.desc("_used"), F.desc("plan")).rowsBetween(Window.unboundedPreceding, 0)
    return plans.withColumn("kept", F.sum("bytes").over(newer) <= budget).drop("_used")


def artefact_state(asked: DataFrame, artefacts: DataFrame, budget: float) -> DataFrame:
    """asked (store, plan, name) with state: present, evicted (it was there and made room) or absent (there never was one)."""
    kept = kept_plans(artefacts, budget)
    had = artefacts.select("store", "plan", "name").distinct().join(kept.select("store", "plan", "kept"), ["store", "plan"])
    state = F.when(F.col("kept"), "present").when(F.col("kept").isNotNull(), "evicted").otherwise("absent")
    return asked.join(had, ["store", "plan", "name"], "left").withColumn("state", state).drop("kept")


def changes_since(plans: DataFrame, revisions: DataFrame) -> DataFrame:
    """plans (.., rev) with notes: those of all later revisions (rev, note), newest first; empty where the plan's revision is unknown. Up to MOST_REVISIONS revisions, of which only those that the oldest plan has not seen travel."""
    oldest = plans.agg(F.min("rev")).head()[0]
    revisions = revisions.where(F.col("rev") > F.lit(oldest)) if oldest is not None else revisions.where("false")
    if revisions.count() > MOST_REVISIONS:
        raise ValueError(f"more than {MOST_REVISIONS} revisions after that of the oldest plan")
    all_notes = revisions.agg(F.sort_array(F.collect_list(F.struct(F.col("rev").alias("r"), "note")), asc=False).alias("_all"))
    notes = F.transform(F.filter("_all", lambda x: x["r"] > F.col("rev")), lambda x: x["note"])
    return plans.crossJoin(F.broadcast(all_notes)).withColumn("notes", F.coalesce(notes, F.array().cast("array<string>"))).drop("_all")  # one row


def noted(zones: DataFrame, notes: DataFrame, key: Column | str) -> DataFrame:
    """zones with the note (.., joins, score) of the same key, not of the same place in a list: the one with the best score, ties to the smaller text."""
    best = notes.groupBy(key).agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("k"), "joins", "score")).alias("_b"))
    return zones.join(best, key, "left").select("*", F.col("_b.joins").alias("joins"), F.col("_b.score").alias("destination")).drop("_b")
