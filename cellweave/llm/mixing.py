"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source with target t and size s takes each of its documents t/s times: floor(t/s) copies for certain and one more with the
fractional probability. The fractions of a source are rounded by the pivotal method: two fractional documents meet, mass moves
at random from one to the other until one is integral, and the other carries the rest on. Documents meet within small blocks of
similar size first (a fold over a sorted array), each block leaves one residual, and residuals meet in a reduction tree of fan-in
FAN until one a source is left. So counts are exact to one document, the words taken stay near the target because mass moves
between documents of like size, and no task sees more than a bounded block. Random numbers are hashes of the documents that
meet and the seed, so that reruns agree for any partitioning.

Defined results: null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order; a source of
size 0 has target 0; texts of any length count whole, and one that exceeds its source's target is taken or not as the dice fall;
repeated rows are documents of their own; a table without rows gives none; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEAF = 256
FAN = 64
_ITEM = "struct<bin:int,size:bigint,h:bigint,doc_id:bigint,row:bigint,p:double>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): targets follow the weights and stop at most * source_size, the excess going to the others by weight.

    The level that all unsaturated sources share is found in one pass: in the order of cap / weight, a source is saturated as
    long as its cap lies below the level that is left when all before it are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("w")).withColumn("n", F.row_number().over(fill))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("n"))).over(everything)
    return per.withColumn("l", level).select("source", "source_size", F.when(F.col("l").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("l") * F.col("w"))).alias("target"))


def _fold(seed: int) -> str:
    """SQL of the pivotal fold over the sorted array `items`: struct(done, cur)."""
    a, b, s = "acc.cur.p", "x.p", "(acc.cur.p + x.p)"
    u = f"(pmod(xxhash64(acc.cur.h, x.h, {seed}L), 9007199254740992L) / 9007199254740992D)"
    cur_stays = f"(CASE WHEN {s} < 1D THEN {u} * {s} < {a} ELSE {u} * (2D - {s}) < (1D - {a}) END)"

    def item(of: str, p: str) -> str:
        return f"named_struct('bin', {of}.bin, 'size', {of}.size, 'h', {of}.h, 'doc_id', {of}.doc_id, 'row', {of}.row, 'p', {p})"

    integral, rest = f"(CASE WHEN {s} < 1D THEN 0D ELSE 1D END)", f"(CASE WHEN {s} < 1D THEN {s} ELSE {s} - 1D END)"
    lost = f"CASE WHEN {cur_stays} THEN {item('x', integral)} ELSE {item('acc.cur', integral)} END"
    stays = f"CASE WHEN {cur_stays} THEN {item('acc.cur', rest)} ELSE {item('x', rest)} END"
    state = f"struct<done:array<{_ITEM}>,cur:{_ITEM}>"
    return f"""aggregate(items, CAST(named_struct('done', array(), 'cur', NULL) AS {state}),
      (acc, x) -> CAST(CASE WHEN acc.cur IS NULL THEN named_struct('done', acc.done, 'cur', x)
        ELSE named_struct('done', concat(acc.done, array({lost})), 'cur', {stays}) END AS {state}))"""


def pivotal_round(items: DataFrame, group: list[str], leaves: int, seed: int = 5) -> DataFrame:
    """items (group columns, bin, leaf, size, h, doc_id, row, p) with 0 < p < 1 to the same without leaf, p being 0.0 or 1.0.

    leaf is a number below leaves; h a long that is as good as random.
    """
    decided, level = [], 0
    keys = [*group, "bin", "leaf"]
    while True:
        item = F.struct("bin", "size", "h", "doc_id", "row", "p").cast(_ITEM)
        met = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("r", F.expr(_fold(seed * 1000 + level)))
        kept = [k for k in keys if k != "bin"]
        met = materialize(met.select(*kept, "r"), f"pivot{level}")
        decided.append(met.select(*group, F.explode("r.done").alias("i")).select(*group, "i.*"))
        items = met.select(*kept, "r.cur.*")
        level += 1
        if leaves > 1:
            leaves = -(-leaves // FAN)
            items = items.withColumn("leaf", F.expr(f"leaf DIV {FAN}"))
        elif "bin" in keys:
            keys = group
            items = items.drop("leaf")
        else:
            break
    u = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    last = items.select(*group, "bin", "size", "h", "doc_id", "row", (u < F.col("p")).cast("double").alias("p"))
    for d in decided:
        last = last.unionByName(d)
    return last


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken, copies) for docs (doc_id, row, source, text); row is any long that tells rows with equal doc_id apart."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row").cast("long").alias("row"), F.col("source").cast("string").alias("source"), size.alias("size")), "sized")
    targets = source_targets(sized, weights, share, most).select(F.col("source").alias("t_source"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized.source.eqNullSafe(targets.t_source)).drop("t_source").withColumn("base", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    leaves = max(1, -(-sized.count() // LEAF))
    h = F.xxhash64("doc_id", "row", F.lit(seed))
    items = joined.withColumn("h", h).withColumn("leaf", F.pmod("h", F.lit(leaves))).withColumn("bin", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    group = ["source", "source_size", "target", "base"]
    items = items.select(*group, "bin", "leaf", "size", "h", "doc_id", "row", "p")
    rounded = pivotal_round(items.where("p > 0"), group, leaves, seed).select(*group, "size", "doc_id", "row", "p")
    whole = items.where("p <= 0").select(*group, "size", "doc_id", "row", F.lit(0.0).alias("p"))
    copies = (F.col("base") + F.col("p")).cast("long")
    return rounded.unionByName(whole).select("doc_id", "row", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """The rows of docs (any columns, among them doc_id, source and text), each as often as the mix takes it."""
    keyed = docs.withColumn("cw__row", F.xxhash64("doc_id", "text"))
    taken = mix(keyed.select("doc_id", F.col("cw__row").alias("row"), "source", "text"), weights, share, most, seed)
    times = taken.groupBy(F.col("row").alias("cw__key")).agg(F.sort_array(F.collect_list("copies")).alias("cw__times"))  # more than one only for repeated rows
    joined = keyed.join(times, keyed.cw__row == times.cw__key)
    nth = F.row_number().over(Window.partitionBy("cw__row").orderBy(F.lit(0)))
    copies = joined.withColumn("cw__n", F.element_at("cw__times", nth.cast("int")))
    return copies.where("cw__n > 0").withColumn("cw__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cw__n")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.xxhash64("text"))
    return mix(docs.select("doc_id", "row", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")
