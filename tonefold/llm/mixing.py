"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are its source's
target over the source's size. Expected copies are summed up over the source's documents in
order, one random offset is added, and a document is taken once for each whole number that
the sum crosses. Documents run in order of size, so that long and short ones are taken alike
and the words taken stay near the target.

The running sum of one source, however large, never meets in one task: documents are ranked
inside small blocks (source, size band, salt), and the blocks' counts are summed up apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the sources in code point order, repeated; null is the last source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SALTS = 64
BANDS_PER_DOUBLING = 16


def source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def hashed(text: Column, bits: int) -> Column:
    """The first bits (a multiple of 4) of a text's MD5, as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """src, source_size, target: one row for each source of sizes(source, src, size).

    Targets are in proportion to weight, add up to `share` of all words and stop at `most`
    times the source's size, what is over going to the others by weight. With the sources in
    order of size over weight, the first one that its share leaves below its limit tells the
    level for all. The windows see one row a source.
    """
    by_source = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = rows.withColumns({"n": F.row_number().over(order), "over": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "total": share * F.sum("source_size").over(everything), "ws": F.sum("w").over(everything)})
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), F.col("total") - F.col("over")) / (F.col("ws") - F.col("gone")))
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("n"))
    level = F.min_by("level", open_).over(everything)
    return rows.select("src", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def with_copies(df: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """df with size, source_size, target and copies (0 to ceil(most)).

    Deterministic: rerunning, or another partitioning, gives the same copies. Within a source documents
    run by size band, salt, doc_id (nulls first), size and a hash of the whole row; rows that are equal
    in all of these are equal for the mix. Repeated rows are documents of their own. Sources without
    words get target 0 and no copies; an empty table gives no rows. Columns of df with these names are
    replaced, all others stay.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*names).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"))
    salt = hashed(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")), 16) % SALTS
    # No document's size lies on a band's edge, where rounding would decide.
    band = F.floor(F.log2(F.col("size") + 1.5) * BANDS_PER_DOUBLING)
    # Maps can't be hashed as they are.
    tie = F.xxhash64(F.to_json("row") if "map<" in rows.schema.simpleString() else F.col("row"))
    rows = rows.withColumns({"src": source_key("source"), "band": band, "salt": salt, "tie": tie})
    block = ["src", "band", "salt"]
    counts = rows.groupBy(*block).agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    running = W.partitionBy("src").orderBy("band", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("n").over(running), F.lit(0)).alias("start"))
    starts = starts.join(source_targets(counts, weights, share, most), "src")
    inside = F.row_number().over(W.partitionBy(*block).orderBy("doc_id", "size", "tie"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hashed(F.concat(F.lit(f"{seed}|"), F.col("src")), 20) / F.lit(float(1 << 20))
    rank = F.col("start") + F.col("rank")
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    out = rows.withColumn("rank", inside).join(starts, block)
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    return out.select(*kept, "size", "source_size", "target", F.least(crossed, F.ceil(rate)).cast("long").alias("copies"))


def mixed(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: df's rows and columns, each row as often as it is taken."""
    names = [F.col(f"`{c}`") for c in df.columns]
    kept = df.select(F.struct(*names).alias("whole"), *[F.col(f"`{options.get(k, k)}`").alias(k) for k in ("doc_id", "source")], size.alias("words"))
    taken = with_copies(kept, F.col("words"), **{k: v for k, v in options.items() if k not in ("doc_id", "source")}).filter("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
