"""Mixing sources to target weights by systematic sampling (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import hash32, word_count

_SALTS = 16


def _bin(size: Column) -> Column:
    """A coarse size class that rises with the size; about a thousand values at most."""
    return (
        F.when(size < 1024, F.floor(size / 16))
        .when(size < 16384, 64 + F.floor(size / 256))
        .otherwise(128 + F.least(F.floor(size / 4096), F.lit(896)))
        .cast("long")
    )


def source_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """Target of each source from its size: one row per (source, source_size) comes in.

    Sources in code-point order (null last) take the weights in turn. The
    total is ``share`` of all sizes, dealt by weight; no target passes
    ``max_repeat`` times its source's size, and what is above is dealt again
    among the others. With sources ordered by cap / weight the capped ones are
    a prefix, so running sums replace the rounds. The windows without a key
    see one row per source, never documents.
    """
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int"))
    every, rising = W.partitionBy(), W.orderBy("ratio", F.col("source").asc_nulls_last())
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("cap_before", F.sum("cap").over(rising) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(every) - (F.sum("weight").over(rising) - F.col("weight")))
        .withColumn("capped", F.col("ratio") <= (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every))
        .withColumn("free_weight", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - F.col("cap_sum")) / F.col("free_weight") * F.col("weight")),
        )
        .select("source", "source_size", "target")
    )


def mix_sources(
    df: DataFrame,
    *,
    size: Column | None = None,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights=(3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Add ``size, source_size, target, copies, taken`` to every row.

    Each row of a source expects ``target / source_size`` copies. Rows of a
    source stand in one fixed order (size class, hash, size, id); with u the
    source's random offset and k a row's place, it is emitted once for each
    integer between u + rate*(k-1) and u + rate*k. As sizes rise along the
    order, the words taken stay near the target.

    A source may hold any share of the rows: places are counted within small
    cells (source, size class, hash) and the cells' counts are summed, so that
    no task sees a whole source.

    Null text counts as size 0; a null source is a source of its own; repeated
    rows are places of their own; an empty table gives an empty table. Input
    columns with the names of the added ones are replaced, all others stay.
    """
    size = word_count(F.col(text_col)) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        size.alias("size"),
    )
    rows = rows.withColumn("bin", _bin(F.col("size"))).withColumn(
        "salt", F.coalesce(hash32(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))) % _SALTS, F.lit(0).cast("long"))
    )
    cells = rows.groupBy("source", "bin", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeat)
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("source").orderBy("bin", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    cells = cells.withColumn("before", before).drop("n", "words").withColumnsRenamed({c: f"c_{c}" for c in ("source", "bin", "salt")})
    targets = targets.withColumnRenamed("source", "t_source")
    cells = cells.join(targets, F.col("c_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    placed = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "bin", "salt").orderBy("size", "id"))).join(
        cells,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("c_bin")) & (F.col("salt") == F.col("c_salt")),
    )
    offset = hash32(F.concat(F.lit(f"{seed}:source:"), F.coalesce(F.col("source").cast("string"), F.lit("")))) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("rank")
    copies = (F.floor(offset + rate * place) - F.floor(offset + rate * (place - 1))).cast("long")
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("size")}
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns if c not in added], *[v.alias(k) for k, v in added.items()]
    )


def mixed_documents(df: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row as often as ``mix_sources`` takes it, with exactly the columns of ``df``."""
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col(text_col).alias("_text"), F.col(source_col).alias("_source"), F.col(id_col).alias("_id"),
    )
    mixed = mix_sources(packed, text_col="_text", source_col="_source", id_col="_id", **options)
    again = mixed.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_again"))
    return again.select("_row.*")
