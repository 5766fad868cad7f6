"""Exact deduplication by distributed radix partitioning from the first byte on.

Texts are split by their length, then by successive runs of bytes, each run longer than the one before. A group that
has one text left is done, as is one whose bytes have ended: its texts are equal byte by byte, no digest decides. Only
texts that still share a group take part in the next round, and each round is one aggregation (counts per group and
run, combined before the shuffle) and one join back, so a group of copies never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

FIRST_RUN, GROWTH = 32, 4


def normalised(column: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the kept columns, all by default), keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays, null ids last; of rows equal in id as well exactly one stays,
    no matter which. An empty table gives no rows. Columns of the input live inside ``row`` and cannot
    clash with those of the result.
    """
    columns = df.columns if keep is None else keep
    in_row = text_col in columns
    base = df.select(
        F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(id_col).alias("id"),
        (F.lit(None).cast("string") if in_row else F.col(text_col)).alias("apart"), F.col(text_col).alias("_text"),
    )
    body = normalised(F.col("_text")).cast("binary")
    keyed = base.withColumn("_body", body).select(
        "row", "id", "apart", F.octet_length("_body").alias("size"), F.substring("_body", 1, FIRST_RUN).alias("run")
    )
    keys = cut_lineage(
        keyed.groupBy("size", "run").agg(F.count("*").alias("n")).where("n > 1")
        .select("size", "run", F.monotonically_increasing_id().alias("grp"))
    )
    text = F.col("row")[text_col] if in_row else F.col("apart")
    # Merge joins throughout: neither side has a bound, and hot groups can be split.
    joined = keyed.join(keys.hint("merge"), ["size", "run"], "left").withColumn("_body", normalised(text).cast("binary"))
    state = cut_lineage(joined.select(
        "row", "id", "size", "grp", F.sha2("_body", 256).alias("sha"), F.monotonically_increasing_id().alias("rid"),
        F.when(F.col("grp").isNotNull(), F.col("_body").substr(F.lit(FIRST_RUN + 1), F.col("size"))).alias("rest"),
    ))

    alone = state.where("grp is null").select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    done, active, at, width = [alone], state.where("grp is not null"), FIRST_RUN, FIRST_RUN * GROWTH
    while True:
        cut = active.withColumn("run", F.substring("rest", 1, width))
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
        counted = cut.groupBy("grp", "run").agg(F.count("*").alias("n"), first.alias("first"), F.max("size").alias("longest"))
        split = cut_lineage(counted.select(
            F.col("grp"), "run", "n", "first", ((F.col("n") == 1) | (F.col("longest") <= at + width)).alias("ended"),
            F.monotonically_increasing_id().alias("next"),
        ))
        more = not split.where("not ended").isEmpty()
        stepped = cut.join(split.hint("merge"), ["grp", "run"]).select(
            "row", "id", "size", "sha", "rid", F.col("rest").substr(F.lit(width + 1), F.col("size")).alias("rest"),
            F.col("next").alias("grp"), "n", "first", "ended",
        )
        if more:
            stepped = cut_lineage(stepped)
        done.append(stepped.where("ended").select(
            "row", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("rid") == F.col("first.rid")).alias("kept"), "sha"))
        if not more:
            break
        active, at, width = stepped.where("not ended").drop("n", "first", "ended"), at + width, width * GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("sha", "text_sha256")


def kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, columns as they came."""
    return groups(df, id_col, text_col).where("kept").select("row.*")
