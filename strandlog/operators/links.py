"""Links: events of type $> that point at another event by its global position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resolve_links(page: DataFrame, log: DataFrame) -> DataFrame:
    """Replace each link by the event it points at, the link itself in the struct column ``link``.

    The original's columns win, further columns of the page's rows (such as runner_id) stay, a dangling link is returned as it is,
    and only one level is resolved. The originals are fetched by a semi-join with the page's pointers, so that of the
    log no more than these rows is moved when the page is small. A row that is no link takes part in the join under its own
    position, which matches nothing: under a null, all of these rows would be sorted by one task.
    """
    own = page.columns
    pointer = F.col("link_global_position")
    pointers = page.where(pointer.isNotNull()).select(pointer.alias("global_position")).distinct()
    originals = log.join(pointers, "global_position", "left_semi")
    shared = [c for c in own if c in originals.columns]
    other = originals.select(F.col("global_position").alias("_at"), F.struct(*shared).alias("_original"))
    joined = page.join(other, (F.coalesce(pointer, F.col("global_position")) == F.col("_at")) & pointer.isNotNull(), "left")
    found = F.col("_original").isNotNull()
    columns = [F.when(found, F.col("_original")[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in own]
    return joined.select(*columns, F.when(found, F.struct(*own)).alias("link"))


def cursor_position(df: DataFrame) -> DataFrame:
    """``df`` with the column cursor: the link's position if the row is a resolved link, else its own."""
    own = F.col("global_position")
    return df.withColumn("cursor", F.coalesce(F.col("link.global_position"), own) if "link" in df.columns else own)
