"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many words a text has; none if it is NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """One unused column name per given stem, whatever columns the caller brought along."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


#: Digests of a doc_id are taken modulo this, to choose rows of a sample; large enough for any number of rows.
DIGESTS = 1 << 62
#: Rows that Spark hands to a Python task at a time, where documents are whole texts.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Bound the memory of Python tasks over whole texts; their workers wait beside the next stage's tasks for a while."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: Rows, and characters in them, of a table that may be sent to every task.
BROADCAST_ROWS, BROADCAST_CHARS = 20_000, 4_000_000


def small(df: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcasting if it is within BROADCAST_ROWS and BROADCAST_CHARS; else as it is."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_CHARS else df
