"""Results that are needed twice, kept where every machine can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durable(frame: DataFrame) -> DataFrame:
    """``frame`` by a checkpoint in the folder that spark.checkpoint.dir names: it outlives lost executors and takes no
    memory. Only where the setting is unset and the master is this machine alone, as in tests, a temporary folder is used."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return frame.checkpoint()


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with further columns (or columns in place of those they are named as), each worked out once a row. Filters on them are not pushed below: as explode's
    output they are not put in terms of what they are made of, each time they are named."""
    kept = [c for c in rows.columns if c not in made]
    both = rows.select(*kept, F.explode(F.array(F.struct(*(c.alias(name) for name, c in made.items())))).alias("__once"))
    return both.select(*kept, *(F.col("__once")[name].alias(name) for name in made))
