"""Run and thread logs (U1 to U11): windows over a run's turns, aggregates over models and origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import origin

# Turns of a run, threads kept, characters of a title.
MOST_TURNS, MOST_THREADS, TITLE = 5, 50, 48


def origin_guard(turns: DataFrame) -> DataFrame:
    """``pinned``, the run's first origin, and ``left``: whether a turn is on another one."""
    pinned = F.first("origin", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("turn"))
    return turns.withColumn("pinned", pinned).withColumn("left", ~F.col("origin").eqNullSafe(pinned))


def stop_reasons(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """By run the turn that ended it and why, from the turns' flags opaque, left, failed, answered, asked, finished, remedy and the
    counts of allowed and denied actions."""
    by_turn = Window.partitionBy("run_id").orderBy("turn")
    refused = (F.col("allowed") == 0) & (F.col("denied") > 0)
    twice = refused & F.coalesce(F.lag(refused, 1).over(by_turn), F.lit(False))
    last = F.col("turn") >= most - 1
    why = F.when(F.col("opaque"), "opaque-document").when(F.col("left"), "navigated-away").when(F.col("failed"), "server-error").when(F.col("answered"), "answered").when(F.col("asked"), "ask-user")
    why = why.when(F.col("finished"), "done").when(refused & F.col("remedy"), "needs-user-input").when(twice | (refused & last), "nothing-executable")
    ended = turns.withColumn("__why", why).groupBy("run_id").agg(F.min(F.when(F.col("__why").isNotNull(), F.struct("turn", F.col("__why").alias("why")))).alias("e"), F.max("turn").alias("__last"))
    return ended.select("run_id", F.coalesce("e.turn", "__last").alias("turn"), F.coalesce("e.why", F.lit("max-turns")).alias("reason"))


def history(actions: DataFrame) -> DataFrame:
    """Allowed actions, and denied ones as REFUSED with their reason."""
    line = F.when(F.col("allowed"), F.col("reasoning")).otherwise(F.concat(F.lit("REFUSED ("), F.coalesce("reason", F.lit("")), F.lit(") "), F.coalesce("reasoning", F.lit(""))))
    return actions.select("run_id", "turn", "idx", line.alias("line"))


def stage_breakdown(turns: DataFrame, stages: list[str]) -> DataFrame:
    """U4: time by stage and its share of all stages."""
    long = turns.select("run_id", F.explode(F.create_map(*(x for s in stages for x in (F.lit(s), F.col(s).cast("double"))))).alias("stage", "ms"))
    sums = long.groupBy("stage").agg(F.sum("ms").alias("ms"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("ms").alias("__all")))).select("stage", "ms", F.try_divide("ms", "__all").alias("share"))  # a row a stage, and one


def model_tradeoff(runs: DataFrame) -> DataFrame:
    """U5."""
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("verified").cast("double")).alias("verified"), *(F.median(c).alias(c) for c in ("turns", "task_ms", "network_ms", "heap_mb")))


def thread_by_origin(threads: DataFrame) -> DataFrame:
    """The newest thread of each origin."""
    newest = threads.where("origin is not null").groupBy("origin").agg(F.max_by(F.struct(*(c for c in threads.columns if c != "origin")), "updated_at").alias("t"))
    return newest.select("origin", "t.*")


def fold_threads(turns: DataFrame) -> DataFrame:
    """By thread its turns in order, its last status (done or open) and open question, first and last time."""
    done = F.max_by(F.col("reason").isin("done", "answered"), "at")
    pending = F.max_by(F.when(F.col("reason").isin("ask-user", "needs-user-input"), F.col("question")), "at")
    return turns.groupBy("thread_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "summary", "withheld"))).alias("turns"), F.when(done, "done").otherwise("open").alias("status"), pending.alias("pending"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.sum("withheld").alias("withheld"),
    )


def newest_threads(threads: DataFrame, most: int = MOST_THREADS) -> DataFrame:
    """U8: the ``most`` threads updated last: a report of bounded size by its purpose."""
    return threads.orderBy(F.desc("updated_at"), "thread_id").limit(most)


def web_origin(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), F.nullif(origin(url), F.lit("about:blank")))


def thread_verdicts(visits: DataFrame, threads: DataFrame) -> DataFrame:
    """Internal, continue, resume or new, of visits (url, active_origin) against the threads' origins."""
    known = threads.select(F.col("origin").alias("__known")).distinct()
    own = web_origin(F.col("url"))
    joined = visits.withColumn("origin", own).join(known, F.col("origin") == F.col("__known"), "left")
    verdict = F.when(F.col("origin").isNull(), "internal").when(F.col("active_origin") == F.col("origin"), "continue").when(F.col("__known").isNotNull(), "resume").otherwise("new")
    return joined.withColumn("verdict", verdict).drop("__known")


def title(goal: Column) -> Column:
    """White space as single blanks, at most 48 characters, the last an ellipsis where more were."""
    t = F.regexp_replace(F.trim(F.regexp_replace(goal, r"\s+", " ")), "^ | $", "")
    return F.when(F.length(t) <= TITLE, t).otherwise(F.concat(F.left(t, F.lit(TITLE - 1)), F.lit("…")))


def question_labels(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The label that an asked node has in the first turn of its run that shows it."""
    found = nodes.where("label is not null").groupBy("run_id", "node_id").agg(F.min_by("label", "turn").alias("label"))
    return asked.join(found, ["run_id", "node_id"], "left")
