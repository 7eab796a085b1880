"""Sessions, locks, discoveries, features and context as folds over event logs: (ts, key columns, action, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """The last non-null value of each column by (ts, seq), and when the key was last active."""
    order = F.struct("ts", "seq")
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns], F.min("ts").alias("started_at"), F.max("ts").alias("last_active"))


def session_status(events: DataFrame, ids: DataFrame, id_column: str = "session") -> DataFrame:
    """Each of these ids, with its state if it ever started."""
    state = latest(events, id_column, "task")
    return ids.join(state, id_column, "left").withColumn("active", F.col("last_active").isNotNull())


def locks(events: DataFrame) -> DataFrame:
    """(file, session, locked_at): who holds what, by events (ts, seq, session, file, action lock or unlock).

    The first locker wins, locking again changes nothing, others are refused, and only the owner unlocks: a fold in event
    order for each file.
    """
    step = F.struct("ts", "seq", "session", "action")
    log = events.where(F.col("action").isin("lock", "unlock")).groupBy("file").agg(F.sort_array(F.collect_list(step)).alias("log"))
    free = F.struct(F.lit(None).cast("string").alias("session"), F.lit(None).cast(events.schema["ts"].dataType).alias("ts"))

    def fold(acc: Column, e: Column) -> Column:
        taken = F.struct(e["session"].cast("string").alias("session"), e["ts"].alias("ts"))
        return F.when(acc["session"].isNull() & (e["action"] == "lock"), taken).when((acc["session"] == e["session"].cast("string")) & (e["action"] == "unlock"), free).otherwise(acc)

    held = log.select("file", F.aggregate("log", free, fold).alias("h"))
    return held.where("h.session is not null").select("file", F.col("h.session").alias("session"), F.col("h.ts").alias("locked_at"))


def discoveries(events: DataFrame, session: str, since: object | None = None, top: int | None = None) -> DataFrame:
    """What other sessions found (action discovery), the newest ``top`` of it."""
    rows = events.where((F.col("action") == "discovery") & (F.col("session").cast("string") != session))
    rows = rows if since is None else rows.where(F.col("ts") >= F.lit(since))
    return rows if top is None else rows.orderBy(F.desc("ts"), F.desc("seq")).limit(top)


def sync(lock_table: DataFrame, events: DataFrame, session: str, top: int = 10) -> DataFrame:
    """Others' locks and last discoveries as rows (kind, session, what, ts)."""
    held = lock_table.where(F.col("session") != session).select(F.lit("lock").alias("kind"), "session", F.col("file").alias("what"), F.col("locked_at").alias("ts"))
    news = discoveries(events, session, top=top).select(F.lit("discovery").alias("kind"), F.col("session").cast("string").alias("session"), F.col("content").alias("what"), "ts")
    return held.unionByName(news)


def context(events: DataFrame, key: str, scalars: tuple[str, ...], lists: tuple[str, ...] = (), as_of: object | None = None) -> DataFrame:
    """State by shallow merge: the last non-null scalar, and lists in event order; ``as_of`` gives a checkpoint's state."""
    rows = events if as_of is None else events.where(F.col("ts") <= F.lit(as_of))
    order = F.struct("ts", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in scalars]
    grown = [F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ts", "seq", F.col(c).alias("x"))))), lambda s: s["x"]).alias(c) for c in lists]
    return rows.groupBy(key).agg(*last, *grown, F.max("ts").alias("last_updated"))


def checkpoints(events: DataFrame, key: str) -> DataFrame:
    """(key, checkpoint, ts), newest first; what is only a sync isn't one."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return events.where(F.col("action") == "checkpoint").withColumn("nth", F.row_number().over(w).cast("long")).select(key, "nth", "ts")


def features(events: DataFrame) -> DataFrame:
    """(name, started_at, status, decisions) from events (ts, seq, name, action start, decide or complete, text)."""
    order = F.struct("ts", "seq")
    status = F.max_by("action", F.when(F.col("action").isin("start", "complete"), order))
    noted = F.sort_array(F.collect_list(F.when(F.col("action") == "decide", F.struct("ts", "seq", "text"))))
    rows = events.groupBy("name").agg(F.min(F.when(F.col("action") == "start", F.col("ts"))).alias("started_at"), F.when(status == "complete", "completed").otherwise("active").alias("status"), F.transform(noted, lambda d: d["text"]).alias("decisions"), F.max(F.when(F.col("action") == "complete", F.col("ts"))).alias("done_at"))
    return rows.where("started_at is not null").withColumn("archive", F.when(F.col("status") == "completed", F.concat_ws("_", F.date_format("done_at", "yyyy-MM-dd"), "name"))).drop("done_at")


def new_features(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the names wanted, those that no feature has; repeated names once."""
    return wanted.select("name").distinct().join(state.select("name"), "name", "left_anti")


def active_feature(state: DataFrame) -> DataFrame:
    return state.where("status = 'active'").orderBy("name").limit(1)
