"""Streaming forms (ST1 to ST4, U7): the batch operators over streams, with watermarks where there is state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.patterns import with_detections
from ..operators.vault import escape


def sanitize_stream(units: DataFrame, secret: str, text: str = "text", least: float = 0.8) -> DataFrame:
    """ST1: stateless; a value becomes ``<PII_KIND_hash>`` by a keyed hash, so equal values are one token everywhere."""
    found = with_detections(units, text, least)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, d):
        value = F.substring(F.col(text), d["start"] + 1, d["end"] - d["start"])
        token = F.concat(F.lit("<PII_"), d["kind"], F.lit("_"), F.substring(F.sha2(F.concat(F.lit(secret), value), 256), 1, 16), F.lit(">"))
        return F.struct(F.concat(s["out"], escape(F.substring(F.col(text), s["at"] + 1, d["start"] - s["at"])), token).alias("out"), d["end"].alias("at"))

    done = F.aggregate("detections", begin, step, lambda s: F.concat(s["out"], escape(F.substring(F.col(text), s["at"] + 1, F.length(text)))))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), done)).drop("detections")


class SessionVault(StatefulProcessor):
    """A session's tokens by value and its last number by kind, as maps in the state store: a batch reads and writes the entries of its own values
    only. A timer, put off by each batch, clears a session that has been quiet for ``quiet_ms``; what it had is then minted anew."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "value string", "token string")
        self.numbers = handle.getMapState("numbers", "kind string", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, pending = timerValues.getCurrentProcessingTimeInMs(), list(self.handle.listTimers())
        if pending and max(pending) <= now:  # rows come before the timers that have run out
            self.tokens.clear()
            self.numbers.clear()
        # The rows of a session in one trigger; the order of minting doesn't depend on how Arrow cuts them.
        own = pd.concat(list(rows)).sort_values(["unit_seq", "start"], ascending=[True, False], kind="stable")
        out = []
        for kind, value in own[["kind", "value"]].drop_duplicates("value").itertuples(index=False):
            if self.tokens.containsKey((value,)):
                continue
            n = (self.numbers.getValue((kind,))[0] if self.numbers.containsKey((kind,)) else 0) + 1
            self.numbers.updateValue((kind,), (n,))
            token = f"<PII_{kind}_{n}>"
            self.tokens.updateValue((value,), (token,))
            out.append((key[0], kind, n, token, value))
        for at in pending:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.quiet_ms)
        yield pd.DataFrame(out, columns=["session_id", "kind", "n", "token", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tokens.clear()
        self.numbers.clear()
        yield pd.DataFrame([], columns=["session_id", "kind", "n", "token", "value"])

    def close(self) -> None:
        pass


class ThreadFold(StatefulProcessor):
    """A thread's head as one value: first and last time, the last turn's reason and question, turns and withheld values so far. Turns themselves are
    passed on, not held, so that the state doesn't grow with a thread. It goes ``quiet_ms`` after a thread's last turn came."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "created_at long, updated_at long, reason string, question string, n long, withheld long", self.quiet_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("at", kind="stable")
        first, last, reason, question, n, withheld = self.head.get() if self.head.exists() else (None, None, None, None, 0, 0)
        new = own.iloc[-1]
        if last is None or new["at"] >= last:  # a turn that comes late doesn't change how the thread stands
            last, reason, question = int(new["at"]), new["reason"], new["question"]
        first = int(own["at"].iloc[0]) if first is None else min(first, int(own["at"].iloc[0]))
        n, withheld = n + len(own), withheld + int(own["withheld"].fillna(0).sum())
        self.head.update((first, last, reason, question, n, withheld))
        pending = question if reason in ("ask-user", "needs-user-input") else None
        turns = [{"at": int(t), "summary": s, "withheld": None if pd.isna(w) else int(w)} for t, s, w in own[["at", "summary", "withheld"]].itertuples(index=False)]
        yield pd.DataFrame([(key[0], turns, "done" if reason in ("done", "answered") else "open", pending, first, last, n, withheld)], columns=["thread_id", "new_turns", "status", "pending", "created_at", "updated_at", "n_turns", "withheld"])

    def close(self) -> None:
        pass


def fold_stream(turns: DataFrame, quiet: int = 30 * 24 * 3600) -> DataFrame:
    """U7 over a stream of turns (thread_id, at (long), summary, withheld, reason, question): for each thread and trigger its new turns in order and how it
    stands after them. The last such row, and the new turns of all, are what ``runs.fold_threads`` gives. A null ``at`` is an error: no place in a thread."""
    who = turns.schema["thread_id"].dataType.simpleString()
    told = f"thread_id {who}, new_turns array<struct<at:bigint,summary:string,withheld:bigint>>, status string, pending string, created_at long, updated_at long, n_turns long, withheld long"
    return turns.groupBy("thread_id").transformWithStateInPandas(ThreadFold(quiet * 1000), told, "Update", "ProcessingTime")


#: The state store that map state and timers need; to be set as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def vault_stream(found: DataFrame, quiet: int = 24 * 3600) -> DataFrame:
    """ST2: the vault of a stream of occurrences (session_id, unit_seq, start, kind, value): each value of a session once, when it is first seen. An ordered
    replay gives the batch vault. A session's state goes ``quiet`` seconds after its last row. A row that comes late is minted when it comes."""
    who = found.schema["session_id"].dataType.simpleString()
    told = f"session_id {who}, kind string, n int, token string, value string"
    return found.groupBy("session_id").transformWithStateInPandas(SessionVault(quiet * 1000), told, "Append", "ProcessingTime")


def withheld_by_window(found: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST3: occurrences (ts, origin, kind) by origin, kind and ten minutes; rows later than ``late`` are left out of closed windows."""
    return found.withWatermark("ts", late).groupBy(F.window("ts", "10 minutes"), "origin", "kind").agg(F.count(F.lit(1)).alias("withheld")).select("window.start", "origin", "kind", "withheld")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST4: by user the sessions of events less than ``gap`` apart: start, end, events and their kinds."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type").isNotNull()).alias("typed")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "typed")
