"""Streaming alert detection.

Signals arrive on a stream; the enabled rules (a handful of rows) are applied
as a literal array expression - no join, no shuffle - and ``transformWithState``
keeps, per tenant, what the greedy policy needs: the last sent time of every
``(alert_type, metric)`` key (map state) and the send times inside the rate-limit
window (list state).

Decisions are made in event-time order within a micro-batch.  A late signal -
older than the newest one decided for its tenant - is decided as if it came at
that newest time: its notification would go out now, so cooldown and limit count
from now.  Signals later than the watermark's delay are dropped by Spark, which
counts them in its progress.  Where signals come in time order, any cut into
micro-batches gives the decisions of
:func:`vigilo.operators.alerts.apply_alert_policy`.

An event-time timer stands at the tenant's newest signal plus the longest of
cooldowns and window.  When the watermark passes it no signal to come can be
touched by what is kept, and the tenant's state is deleted, so state is bounded
by the tenants and keys of one such horizon, not by the stream.
``transformWithState`` needs the RocksDB state store, which is set on the session.
"""

from __future__ import annotations

import json
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilo.operators.alerts import MINUTE, evaluate_rules_inline
from vigilo.presets import clinical as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(t: datetime) -> int:
    d = t.astimezone(timezone.utc) - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


class AlertPolicy(StatefulProcessor):
    """Cooldown and rate limit of one tenant."""

    def __init__(self, key_cols: Sequence[str], ts: str, order: Sequence[str], most: int, window: int, horizon: int,
                 columns: Sequence[str]):
        self.key_cols, self.ts, self.order = list(key_cols), ts, list(order)
        self.most, self.window, self.horizon, self.columns = most, window, horizon, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last_sent", "alert string", "at long")
        self.recent = handle.getListState("recent", "at long")
        self.clock = handle.getValueState("clock", "newest long, expires long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r[self.ts], *((r[c] is not None, r[c]) for c in self.order)))
        newest, expires = self.clock.get() if self.clock.exists() else (None, None)
        recent = deque(r[0] for r in self.recent.get()) if self.recent.exists() else deque()
        decided = Row(*self.columns, "emitted", "suppressed_by")
        last: dict[str, int | None] = {}
        changed: set[str] = set()
        for r in rows:
            t = _micros(r[self.ts])
            newest = t = t if newest is None else max(t, newest)
            name = json.dumps([r[c] for c in self.key_cols])
            if name not in last:
                found = self.last.getValue((name,)) if self.last.exists() and self.last.containsKey((name,)) else None
                last[name] = None if found is None else found[0]
            while recent and recent[0] <= t - self.window:
                recent.popleft()
            if last[name] is not None and last[name] > t - r["cooldown_minutes"] * MINUTE:
                reason = "cooldown"
            elif len(recent) >= self.most:
                reason = "rate_limit"
            else:
                reason = None
                last[name] = t
                changed.add(name)
                recent.append(t)
            yield decided(*(r[c] for c in self.columns), reason is None, reason)
        if newest is None:
            return
        for name in changed:
            self.last.updateValue((name,), (last[name],))
        if recent:
            self.recent.put([(t,) for t in recent])
        else:
            self.recent.clear()
        due = (newest + self.horizon) // 1000 + 1
        if due != expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(due)
        self.clock.update((newest, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.clock.exists() and self.clock.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.recent.clear()
            self.clock.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(signals: DataFrame, rules: DataFrame, key_cols: Sequence[str] = ("alert_type", "metric"), ts: str = "ts",
                 order: Sequence[str] = (), tenant_cols: Sequence[str] = (), max_alerts: int = C.MAX_ALERTS_PER_HOUR,
                 window_minutes: int = 60, watermark: str = "1 hour", candidates: bool = False) -> DataFrame:
    """Alert decisions for a stream of signals (or of ready candidates with
    ``candidates=True``); without tenant columns all alerts share one limit and
    hence one state."""
    if not signals.isStreaming:
        raise ValueError("signals must be a stream; use apply_alert_policy on tables")
    signals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Spark starts the processor in a Python process on the driver too, which has no files sent to executors.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cand = signals if candidates else evaluate_rules_inline(signals, rules)
    src = (cand if tenant_cols else cand.withColumn("_tenant", F.lit(0))).withWatermark(ts, watermark)
    groups = list(tenant_cols) or ["_tenant"]
    schema = T.StructType([*src.schema.fields, T.StructField("emitted", T.BooleanType()), T.StructField("suppressed_by", T.StringType())])
    longest = rules.agg(F.max("cooldown_minutes")).first()[0] or 0
    window = window_minutes * MINUTE
    policy = AlertPolicy(key_cols, ts, order, max_alerts, window, max(int(longest) * MINUTE, window), src.columns)
    out = src.groupBy(*groups).transformWithState(policy, schema, "Append", "EventTime")
    return out if tenant_cols else out.drop("_tenant")
