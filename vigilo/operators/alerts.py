"""Alert rules, cooldown, rate limit and life cycle.

Rule evaluation is a join of signals to the (small, caller-defined, hence
broadcast) rule table.  Cooldown and rate limit are greedy and depend on order:
whether an alert is sent depends on the alerts *sent* before it, so they cannot
be written with ``lag``.  They run as one ordered scan - cooldown per
``(alert_type, metric)`` key, the rate limit per tenant - over *alert
candidates*, which are produced per signal window.  After a quiet time as long
as the longest cooldown and the rate window no earlier alert can matter, so
every key's or tenant's candidates are cut into sessions at such gaps; sessions
are dealt to tasks, sorted there and read batch by batch with the state of one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from vigilo.presets import clinical as C

MINUTE = 60_000_000  # microseconds

RULE_SCHEMA = ("name string, alert_type string, threshold double, severity string, "
               "channels array<string>, cooldown_minutes int, enabled boolean")


def rules_table(spark: SparkSession, rules=C.DEFAULT_ALERT_RULES, enabled: bool = True) -> DataFrame:
    rows = [(n, t, float(th), sev, list(ch), int(cd), enabled) for n, t, th, sev, ch, cd in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def severity_rank(col) -> F.Column:
    order = F.array(*[F.lit(s) for s in C.SEVERITY_ORDER])
    return F.array_position(order, col)


# M11 ------------------------------------------------------------------------
def evaluate_rules(signals: DataFrame, rules: DataFrame, key_cols: Sequence[str] = ("signal_id",),
                   value: str = "value") -> DataFrame:
    """One alert per signal that meets at least one enabled rule (``value >= threshold``).

    Severity is the highest *ordinal* severity of the matched rules (the
    source compared the strings, so 'high' beat 'critical'); channels are the
    union; the cooldown is the longest applicable one.
    """
    keys = list(key_cols)
    # The rule table is defined by the caller (a handful of rows): broadcast.
    active = F.broadcast(rules.filter(F.col("enabled")).select(
        F.col("alert_type").alias("_rt"), F.col("name").alias("rule_name"), "threshold",
        F.col("severity").alias("_sev"), "channels", "cooldown_minutes"))
    hit = signals.join(active, (signals["alert_type"] == F.col("_rt")) & (F.col(value) >= F.col("threshold")))
    sev_order = F.array(*[F.lit(s) for s in C.SEVERITY_ORDER])
    rest = [c for c in signals.columns if c not in keys]
    return hit.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest],
        F.element_at(sev_order, F.max(severity_rank(F.col("_sev"))).cast("int")).alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"),
        F.max("cooldown_minutes").alias("cooldown_minutes"),
        F.array_sort(F.collect_list("rule_name")).alias("matched_rules"))


def evaluate_rules_inline(signals: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """M11 without a join or shuffle: the enabled rules (a handful of rows,
    read once on the driver) become a literal array, and every signal keeps
    the rules it meets.  Works unchanged on a stream."""
    rows = rules.filter(F.col("enabled")).collect()
    if not rows:
        return signals.limit(0)
    arr = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["alert_type"]).alias("alert_type"),
                             F.lit(float(r["threshold"])).alias("threshold"),
                             F.lit(C.SEVERITY_ORDER.index(r["severity"]) + 1).alias("rank"),
                             F.array(*[F.lit(c) for c in r["channels"]]).cast("array<string>").alias("channels"),
                             F.lit(int(r["cooldown_minutes"])).alias("cooldown"))
                    for r in rows])
    matched = F.filter(arr, lambda r: (r["alert_type"] == F.col("alert_type")) & (F.col(value) >= r["threshold"]))
    sev_order = F.array(*[F.lit(x) for x in C.SEVERITY_ORDER])
    out = signals.withColumn("_m", matched).filter(F.size("_m") > 0)
    return out.select(
        *signals.columns,
        F.element_at(sev_order, F.array_max(F.transform("_m", lambda r: r["rank"]))).alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_m", lambda r: r["channels"])))).alias("channels"),
        F.array_max(F.transform("_m", lambda r: r["cooldown"])).alias("cooldown_minutes"),
        F.array_sort(F.transform("_m", lambda r: r["name"])).alias("matched_rules"))


# M12 / M13 ordered scans ------------------------------------------------------
class _Cooldown:
    """Sent unless a sent alert of the session lies within the cooldown."""

    added = [pa.field("emitted", pa.bool_())]

    def __init__(self):
        self.last = None

    def __call__(self, t: int, minutes: int) -> tuple:
        sent = self.last is None or self.last <= t - minutes * MINUTE
        if sent:
            self.last = t
        return (sent,)


class _RateLimit:
    """At most ``most`` sent in any trailing window; ``candidate`` false is never sent."""

    added = [pa.field("emitted", pa.bool_())]

    def __init__(self, most: int, window: int):
        self.most, self.window, self.recent = most, window, deque()

    def __call__(self, t: int, candidate: bool) -> tuple:
        while self.recent and self.recent[0] <= t - self.window:
            self.recent.popleft()
        sent = bool(candidate) and len(self.recent) < self.most
        if sent:
            self.recent.append(t)
        return (sent,)


class _Policy:
    """Exact coupled semantics: cooldown against *sent* alerts of the key, then
    the rate limit against all sent alerts; a suppressed alert leaves no trace."""

    added = [pa.field("emitted", pa.bool_()), pa.field("suppressed_by", pa.string())]

    def __init__(self, most: int, window: int):
        self.most, self.window, self.recent, self.last = most, window, deque(), {}

    def __call__(self, t: int, minutes: int, *key) -> tuple:
        while self.recent and self.recent[0] <= t - self.window:
            self.recent.popleft()
        if key in self.last and self.last[key] > t - minutes * MINUTE:
            return False, "cooldown"
        if len(self.recent) >= self.most:
            return False, "rate_limit"
        self.last[key] = t
        self.recent.append(t)
        return True, None


def with_sessions(alerts: DataFrame, keys: Sequence[str], ts: str, horizon_minutes: int) -> DataFrame:
    """Adds ``_session``: runs of alerts of a key without a quiet time of ``horizon_minutes``.

    Time is cut into slots of that length; successive slots with alerts are one
    session, and an empty slot between two alerts is a gap longer than the
    horizon.  Only the distinct slots of a key (one row each) are ordered.
    """
    keys = list(keys)
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(max(int(horizon_minutes), 1) * 60_000_000))
    rows = alerts.withColumn("_slot", slot)
    slots = rows.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_slot").alias("_k_slot")).distinct()
    w = Window.partitionBy(*["_k_" + k for k in keys]).orderBy("_k_slot")
    fresh = F.when(F.coalesce(F.col("_k_slot") - F.lag("_k_slot").over(w) > 1, F.lit(True)), F.col("_k_slot"))
    slots = slots.withColumn("_new", fresh).withColumn(
        "_session", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    cond = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys] + [F.col("_slot").eqNullSafe(F.col("_k_slot"))]
    return rows.join(slots, cond).drop("_slot", "_k_slot", *["_k_" + k for k in keys])


def _longest_cooldown(alerts: DataFrame) -> int:
    return int(alerts.agg(F.max("cooldown_minutes")).first()[0] or 0)


def _scan(alerts: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], horizon: int, start: Callable[[], Callable],
          args: Sequence[str]) -> DataFrame:
    """One pass over the sessions of every key in time order, with the columns that ``start().added`` names.

    Sessions are dealt to tasks by a hash and sorted there; the pass reads batch
    after batch and holds one session's state, however long the session is.
    ``start`` makes a session's decider, called with each row's time in
    microseconds and its ``args``.
    """
    by = [*keys, "_session"]
    names, added = alerts.columns, start().added
    cut = with_sessions(alerts, keys, ts, horizon).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    dealt = cut.repartition(*by).sortWithinPartitions(*by, "_at", *order)
    schema = T.StructType([*alerts.schema.fields, *[T.StructField(f.name, from_arrow_type(f.type)) for f in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, decide = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in args]
            times = batch.column("_at").to_pylist()
            for own, t, *row in zip(zip(*(batch.column(c).to_pylist() for c in by)), times, *columns):
                if decide is None or own != session:
                    session, decide = own, start()
                out.append(decide(t, *row))
            results = [pa.array(list(x), f.type) for x, f in zip(zip(*out), added)] if out else \
                [pa.array([], f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *results], [*names, *(f.name for f in added)])

    return dealt.mapInArrow(run, schema)


def apply_cooldown(alerts: DataFrame, key_cols: Sequence[str] = ("alert_type", "metric"), ts: str = "ts",
                   order: Sequence[str] = (), longest_cooldown: int | None = None) -> DataFrame:
    """An alert is sent unless a *sent* alert of the same key lies within
    its (longest applicable) cooldown; a null metric is a key of its own.
    ``longest_cooldown`` saves a pass over the alerts to find it."""
    horizon = _longest_cooldown(alerts) if longest_cooldown is None else longest_cooldown
    return _scan(alerts, list(key_cols), ts, order, horizon, _Cooldown, ["cooldown_minutes"])


def apply_rate_limit(alerts: DataFrame, max_alerts: int = C.MAX_ALERTS_PER_HOUR, window_minutes: int = 60,
                     tenant_cols: Sequence[str] = (), ts: str = "ts", order: Sequence[str] = (),
                     only_where: str | None = None) -> DataFrame:
    """At most ``max_alerts`` sent in any trailing window (per tenant, or
    all alerts when no tenant column is given; their sessions still run apart).
    ``only_where`` names a boolean column of candidates (e.g. the cooldown
    result); the others are not sent and do not count.  The output's ``emitted``
    replaces ``only_where``."""
    src = alerts.withColumn("_cand", F.col(only_where) if only_where else F.lit(True)).drop("emitted", only_where or "emitted")
    return _scan(src, list(tenant_cols), ts, order, window_minutes,
                 lambda: _RateLimit(max_alerts, window_minutes * MINUTE), ["_cand"]).drop("_cand")


def apply_alert_policy(alerts: DataFrame, key_cols: Sequence[str] = ("alert_type", "metric"),
                       max_alerts: int = C.MAX_ALERTS_PER_HOUR, window_minutes: int = 60,
                       tenant_cols: Sequence[str] = (), ts: str = "ts", order: Sequence[str] = (),
                       longest_cooldown: int | None = None) -> DataFrame:
    """Cooldown and rate limit in one pass with the source's exact coupling."""
    longest = _longest_cooldown(alerts) if longest_cooldown is None else longest_cooldown
    return _scan(alerts, list(tenant_cols), ts, order, max(longest, window_minutes),
                 lambda: _Policy(max_alerts, window_minutes * MINUTE), ["cooldown_minutes", *key_cols])


# M14 ------------------------------------------------------------------------
def alert_state(alerts: DataFrame, actions: DataFrame, id_col: str = "alert_id", ts: str = "ts") -> DataFrame:
    """Status from the last action per alert: active, acknowledged or resolved."""
    last = actions.groupBy(id_col).agg(F.max(F.struct(F.col(ts), F.col("action"))).alias("_a"))
    out = alerts.join(last, [id_col], "left")
    status = (F.when(F.col("_a.action") == "resolve", "resolved")
              .when(F.col("_a.action") == "acknowledge", "acknowledged").otherwise("active"))
    return out.withColumn("status", status).withColumn("status_ts", F.col("_a." + ts)).drop("_a")


# M15 ------------------------------------------------------------------------
def alert_history(alerts: DataFrame, since, ts: str = "ts") -> DataFrame:
    return alerts.filter(F.col(ts) > F.lit(since).cast(alerts.schema[ts].dataType)).orderBy(F.col(ts).desc())


# M17 ------------------------------------------------------------------------
def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Add or replace rules by name."""
    return rules.join(new.select("name"), ["name"], "left_anti").unionByName(new)


def remove_rule(rules: DataFrame, name: str) -> DataFrame:
    return rules.filter(F.col("name") != name)
