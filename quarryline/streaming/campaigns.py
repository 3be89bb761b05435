"""A running campaign: its progress from log lines, and which sessions are ready, each the same as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalar import STEPS_PER_TURN
from ..session import ship

# fixed values: the marks of a campaign's log and its first activities
STAGE, RESUMED, REUSED = "[ETAPA] ", "[RESUME]", "reutilizado"
TAGGED = r"^\[(PROGRESO|INICIO|EN CURSO|CPU)\]\s*(.*)"
HEARTBEAT, NOISE = "EN CURSO", ("Se está ejecutando:", "Completado:")
STEP_NAME, TIMES, GENERIC = r"(?i)^Paso\s+[\w.]+$", r"(?i)^(Tiempo\s+(actividad|total).*|\d+(\.\d+)?\s*s)$", r"(?i)^Procesando paso\s+[\w.]+[.…]*$"
OPENED = "Preparando entradas del paso"

PROGRESS = "campaign {}, ts timestamp, event string, stage string, activity string, stage_s double, activity_s double, total_s double"


def _detail(text: Column) -> Column:
    """A tagged line's own words: without the step's name and without times."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    named = F.element_at(parts, 1).rlike(STEP_NAME) | F.element_at(parts, 1).endswith(".py")
    parts = F.when(named, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    return F.trim(F.array_join(F.filter(parts, lambda p: ~p.rlike(TIMES)), " | "))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """With ``kind`` (stage, resumed, work or beat; null says nothing) and ``detail``."""
    text = F.col(line)
    tag, words = F.regexp_extract(text, TAGGED, 1), F.regexp_extract(text, TAGGED, 2)
    detail = _detail(words)
    quiet = words.startswith(NOISE[0]) | words.startswith(NOISE[1]) | (detail == "") | detail.rlike(GENERIC)
    kind = F.when(text.startswith(STAGE), "stage").when(text.startswith(RESUMED) & text.contains(REUSED), "resumed").when((tag == "") | quiet, None).when(tag == HEARTBEAT, "beat").otherwise("work")
    said = F.when(text.startswith(STAGE), F.trim(F.substring(text, len(STAGE) + 1, 1 << 20))).when(text.startswith(RESUMED), F.trim(F.substring(text, len(RESUMED) + 1, 1 << 20))).otherwise(detail)
    return lines.withColumn("kind", kind).withColumn("detail", F.when(kind.isNotNull(), said))


def _seconds(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) / 1e6 - F.unix_micros(earlier) / 1e6


def _batch(rows: DataFrame, silence: float, late: float) -> DataFrame:
    by = Window.partitionBy("campaign").orderBy("ts", "line")
    far, before = (by.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    rows = rows.dropDuplicates(["campaign", "ts", "line"]).withColumns({"first": F.first("ts").over(far), "next": F.lead("ts").over(by), "opened": F.sum((F.col("kind") == "stage").cast("int")).over(far)})
    rows = rows.withColumn("opened", F.coalesce("opened", F.lit(0)))
    of = Window.partitionBy("campaign", "opened").orderBy("ts", "line")
    upto, earlier = (of.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    is_stage = F.col("kind") == "stage"
    rows = rows.withColumns({"stage": F.first(F.when(is_stage, F.col("detail")), True).over(upto), "stage_at": F.first("ts").over(upto)})
    title = F.coalesce(F.element_at(F.split("stage", r" \| "), -1), F.lit(""))
    rows = rows.withColumn("valid", F.col("kind").isin("work", "beat") & (F.col("detail") != title))
    specific = F.coalesce(F.max("valid").over(earlier), F.lit(False))
    rows = rows.withColumn("says", F.when(is_stage, F.lit(OPENED)).when(F.col("valid") & ((F.col("kind") == "work") | ~specific) | (F.col("kind") == "resumed") & ~specific, F.col("detail")))
    old = F.last("says", True).over(earlier)
    changed = F.col("says").isNotNull() & (is_stage | old.isNull() | (F.col("says") != old))
    rows = rows.withColumns({"changed": changed, "activity": F.last("says", True).over(upto), "fresh": changed & (F.coalesce(F.col("kind"), F.lit("")) != "resumed")})
    started = F.coalesce(F.last(F.when(F.col("fresh"), F.col("ts")), True).over(upto), F.col("first"))
    earlier_start = F.coalesce(F.last(F.when(F.col("fresh"), F.col("ts")), True).over(before), F.col("first"))
    rows = rows.withColumns({"since": started, "was": earlier_start})
    stage_at = F.when(F.col("opened") > 0, F.col("stage_at")).otherwise(F.col("first"))
    made = lambda when, event, since, rows: rows.select("campaign", when.alias("ts"), event.alias("event"), "stage", "activity", _seconds(when, stage_at).alias("stage_s"), _seconds(when, since).alias("activity_s"), _seconds(when, F.col("first")).alias("total_s"))
    changes = made(F.col("ts"), F.when(is_stage, "stage").otherwise("activity"), F.col("was"), rows.where("changed"))
    seen = rows.agg((F.max("ts") - F.make_dt_interval(secs=F.lit(late))).alias("seen"))
    over = F.col("ts") + F.make_dt_interval(secs=F.lit(silence))
    quiet = rows.crossJoin(F.broadcast(seen)).where((F.coalesce(F.col("next"), F.col("seen")) > over) & F.col("ts").isNotNull())  # one row
    return changes.unionByName(made(over, F.lit("silent"), F.col("since"), quiet))


class _Progress(StatefulProcessor):
    """A campaign's stage, activity and times; its timer is due when it has been silent too long."""

    STATE = "first double, last double, line string, stage string, stage_at double, activity string, since double, specific boolean, due double"

    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("progress", self.STATE)

    def _row(self, key, s: dict, at: float, event: str, since: float) -> tuple:
        return (*key, at, event, s["stage"], s["activity"], at - s["stage_at"], at - since, at - s["first"])

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        out = pd.DataFrame(rows, columns=["campaign", "ts", "event", "stage", "activity", "stage_s", "activity_s", "total_s"])
        out = out.astype({c: "float64" for c in ("ts", "stage_s", "activity_s", "total_s")})
        out["ts"] = pd.to_datetime((out["ts"] * 1e6).round().astype("int64"), unit="us")
        return out

    def _load(self) -> dict | None:
        return dict(zip([x.split()[0] for x in self.STATE.split(", ")], self.state.get(), strict=True)) if self.state.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = pd.concat(list(rows))
        s, out = self._load(), []
        for r in sorted({(x.at, x.line, x.kind, x.detail) for x in new.itertuples()}, key=lambda x: x[:2]):
            at, line, kind, detail = r
            kind, detail = (None, None) if pd.isna(kind) else (kind, detail)
            if s and (at, line) <= (s["last"], s["line"]):
                continue  # late or repeated
            if not s:
                s = {"first": at, "last": at, "line": line, "stage": None, "stage_at": at, "activity": None, "since": at, "specific": False, "due": 0.0}
            elif s["due"] and at > s["due"]:
                out.append(self._row(key, s, s["due"], "silent", s["since"]))
            s["last"], s["line"] = at, line
            title = (s["stage"] or "").split(" | ")[-1]
            valid = kind in ("work", "beat") and detail != title
            if kind == "stage":
                was = s["since"]
                s |= {"stage": detail, "stage_at": at, "activity": OPENED, "since": at, "specific": False}
                out.append(self._row(key, s, at, "stage", was))
            elif valid and (kind == "work" or not s["specific"]) or kind == "resumed" and not s["specific"]:
                if detail != s["activity"]:
                    was = s["since"]
                    s["activity"] = detail
                    if kind != "resumed":
                        s["since"] = at
                    out.append(self._row(key, s, at, "activity", was))
            s["specific"] = s["specific"] or valid
            s["due"] = at + self.silence
        if s:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if s["due"]:
                self.handle.registerTimer(int(s["due"] * 1000) + 1)
            self.state.update(tuple(s.values()))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        s = self._load()
        if s and s["due"]:
            row = self._row(key, s, s["due"], "silent", s["since"])
            s["due"] = 0.0
            self.state.update(tuple(s.values()))
            yield self._frame([row])

    def close(self) -> None:
        pass


def progress(lines: DataFrame, campaign: str = "campaign", time: str = "ts", line: str = "line", silence: float = 600.0, late: float = 60.0) -> DataFrame:
    """What changes in each campaign: campaign, ts, event, stage, activity, stage_s, activity_s, total_s.

    event is ``stage`` (a stage opens), ``activity`` (its specific activity changes) or ``silent`` (no line for ``silence`` seconds, told once, at
    that time). stage_s: since the stage opened; activity_s: how long the activity before it took, or for ``silent`` this one so far; total_s: since the
    campaign's first line. Once a stage has said what it does, the heartbeats of what is around it don't change that.

    A stream and a batch give the same rows. In a stream a line that is repeated, or older than the last one of its campaign, changes nothing, and one
    later than ``late`` seconds may be dropped; a batch has all lines in order of time and then text. Rows with a null time, key or line don't count.
    """
    rows = parsed(lines.select(F.col(campaign).alias("campaign"), F.col(time).cast("timestamp").alias("ts"), F.col(line).alias("line")).where("campaign is not null and ts is not null and line is not null"))
    if not lines.isStreaming:
        return _batch(rows, silence, late).withColumnRenamed("campaign", campaign)
    ship(lines.sparkSession)
    kind = dict(rows.dtypes)["campaign"]
    told = rows.withWatermark("ts", f"{int(late * 1000)} milliseconds").withColumn("at", F.unix_micros("ts") / 1e6).groupBy("campaign")
    return told.transformWithStateInPandas(_Progress(silence), PROGRESS.format(kind), "Append", "EventTime").withColumnRenamed("campaign", campaign)


def ready_sessions(captures: DataFrame, closures: DataFrame, views: int = 25, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """session, ts, ready and reason of each captured session, once: of ``captures(session, ts, views)`` and ``closures(session, ts, steps, flag)``.

    A session is ready if all its views were captured and, up to ``within`` after it, the whole turn was made and flagged. Else the reason says
    what is missing: ``views``, ``closure`` or ``turn``. Of repeated events one counts (in a batch the first, in a stream the first to come
    within ``late``). A stream tells a session without a closure when its watermark has passed the time for one. Rows with a null session or time don't count.
    """
    span = lambda text: F.expr(f"INTERVAL {text}")
    took = captures.select("session", F.col("ts").cast("timestamp").alias("ts"), "views").where("session is not null and ts is not null")
    closed = closures.select(F.col("session").alias("_session"), F.col("ts").cast("timestamp").alias("_ts"), "steps", "flag").where("_session is not null and _ts is not null")
    if captures.isStreaming:
        took = took.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session"])
        closed = closed.withWatermark("_ts", late).dropDuplicatesWithinWatermark(["_session"])
    else:
        took = took.groupBy("session").agg(F.min(F.struct("ts", "views")).alias("s")).select("session", "s.*")
        closed = closed.groupBy("_session").agg(F.min(F.struct("_ts", "steps", "flag")).alias("s")).select("_session", "s.*")
    met = took.join(closed, (F.col("session") == F.col("_session")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + span(within)), "left")
    turn = F.coalesce((F.col("steps") == STEPS_PER_TURN) & (F.col("flag") == "1"), F.lit(False))
    reason = F.when(F.coalesce(F.col("views"), F.lit(0)) != views, "views").when(F.col("_session").isNull(), "closure").when(~turn, "turn")
    return met.select("session", "ts", reason.isNull().alias("ready"), reason.alias("reason"))
