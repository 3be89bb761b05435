"""Stages of a campaign with reuse by signature: the first miss makes all later stages run again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import signature


@dataclass
class Stage:
    """name, what it makes, its parameters, and verdicts that end the campaign (recorded, no error)."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    parameters: dict = field(default_factory=dict)
    gate: Callable[[DataFrame], str] | None = None
    stop_on: tuple[str, ...] = ("rejected",)


class Campaign:
    """Runs stages in order; each writes its table under ``root`` and a row of the ``checkpoints`` table."""

    def __init__(self, spark: SparkSession, root: str, version: str = "1"):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _recorded(self) -> dict[str, tuple[str, str]]:
        try:
            rows = self.spark.read.parquet(f"{self.root}/checkpoints").orderBy("at").collect()  # a row for each stage run
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return {}
        return {r["stage"]: (r["signature"], r["verdict"]) for r in rows}

    def run(self, stages: list[Stage], inputs: dict[str, str] | None = None) -> list[tuple[str, str, bool]]:
        """(stage, verdict, reused) of every stage that was reached."""
        known, tables, upstream, out, fresh = self._recorded(), {}, dict(inputs or {}), [], False
        for at, s in enumerate(stages):
            sign, path = signature(upstream, s.parameters, self.version), f"{self.root}/{s.name}"
            reused = not fresh and known.get(s.name, ("", ""))[0] == sign
            if reused:
                verdict = known[s.name][1]
            else:
                fresh = True
                s.make(tables).write.mode("overwrite").parquet(path)
                verdict = s.gate(self.spark.read.parquet(path)) if s.gate else "accepted"
                self.spark.createDataFrame([(s.name, sign, verdict, len(known) * 1000 + at)], "stage string, signature string, verdict string, at long").write.mode("append").parquet(f"{self.root}/checkpoints")
            tables[s.name] = self.spark.read.parquet(path)
            upstream[s.name] = sign
            out.append((s.name, verdict, reused))
            if verdict in s.stop_on:
                break
        return out
