"""Layers of many seeds: tasks get about the same number of members however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import fusion


def slow(rows, gap):
    out = {}
    for seed in {r[0] for r in rows}:
        layers, last = [], None
        for h, p in sorted((r[2], r[1]) for r in rows if r[0] == seed):
            if last is None or h - last > gap:
                layers.append({})
            layers[-1].setdefault(p, []).append(h)
            last = h
        found = []
        for i, layer in enumerate(layers):
            h = [sum(v) / len(v) for v in layer.values()]
            held = float(np.mean([abs(x - (sum(h) - x) / (len(h) - 1)) for x in h])) if len(h) > 1 else None
            found.append((i, sum(h) / len(h), len(h), held))
        best = min(found, key=lambda f: (-f[2], np.inf if f[3] is None else f[3], f[1]))
        out |= {(seed, f[0]): (*f[1:], f is best) for f in found}
    return out


def test_tasks_grow_with_members(spark, monkeypatch):
    monkeypatch.setattr(fusion, "ROWS", 40, raising=False)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(90)), int(rng.integers(5)), float(h)) for h in rng.uniform(0, 20, 1200)]
    layers = fusion.resolve_layers(spark.createDataFrame(rows, "seed int, pose int, height double"), 0.8)
    got = layers.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 10  # more than spark.sql.shuffle.partitions
    want = slow(rows, 0.8)
    assert {(r["seed"], r["layer"]) for r in got} == set(want)
    for r in got:
        height, poses, held, chosen = want[r["seed"], r["layer"]]
        assert (r["poses"], r["chosen"]) == (poses, chosen) and r["height"] == pytest.approx(height)
        assert r["held_out"] is None if held is None else r["held_out"] == pytest.approx(held)
