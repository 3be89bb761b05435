"""Rows that counts of contacts shuffle: in proportion to the faces, not to their pairs."""

import numpy as np

from quarryline.operators import contacts, near


def test_shuffled_rows_grow_with_the_faces(spark, monkeypatch):
    for module, name in ((near, "POINTS"), (near, "FACES"), (contacts, "LEAST")):
        monkeypatch.setattr(module, name, 8, raising=False)
    v = np.random.default_rng(9).normal(size=(402, 3))
    vertices = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(400)], "fid long, a long, b long, c long")
    rows, dealt = [], type(faces).repartition
    monkeypatch.setattr(type(faces), "repartition", lambda df, *by: rows.append(df.count()) or dealt(df, *by))
    got = {r["category"]: r["n"] for r in contacts.contact_counts(faces, vertices).collect()}
    assert rows and sum(rows) <= 17 * 400
    assert got == {r["category"]: r["count"] for r in contacts.contacts(faces, vertices).groupBy("category").count().collect()}
