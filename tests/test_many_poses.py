"""More poses than are broadcast are all used."""

from pyspark.sql import functions as F

from quarryline.operators import consensus


def test_every_pose_is_used(spark):
    n = consensus.FEW + 5
    eye = {f"r{i}{j}": F.lit(float(i == j)) for i in range(3) for j in range(3)} | {f"t{a}": F.lit(0.0) for a in "xyz"}
    poses = spark.range(n).withColumnRenamed("id", "pose_index").withColumns(eye)
    voxels = spark.createDataFrame([(7, 0.0, 0.0, 1.0)], "voxel long, x double, y double, z double")
    hits = poses.select("pose_index", F.lit(0).alias("u"), F.lit(0).alias("v"))
    got = consensus.silhouette_support(voxels, poses, hits, 1.0, 0.0, 0.0).first()
    assert (got["tested"], got["inside"]) == (n, n)
