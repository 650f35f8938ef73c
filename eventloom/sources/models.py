"""Which backbones and sizes each descriptor model allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (method, backbone, allowed sizes); the first line of a method is its default,
#: with its first size.
ALLOWED = [
    ("netvlad", "VGG16", [4096, 32768]),
    ("sfrs", "VGG16", [4096]),
    ("cosplace", "ResNet50", [2048, 32, 64, 128, 256, 512, 1024]),
    ("cosplace", "ResNet101", [2048, 32, 64, 128, 256, 512, 1024]),
    ("cosplace", "ResNet152", [2048, 32, 64, 128, 256, 512, 1024]),
    ("cosplace", "ResNet18", [512, 32, 64, 128, 256]),
    ("cosplace", "VGG16", [512, 64, 128, 256]),
    ("convap", "ResNet50", [8192, 512, 2048, 4096]),
    ("mixvpr", "ResNet50", [4096, 128, 512]),
    ("eigenplaces", "ResNet50", [2048, 128, 256, 512]),
    ("eigenplaces", "ResNet101", [2048, 128, 256, 512]),
    ("eigenplaces", "ResNet152", [2048, 128, 256, 512]),
    ("eigenplaces", "ResNet18", [512, 256]),
    ("eigenplaces", "VGG16", [512]),
    ("eigenplaces-indoor", "ResNet50", [2048]),
    ("apgem", "Resnet101", [2048]),
    ("anyloc", "DINOv2", [49152]),
    ("salad", "DINOv2", [8448]),
    ("clique-mining", "DINOv2", [8448]),
    ("salad-indoor", "Dinov2", [8448]),
    ("cricavpr", "Dinov2", [10752]),
    ("megaloc", "Dinov2", [8448]),
    ("boq", "ResNet50", [16384]),
    ("boq", "Dinov2", [12288]),
    ("dinomix", "Dinov2", [4096]),
]


def allowed(spark: SparkSession) -> DataFrame:
    """(method, backbone, dim) of all allowed models."""
    return spark.createDataFrame([(m, b, d) for m, b, ds in ALLOWED for d in ds], "method string, backbone string, dim int")


def validate(configs: DataFrame) -> DataFrame:
    """Adds defaults for a missing backbone or size, and ``valid``."""
    spark = configs.sparkSession
    first: dict[str, tuple[str, int]] = {}
    for m, b, ds in ALLOWED:
        first.setdefault(m, (b, ds[0]))
    d = spark.createDataFrame([(m, b, n) for m, (b, n) in first.items()], "method string, _b string, _d int")
    full = configs.join(F.broadcast(d), "method", "left").withColumn("backbone", F.coalesce("backbone", "_b")).withColumn("dim", F.coalesce("dim", "_d")).drop("_b", "_d")
    ok = allowed(spark).withColumn("_ok", F.lit(True))
    return full.join(F.broadcast(ok), ["method", "backbone", "dim"], "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")
