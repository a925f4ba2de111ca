"""Boosted trees as a model factory: another family than ridge, the same walk-forward. (M2)"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk_forward_trees(df: DataFrame, features: Sequence[str], target: str, time: str, end: str, blocks: Sequence[tuple[datetime, datetime]], min_rows: int = 100, trees: int = 30, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """df with score of each block [first, next), from a model of rows whose label had closed before it.

    Gradient-boosted regression trees of MLlib; statistically like, not bitwise equal to, other libraries' trees.
    Missing features stand at 0 (rank inputs are centred). Blocks with too little history are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = df.fillna(0.0, list(features))
    d = VectorAssembler(inputCols=list(features), outputCol="__x").transform(d)
    out = None
    for first, nxt in blocks:
        train = d.where((F.col(end) < F.lit(first)) & F.col(target).isNotNull())
        if train.count() < min_rows:
            continue
        model = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="score", maxIter=trees, maxDepth=depth, stepSize=rate, seed=0).fit(train)
        part = model.transform(d.where((F.col(time) >= F.lit(first)) & (F.col(time) < F.lit(nxt)))).drop("__x")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("score", F.lit(None).cast("double"))
