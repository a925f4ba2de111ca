"""Filling containers of fixed capacity: vector best-fit in bounded shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, encode_corpus
from tidemark.session import cut_lineage, table

CAPACITY = 2048
#: Another capacity of a container: the documents in it. The third, attention cost, is the sum of squared piece lengths.
MAX_PIECES = 512
#: Weights of the residual token, document and cost capacities in the norm that selects a container.
WEIGHTS = (1.0, 0.01, 0.01)
#: Pieces packed together by one task. A shard leaves about one container part filled, of a thousand or two.
SHARD_PIECES = 8192


def best_fit(tokens: np.ndarray, capacity: int, max_pieces: int, max_cost: float, weights=WEIGHTS) -> np.ndarray:
    """Container number of each piece, for pieces in falling order of tokens.

    A piece goes where, after it, the weighted norm of the residual capacities (each as a share of the whole) is
    least, among open containers in which every capacity suffices; if none has room, a new one is opened. A piece
    whose cost alone exceeds max_cost has a container of its own.
    """
    n = len(tokens)
    bins = np.empty(n, np.int64)
    whole = np.array([capacity, max_pieces, max_cost], float)
    w = (np.array(weights) / whole) ** 2
    left, name, used, opened = np.empty((n, 3)), np.empty(n, np.int64), 0, 0
    least = int(tokens.min()) if n else 0
    for i in range(n):
        t = int(tokens[i])
        need = np.array([t, 1.0, float(t) * t])
        k = -1
        alone = float(t) * t > max_cost
        if used and t < capacity and not alone:
            rest = left[:used] - need
            fits = (rest >= 0).all(axis=1)
            norm = np.where(fits, (rest * rest) @ w, np.inf)
            k = int(norm.argmin())
            if not fits[k]:
                k = -1
        if k < 0:
            left[used], name[used], k = whole, opened, used
            used, opened = used + 1, opened + 1
        left[k] -= need
        bins[i] = name[k]
        if alone or left[k, 0] < least or left[k, 1] < 1 or left[k, 2] < float(least) * least:
            used -= 1
            left[k], name[k] = left[used], name[used]
    return bins


def pack(sizes: DataFrame, capacity: int = CAPACITY, max_pieces: int = MAX_PIECES, max_cost: float | None = None) -> DataFrame:
    """doc_id, part, start, n_tokens, container_id, offset: every document of doc_id, n_tokens in containers.

    A document longer than `capacity` is split into full containers and a last piece; start is a piece's first token
    within its document, offset its place in its container. Documents without tokens or with a null size take no
    room and have no row. Repeated rows are packed each by itself. max_cost is capacity squared if None, which no
    filling exceeds; with less, containers are closed by their cost too, and a piece that alone exceeds it has a
    container of its own. max_pieces is at least 1.

    Plan: pieces are spread over shards of about SHARD_PIECES by hash, so a giant document is many tasks' work and no
    task holds more than a shard; the number of shards, and of partitions, follows the number of pieces.
    """
    cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    if max_pieces < 1 or not cost > 0:
        raise ValueError("max_pieces must be at least 1 and max_cost more than 0")
    cap = F.lit(capacity)
    some = sizes.where(F.col("n_tokens") > 0).select("doc_id", F.col("n_tokens").cast("long").alias("whole"))
    pieces = some.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / cap))).alias("part"))
    pieces = pieces.select("doc_id", "part", (F.col("part") * cap).alias("start"), F.least(cap.cast("long"), F.col("whole") - F.col("part") * cap).alias("n_tokens"))
    n = some.agg(F.coalesce(F.sum(F.floor((F.col("whole") - 1) / cap) + 1), F.lit(0)).alias("n")).first().n
    shards = max(1, round(n / SHARD_PIECES))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("long")).repartition(shards, "shard")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        pdf["container_id"] = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_pieces, cost) + int(pdf["shard"].iloc[0]) * (1 << 24)
        pdf["offset"] = pdf.groupby("container_id")["n_tokens"].cumsum() - pdf["n_tokens"]
        return pdf[["doc_id", "part", "start", "n_tokens", "container_id", "offset"]]

    return pieces.groupBy("shard").applyInPandas(fill, "doc_id long, part long, start long, n_tokens long, container_id long, offset long")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(encode_corpus(table(spark, sf_dir, "documents"), VOCABULARY, counts_only=True))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir))


def p9_costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_containers, with half the attention cost of one full piece: every capacity can close a container."""
    return pack(_sizes(spark, sf_dir), max_pieces=64, max_cost=CAPACITY**2 / 2)


QUERIES = {"p9_containers": p9_containers, "p9_costed": p9_costed}
SQL: dict[str, str] = {}
