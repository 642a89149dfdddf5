"""Scoring files with a tagging model, cached by content hash.

The misses are found on hashes alone; one file stands for each missing hash, and only these files' bytes meet the model,
an iterator pandas UDF that loads it once per task and feeds it Arrow batches. The new cache rows are written down once
and read back for both results, so nothing is scored twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import materialize

# make_model() -> predict(list[bytes]) -> 2-d array (rows = files, columns = label index)
ModelFactory = Callable[[], Callable[[list[bytes]], np.ndarray]]


def _score_udf(make_model: ModelFactory):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_model()                 # once per task, not per row
        for contents in batches:
            out = np.asarray(predict(list(contents)), dtype=np.float32)
            yield pd.Series(list(out))
    return score


def score_files(files: DataFrame, cache: DataFrame, repo: str, make_model: ModelFactory, key: str = "file_id"
                ) -> tuple[DataFrame, DataFrame]:
    """``files(<key>, hash, content, ...)``, ``cache(hash, repo_name, scores)`` ->
    ``(files with scores, new cache rows)``. Files without a hash have no scores (null)."""
    cached = cache.where(F.col("repo_name") == repo).select("hash", "scores")
    missing = (files.select("hash", key).where(F.col("hash").isNotNull())
               .join(cached.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min(key).alias(key)))
    todo = files.select(key, "hash", "content").join(missing, [key, "hash"], "left_semi").dropDuplicates(["hash"])
    fresh = materialize(todo.select("hash", _score_udf(make_model)(F.col("content")).alias("scores")), "scores")
    scores = cached.unionByName(fresh)
    return files.drop("content").join(scores, "hash", "left"), fresh.select("hash", F.lit(repo).alias("repo_name"), "scores")
