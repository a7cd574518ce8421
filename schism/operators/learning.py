"""Models on graphs and pairs (ids L1, L3, L4, L6, L8, M12): embeddings of triples, a classifier of pooled features, pluggable attitude models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most triples that are fitted in the driver's numpy.
MAX_TRIPLES = 2_000_000


def embed_triples(triples: DataFrame, size: int = 32, epochs: int = 20, rate: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """L1: vectors of entities and relations (name, vector): bilinear diagonal scores, logistic loss against corrupted objects.

    Refuses more than MAX_TRIPLES distinct triples (checked): samples of the graph belong to the caller."""
    rows = triples.select("subject", "predicate", "object").distinct()
    if rows.limit(MAX_TRIPLES + 1).count() > MAX_TRIPLES:
        raise ValueError(f"over {MAX_TRIPLES} triples")
    table = rows.orderBy("subject", "predicate", "object").toPandas()
    names, index = np.unique(pd.concat([table["subject"], table["object"]]).to_numpy(str), return_inverse=True)
    relations, r = np.unique(table["predicate"].to_numpy(str), return_inverse=True)
    s, o = index[: len(table)], index[len(table) :]
    random = np.random.default_rng(seed)
    e, w = random.normal(0, 0.3, (len(names), size)), random.normal(0, 0.3, (len(relations), size))
    for _ in range(epochs if len(table) else 0):
        order = random.permutation(len(table))
        for at in range(0, len(order), 512):
            b = order[at : at + 512]
            ss, rr = np.tile(s[b], 2), np.tile(r[b], 2)
            oo = np.concatenate([o[b], random.integers(0, len(names), len(b))])
            y = np.concatenate([np.ones(len(b)), np.zeros(len(b))])
            g = 1 / (1 + np.exp(-np.clip((e[ss] * w[rr] * e[oo]).sum(1), -30, 30))) - y
            ds, dr, do = g[:, None] * w[rr] * e[oo], g[:, None] * e[ss] * e[oo], g[:, None] * e[ss] * w[rr]
            np.add.at(e, ss, -rate * ds)
            np.add.at(w, rr, -rate * dr / len(b) * 8)
            np.add.at(e, oo, -rate * do)
    spark = triples.sparkSession
    frame = lambda n, v: spark.createDataFrame([(str(a), [float(x) for x in b]) for a, b in zip(n, v)], "name string, vector array<double>")
    return frame(names, e), frame(relations, w)


#: Most numbers of all vectors that may be broadcast.
BROADCAST_NUMBERS = 4_000_000


def pooled_features(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """L3 stand-in: path, label, features: mean vector of a sample's nodes, its edges and nodes (samples: path, label, s, o).

    Samples are dealt by path once, into as many parts as their size asks for, so that no task's tables grow with the input; the means take a column per dimension."""
    from ..sources.stages import parts

    held = vectors.agg(F.sum(F.size("vector")).alias("n"), F.max(F.size("vector")).alias("size")).first()
    numbered = vectors.filter("vector is not null").select("name", "vector", F.row_number().over(Window.partitionBy("name").orderBy("name")).alias("copy"))
    dealt = samples.filter("path is not null").select("path", "label", "s", "o").repartition(parts(samples), "path")
    both = F.array(F.struct(F.col("s").alias("name"), F.lit(1).alias("edges")), F.struct(F.col("o").alias("name"), F.lit(0).alias("edges")))
    nodes = dealt.select("path", "label", F.explode(both).alias("e")).groupBy("path", "e.name").agg(F.max("label").alias("label"), F.sum("e.edges").alias("edges"))
    found = nodes.join(F.broadcast(numbered) if (held["n"] or 0) <= BROADCAST_NUMBERS else numbered.hint("merge"), "name", "left")
    one = F.coalesce(F.col("copy"), F.lit(1)) == 1  # a name of several vectors is one node
    mean = [F.avg(F.get("vector", F.lit(i))).alias(f"m{i}") for i in range(held["size"] or 0)]
    out = found.groupBy("path").agg(F.max("label").alias("label"), F.sum(F.when(one, F.col("edges"))).cast("double").alias("edges"), F.sum(F.when(one, 1)).cast("double").alias("nodes"), F.max(F.size("vector")).alias("size"), *mean)
    own = F.slice(F.array(*(f"m{i}" for i in range(len(mean)))).cast("array<double>"), 1, F.col("size"))
    return out.filter("size > 0").select("path", "label", F.concat(own, F.array(F.log1p("nodes"), F.log1p("edges"))).alias("features"))


def classifier(rows: DataFrame, folds: int = 3, penalties=(0.01, 0.1), seed: int = 11):
    """L4: cross-validated logistic regression over `features` (array) and `label`; returns the fitted model and its rows' vector form.

    The rows are staged: every pass of every fit reads them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from ..sources.stages import stage

    ready = stage(rows, "features").withColumn("features", array_to_vector("features"))
    model = LogisticRegression(maxIter=30)
    grid = ParamGridBuilder().addGrid(model.regParam, list(penalties)).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(ready), ready


def text_classifier(rows: DataFrame, load=None, column: str = "text", **options):
    """`label` from a text: a cross-validated logistic regression (L4) over what an encoder that is plugged in (L11; hashed words by default) makes of it.

    Returns the fitted model and the encoded rows; rows without a label have no part in the fit and are left out."""
    from ..sources.annotators import encode, hashed_words

    encoded = encode(rows.filter("label IS NOT NULL"), load or hashed_words, column).withColumnRenamed("embedding", "features")
    return classifier(encoded, **options)


def infer_attitudes(pairs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "masked") -> DataFrame:
    """`proba` of masked sentences by a model that `load` brings up once per task; scores (negative, neutral, positive) pass a softmax."""
    schema = f"{pairs.schema.simpleString()[7:-1]}, proba:struct<negative:double,neutral:double,positive:double>"

    def run(frames):
        model = load()
        for frame in frames:
            z = np.asarray(model(frame[column].tolist()), float).reshape(-1, 3)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield frame.assign(proba=[dict(zip(("negative", "neutral", "positive"), map(float, x))) for x in p])

    return pairs.mapInPandas(run, schema)
