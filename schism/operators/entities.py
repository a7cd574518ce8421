"""Entity spans in sentences: overlap, filters, transformations, coreference, frequency (ids J1, J2, F8-F11, X11, X12, A27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (begin, end; ends exclusive) of a and b in one sentence that intersect; a row per overlap."""
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    return a.join(right, keys).filter("begin_b < end and begin < end_b")


def without_overlap(phrases: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases that no entity of their sentence overlaps."""
    e = entities.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return phrases.join(e, same & (F.col("__b") < F.col("end")) & (F.col("begin") < F.col("__e")), "left_anti")


def first_per_span(entities: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """of entities with one span in a sentence the first."""
    w = Window.partitionBy(*keys, "begin", "end").orderBy(position)
    return entities.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def transform_entities(column, operations: list[dict]):
    """ordered operations over an array of entities: {'replace': {title: new}} or {'delete': [dbpedia, ...]}."""
    c = F.col(column) if isinstance(column, str) else column
    for op in operations:
        if op.get("replace"):
            c = _replaced(c, F.create_map(*(F.lit(x) for pair in op["replace"].items() for x in pair)))
        if op.get("delete"):
            c = _without(c, op["delete"])
    return c


def _replaced(c, table):
    return F.transform(c, lambda e: F.when(table[e["title"]].isNotNull(), e.withField("title", table[e["title"]]).withField("dbpedia", table[e["title"]])).otherwise(e))


def _without(c, gone):
    return F.filter(c, lambda e: ~F.coalesce(e["dbpedia"].isin(*gone), F.lit(False)))


def top_entities(mentions: DataFrame, entity: str = "entity", n: int = 50) -> DataFrame:
    """Most frequent entities, ties by name."""
    return mentions.groupBy(entity).agg(F.count("*").alias("n")).orderBy(F.desc("n"), entity).limit(n)


def resolve_coreference(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """X11: mentions (uid, cluster, begin, end) after a cluster's first one are replaced by its text, from right to left."""
    w = Window.partitionBy("uid", "cluster").orderBy("begin", "end")
    head = clusters.withColumn("r", F.row_number().over(w)).withColumns({"hb": F.first("begin").over(w), "he": F.first("end").over(w)}).filter("r > 1")
    spans = head.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "hb", "he"))).alias("spans"))
    text = F.aggregate(F.reverse(F.col("spans")), F.col("text"), lambda acc, s: F.concat(F.substr(acc, F.lit(1), s["begin"]), F.substr(F.col("text"), s["hb"] + 1, s["he"] - s["hb"]), F.substr(acc, s["end"] + 1, F.length(acc))))
    return articles.join(spans, "uid", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text)).drop("spans")


def propagate_entities(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """An entity that overlaps a mention of a cluster is also at the cluster's other mentions."""
    hit = entities.join(clusters.select("uid", "cluster", F.col("begin").alias("mb"), F.col("end").alias("me")), "uid").filter("mb < end and begin < me").select("uid", "cluster", "title").distinct()
    more = hit.join(clusters, ["uid", "cluster"]).select("uid", "begin", "end", "title")
    return entities.select("uid", "begin", "end", "title").union(more).distinct()
