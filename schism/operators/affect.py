"""Emotion hierarchy and word senses (ids X28, X29)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def ancestors(tree: DataFrame) -> DataFrame:
    """name, ancestor, up (0: itself) of every node of a tree (name, parent; the root's is null): a join for each level, however many.

    Raises on a cycle."""
    from ..sources.stages import stage

    tree = stage(tree.select("name", "parent"), "tree")
    parents = tree.filter("parent is not null").select(F.col("name").alias("ancestor"), "parent")
    out = front = tree.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("up"))
    most = tree.count()
    for up in itertools.count(1):
        front = stage(front.join(parents, "ancestor").select("name", F.col("parent").alias("ancestor"), F.lit(up).alias("up")), "ancestors")
        if front.isEmpty():
            return out
        if up > most:
            raise ValueError("the tree has a cycle")
        out = out.unionByName(front)


def at_level(tree: DataFrame, level: int) -> DataFrame:
    """Each node's ancestor at a level (0: the root); a node above that level is its own."""
    chain = ancestors(tree)
    depth = chain.groupBy("name").agg(F.max("up").alias("depth"))
    wanted = chain.join(depth, "name").filter(F.col("up") == F.greatest(F.col("depth") - level, F.lit(0)))
    return wanted.select("name", F.col("ancestor").alias("emotion"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """Number of nodes below each node."""
    return ancestors(tree).groupBy(F.col("ancestor").alias("name")).agg((F.count("*") - 1).alias("below"))


def word_emotions(words: DataFrame, senses: DataFrame, emotions: DataFrame) -> DataFrame:
    """Emotion of a word (word, pos): that of its first sense which has one.

    senses: word, pos, rank, synset.  emotions: synset, emotion."""
    hit = words.join(senses, ["word", "pos"]).join(emotions, "synset")
    return hit.groupBy("word", "pos").agg(F.min_by("emotion", F.struct("rank", "synset")).alias("emotion"))
