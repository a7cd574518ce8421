"""Topics, their polarization and ranking (ids J6, J11, J12, J16, A11-A16, A20, A22, A23, F13-F15, M7, T4-T7, G6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import centroids, cosine, equal_width_bin, polarization


def phrase_topics(rows: DataFrame, topics: DataFrame, phrase: str = "np") -> DataFrame:
    """Rows with the topics of their phrase; unmatched rows drop, a phrase of several topics fans out."""
    return rows.join(topics.select(F.col("clean_np").alias(phrase), "topic_id").distinct(), phrase)


def surface_only(rows: DataFrame, surface: DataFrame, phrase: str = "np") -> DataFrame:
    """G6 parity: keep clean phrases that also occur as a surface form."""
    return rows.join(surface.select(F.col("np").alias(phrase)).distinct(), phrase, "left_semi")


def side_values(obs: DataFrame, groups: DataFrame, dipoles: DataFrame, value: str) -> DataFrame:
    """Counts of each attitude value per dipole, topic and side; topics on both sides with a non-zero value on each (F13), zeros gone.

    obs: entity, topic, value; the long form of the attitude bags.
    """
    per_group = obs.join(groups, "entity").groupBy("fid", "topic", F.col(value).alias("v")).agg(F.count("*").alias("k")).filter("v <> 0")
    d = dipoles.select("f1", "f2", F.posexplode(F.array("f1", "f2")).alias("side", "fid")).withColumn("side", F.col("side") + 1)
    both = d.join(per_group, "fid").select("f1", "f2", "topic", "side", "v", "k")
    sides = both.groupBy("f1", "f2", "topic").agg(F.sum(F.when(F.col("side") == 1, F.col("k")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("side") == 2, F.col("k")).otherwise(0)).alias("n2"))
    return both.join(sides.filter("n1 > 0 and n2 > 0"), ["f1", "f2", "topic"])


def _pi(weight: Column, scale: float) -> Column:
    v = F.col("v")
    n = lambda cond: F.sum(F.when(cond, weight).otherwise(0))
    total = lambda cond: F.sum(F.when(cond, weight * v).otherwise(0))
    pos, neg = n(v > 0), n(v < 0)
    return polarization(pos, neg, F.try_divide(total(v > 0).cast("double"), pos * F.lit(scale)), F.try_divide(total(v < 0).cast("double"), neg * F.lit(scale)))


def topic_polarization(values: DataFrame, scale: float = 1.0) -> DataFrame:
    """Pi of the pooled values, pi_res with the smaller side resampled up (null for equal sides), observations.

    Resampling: each value of the smaller side counts floor(n k / len) times, n being the larger side's size.
    """
    small = F.when(F.col("side") == 1, F.col("n1") < F.col("n2")).otherwise(F.col("n2") < F.col("n1"))
    size = F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n2"))
    resampled = F.when(small, F.floor(F.greatest("n1", "n2") * (F.col("k") / size))).otherwise(F.col("k"))
    out = values.withColumn("kr", resampled).groupBy("f1", "f2", "topic", "n1", "n2").agg(_pi(F.col("k"), scale).alias("pi"), _pi(F.col("kr"), scale).alias("pr"))
    return out.select("f1", "f2", "topic", "pi", F.when(F.col("n1") != F.col("n2"), F.col("pr")).alias("pi_res"), (F.col("n1") + F.col("n2")).alias("observations"))


def polarization_labels(scores: DataFrame, value: str = "pi", n: int = 10) -> DataFrame:
    """Polarization1..n by equal-width half-open bins; the maximum falls outside and is Polarization0."""
    span = scores.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    label = F.when((F.col(value) < F.col("hi")) | (F.col("lo") == F.col("hi")), equal_width_bin(value, "lo", "hi", n)).otherwise(0)
    return scores.crossJoin(F.broadcast(span)).withColumn("label", F.concat(F.lit("Polarization"), label)).drop("lo", "hi")  # one row


def rank_topics(scores: DataFrame, value: str = "pi") -> DataFrame:
    """Dipoles, observations and statistics of pi per topic; score = observations / dipoles * median."""
    out = scores.groupBy("topic").agg(
        F.count("*").alias("dt"), F.sum("observations").alias("obst"), F.median(value).alias("mt"), F.max(value).alias("max_pi"), F.min(value).alias("min_pi"), F.stddev_pop(value).alias("std_pi"), F.avg(value).alias("avg_pi")
    )
    return out.withColumn("score", F.col("obst") / F.col("dt") * F.col("mt"))


def topic_score(scores: DataFrame, topic: str, value: str = "pi") -> DataFrame:
    """One topic's score, 0 without a dipole."""
    return scores.filter(F.col("topic") == topic).agg(F.coalesce(F.try_divide(F.sum("observations").cast("double"), F.count("*").cast("double")) * F.median(value), F.lit(0.0)).alias("score"))


def top_topics(ranked: DataFrame, relevant: DataFrame | None = None, n: int = 25) -> DataFrame:
    """T5: by score, ties by topic; only relevant ones where given."""
    if relevant is not None:
        ranked = ranked.join(relevant.select("topic").distinct(), "topic", "left_semi")
    return ranked.orderBy(F.desc("score"), "topic").limit(n)


def entity_topic_weights(obs: DataFrame, value: str, scale: float = 1.0, times: str | None = None) -> DataFrame:
    """Median attitude of an entity towards a topic; times: a column that says how often a row was observed."""
    k = F.lit(1) if times is None else F.col(times)
    return obs.groupBy("entity", "topic").agg((F.percentile(value, 0.5, k) / scale).alias("weight"), F.sum(k).cast("long").alias("observations"))


def group_topic_weights(obs: DataFrame, groups: DataFrame, value: str, scale: float = 1.0, times: str | None = None) -> DataFrame:
    """Mean of the pooled attitudes of a fellowship's members; times as in A13."""
    k = F.lit(1) if times is None else F.col(times)
    pooled = obs.join(groups, "entity").groupBy("fid", "topic").agg(F.sum(F.col(value) * k).alias("t"), F.sum(k).cast("long").alias("observations"))
    return pooled.select("fid", "topic", (F.col("t") / (F.col("observations") * F.lit(scale))).alias("weight"), "observations")


def relevance(topics: DataFrame, seeds: DataFrame, key: str = "topic", vector: str = "embedding") -> DataFrame:
    """Mean cosine of a topic's centroid with all seed vectors.

    The mean of cosines is the centroid's product with the mean unit seed vector: no pairs are formed.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = seeds.select(F.posexplode(F.transform(vector, lambda x: x.cast("double") / norm)).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    mean = unit.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("seed"))  # one row: a vector
    dotted = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = F.col("centroid")
    return centroids(topics, key, vector).crossJoin(F.broadcast(mean)).select(key, F.try_divide(dotted(c, F.col("seed")), F.sqrt(dotted(c, c))).alias("relevance"))


def nearest_topic(phrases: DataFrame, centres: DataFrame, most: float = 0.2, key: str = "np") -> DataFrame:
    """Nearest centroid within a cosine distance; centres are counted before the broadcast, and more go in blocks."""
    from .clustering import BROADCAST_CENTRES, nearest_head

    if centres.limit(BROADCAST_CENTRES + 1).count() > BROADCAST_CENTRES:
        heads = centres.select(F.col("topic").alias("head"), F.col("centroid").alias("v"))
        return nearest_head(phrases, heads, 1 - most, key=key).select(key, F.col("head").alias("topic"), (1 - F.col("similarity")).alias("distance"))
    near = phrases.crossJoin(F.broadcast(centres)).select(key, "topic", (1 - cosine("embedding", "centroid")).alias("distance")).filter(F.col("distance") <= most)
    return near.groupBy(key).agg(F.min_by(F.struct("topic", "distance"), F.struct("distance", "topic")).alias("t")).select(key, "t.*")


def relevant_only(topics: DataFrame, scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """F15."""
    return topics.join(scores.filter(F.col("relevance") > threshold).select("topic"), "topic", "left_semi")


def purity(rows: DataFrame, keys: list[str], label: str = "label", neutral: str = "N") -> DataFrame:
    """Share of the most common non-neutral label among all labels; 0 if all are neutral."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(label) != neutral, F.col("k"))), F.lit(0)).alias("most"), F.sum("k").alias("population")).select(*keys, "population", (F.col("most") / F.col("population")).alias("purity"))


def attitudinal_cohesiveness(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Purity of entity-topic labels (entity, topic, label) per fellowship and topic, population and member share."""
    size = groups.groupBy("fid").agg(F.count("*").alias("size"))
    p = purity(labelled.join(groups, "entity"), ["fid", "topic"], neutral="NEUTRAL")
    return p.join(size, "fid").select("fid", "topic", F.col("population").alias("attitude_population"), F.col("purity").alias("cohesiveness"), (F.col("population") / F.col("size")).alias("member_ratio"))


def cohesiveness_summary(cohesiveness: DataFrame) -> DataFrame:
    """A21 (attitudes): per fellowship, population statistics of cohesiveness."""
    c = "cohesiveness"
    return cohesiveness.groupBy("fid").agg(F.avg(c).alias("avg_cohesiveness"), F.stddev_pop(c).alias("std_cohesiveness"), F.max(c).alias("max_cohesiveness"), F.min(c).alias("min_cohesiveness"))
