"""From mentions to pairwise attitudes: pairs in a sentence, filters, bags (ids J3-J6, A1-A5, A28, F6-F12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import scalar_attitude, sign_label


def within(df: DataFrame, column: str = "sentence", most: int = 512, least: int = 0) -> DataFrame:
    """sentences of at most `most` characters (and more than `least` when stripped), before any pair expansion."""
    return df.filter((F.length(column) <= most) & (F.length(F.trim(column)) > least))


def entity_pairs(mentions: DataFrame, keys: list[str], entity: str = "entity", order: str | None = None) -> DataFrame:
    """Pairs of mentions of different entities in a sentence, ends sorted; equi-join on the sentence keys.

    With `order` a mention meets those after it (every mention pair once); without, every pair of distinct names once.
    """
    extra = [c for c in mentions.columns if c not in keys]
    a = mentions.select(*keys, *(F.col(c).alias(f"{c}_a") for c in extra))
    b = mentions.select(*keys, *(F.col(c).alias(f"{c}_b") for c in extra))
    both = a.join(b, keys)
    both = both.filter(F.col(f"{order}_a") < F.col(f"{order}_b")).filter(F.col(f"{entity}_a") != F.col(f"{entity}_b")) if order else both.filter(F.col(f"{entity}_a") < F.col(f"{entity}_b"))
    return both.withColumns({"e1": F.least(f"{entity}_a", f"{entity}_b"), "e2": F.greatest(f"{entity}_a", f"{entity}_b")})


def entity_phrases(entities: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity with every noun phrase of its sentence."""
    return entities.join(phrases, keys)


def multiplicity(pairs: DataFrame, n1: str, n2: str) -> DataFrame:
    """An attitude counts once per pair of mentions: weight n1 * n2 instead of repeated rows."""
    return pairs.withColumn("weight", F.col(n1) * F.col(n2))


def merge_entities(pairs: DataFrame, merge: DataFrame) -> DataFrame:
    """names by a merge map (entity, target), ends sorted again, self pairs dropped."""
    for end in ("e1", "e2"):
        pairs = pairs.join(merge.select(F.col("entity").alias(end), F.col("target").alias(f"__{end}")), end, "left")
    x, y = F.coalesce("__e1", "e1"), F.coalesce("__e2", "e2")
    return pairs.withColumns({"__a": F.least(x, y), "__b": F.greatest(x, y)}).drop("e1", "e2", "__e1", "__e2").withColumnsRenamed({"__a": "e1", "__b": "e2"}).filter("e1 <> e2")


def allow_entities(pairs: DataFrame, allowed: DataFrame, ends: tuple[str, ...] = ("e1", "e2")) -> DataFrame:
    """F8: rows whose ends are all listed (entity)."""
    for end in ends:
        pairs = pairs.join(allowed.select(F.col("entity").alias(end)), end, "left_semi")
    return pairs


def polarity(tokens: DataFrame, lexicon: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """A1: (P - N) / (P + N) of a span's tokens (text, else lemma, in lower case) by a lexicon (word, polarity); 'both' counts twice; 0 if none."""
    found = tokens.filter(~F.lower("text").isin(*skip)) if skip else tokens
    by_text = lexicon.select(F.col("word").alias("t"), F.col("polarity").alias("pt"))
    by_lemma = lexicon.select(F.col("word").alias("l"), F.col("polarity").alias("pl"))
    found = found.join(by_text, F.lower(found["text"]) == F.col("t"), "left").join(by_lemma, F.lower(found["lemma"]) == F.col("l"), "left")
    p = F.coalesce("pt", "pl")
    pos, neg = F.sum(p.isin("positive", "both").cast("int")), F.sum(p.isin("negative", "both").cast("int"))
    return found.groupBy(*keys).agg(pos.alias("p"), neg.alias("n")).select(*keys, F.coalesce(F.try_divide(F.col("p") - F.col("n"), F.col("p") + F.col("n")), F.lit(0.0)).alias("polarity"))


def sentence_attitude(paths: DataFrame, keys: list[str], value: str = "polarity") -> DataFrame:
    """A2: mean of the paths' non-zero polarities, else 0."""
    return paths.groupBy(*keys).agg(F.coalesce(F.avg(F.nullif(F.col(value), F.lit(0.0))), F.lit(0.0)).alias("attitude"))


def from_probabilities(df: DataFrame, column: str = "proba") -> DataFrame:
    """A5 on a struct(positive, neutral, negative)."""
    return df.withColumn("attitude", scalar_attitude(F.col(f"{column}.negative"), F.col(f"{column}.neutral"), F.col(f"{column}.positive")))


def bag(df: DataFrame, keys: list[str], value: str = "attitude") -> DataFrame:
    """A3/A4: all attitudes of a pair; for reports only, sums below need no lists."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("attitudes"))


def aggregate(df: DataFrame, keys: list[str], value: str, func=F.avg, drop: tuple = ()) -> DataFrame:
    """A6/A8 with a function of the caller's (Column -> Column, a pandas aggregate included) over values other than `drop`; n counts all."""
    used = F.when(~F.col(value).isin(*drop), F.col(value)) if drop else F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), func(used).alias("value"))


def pair_sums(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Per pair: n (mentions), total, n_used and total over non-zero values (A28); partial sums before the shuffle."""
    w = F.lit(1) if weight is None else weight
    v = F.col(value)
    return df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(v * w).alias("total"), F.sum(F.when(v != 0, w).otherwise(0)).alias("n_nonzero"))


def signed_pairs(sums: DataFrame, scale: float = 1.0, minimum_frequency: int = 5, bounds=(-0.02, 0.02), skip_zero: bool = False) -> DataFrame:
    """Label of the mean of pairs seen often enough; frequency counts all values, an empty filtered bag is NEUTRAL."""
    n = F.col("n_nonzero") if skip_zero else F.col("n")
    mean = F.try_divide(F.col("total").cast("double"), n * F.lit(scale))
    return sums.filter(F.col("n") >= minimum_frequency).withColumn("mean", mean).withColumn("label", F.when(F.col("mean").isNull(), "NEUTRAL").otherwise(sign_label("mean", *bounds)))


def dynamic_threshold(df: DataFrame, value: Column) -> DataFrame:
    """Midpoint of the medians of positive and of negative values."""
    return df.agg(F.median(F.when(value > 0, value)).alias("mp"), F.median(F.when(value < 0, value)).alias("mn")).select(((F.col("mp") + F.col("mn")) / 2).alias("threshold"))


def histogram(df: DataFrame, value: str, n: int = 10, widen: bool = True) -> DataFrame:
    """Counts in n equal-width bins over [min, max]; the range is one row that joins each.  A single-valued range is widened, or lies in the last bin."""
    from ..functions.numbers import equal_width_bin

    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.crossJoin(F.broadcast(span)).groupBy(equal_width_bin(value, "lo", "hi", n, widen).alias("bin")).agg(F.count("*").alias("n"))  # one row
