"""Lexicon features and TF-IDF of documents (ids X21-X26, A30-A32, U5)."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import pieces, small_batches
from ..functions.text import words


def counted(text, n: tuple[int, int] = (1, 1), unit: str = "word"):
    """Array of (word, k, n): the different words of a text, or its runs of n[0] to n[1] words (characters, with unit="char"), how often each occurs, and all together.

    In Arrow batches, a bounded piece of text at a time: bytes.split cuts at the white space of the regular expression \\s."""
    low, high = n
    kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64()), ("n", pa.int32())]))

    def grams(text: bytes) -> Counter:
        if unit == "char":
            chars = text.decode("utf-8", "surrogatepass")
            return Counter(chars[i : i + k].replace(" ", "").encode("utf-8", "surrogatepass") for k in range(low, high + 1) for i in range(len(chars) - k + 1))
        ws = text.split()
        if high == 1:
            return Counter(ws)
        return Counter(itertools.chain.from_iterable(ws if k == 1 else map(b" ".join, zip(*(ws[j:] for j in range(k)))) for k in range(low, high + 1)))

    def listed(texts: pa.Array) -> pa.Array:
        own = [grams(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        words, ks = (pa.array([x for c in own for x in part(c)], type_) for part, type_ in ((Counter.keys, pa.binary()), (Counter.values, pa.int64())))
        totals = np.repeat(np.array([sum(c.values()) for c in own], np.int32), [len(c) for c in own])
        ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
        fields = list(kind.value_type)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words.view(pa.string()), ks, pa.array(totals)], fields=fields))

    @F.arrow_udf("array<struct<word:string,k:bigint,n:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], kind), *(listed(texts.slice(start, stop - start)) for start, stop in pieces(texts))])

    return run(F.col(text) if isinstance(text, str) else text)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", terms=None) -> DataFrame:
    """key, word, k: the different lower-case words of each row (a key has one row), counted within the row, so without a shuffle.

    `terms`: another column of counts than those of the words (see `counted`)."""
    small_batches(docs.sparkSession)
    own = counted(F.lower(F.col(text))) if terms is None else terms
    return docs.select(key, own.alias("__c")).select(key, F.explode("__c").alias("w")).select(key, "w.word", "w.k")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word: one row per lower-case word."""
    return docs.select(key, F.explode(words(F.lower(F.col(text)))).alias("word"))


def vocabulary_richness(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Richness measures from word counts; 0 for texts without words.  A word of two occurrences counts both in dis-hapax."""
    per_word = word_counts(docs, key)
    when = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    k = F.col("k")
    s = per_word.groupBy(key).agg(F.sum("k").alias("n"), F.count("*").alias("v"), when(k == 1, 1).alias("v1"), when(k == 2, 2).alias("dis"), when(k >= 2, 1).alias("v2"), F.sum(k * k).alias("m2"))
    s = docs.select(key).distinct().join(s, key, "left")
    z = lambda x: F.coalesce(x, F.lit(0.0))
    n, v, v1, v2, m2 = (F.col(c).cast("double") for c in ("n", "v", "v1", "v2", "m2"))
    return s.select(
        key, z(v1).alias("vr_hapax"), z(F.col("dis").cast("double")).alias("vr_dis_hapax"), z(v / n).alias("vr_ttr"), z(F.pow(n, F.pow(v, F.lit(-0.169)))).alias("vr_brunet"),
        z(F.try_divide(100 * F.ln(n), 1 - v1 / n)).alias("vr_honore"), z(v2 / n).alias("vr_sichel"), z(F.try_divide(v * v, m2 - v)).alias("vr_yule"),
    )


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and category tokens that the lexicon (term, category) lists, distinct terms, share of all tokens; counted within the row."""
    per_word = _with_size(docs, key)
    found = per_word.join(lexicon.select(F.col("term").alias("word"), "category").distinct(), "word").groupBy(key, "category")
    found = found.agg(F.sum("k").alias("hits"), F.count("*").alias("terms"), F.max("words").alias("words"))
    return found.select(key, "category", "hits", "terms", (F.col("hits") / F.col("words")).alias("share"))


def _with_size(docs: DataFrame, key: str) -> DataFrame:
    """key, word, k, and words: all tokens of the row."""
    small_batches(docs.sparkSession)
    rows = docs.select(key, counted(F.lower(F.col("text"))).alias("__c")).select(key, F.explode("__c").alias("w"))
    return rows.select(key, "w.word", "w.k", F.col("w.n").alias("words"))


def phrase_presence(text, terms, whole_words: bool = True):
    """X22/X24 for short fixed lists, phrases included: number of terms that occur in a text, as " term " (so neither as first nor as last word) or anywhere."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    marks = [f" {t} " if whole_words else t for t in terms]
    return sum((F.coalesce(c.contains(m), F.lit(False)).cast("int") for m in marks), F.lit(0))


def lexicon_score(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean score of the lexicon terms (term, score) that occur in a document."""
    present = word_counts(docs, key).join(lexicon.select(F.col("term").alias("word"), "score"), "word")
    return present.groupBy(key).agg(F.avg("score").alias("score"))


def pattern_categories(docs: DataFrame, patterns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per category the percentage of tokens that match; a pattern ending in * is a prefix, the shortest prefix of a token wins over longer ones and over equality.

    The different tokens meet patterns by equality of their prefixes, up to the longest pattern, an equi-join; those that match meet the rows.
    """
    from ..sources.stages import small, stage

    p = patterns.select(F.regexp_replace("pattern", r"\*$", "").alias("stem"), F.col("pattern").endswith("*").alias("wild"), "category")
    longest = p.agg(F.coalesce(F.max(F.length("stem")), F.lit(1)).alias("most"))
    vocabulary = _with_size(docs, key).select("word").distinct().crossJoin(F.broadcast(longest))  # one row
    heads = vocabulary.filter("most > 0").withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), "most")))).withColumn("stem", F.expr("substring(word, 1, l)"))
    hits = small(heads, p, "stem").filter((F.col("wild")) | (F.col("l") == F.length("word")))
    rank = F.rank().over(Window.partitionBy("word").orderBy(F.when(F.col("wild"), F.col("l")).otherwise(F.lit(1 << 20))))
    best = stage(hits.withColumn("r", rank).filter("r = 1").select("word", "category").distinct(), "matches")
    found = small(_with_size(docs, key), best, "word").groupBy(key, "category").agg(F.sum("k").alias("hits"), F.max("words").alias("n"))
    return found.select(key, "category", (F.col("hits") / F.col("n") * 100).alias("percent"))


def tfidf(docs: DataFrame, n: int | tuple[int, int] = 1, min_df: int = 5, max_df: float = 0.8, key: str = "doc_id", text: str = "text", unit: str = "word") -> DataFrame:
    """Terms of n (or n to m) words, or characters (unit="char"), with tf * (ln((1 + N) / (1 + df)) + 1), unit length per document.

    Terms of too few or too many documents are left out.  Terms are counted within the row and staged once; POS and
    stop-word sequences are texts like others, punctuation sequences go by characters."""
    from ..sources.stages import small, stage

    span = (n, n) if isinstance(n, int) else n
    terms = counted(F.col(text) if unit == "char" else F.lower(F.col(text)), span, unit)
    grams = stage(word_counts(docs, key, terms=terms).withColumnsRenamed({"word": "term", "k": "tf"}), "grams")
    total = docs.agg(F.count("*").alias("docs"))
    df = grams.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))  # one row
    idf = stage(df.select("term", (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = small(grams, idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weight.select(key, "term", (F.col("w") / length).alias("tfidf"))


def keywords(docs: DataFrame, top: int = 10, key: str = "doc_id", **options) -> DataFrame:
    """Highest TF-IDF terms of each document, ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc("tfidf"), "term")
    return tfidf(docs, key=key, **options).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles (interpolated), mean, extremes and population deviation."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"))


def prune_subsequences(paths: list[list]) -> list[list]:
    """By descending length, a list stays unless it is a subsequence of one that stayed."""
    kept: list[list] = []
    for path in sorted(paths, key=lambda p: (-len(p), p)):
        for longer in kept:
            at = 0  # how much of the path has been found in order
            for x in longer:
                at += at < len(path) and x == path[at]
            if at == len(path):
                break
        else:
            kept.append(path)
    return kept


def pruned(column, kind: str = "array<array<string>>"):
    """U5 over a column of lists of lists."""

    @F.pandas_udf(kind)
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: prune_subsequences([list(p) for p in c]))

    return run(column)
