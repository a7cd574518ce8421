"""Queries of n-grams with offsets, sequences and their TF-IDF, and pruned paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import small_batches
from ..operators import features, syntax
from .registry import query
from .tables import table


@query()
def x7_ngram_spans(spark, sf):
    """Two tokens each, as they stand in the text; tests hold them against a loop over the text."""
    small_batches(spark)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.ngram_spans("text", 2)).alias("g"))
    return rows.select("conv_id", "turn", "g.*")


_WEIGHTED = """, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM k GROUP BY term), w AS (SELECT doc_id, term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM k JOIN d USING (term), n WHERE df >= 5 AND df <= n * CAST(0.8 AS DOUBLE)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT doc_id, count(*) AS terms, round(sum(w / l), 4) AS total FROM w JOIN z USING (doc_id) GROUP BY doc_id"""


def _summed(rows):
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("tfidf"), 4).alias("total"))


@query("""WITH s AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g') AS m FROM documents), g AS (SELECT doc_id, substr(m, i, n) AS term FROM (SELECT doc_id, m, n, unnest(range(1, len(m) - n + 2)) AS i FROM s, (VALUES (1), (2), (3), (4)) v(n))), k AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)""" + _WEIGHTED)
def a31_punctuation_ngrams(spark, sf):
    """One to four marks after each other."""
    rows = table(spark, sf, "documents").select("doc_id", X.punctuation_sequence("text").alias("marks"))
    return _summed(features.tfidf(rows, (1, 4), text="marks", unit="char"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"


@query(f"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x IN {_STOPS}) AS ws FROM documents), g AS (SELECT doc_id, array_to_string(ws[i:i+n-1], ' ') AS term FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM s, (VALUES (1), (2), (3)) v(n))), k AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)""" + _WEIGHTED)
def a31_stop_word_ngrams(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", X.stop_word_sequence("text").alias("stops"))
    return _summed(features.tfidf(rows, (1, 3), text="stops"))


@query()
def a31_tag_ngrams(spark, sf):
    """One to three tags of the default tagger; the weights are those of the other sequences."""
    rows = syntax.tag_sequence(syntax.parse(table(spark, sf, "documents").select("doc_id", "text"), column="text"))
    return _summed(features.tfidf(rows.select("doc_id", "tags"), (1, 3), text="tags"))


@query()
def u5_pruned_paths(spark, sf):
    """Parts of each order, line by line, as a path from each line on; those within another go.  Tests hold it against all subsequences."""
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"))))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(own.alias("o")).select("l_orderkey", F.col("o.p").alias("o"))
    tails = F.transform(F.sequence(F.lit(1), F.size("o")), lambda i: F.slice("o", i, F.size("o")))
    return rows.select("l_orderkey", features.pruned(tails).alias("paths"))
