"""How the analysis tables derive from the relational test tables; each with the same derivation as SQL.

Orders are sentences, suppliers entities, part types topics, discounts the tone, nations fellowships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attitudes, graph, topics
from ..sources.stages import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; texts go over all cores where their file gives less than half as many tasks, as work on them is long."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if what they are read from gives less than half as many tasks: for long work on each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def mentions(spark, sf) -> DataFrame:
    tone = F.round(F.col("l_discount") * 100).cast("int") - 5
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part"), tone.alias("tone"))


def ee(spark, sf) -> DataFrame:
    m = mentions(spark, sf).select("sent", "ln", "entity", "tone")
    return attitudes.entity_pairs(m, ["sent"], order="ln").select("sent", "e1", "e2", (F.col("tone_a") + F.col("tone_b")).alias("tone2"))


def pair_sums(spark, sf) -> DataFrame:
    return attitudes.pair_sums(ee(spark, sf), ["e1", "e2"], "tone2")


def labelled(spark, sf) -> DataFrame:
    return attitudes.signed_pairs(pair_sums(spark, sf), scale=10.0)


def sag(spark, sf) -> DataFrame:
    return graph.signed_edges(labelled(spark, sf))


def sag_table(spark, sf) -> DataFrame:
    """The graph as a stage table: for steps that read it several times, so that the pair join runs once."""
    return stage(sag(spark, sf), "sag")


def groups(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("fid"), F.col("s_suppkey").alias("entity"))


def et(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("topic"))
    return mentions(spark, sf).join(parts, "part").select("sent", "entity", "topic", "tone")


def party(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("fid"), "n_regionkey")
    label = F.when(F.col("n_regionkey") == 0, "R").when(F.col("n_regionkey") == 1, "D").otherwise("N")
    return groups(spark, sf).join(n, "fid").select("entity", label.alias("label"))


def candidates(spark, sf) -> DataFrame:
    return graph.dipole_candidates(sag(spark, sf), groups(spark, sf))


def dipole_topics(spark, sf, dipoles: DataFrame | None = None) -> DataFrame:
    dipoles = candidates(spark, sf).filter("negative_ratio >= 0.5") if dipoles is None else dipoles
    values = stage(topics.side_values(et(spark, sf), groups(spark, sf), dipoles, "tone"), "sides")
    return topics.topic_polarization(values, scale=5.0)


_CTE = {
    "mentions": ((), "SELECT l_orderkey AS sent, l_linenumber AS ln, l_suppkey AS entity, l_partkey AS part, CAST(round(l_discount * 100) AS INT) - 5 AS tone FROM lineitem"),
    "ee": (("mentions",), "SELECT x.sent, least(x.entity, y.entity) AS e1, greatest(x.entity, y.entity) AS e2, x.tone + y.tone AS tone2 FROM mentions x JOIN mentions y ON x.sent = y.sent AND x.ln < y.ln AND x.entity <> y.entity"),
    "sums": (("ee",), "SELECT e1, e2, count(*) AS n, CAST(sum(tone2) AS BIGINT) AS total, count(*) FILTER (WHERE tone2 <> 0) AS n_nonzero FROM ee GROUP BY e1, e2"),
    "means": (("sums",), "SELECT *, CAST(total AS DOUBLE) / (n * CAST(10 AS DOUBLE)) AS mean FROM sums WHERE n >= 5"),
    "labelled": (("means",), "SELECT *, CASE WHEN mean >= -1 AND mean < CAST(-0.02 AS DOUBLE) THEN 'NEGATIVE' WHEN mean >= CAST(0.02 AS DOUBLE) AND mean < 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label FROM means"),
    "sag": (("labelled",), "SELECT e1, e2, CASE label WHEN 'POSITIVE' THEN 1 ELSE -1 END AS weight FROM labelled WHERE label <> 'NEUTRAL'"),
    "adj": (("sag",), "SELECT e1 AS node, e2 AS other, weight FROM sag UNION ALL SELECT e2, e1, weight FROM sag"),
    "seen": (("adj",), "SELECT node AS entity, count(*) FILTER (WHERE weight > 0) AS pos, count(*) FILTER (WHERE weight < 0) AS neg, count(*) AS deg FROM adj GROUP BY node"),
    "fellows": ((), "SELECT s_nationkey AS fid, s_suppkey AS entity FROM supplier"),
    "et": (("mentions",), "SELECT sent, entity, p_type AS topic, tone FROM mentions JOIN part ON part = p_partkey"),
    "party": ((), "SELECT s_suppkey AS entity, CASE n_regionkey WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'N' END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "crossed": (("sag", "fellows"), "SELECT e1, e2, weight, a.fid AS x, b.fid AS y FROM sag JOIN fellows a ON a.entity = e1 JOIN fellows b ON b.entity = e2"),
    "cand": (("crossed",), "SELECT least(x, y) AS f1, greatest(x, y) AS f2, count(*) FILTER (WHERE weight > 0) AS pos, count(*) FILTER (WHERE weight < 0) AS neg FROM crossed WHERE x <> y GROUP BY 1, 2 HAVING count(*) FILTER (WHERE weight < 0) > 0"),
    "dip": (("cand",), "SELECT f1, f2 FROM cand WHERE neg / CAST(pos + neg AS DOUBLE) >= 0.5"),
    "gv": (("et", "fellows"), "SELECT fid, topic, tone AS v, count(*) AS k FROM et JOIN fellows USING (entity) WHERE tone <> 0 GROUP BY ALL"),
    "sides0": (("dip", "gv"), "SELECT f1, f2, topic, 1 AS side, v, k FROM dip JOIN gv ON fid = f1 UNION ALL SELECT f1, f2, topic, 2, v, k FROM dip JOIN gv ON fid = f2"),
    "sides": (("sides0",), "SELECT * FROM (SELECT *, sum(CASE side WHEN 1 THEN k ELSE 0 END) OVER t AS n1, sum(CASE side WHEN 2 THEN k ELSE 0 END) OVER t AS n2 FROM sides0 WINDOW t AS (PARTITION BY f1, f2, topic)) WHERE n1 > 0 AND n2 > 0"),
    "resampled": (("sides",), "SELECT *, CASE WHEN (side = 1 AND n1 < n2) OR (side = 2 AND n2 < n1) THEN floor(greatest(n1, n2) * (CAST(k AS DOUBLE) / (CASE side WHEN 1 THEN n1 ELSE n2 END))) ELSE k END AS kr FROM sides"),
    "sided": (("resampled",), """SELECT f1, f2, topic, n1, n2,
      CAST(sum(CASE WHEN v > 0 THEN k ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN v < 0 THEN k ELSE 0 END) AS DOUBLE) AS m, CAST(sum(CASE WHEN v > 0 THEN k * v ELSE 0 END) AS DOUBLE) AS sp, CAST(sum(CASE WHEN v < 0 THEN k * v ELSE 0 END) AS DOUBLE) AS sm,
      CAST(sum(CASE WHEN v > 0 THEN kr ELSE 0 END) AS DOUBLE) AS rp, CAST(sum(CASE WHEN v < 0 THEN kr ELSE 0 END) AS DOUBLE) AS rm, CAST(sum(CASE WHEN v > 0 THEN kr * v ELSE 0 END) AS DOUBLE) AS rsp, CAST(sum(CASE WHEN v < 0 THEN kr * v ELSE 0 END) AS DOUBLE) AS rsm
      FROM resampled GROUP BY f1, f2, topic, n1, n2"""),
    "dtop": (("sided",), """SELECT f1, f2, topic, CASE WHEN p + m = 0 THEN 0 ELSE (1 - abs(p - m) / (p + m)) * abs(coalesce(sp / nullif(p * 5, 0), 0) - coalesce(sm / nullif(m * 5, 0), 0)) / 2 END AS pi,
      CASE WHEN n1 <> n2 THEN CASE WHEN rp + rm = 0 THEN 0 ELSE (1 - abs(rp - rm) / (rp + rm)) * abs(coalesce(rsp / nullif(rp * 5, 0), 0) - coalesce(rsm / nullif(rm * 5, 0), 0)) / 2 END END AS pi_res, CAST(n1 + n2 AS BIGINT) AS observations FROM sided"""),
    "commons": (("adj",), "SELECT a.node AS a, b.node AS b, count(*) AS both, count(*) FILTER (WHERE a.weight = 1 AND b.weight = 1) AS pp, count(*) FILTER (WHERE a.weight = 1 AND b.weight = -1) AS pn, count(*) FILTER (WHERE a.weight = -1 AND b.weight = 1) AS np, count(*) FILTER (WHERE a.weight = -1 AND b.weight = -1) AS nn FROM adj a JOIN adj b ON a.other = b.other AND a.node < b.node GROUP BY 1, 2"),
    "words": ((), "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM documents"),
    "counts": (("words",), "SELECT doc_id, word, count(*) AS k FROM words GROUP BY ALL"),
}


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """`body` behind the common table expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order) + ("\n" if not body.startswith(",") else "") + body
