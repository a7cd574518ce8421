"""Sources and sinks (ids S2, S4-S6, S8-S20, S25, S26, X6, F1)."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import small_batches

#: Columns of the GDELT 1.0 event export and their types, in file order.
_GDELT = """
globaleventid bigint, day string, monthyear int, year int, fractiondate double,
actor1code string, actor1name string, actor1countrycode string, actor1knowngroupcode string, actor1ethniccode string, actor1religion1code string, actor1religion2code string, actor1type1code string, actor1type2code string, actor1type3code string,
actor2code string, actor2name string, actor2countrycode string, actor2knowngroupcode string, actor2ethniccode string, actor2religion1code string, actor2religion2code string, actor2type1code string, actor2type2code string, actor2type3code string,
isrootevent int, eventcode string, eventbasecode string, eventrootcode string, quadclass int, goldsteinscale double, nummentions int, numsources int, numarticles int, avgtone double,
actor1geo_type int, actor1geo_fullname string, actor1geo_countrycode string, actor1geo_adm1code string, actor1geo_lat double, actor1geo_long double, actor1geo_featureid string,
actor2geo_type int, actor2geo_fullname string, actor2geo_countrycode string, actor2geo_adm1code string, actor2geo_lat double, actor2geo_long double, actor2geo_featureid string,
actiongeo_type int, actiongeo_fullname string, actiongeo_countrycode string, actiongeo_adm1code string, actiongeo_lat double, actiongeo_long double, actiongeo_featureid string,
dateadded string, sourceurl string
"""
GDELT_SCHEMA = " ".join(_GDELT.split())
ARTICLE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "images" else T.StringType()) for n in ("url", "uid", "images", "publication-date", "text", "title", "top-image")])


def gdelt_columns() -> list[str]:
    """Names of the event columns in file order."""
    return [c.split()[0] for c in GDELT_SCHEMA.split(",")]


def gdelt(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated event files without a header, plain or gzip."""
    return spark.read.schema(GDELT_SCHEMA).option("sep", "\t").csv(path)


def select_articles(events: DataFrame, keywords=(), domains=(), country1: str | None = None, country2: str | None = None, n_articles: int | None = 1000) -> DataFrame:
    """Distinct events of a country on either side whose URL path and host match; the n with most keywords per day, ties by URL."""
    from pyspark.sql import Window

    from ..functions.text import keyword_count, url_host, url_path

    if country1 or country2:
        events = events.filter((F.col("actor1countrycode") == country1) | (F.col("actor2countrycode") == country2))
    events = events.withColumn("n_keywords", keyword_count(url_path("sourceurl"), keywords) if keywords else F.lit(0))
    if keywords:
        events = events.filter("n_keywords > 0")
    if domains:
        events = events.filter(keyword_count(url_host("sourceurl"), domains) > 0)
    rows = events.select("day", "sourceurl", "n_keywords").distinct()
    if n_articles is None:
        return rows
    w = Window.partitionBy("day").orderBy(F.desc("n_keywords"), "sourceurl")
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_articles).drop("r")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON articles, one per file in any folder below, as an object or as a string that holds one."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return raw.select(decode_article(F.col("value")).alias("a")).select("a.*")


def decode_article(c):
    twice = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    return F.from_json(F.when(F.trim(c).startswith('"'), twice).otherwise(c), ARTICLE)


#: English abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "Gen", "Sen", "Rep", "Gov", "Col", "Lt", "vs", "etc", "No", "e\\.g", "i\\.e", "U\\.S", "U\\.K", "a\\.m", "p\\.m")


class _Page(HTMLParser):
    """Title, paragraphs, images, publication date of a page; scripts, styles, menus and footers are left out."""

    SKIP = ("script", "style", "nav", "footer", "header", "aside", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.images, self.date, self.skip, self.at, self.top = "", [], [], None, 0, None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "meta":
            name = a.get("property") or a.get("name") or ""
            if name in ("article:published_time", "date", "pubdate"):
                self.date = (a.get("content") or "")[:10] or None
            elif name == "og:image":
                self.top = a.get("content")
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"])
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "td"):
            self.parts.append("\n")
        self.at = tag

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        self.at = None

    def handle_data(self, data):
        if self.at == "title":
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def parse_html(pages: DataFrame, day: str | None = None) -> DataFrame:
    """page_id, url, title, text, images, top_image, publication_date (of the page, else the folder's day)."""

    @F.pandas_udf("title string, text string, images array<string>, top_image string, publication_date string")
    def parse(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            p = _Page()
            p.feed(h or "")
            p.close()
            text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.parts).split("\n")) if x)
            rows.append((p.title.strip(), text, p.images, p.top or (p.images[0] if p.images else None), p.date))
        return pd.DataFrame(rows, columns=["title", "text", "images", "top_image", "publication_date"])

    out = pages.withColumn("p", parse("html")).select(*[c for c in pages.columns if c != "html"], "p.*")
    return out.withColumn("publication_date", F.coalesce(F.to_date("publication_date"), F.to_date(F.lit(day))))


def subjectivity_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lines of key=value tokens to word, polarity; of a repeated word the last line counts."""
    return parse_subjectivity(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()))


def parse_subjectivity(lines: DataFrame) -> DataFrame:
    entry = F.map_from_entries(F.transform(F.filter(F.split("value", " "), lambda t: t.contains("=")), lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substring_index(t, "=", -1).alias("v"))))
    rows = lines.select(entry.alias("m"), "at").select(F.col("m")["word1"].alias("word"), F.col("m")["priorpolarity"].alias("polarity"), "at").filter("word is not null")
    return rows.groupBy("word").agg(F.max_by("polarity", "at").alias("polarity"))


def category_dictionary(lines: list[str]) -> list[tuple[str, str]]:
    """(pattern, category) from a dictionary file: ids and names between two % lines, then patterns and their ids."""
    section, names, out = 0, {}, []
    for line in lines:
        if line.strip() == "%":
            section += 1
        elif section == 1 and line.split():
            key, name = line.split(None, 1)
            names[key] = name.strip()
        elif section >= 2 and line.split():
            pattern, *ids = line.split()
            out += [(pattern, names[i]) for i in ids if i in names]
    return out


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a lexicon file, which the driver reads as a whole: small by nature."""
    return [x for r in spark.read.option("wholetext", True).text(path).collect() for x in r["value"].split("\n")]


def category_dictionary_file(spark: SparkSession, path: str) -> DataFrame:
    """Pattern, category of a dictionary file."""
    return spark.createDataFrame(category_dictionary(_lines(spark, path)), "pattern string, category string")


def word_list(spark: SparkSession, path: str, comment: str = "#", sep: str | None = None) -> DataFrame:
    """One term per line, trimmed and in lower case; comments, empty lines and lines of several columns dropped."""
    c = F.trim("value")
    rows = spark.read.text(path).filter(~F.startswith(c, F.lit(comment)) & (c != ""))
    return (rows.filter(~c.contains(sep)) if sep else rows).select(F.lower(c).alias("term")).distinct()


def weighted_list(spark: SparkSession, path: str) -> DataFrame:
    """Term and score, tab-separated; of a repeated term the last line counts."""
    rows = spark.read.schema("term string, score double").option("sep", "\t").csv(path).withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("term").agg(F.max_by("score", "at").alias("score"))


def emotion_table(spark: SparkSession, path: str) -> DataFrame:
    """Word, emotion of the associations that aren't 0."""
    rows = spark.read.schema("word string, emotion string, association int").option("sep", "\t").csv(path)
    return rows.filter("association <> 0").select(F.col("word").alias("term"), F.col("emotion").alias("category")).distinct()


def nested_lexicon(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(category, term) of nested dictionaries; names of levels joined by _, in lower case."""
    out: list[tuple[str, str]] = []
    for name, below in tree.items():
        full = f"{prefix}_{name}".lower().strip("_")
        if isinstance(below, dict):
            out += nested_lexicon(below, full)
        else:
            out += [(full, t) for t in ([below] if isinstance(below, str) else below)]
    return out


def read_yaml(lines: list[str]) -> dict:
    """Nested mappings with lists of plain or quoted words, as blocks (- word) or in brackets; the part of YAML that lexicons use."""
    rows = []
    for line in lines:
        text = line.split(" #")[0].rstrip()
        if text.strip() and not text.lstrip().startswith("#"):
            rows.append((len(text) - len(text.lstrip()), text.strip()))
    plain = lambda x: x.strip().strip("\"'")

    def block(at: int, indent: int):
        """Value of the rows from `at` that stand at least at this indent, and the row behind them."""
        if at < len(rows) and rows[at][1].startswith("-"):
            items = []
            while at < len(rows) and rows[at][0] >= indent and rows[at][1].startswith("-"):
                items.append(plain(rows[at][1][1:]))
                at += 1
            return items, at
        out, own = {}, rows[at][0] if at < len(rows) else indent
        while at < len(rows) and rows[at][0] == own and own >= indent:
            name, _, value = rows[at][1].partition(":")
            value, at = value.strip(), at + 1
            if value:
                out[plain(name)] = [plain(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else plain(value)
            else:
                below = at < len(rows) and (rows[at][0] > own or rows[at][1].startswith("-"))
                out[plain(name)], at = block(at, own if below and rows[at][1].startswith("-") else own + 1) if below else ([], at)
        return out, at

    return block(0, 0)[0] if rows else {}


def nested_lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    """Category, term of a YAML lexicon."""
    return spark.createDataFrame(nested_lexicon(read_yaml(_lines(spark, path))), "category string, term string")


def write_topics(rows: DataFrame, path: str) -> None:
    """Topics (topic_id, pos, np, clean_np, similarity) as gzip JSON, an object of one topic a line."""
    own = F.array_sort(F.collect_list(F.struct("pos", "np", "clean_np", "similarity")))
    body = F.struct(F.col("o.np").alias("noun_phrases"), F.col("o.clean_np").alias("pre_processed"), F.col("o.similarity").alias("similarity_scores"))
    rows.groupBy("topic_id").agg(own.alias("o")).select(F.to_json(F.create_map("topic_id", body)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics from JSON (gzip too): objects of id -> {noun_phrases, pre_processed, similarity_scores}, one a file or one a line, as long rows."""
    kind = "map<string, struct<noun_phrases: array<string>, pre_processed: array<string>, similarity_scores: array<double>>>"
    whole = spark.read.option("wholetext", True).text(path)
    one = F.from_json("value", kind)
    lines = F.when(F.rtrim("value", F.lit("\n")).contains("}\n{"), F.split(F.rtrim("value", F.lit("\n")), "(?<=\\})\n(?=\\{)")).otherwise(F.array("value"))
    raw = whole.select(F.explode(lines).alias("value")).select(F.explode(one).alias("topic_id", "t"))
    zipped = F.arrays_zip(F.col("t.noun_phrases").alias("np"), F.col("t.pre_processed").alias("clean_np"), F.col("t.similarity_scores").alias("similarity"))
    return raw.select("topic_id", F.posexplode(zipped).alias("pos", "x")).select("topic_id", "pos", "x.*")


def write_fellowships(groups: DataFrame, path: str) -> None:
    """One JSON line per fellowship with its sorted members."""
    groups.groupBy("fid").agg(F.array_sort(F.collect_list("entity")).alias("members")).write.mode("overwrite").json(path)


def write_graph(path: str, edges: DataFrame, dipoles: DataFrame) -> None:
    """A graph as tables: edges (e1, e2, weight), ids of its entities, dipoles."""
    from ..operators.graph import node_ids

    for name, df in (("edges", edges), ("ids", node_ids(edges)), ("dipoles", dipoles)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S10."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("edges", "ids", "dipoles")}


def attitude_table(spark: SparkSession, path: str) -> DataFrame:
    """Attitudes of a stage, with the columns that every such table has."""
    found = spark.read.parquet(path)
    missing = {"uid", "sent_ix", "attitude"}.difference(found.columns)
    if missing:
        raise ValueError(f"no attitude table: {path} lacks {sorted(missing)}")
    return found


def write_csv(df: DataFrame, path: str) -> None:
    """S11."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_edge_list(edges: DataFrame, path: str, sep: str = "\t") -> None:
    """S12/S13."""
    from ..operators.communities import edge_list

    edge_list(edges).write.mode("overwrite").option("sep", sep).csv(path)


def sentences(articles: DataFrame, text: str = "text") -> DataFrame:
    """Uid, sent_ix, sentence, from, to: lines cut after . ! or ? (and the quotes behind) but not after abbreviations and initials; offsets into the text (ends exclusive).

    The ends of lines are parts too, so that a part's place is the sum of the lengths before it; only a mark asks what is before it."""
    small_batches(articles.sparkSession)
    ending = r"[^\n]*?(?=[.!?])(?<!\b(?:" + "|".join(ABBREVIATIONS) + r"|[A-Z]))[.!?]+[\"')\]]*(?=\s|$)|[^\n]+|\n+"
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ending), F.lit(0))
    placed = F.arrow_udf(_placed, "array<struct<sentence:string,from:int,to:int>>")
    rows = articles.select("uid", F.posexplode(placed(parts)).alias("sent_ix", "s"))  # a column of its own would be worked out twice: Spark asks first whether it is empty
    return rows.select("uid", "sent_ix", "s.*")


def _placed(parts: pa.Array) -> pa.Array:
    """Parts that follow one another as (sentence, from, to): without spaces before them, ends of lines and what is blank."""
    flat, ends = parts.flatten(), np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
    own = pc.utf8_ltrim(flat, " ")
    at = np.append(0, np.cumsum(pc.utf8_length(flat).to_numpy()))
    left = pc.utf8_length(own).to_numpy()
    to = at[1:] - np.repeat(at[ends[:-1]], np.diff(ends))
    kept = (left > 0) & ~pc.starts_with(flat, "\n").to_numpy(zero_copy_only=False)
    columns = [own.filter(pa.array(kept)), pa.array((to - left)[kept], pa.int32()), pa.array(to[kept], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[ends], pa.int32()), pa.StructArray.from_arrays(columns, ["sentence", "from", "to"]))


def gazetteer_entities(sentence_rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """S21/S25 default: names of a gazetteer (name, title) that occur in a sentence as a run of its words, first occurrence.

    Runs of up to as many words as occur in the gazetteer meet it by an equi-join: the runs, many times their sentences, are never the broadcast side."""
    from ..functions.text import ngrams, words

    longest = gazetteer.agg(F.max(F.size(words("name")))).first()[0] or 1
    grams = F.flatten(F.array(*(ngrams(words(F.regexp_replace("sentence", r"[^\p{L}\p{N}\s]", "")), n) for n in range(1, longest + 1))))
    hit = sentence_rows.withColumn("name", F.explode(F.array_distinct(grams))).join(_never_the_left(gazetteer), "name")
    begin = F.call_function("locate", F.col("name"), F.col("sentence")) - 1
    return hit.withColumn("begin", begin).filter("begin >= 0").withColumn("end", F.col("begin") + F.length("name")).select("uid", "sent_ix", "title", "name", "begin", "end")


def _never_the_left(right: DataFrame, most: int = 100_000) -> DataFrame:
    """A list to join, broadcast after a count, else by a merge join: a size that Spark doesn't know (a list from the driver) would have it broadcast the rows instead."""
    return F.broadcast(right) if right.limit(most + 1).count() <= most else right.hint("merge")


def noun_phrases(sentence_rows: DataFrame) -> DataFrame:
    """S26 default: runs of words between stop words and punctuation, with offsets into the sentence."""
    from ..functions.text import STOP_WORDS

    cut = F.regexp_replace("sentence", r"(?i)\b(?:" + "|".join(STOP_WORDS) + r")\b|\s{2,}|[^\p{L}\p{N} -]", "\u0001")
    runs = F.transform(F.regexp_extract_all(cut, F.lit(r"[\p{L}\p{N}-][\p{L}\p{N} -]*"), F.lit(0)), lambda x: F.rtrim(x))  # no nested repetition: long runs need no stack
    rows = sentence_rows.withColumn("ngram", F.explode(F.array_distinct(runs)))
    begin = F.call_function("locate", F.col("ngram"), F.col("sentence")) - 1
    return rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("ngram")).select("uid", "sent_ix", "ngram", "begin", "end")
