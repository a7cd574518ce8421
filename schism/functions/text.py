
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces, structs

#: English contractions and their expansions, in the order in which they apply.
CONTRACTIONS = (
    (r"(\b)([Aa]re|[Cc]ould|[Dd]id|[Dd]oes|[Dd]o|[Hh]ad|[Hh]as|[Hh]ave|[Ii]s|[Mm]ight|[Mm]ust|[Ss]hould|[Ww]ere|[Ww]ould)n't", "$1$2 not"),
    (r"(\b)([Hh]e|[Ii]|[Ss]he|[Tt]hey|[Ww]e|[Ww]hat|[Ww]ho|[Yy]ou)'ll", "$1$2 will"),
    (r"(\b)([Tt]hey|[Ww]e|[Ww]hat|[Ww]ho|[Yy]ou)'re", "$1$2 are"),
    (r"(\b)([Ii]|[Ss]hould|[Tt]hey|[Ww]e|[Ww]hat|[Ww]ho|[Ww]ould|[Yy]ou)'ve", "$1$2 have"),
    (r"(\b)([Cc]a)n't", "$1$2n not"),
    (r"(\b)([Ii])'m", "$1$2 am"),
    (r"(\b)([Ll]et)'s", "$1$2 us"),
    (r"(\b)([Tt]here)'s", "$1$2 is"),
    (r"(\b)([Ww])on't", "$1$2ill not"),
    (r"(\b)([Ss])han't", "$1$2hall not"),
    (r"(\b)([Yy])(?:'all|a'll)", "$1$2ou all"),
)
#: A short list of English function words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_quotes(c) -> Column:
    """Curly quotes and long dashes to plain ones; double backticks to two apostrophes, single ones to one."""
    c = F.replace(_c(c), F.lit("``"), F.lit("''"))
    return F.translate(c, "`‘’“”–—", "'''\"\"--")


def expand_contractions(c) -> Column:
    """X2."""
    c = _c(c)
    for pattern, to in CONTRACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def preprocess(c) -> Column:
    """Quotes, contractions, then line breaks to spaces."""
    return F.regexp_replace(expand_contractions(normalise_quotes(c)), r"[\r\n]", " ")


def collapse(c) -> Column:
    """X8."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def words(c) -> Column:
    """Runs of characters other than white space; null gives an empty list."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\s+"), lambda w: w != "")


def strip_punctuation(c) -> Column:
    """Punctuation to spaces; a hyphen between word characters goes without a trace of a gap."""
    c = _c(c)
    for _ in range(2):  # neighbouring matches share a character
        c = F.regexp_replace(c, r"(\w)-(\w)", "$1$2")
    return F.regexp_replace(c, PUNCTUATION, " ")


def clean_phrase(c, stop_words=STOP_WORDS, lemma=None) -> Column:
    """Lemma (a pluggable column function), lower case, punctuation, white space, digit-only and stop words."""
    c = lemma(_c(c)) if lemma else _c(c)
    kept = F.filter(words(strip_punctuation(F.lower(c))), lambda w: ~w.rlike(r"^\d+$") & ~w.isin(*stop_words))
    return F.array_join(kept, " ")


def phrase_has_content(c, stop_words=STOP_WORDS) -> Column:
    """Whether anything but punctuation and stop words is left."""
    return F.exists(words(strip_punctuation(F.lower(_c(c)))), lambda w: ~w.isin(*stop_words))


def punctuation_sequence(c) -> Column:
    """What is left without letters, digits and white space."""
    return F.regexp_replace(_c(c), r"[A-Za-z0-9\s]", "")


def stop_word_sequence(c, stop_words=STOP_WORDS) -> Column:
    """The stop words of a text in order."""
    return F.array_join(F.filter(words(F.lower(_c(c))), lambda w: w.isin(*stop_words)), " ")


def ascii_fold(c) -> Column:
    """Characters outside ASCII dropped."""
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")


def char_count(c, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(_c(c)) - F.length(F.replace(_c(c), F.lit(char), F.lit("")))


#: The 32 punctuation characters of ASCII, in their order.
MARKS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))


def punctuation_counts(c, marks: str = MARKS) -> dict[str, Column]:
    """A count per mark and their sum, fresh for every row."""
    out = {f"pnc_{i}": char_count(c, m) for i, m in enumerate(marks)}
    other = "[^" + "".join("\\" + m for m in marks) + "]"
    return out | {"pnc_total": F.length(F.regexp_replace(_c(c), other, ""))}


def title_slug(c) -> Column:
    """punctuation to spaces, runs of spaces to a hyphen, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(c), PUNCTUATION, " "), " +", "-"))


def url_host(c) -> Column:
    """authority of a URL, user and port included; empty when there is none."""
    return F.coalesce(F.try_parse_url(_c(c), F.lit("AUTHORITY")), F.lit(""))


def url_path(c) -> Column:
    return F.coalesce(F.try_parse_url(_c(c), F.lit("PATH")), F.lit(""))


def keyword_count(c, keywords) -> Column:
    """matches of any keyword (regular expressions, case-sensitive)."""
    return F.regexp_count(_c(c), F.lit("|".join(keywords)))


def ngrams(tokens, n: int) -> Column:
    """N-grams of a token list, joined by spaces; none when it is shorter."""
    t = _c(tokens)
    out = t
    for k in range(1, n):  # lists zipped with their shifts: the token list is worked out n times, not once per gram
        out = F.zip_with(out, F.slice(t, k + 1, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) >= n, F.slice(out, 1, F.size(t) - (n - 1))).otherwise(F.array().cast("array<string>"))


def first_span(text, target) -> Column:
    """struct(begin, end) of the first occurrence, null if absent."""
    at = F.instr(_c(text), target) if isinstance(target, str) else F.call_function("instr", _c(text), _c(target))
    return F.when(at > 0, F.struct((at - 1).alias("begin"), (at - 1 + F.length(_c(target) if not isinstance(target, str) else F.lit(target))).alias("end")))


def replace_spans(text, spans, by) -> Column:
    """Replace each span (begin, end; ends exclusive, not overlapping) by a text; a span behind the end of the text goes to its end.

    `by` is a column function of the span.  Pieces are cut from the text itself, never from a replacement."""
    c = _c(text)
    start = F.struct(F.lit(0).alias("at"), F.when(c.isNotNull(), F.lit("")).alias("out"))

    def add(acc, s):
        kept = F.substr(c, acc["at"] + 1, F.greatest(s["begin"].cast("int") - acc["at"], F.lit(0)))
        return F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], kept, by(s)).alias("out"))

    return F.aggregate(F.array_sort(_c(spans)), start, add, lambda acc: F.concat(acc["out"], F.substr(c, acc["at"] + 1, F.length(c))))


def representation(phrases, n: int = 3) -> Column:
    """First phrases of a topic."""
    return F.array_join(F.slice(_c(phrases), 1, n), ", ")


def wiki_links(c) -> Column:
    """Targets and labels in [[target|label]], flattened."""
    inner = F.regexp_extract_all(_c(c), F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1))
    return F.flatten(F.transform(inner, lambda x: F.split(x, r"\|")))


def readability(docs: DataFrame, text: str = "text", easy=STOP_WORDS) -> DataFrame:
    """Readability indices (ri_) from counts of sentences, words, letters and vowel groups.

    Difficult words have two vowel groups and aren't in `easy`; linsear looks at the first hundred words."""
    c = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("__w", words(F.lower(c)))
    groups = F.transform("__w", lambda w: F.regexp_count(w, F.lit("[aeiouy]+")))  # once for each word
    base = base.withColumns({"__g": groups, "__s": F.greatest(F.regexp_count(c, F.lit(r"[.!?]+")), F.lit(1)), "__l": F.length(F.regexp_replace(c, "[^A-Za-z]", ""))})
    some = lambda a, f: F.size(F.filter(a, f)).cast("double")
    hard = F.size(F.filter(F.zip_with("__w", "__g", lambda w, g: (g >= 2) & ~w.isin(*easy)), lambda x: x))
    head = F.slice("__g", 1, 100)
    ends = F.greatest(F.regexp_count(F.array_join(F.slice("__w", 1, 100), " "), F.lit(r"[.!?]+")), F.lit(1))
    base = base.select(
        *docs.columns, F.size("__w").cast("double").alias("__n"), F.col("__s").cast("double").alias("__s"), F.col("__l").cast("double").alias("__l"), F.aggregate("__g", F.lit(0), lambda a, g: a + g).alias("__y"),
        some("__g", lambda g: g >= 3).alias("__many"), hard.alias("__hard"), some("__w", lambda w: F.length(w) > 6).alias("__long"), ((F.size(head) + 2 * some(head, lambda g: g >= 3)) / ends).alias("__lw"),
    )
    n, s, letters, y, many, long, lw = (F.col(f"__{k}") for k in ("n", "s", "l", "y", "many", "long", "lw"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_sentence, per_word, share = n / s, ratio(y.cast("double"), n), 100 * ratio(F.col("__hard").cast("double"), n)
    return base.select(
        *docs.columns, y.alias("ri_syllables"), (206.835 - 1.015 * per_sentence - 84.6 * per_word).alias("ri_flesch_ease"), (1.043 * F.sqrt(30 * many / s) + 3.1291).alias("ri_smog"),
        (0.39 * per_sentence + 11.8 * per_word - 15.59).alias("ri_flesch_grade"), (5.88 * ratio(letters, n) - 29.6 * ratio(s, n) - 15.8).alias("ri_coleman_liau"), (4.71 * ratio(letters, n) + 0.5 * per_sentence - 21.43).alias("ri_ari"),
        (0.1579 * share + 0.0496 * per_sentence + F.when(share > 5, 3.6365).otherwise(0.0)).alias("ri_dale_chall"), F.col("__hard").alias("ri_difficult_words"), F.when(lw > 20, lw / 2).otherwise((lw - 2) / 2).alias("ri_linsear"),
        (0.4 * (per_sentence + 100 * ratio(many, n))).alias("ri_fog"), (per_sentence + 100 * ratio(long, n)).alias("ri_lix"),
    )


def surface(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """18 surface features (sf_): counts, shares of characters in words, and means over the sentences (pieces between . ! ? and line ends that hold a word).

    Words lose the punctuation around them; each sentence counts one stop word more than it has; no sentence counts as one."""
    c = F.coalesce(F.col(text), F.lit(""))
    around = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
    pieces = F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.filter(F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, around, "")), lambda w: w != ""))
    rows = docs.withColumns({"__lines": char_count(c, "\n") + 1, "__ws": F.filter(pieces, lambda ws: F.size(ws) > 0)})
    left = lambda ws, drop: F.length(F.regexp_replace(F.array_join(ws, ""), drop, ""))
    count = lambda ws, f: F.size(F.filter(ws, f))

    def measured(ws):
        return F.struct(
            F.size(ws).alias("n"), F.length(F.array_join(ws, "")).alias("chars"), left(ws, "[^A-Za-z]").alias("alpha"), left(ws, "[^A-Z]").alias("upper"), left(ws, "[^0-9]").alias("digit"),
            count(ws, lambda w: w.rlike("[A-Z]") & ~w.rlike("[a-z]")).alias("caps"), count(ws, lambda w: w.rlike("^[a-z]")).alias("low"), count(ws, lambda w: w.rlike("^[A-Z]") & w.rlike("[a-z]")).alias("up"),
            (count(ws, lambda w: w.isin(*stop_words)) + 1).alias("stops"),
        )

    rows = rows.withColumn("__m", F.transform("__ws", measured)).drop("__ws")
    total = lambda k: F.aggregate(F.col(f"__m.{k}"), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumns({f"__{k}": total(k) for k in ("n", "chars", "alpha", "upper", "digit", "caps", "low", "up", "stops")})
    sentences = F.greatest(F.size("__m"), F.lit(1))
    mean = lambda k: F.aggregate("__m", F.lit(0.0), lambda a, m: a + m[k] / m["n"]) / sentences
    share = lambda k: F.coalesce(F.try_divide(F.col(f"__{k}").cast("double"), F.col("__chars").cast("double")), F.lit(0.0))
    own = {"sf_sentences": sentences, "sf_words": F.col("__n"), "sf_chars": F.col("__chars"), "sf_begin_upper": F.col("__up"), "sf_begin_lower": F.col("__low"), "sf_all_caps": F.col("__caps"), "sf_stop_words": F.col("__stops"), "sf_lines": F.col("__lines")}
    own |= {"sf_alphabetic": share("alpha"), "sf_uppercase": share("upper"), "sf_digit": share("digit"), "sf_chars_per_word": mean("chars"), "sf_words_per_sentence": F.col("__n") / sentences, "sf_chars_per_sentence": F.col("__chars") / sentences}
    own |= {f"sf_{k}_per_sentence": mean(v) for k, v in (("begin_upper", "up"), ("begin_lower", "low"), ("all_caps", "caps"), ("stop_words", "stops"))}
    return rows.select(*docs.columns, *(v.alias(k) for k, v in own.items()))


def ngram_spans(c, n: int, stop_words=STOP_WORDS) -> Column:
    """Array of (ngram, from, to): n tokens (words, or single marks) as they stand in the text, offsets with exclusive ends; grams of marks alone or of stop words alone are left out.

    In Arrow batches, a bounded piece of text at a time: no built-in function gives the places of matches in linear time."""
    token = re.compile(r"\w+|[^\w\s]")

    kind = pa.list_(pa.struct([("ngram", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))

    def grams(text) -> list[tuple]:
        found = [(m.start(), m.end(), m.group()) for m in token.finditer(text or "")]
        mark = [(w in stop_words, w[0].isalnum() or w[0] == "_") for _, _, w in found]
        rows = []
        for i in range(len(found) - n + 1):
            if any(word for _, word in mark[i : i + n]) and not all(stop for stop, _ in mark[i : i + n]):
                a, b = found[i][0], found[i + n - 1][1]
                rows.append((text[a:b], a, b))
        return rows

    @F.arrow_udf("array<struct<ngram:string,from:int,to:int>>")
    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(start, stop - start).to_pylist() for start, stop in pieces(texts))
        return pa.concat_arrays([pa.array([], kind), *(structs([grams(t) for t in own], kind) for own in parts)])

    return run(_c(c))


def contains(items, item) -> Column:
    """Whether a list holds an item; false for null."""
    return F.coalesce(F.array_contains(_c(items), _c(item) if isinstance(item, Column) else F.lit(item)), F.lit(False))
