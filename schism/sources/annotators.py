"""Pluggable annotators and encoders (ids S3, S23, S24, L11): a model that `load` brings up once per task works on Arrow batches.

The defaults need no model, so every step runs without downloads.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Auxiliary verbs at which the default extractor divides a sentence.
VERBS = ("is", "are", "was", "were", "has", "have", "had")


def annotate(rows: DataFrame, load: Callable[[], Callable[[list], list]], name: str, kind: str, column: str = "sentence") -> DataFrame:
    """rows with a column `name` of type `kind`: what the function that `load` returns makes of a list of the column's values."""
    schema = f"{rows.schema.simpleString()[7:-1]}, {name}:{kind}"

    def run(frames):
        work = load()
        for frame in frames:
            yield frame.assign(**{name: pd.Series(list(work(frame[column].tolist())), index=frame.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def fetch(urls: DataFrame, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """S3: url, html, error: each address is asked once; a failure leaves the name of its error instead of a page."""

    def run(frames):
        get = load()
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, get(url), None))
                except Exception as e:  # what one address does must not end the others
                    rows.append((url, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """S3 offline: addresses with the pages (url, html) that were fetched before."""
    return urls.select("url").join(pages, "url")


def _divided(sentence: str | None):
    return re.match(rf"(?s)(.*?) ({'|'.join(VERBS)}) (.*)$", sentence or "")


def divided_triples(sentences: list) -> list:
    """Default of S23: what stands before and behind the first auxiliary verb."""
    found = map(_divided, sentences)
    return [[dict(zip(("subject", "relation", "object"), m.groups()))] if m else [] for m in found]


def open_triples(rows: DataFrame, load=lambda: divided_triples, column: str = "sentence") -> DataFrame:
    """Adds `triples` (subject, relation, object)."""
    return annotate(rows, load, "triples", "array<struct<subject:string,relation:string,object:string>>", column)


def divided_frames(sentences: list) -> list:
    """Default of S24."""
    return [[{"verb": t["relation"], "arg0": t["subject"], "arg1": t["object"]} for t in ts] for ts in divided_triples(sentences)]


def semantic_roles(rows: DataFrame, load=lambda: divided_frames, column: str = "sentence") -> DataFrame:
    """Adds `frames` (verb, arg0, arg1)."""
    return annotate(rows, load, "frames", "array<struct<verb:string,arg0:string,arg1:string>>", column)


def hashed_words(size: int = 64):
    """Default of L11: counts of words by their crc32, of unit length; a text without words is the zero vector."""

    def work(sentences: list) -> list:
        out = []
        for s in sentences:
            v = np.zeros(size)
            for w in (s or "").lower().split():
                v[zlib.crc32(w.encode("utf-8", "surrogatepass")) % size] += 1
            out.append((v / max(np.sqrt((v * v).sum()), 1e-12)).tolist())
        return out

    return work


def encode(rows: DataFrame, load=hashed_words, column: str = "sentence") -> DataFrame:
    """Adds `embedding`."""
    return annotate(rows, load, "embedding", "array<double>", column)
