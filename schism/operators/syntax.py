"""Syntax: dependency paths, part-of-speech counts, parse trees, arborescences (ids X20, X27, X33, X34, G21).

Parsers and taggers are pluggable: a function from a sentence to tokens.  The defaults need no model: a tagger by
word lists and endings, and a chain of tokens as dependencies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.batches import pieces, small_batches, structs
from ..functions.text import STOP_WORDS

TOKEN = "array<struct<text:string,lemma:string,pos:string,head:int,dep:string>>"
TOKEN_TYPE = ArrayType(StructType([StructField(c, IntegerType() if c == "head" else StringType()) for c in ("text", "lemma", "pos", "head", "dep")]))
#: Closed classes of English by Penn tag, and endings of open ones in the order they are tried.
_CLOSED = {"DT": ("the", "a", "an", "this", "that"), "IN": ("of", "in", "for", "on", "with", "at", "by", "from"), "CC": ("and", "or", "but"), "PRP": ("he", "she", "it", "they", "we", "i", "you"), "TO": ("to",), "MD": ("will", "can", "may", "must")}
_ENDINGS = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("s", "NNS"))
_WORD = {w: tag for tag, own in _CLOSED.items() for w in own}


def chain_parser(sentence: str) -> list[tuple]:
    """Default parser: every token depends on the one before."""
    import re

    words = re.findall(r"\w+|[^\w\s]", sentence or "")
    return [(w, w.lower(), tag(w), max(i - 1, 0), "dep") for i, w in enumerate(words)]


def tag(word: str) -> str:
    """Default tagger."""
    low = word.lower()
    if not low[:1].isalnum():
        return "."
    if low.isdigit():
        return "CD"
    return _WORD.get(low) or next((t for e, t in _ENDINGS if low.endswith(e) and len(low) > len(e) + 2), "NNP" if word[0].isupper() else "NN")


def parse(sentences: DataFrame, parser: Callable[[str], list[tuple]] = chain_parser, column: str = "sentence") -> DataFrame:
    """Adds `tokens` by a parser, a bounded piece of text at a time: a batch of whole tokens would grow with the rows of a task."""
    small_batches(sentences.sparkSession)
    rows = sentences.drop("tokens")
    schema = StructType([*rows.schema.fields, StructField("tokens", TOKEN_TYPE)])
    kind = to_arrow_type(schema["tokens"].dataType)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for start, stop in pieces(texts):
                found = structs([parser(s) for s in texts.slice(start, stop - start).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, found], [*batch.schema.names, "tokens"])

    return rows.mapInArrow(run, schema)


def pos_counts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Key, tag, n, share of the key's tokens."""
    rows = parsed.select(*keys, F.explode("tokens.pos").alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    total = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    return rows.join(total, keys).select(*keys, "tag", "n", (F.col("n") / F.col("total")).alias("share"))


#: Derived counts of X20: sums of tags, and forms of pronouns.
_TENSES = {"future": ("MD",), "past": ("VBN", "VBD"), "present": ("VBZ", "VBG", "VBP")}
_PRONOUNS = {"i": ("i",), "we": ("we",), "you": ("you",), "he_she": ("he", "she")}


def derived_counts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key words of future, past and present tense, pronouns, quotation marks and quoted passages (half of the marks, rounded up)."""
    t = parsed.select(*keys, F.explode("tokens").alias("t")).select(*keys, "t.pos", F.lower("t.text").alias("text"))
    count = lambda c: F.sum(c.cast("int"))
    quotes = count(F.col("text").isin('"', "''", "``", "“", "”"))
    out = {f"pos_{k}_tense": count(F.col("pos").isin(*v)) for k, v in _TENSES.items()}
    out |= {f"pos_{k}": count((F.col("pos") == "PRP") & F.col("text").isin(*v)) for k, v in _PRONOUNS.items()}
    out |= {"quotes": quotes, "quoted": F.ceil(quotes / 2)}
    return t.groupBy(*keys).agg(*(v.alias(k) for k, v in out.items()))


def tag_sequence(parsed: DataFrame) -> DataFrame:
    """Adds `tags`, the tags of the tokens as a text."""
    return parsed.withColumn("tags", F.array_join("tokens.pos", " "))


def paths_between(tokens, source: list[int], target: list[int], expand=("ccomp", "compound", "conj"), stop=STOP_WORDS) -> list[list[str]]:
    """Texts on the simple paths of the undirected dependency graph from source to target tokens, ends and stop words left out.

    Where the two are joined directly by one of `expand`, the neighbours of both ends are taken instead."""
    near: dict[int, list[int]] = {i: [] for i in range(len(tokens))}
    kinds = {}
    for i, t in enumerate(tokens):
        if t["head"] != i:
            near[i].append(t["head"])
            near[t["head"]].append(i)
            kinds[frozenset((i, t["head"]))] = t["dep"]
    ends, out = set(source) | set(target), []
    for s in source:
        for g in target:
            for path in _simple_paths(near, s, g):
                if len(path) == 2 and kinds.get(frozenset(path)) in expand:
                    path = [s, *(x for x in near[s] + near[g] if x not in ends), g]
                words = [tokens[x]["text"] for x in path if x not in ends and tokens[x]["text"].lower() not in stop]
                if words and words not in out:
                    out.append(words)
    return out


def _simple_paths(near, start, goal):
    """All of them; every token has one head, so a tree has one."""
    stack = [(start, [start])]
    while stack:
        x, path = stack.pop()
        if x == goal:
            yield path
            continue
        stack += [(y, [*path, y]) for y in sorted(near[x], reverse=True) if y not in path]


def attitude_paths(pairs: DataFrame) -> DataFrame:
    """X34 on rows with tokens, source and target (arrays of token numbers): adds `paths`."""

    small_batches(pairs.sparkSession)

    @F.arrow_udf("array<array<string>>")
    def run(tokens: pa.Array, source: pa.Array, target: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.list_(pa.string())))]
        for start, stop in pieces(tokens, 1 << 14):
            own = (c.slice(start, stop - start).to_pylist() for c in (tokens, source, target))
            out.append(pa.array([paths_between(t, s, g) for t, s, g in zip(*own)], out[0].type))
        return pa.concat_arrays(out)

    return pairs.withColumn("paths", run("tokens", "source", "target"))


def read_tree(text: str):
    """A bracketed parse, (S (NP I) (VP go)), as nested lists [label, child, ...] with strings as leaves."""
    stack: list[list] = [[]]
    for part in text.replace("(", " ( ").replace(")", " ) ").split():
        if part == "(":
            stack.append([])
        elif part == ")":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(part)
    return stack[0][0] if stack[0] else []


def tree_depth(tree) -> int:
    return 1 + max((tree_depth(c) for c in tree[1:]), default=0) if isinstance(tree, list) else 0


def phrases(tree, label: str) -> list:
    """Subtrees with a label, outer ones first."""
    if not isinstance(tree, list):
        return []
    return ([tree] if tree[0] == label else []) + [x for c in tree[1:] for x in phrases(c, label)]


def complexity(tree) -> dict[str, float]:
    """Numbers and mean depths of noun and verb phrases, depth of the tree."""
    out = {"depth": float(tree_depth(tree))}
    for label in ("NP", "VP"):
        own = [tree_depth(p) for p in phrases(tree, label)]
        out |= {f"{label.lower()}_count": float(len(own)), f"{label.lower()}_depth": float(np.mean(own)) if own else 0.0}
    return out


def measured(text: str) -> tuple[int, dict[str, float]]:
    """Number of words of a bracketed parse and its complexity, in one pass over the text (no tree, no recursion).

    As in a tree, what stands first within a bracket is its label and isn't measured."""
    parts = text.replace("(", " ( ").replace(")", " ) ").split()
    count = {"NP": 0, "VP": 0}
    total = {"NP": 0, "VP": 0}
    words, top, above = 0, None, []  # above: of each open bracket the label (None before it is read), the height of its children, the counts before it
    label, height = None, -1
    for part in parts:
        if part == "(":
            above.append((label, height, words, *count.values(), *total.values()))
            label, height = None, 0
        elif part == ")":
            if not above:
                break
            done = height + 1
            if label in count:
                count[label] += 1
                total[label] += done
            label, height, *before = above.pop()
            if not above:
                top = done
                break
            if label is None:  # a bracket in the place of a label
                words, count["NP"], count["VP"], total["NP"], total["VP"] = before
                label = ""
            elif done > height:
                height = done
        elif not above:
            words, top = 1, 0
            break
        elif label is None:
            label = part
        else:
            words += 1
    if top is None:
        tree = read_tree(text)
        return len(leaves(tree)), complexity(tree)
    out = {"depth": float(top)}
    for kind, n in count.items():
        out |= {f"{kind.lower()}_count": float(n), f"{kind.lower()}_depth": total[kind] / n if n else 0.0}
    return words, out


def complexities(rows: DataFrame, column: str = "parse", most: int = 70) -> DataFrame:
    """X27 on bracketed parses, a string or an array with one for each sentence: adds depth, np_count, np_depth, vp_count, vp_depth.

    Means over the sentences; sentences of over `most` words aren't measured: with no other, all are null.  No parse gives 0."""
    names = ("depth", "np_count", "np_depth", "vp_count", "vp_depth")
    single = dict(rows.dtypes)[column] == "string"

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(parses: pd.Series) -> pd.DataFrame:
        out = []
        for own in parses:
            trees = [measured(p) for p in ([own] if single else own if own is not None else []) if p and p.strip()]
            short = [c for words, c in trees if words <= most]
            out.append([float(np.mean([c[n] for c in short])) if short else None if trees else 0.0 for n in names])
        return pd.DataFrame(out, columns=list(names), dtype=object).astype("float64")

    return rows.withColumn("__c", run(column)).select(*rows.columns, "__c.*")


def tree_places(rows: DataFrame, column: str, path: tuple[int, ...]) -> DataFrame:
    """X33 on bracketed parses: adds the leaves left and right of the node at a path of child numbers, and the tree's structural hash."""

    @F.pandas_udf("left int, right int, shape long")
    def run(parses: pd.Series) -> pd.DataFrame:
        trees = [read_tree(p) for p in parses]
        return pd.DataFrame([(*leaves_beside(t, path), tree_hash(t)) for t in trees], columns=["left", "right", "shape"])

    return rows.withColumn("__p", run(column)).select(*rows.columns, "__p.*")


def leaves(tree) -> list[str]:
    return [x for c in tree[1:] for x in leaves(c)] if isinstance(tree, list) else [tree]


def leaves_beside(tree, path: tuple[int, ...]) -> tuple[int, int]:
    """Number of leaves left and right of the node at a path of child numbers."""
    left = right = 0
    for k in path:
        left += sum(len(leaves(c)) for c in tree[1 : k + 1])
        right += sum(len(leaves(c)) for c in tree[k + 2 :])
        tree = tree[k + 1]
    return left, right


def tree_hash(tree) -> int:
    """Equal for trees of equal shape and labels."""
    import zlib

    return zlib.crc32(repr(tree).encode())


def arborescence(scores: np.ndarray, root: int) -> list[tuple[int, int]]:
    """Greedy spanning arborescence: from the root the best edge (parent, child) to a new node, again and again.

    Ties: the parent that was reached first, then the smaller child.  Every node keeps its best edge so far, so a step costs a row."""
    n, edges = len(scores), []
    best, parent, reached = np.array(scores[root], float), np.full(n, root), np.zeros(n, int)
    outside = np.ones(n, bool)
    outside[root] = False
    for turn in range(1, n):
        rest = np.flatnonzero(outside)
        top = rest[best[rest] == best[rest].max()]
        child = int(top[reached[parent[top]].argmin()])
        edges.append((int(parent[child]), child))
        outside[child], reached[child] = False, turn
        nearer = outside & (scores[child] > best)
        best[nearer], parent[nearer] = scores[child][nearer], child
    return edges


def arborescence_stats(edges: list[tuple[int, int]], root: int) -> dict[str, float]:
    """Height, leaves and mean distance to the parent in sentence positions."""
    depth, parents = {root: 0}, {p for p, _ in edges}
    for p, c in edges:
        depth[c] = depth[p] + 1
    return {"height": float(max(depth.values())), "leaves": float(sum(x not in parents for x in depth)), "mean_distance": float(np.mean([abs(p - c) for p, c in edges])) if edges else 0.0}


def group_arborescences(rows: DataFrame, key: str, position: str, vector: str, most: int = 1_000) -> DataFrame:
    """G21 for sentences: per key (at most `most` tokens, by position; longer ones are refused) the arborescence of the tokens' cosines from the first one.

    One row per edge: key, parent, child, and the tree's height, leaves and mean distance."""
    kind = dict(rows.dtypes)[key]
    if not rows.groupBy(key).count().filter(F.col("count") > most).isEmpty():
        raise ValueError(f"a sentence of over {most} tokens")

    def run(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(position, ignore_index=True)
        m = np.stack([np.asarray(v, float) for v in frame[vector]])
        m = m / np.maximum(np.sqrt((m * m).sum(1)), 1e-12)[:, None]
        edges = arborescence(m @ m.T, 0)
        stats = arborescence_stats(edges, 0)
        return pd.DataFrame([(name[0], p, c, *stats.values()) for p, c in edges], columns=[key, "parent", "child", *stats])

    return rows.select(key, position, vector).groupBy(key).applyInPandas(run, f"{key} {kind}, parent int, child int, height double, leaves double, mean_distance double")


def adjacent_scores(tokens: list[str]) -> np.ndarray:
    """Default of L7: the nearer two tokens stand, the likelier is an edge between them."""
    at = np.arange(len(tokens))
    return 1 / (1 + np.abs(at[:, None] - at[None, :]))


def scored_trees(rows: DataFrame, load=lambda: adjacent_scores, column: str = "tokens", root: int = 0) -> DataFrame:
    """Adds heads, per token the position of its parent (-1 for the root): the arborescence of the scores (parent, child) that a model gives a list of tokens.

    `load` brings the model up once per task.  Null and empty lists have no heads."""
    schema = f"{rows.schema.simpleString()[7:-1]}, heads:array<int>"

    def heads(model, tokens) -> list[int]:
        out = [-1] * len(tokens)
        for parent, child in arborescence(np.asarray(model(tokens), float), root) if len(tokens) else ():
            out[child] = parent
        return out

    def run(frames):
        model = load()
        for frame in frames:
            yield frame.assign(heads=pd.Series([heads(model, list(t) if t is not None else []) for t in frame[column]], index=frame.index, dtype=object))

    return rows.mapInPandas(run, schema)
