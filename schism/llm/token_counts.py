"""Token counts (6): linear longest-match automaton.

The vocabulary is a trie with failure links; each node knows how many pieces are popped when its link is taken, so
the number of greedy longest-match word pieces comes from one pass over a word's characters, no piece being built.
A word is a run of bytes other than space and 09-0D.  With `cover` (op6) it is read behind its word mark over the whole
vocabulary: the lone mark begins words without a marked piece, and a character outside the vocabulary counts its byte
pieces.  Without, only marked pieces begin a word, and a word that they can't cover counts as one unknown piece.
Null and empty texts count nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts
from .segments import SegmentCache, cached, split_column


class LongestMatch:
    """initial: pieces that begin a word; inner: pieces that continue one; costs: of pieces that count other than one."""

    def __init__(self, initial, inner, costs=None):
        self.step: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: after a piece
        whole = [0, 0]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.step[node]:
                        self.step[node][c] = len(self.step)
                        self.step.append({})
                        whole.append(0)
                    node = self.step[node][c]
                if node > 1:
                    whole[node] = (costs or {}).get(piece, 1)
        self.fail, self.pops = [-1] * len(self.step), [0] * len(self.step)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for c, node in self.step[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.fail[node], self.pops[node] = 1, whole[node]
                        continue
                    link, popped = self.fail[parent], self.pops[parent]
                    while link >= 0 and c not in self.step[link]:
                        popped += self.pops[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[node], self.pops[node] = self.step[link][c], popped
            level = below

    def count(self, word: str) -> int:
        """Number of pieces, or -1 if there is no segmentation by greedy longest match."""
        step, fail, pops = self.step, self.fail, self.pops
        node = found = 0
        for c in word:
            while (to := step[node].get(c)) is None:
                if fail[node] < 0:
                    return -1
                found += pops[node]
                node = fail[node]
            node = to
        while node > 1:
            if fail[node] < 0:
                return -1
            found += pops[node]
            node = fail[node]
        return found


class WholeMatch(LongestMatch):
    """All pieces, marked ones among them, over a word behind its mark; other characters are their UTF-8 bytes (one unknown piece without byte pieces)."""

    def __init__(self, own, has_bytes: bool = True):
        own, self.has_bytes = set(own), has_bytes
        self.outside = {c for piece in own for c in piece} - own
        super().__init__((), own | self.outside, {c: self.cost(c) for c in self.outside})

    def cost(self, c: str) -> int:
        return len(c.encode("utf-8", "surrogatepass")) if self.has_bytes else 1

    def count(self, word: str) -> int:
        """Number of pieces, negative if the word has a character that is no piece."""
        step, fail, pops = self.step, self.fail, self.pops
        node, found, known = 1, 0, True
        for c in "▁" + word:
            while (to := step[node].get(c)) is None:
                if node == 1:
                    found, known, to = found + self.cost(c), False, 1
                    break
                found += pops[node]
                node = fail[node]
            node = to
        while node > 1:
            found += pops[node]
            node = fail[node]
        return found if known and self.outside.isdisjoint(word) else -found


def whole_pieces(model_file: str) -> tuple[list[str], bool]:
    """All text pieces of a sentencepiece vocabulary, the lone word mark among them, and whether it has the byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [model.id_to_piece(i) for i in ids if not model.is_byte(i)], sum(map(model.is_byte, ids)) == 256


def pieces(model_file: str) -> tuple[list[str], list[str]]:
    """Word-starting and word-continuing pieces of a sentencepiece vocabulary (control and byte pieces left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in own if p[0] == "▁" and len(p) > 1], [p for p in own if p[0] != "▁"]


def counts(docs: DataFrame, model_file: str, cover: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_tokens, n_unknown.  No shuffle.

    n_unknown: words that the vocabulary can't cover, counting one each; with cover, words with a character outside it.
    """

    def run(batches):
        def make():
            automaton = WholeMatch(*whole_pieces(model_file)) if cover else LongestMatch(*pieces(model_file))
            return SegmentCache(lambda segments: [automaton.count(s.decode("utf-8", "surrogatepass")) for s in segments])

        cache = cached(("pieces", model_file, cover), make)
        for block in blocks(batches):
            texts = split_column(block.column("text"))
            known = cache.load(set().union(*texts))
            found = [[known[s] for s in t] for t in texts]
            unknown = [sum(n < 0 for n in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(map(abs, f)) for f in found], pa.int64()), pa.array(unknown, pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
