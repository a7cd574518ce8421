"""Token-ID output (3): Parquet files of list columns in ascending doc_id order.

Ids are dictionary encoded (delta encoding where a dictionary grows too large), row groups and pages have set
sizes, and page indexes are written, so a reader can fetch a few documents' ids, or metadata alone, without the
rest.  `part` and `local_start` place each document among the ids of its file; `offsets` adds the files before it.

Defined cases: null text is empty and holds the end id alone; null doc_ids come first; repeated rows are written
as often as they occur, in any order among themselves; an empty table leaves one empty file.
"""

from __future__ import annotations

import array
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, new_path, same_bytes, spans, text_bytes, texts, word_hashes
from .segments import byte_alphabet, cached, normal_form, pretokens

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


class Encoder:
    """The tokenizers library over segments: value is the little-endian 32-bit ids.

    A segment is cut into the pre-tokens that the library would cut it into, and the library's BPE model encodes
    each, most of them but once.  A segment with an added token, or a tokenizer of another make, goes to the library
    as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        self.pattern, self.known, self.alphabet = self._cut(spec), {}, byte_alphabet()
        self.model = self.tokenizer.model

    @staticmethod
    def _cut(spec: dict):
        """The pattern of pre-tokens, if the file has the parts that this class stands in for."""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        import regex

        return regex.compile(parts[0]["pattern"]["Regex"])

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.known.get(word)
        if ids is None:
            symbols = word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])
            ids = array.array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = ids
        return ids

    def __call__(self, segments: list[bytes]):
        tokenize, new = self.model.tokenize, array.array
        for s in segments:
            if self.pattern is not None and s.isalpha():  # ASCII letters: one pre-token
                yield new("I", [t.id for t in tokenize(s.decode().lower())]).tobytes()
                continue
            text = s.decode("utf-8", "surrogatepass")
            if self.pattern is None or any(a in text for a in self.added):
                yield new("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(self._word, pretokens(self.pattern, normal_form(text))))


class IdTable:
    """Ids of the segments seen so far, by their 64-bit hash: sorted arrays, 40 bytes, the segment and its ids each.

    All segments of a block are looked up at once; of each new one the encoder is asked once.  Every hit is compared
    byte by byte; a block with segments of equal hash and different bytes is encoded segment by segment.  At `most`
    segments the table starts anew.
    """

    def __init__(self, encoder, most: int = 1_500_000):
        self.encoder, self.most = encoder, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.held, self.places, self.lengths = np.zeros(1 << 16, np.uint8), 0, np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, at: np.ndarray, keys: np.ndarray, segments: list[bytes]) -> None:
        values = list(self.encoder(segments))
        sizes = np.fromiter((len(v) // 4 for v in values), np.int32, len(values))
        new = np.frombuffer(b"".join(values), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        text, lengths = np.frombuffer(b"".join(segments), np.uint8), np.fromiter(map(len, segments), np.int32, len(segments))
        if self.held + len(text) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.held], np.zeros(max(len(self.bytes), len(text)), np.uint8)])
        self.bytes[self.held : self.held + len(text)] = text
        self.places, self.lengths = np.concatenate([self.places, self.held + np.cumsum(lengths) - lengths]), np.concatenate([self.lengths, lengths])
        self.held += len(text)
        slots = np.arange(len(self.sizes), len(self.sizes) + len(keys), dtype=np.int32)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(new)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the borders between texts."""
        starts, ends, first = spans(raw, offsets)
        kinds, index, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        length, own = ends - starts, index[inverse]
        if not ((length == length[own]).all() and same_bytes(raw, starts, raw, starts[own], length).all()):
            return self._each(raw, starts, ends, first, end_id)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != kinds[inside]
        known, held = index[~new], self.slots[at[~new]]
        if not ((length[known] == self.lengths[held]).all() and same_bytes(raw, starts[known], self.bytes[: self.held], self.places[held], length[known]).all()):
            return self._each(raw, starts, ends, first, end_id)
        if new.any():
            data, which = raw.tobytes(), index[new]
            self._add(at[new], kinds[new], [data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())])
            at = np.searchsorted(self.keys, kinds)
        slot = self.slots[at][inverse]
        size = self.sizes[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[slot] - upto[:-1], size) + np.arange(upto[-1])]
        borders = upto[first]
        return np.insert(ids, borders[1:], end_id), borders + np.arange(len(borders))

    def _each(self, raw, starts, ends, first, end_id):
        """As encode, without the table."""
        data = raw.tobytes()
        values = [np.frombuffer(v, "<u4") for v in self.encoder([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])]
        borders = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)[first]
        return np.insert(np.concatenate(values), borders[1:], end_id), borders + np.arange(len(borders))


def _encode(path: str, end_id: int):
    def run(batches):
        table = cached(("ids", path), lambda: IdTable(Encoder(path)))
        part, start = TaskContext.get().partitionId(), 0
        for block in blocks(batches):
            ids, first = table.encode(*text_bytes(block.column("text")), end_id)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.full(block.num_rows, part, np.int32)), pa.array(start + first[:-1]), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                ["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(first[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, row_group: int = 16 << 20, page: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Encode docs (doc_id, text) and write the files under path.  The texts, smaller than their ids, are what is shuffled."""
    salt = F.xxhash64("text")  # rows of one id, or without one, can go to several files
    ordered = texts(docs).withColumn("salt", salt).repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(
        **{
            "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows),
        }
    ).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def offsets(files: DataFrame) -> DataFrame:
    """Per part: the ids in the parts before it; read from metadata columns alone."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))  # one row a file


def _sums(batches):
    for batch in batches:
        tokens = batch.column("tokens")
        values, ends = tokens.values.to_numpy().astype("<u4"), tokens.offsets.to_numpy()
        view = memoryview(values).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def summary(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, all taken from the ids read back."""
    rows = files.mapInArrow(_sums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets(files)), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")  # the broadcast side has a row per file


def encode_and_check(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, **options)
    return summary(read(docs.sparkSession, path))
