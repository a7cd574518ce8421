"""N-gram Jaccard join (4): token-combination prefixes.

A document is the set of its n-word shingles.  Tokens (shingle hashes) are counted over all documents and fall in
two classes: rare, and frequent.  In the order rare first, then by hash, a set's prefix is extended until its
guarantee holds:

- enough rare tokens: the first e + 1 + m of them, one by one (e: tokens that a partner of least overlap may lack;
  m: up to 4); a pair has to share m + 1 of these to be compared;
- fewer: all rare tokens one by one, and combinations of two neighbouring frequent tokens among the first
  (e - r) + (D - r) + 2, where D bounds the symmetric difference and r counts the rare ones.  If no rare token is
  shared, more frequent ones are shared than the unmatched ones can separate, so two stay neighbours in both sets.

Any pair over the threshold shares an entry of the index whatever the classes are, so counting can be coarse
without a loss.  Rare entries give pairs; combinations give families, in which sets are compared with the one that
has most frequent tokens and, where that leaves several components, with all in tiles.  Overlaps are counted on
whole sets.  Equal sets are one node from the start.

Results rest on 64-bit hashes of shingles and sets.  Defined cases: no words (null, empty, blank): no shingles, own
component; fewer than n words: one shingle, the whole sequence; repeated rows are members of one node, of which
keep_one keeps one; a null doc_id belongs to its node but names no component that has another row with an id; a
doc_id on several texts is dropped only where its text is linked with a smaller one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, drop_stage, exists, few, input_bytes, lookup, lower_words, mark, mix, narrow, new_path, pack, partitions, released, remove, rows_kept, stage, stage_small, texts, unpack
from .components import components

#: Documents with a token from which on it is frequent, and entries of the broadcast list of such tokens (8 bytes
#: each; if there are more, the most frequent ones).  Both steer the index only; no result depends on them.
FREQUENT, LISTED = 16, 1_000_000
#: Rare tokens by which a prefix is extended beyond the first e + 1, so that a pair has to share one more for each;
#: bits of a token's hash that are counted in a shard.
EXTRA, COUNTED_BITS = 4, 26
#: Bytes of documents whose tokens and entries make up a shard, and most bits of a shard's number: beyond those
#: (2**20 shards) shards grow.  Neither changes a result.
SHARD_BYTES, MOST_BITS = 32 << 20, 20
#: Members of an index entry from which on it makes a family instead of pairs; sets in a tile.
PAIRED, TILE = 256, 512
#: In an entry: below this the extra tokens of a prefix, from it on a combination and the share of frequent tokens.
FAMILY = 16
_FLUSH = 1_000_000


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after another, and their borders."""
    words, first = lower_words(col)
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(count)), made)
    start = first[rows] + np.arange(at[-1]) - at[rows]
    step = np.uint64(0x9FB21C651E98DF25)
    found = np.full(at[-1], np.uint64(n), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        found = found * step + padded[start + k]
    found = mix(found)
    for i in np.flatnonzero((count > 0) & (count < n)):
        whole = np.uint64(count[i])
        for w in words[first[i] : first[i + 1]]:
            whole = mix(np.array([whole * step + w], np.uint64))[0]
        found[at[i]] = whole
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[at]


def _node(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches, n: int):
    """(block, doc of each distinct set not seen lately in this task, values, borders) of each block."""
    seen: set = set()
    for block in blocks(batches):
        values, at = shingle_sets(block.column("text"), n)
        nodes = [_node(values[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
        fresh = []
        for i, node in enumerate(nodes):
            if node is not None and node not in seen:
                seen.add(node)
                fresh.append(i)
        if len(seen) > 500_000:
            seen.clear()
        yield block, nodes, fresh, values, at


def _errstate(fn):
    def run(*a):
        with np.errstate(over="ignore"):
            yield from fn(*a)

    return run


def _join(parts) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


class _Join:
    def __init__(self, docs: DataFrame, n: int, threshold: tuple[int, int]):
        self.docs = texts(docs).withColumn("mark", mark())
        self.spark, self.n = docs.sparkSession, n
        self.num, self.den = threshold
        shards = max(8, 2 * partitions(self.spark) - 1, -(-input_bytes(docs) // SHARD_BYTES))  # as many as the input asks for
        self.bits = max(4, min((shards - 1).bit_length(), MOST_BITS))

    # -- counts

    def scan(self) -> tuple[DataFrame, DataFrame]:
        """Documents (doc_id, mark, n, node), and packed token counts by shard."""
        n, bits = self.n, self.bits
        shift = np.uint64(64 - bits - COUNTED_BITS)

        def counted(held):
            keys, times = np.unique(np.concatenate(held) >> shift, return_counts=True)
            edges = np.searchsorted(keys >> np.uint64(COUNTED_BITS), np.arange((1 << bits) + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(edges)).tolist()
            low = (keys & np.uint64((1 << COUNTED_BITS) - 1)).astype(np.uint32)
            data = [pack(np.diff(low[edges[s] : edges[s + 1]], prepend=np.uint32(0))) for s in full]
            more = [pack(narrow(times[edges[s] : edges[s + 1]])) for s in full]
            none = pa.nulls(len(full), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * len(full), pa.int32()), none, none, none, none, pa.array(full, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())], names)

        names = ["kind", "doc_id", "mark", "n", "node", "shard", "data", "more"]

        @_errstate
        def run(batches):
            held, size = [], 0
            for block, nodes, _, values, at in _sets(batches, n):
                none = [pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.binary()), pa.nulls(len(nodes), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(nodes), pa.int32()), block.column("doc_id"), block.column("mark"), pa.array(np.diff(at)), pa.array(nodes, pa.int64()), *none], names)
                held.append(values)
                size += len(values)
                if size > _FLUSH:
                    yield counted(held)
                    held, size = [], 0
            if size:
                yield counted(held)

        rows = self.docs.mapInArrow(run, "kind int, doc_id long, mark long, n long, node long, shard int, data binary, more binary")
        path = new_path(self.spark, "jaccard-scan")
        rows.write.partitionBy("kind").parquet(path)
        self.scanned_path = path
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(f"{path}/kind={kind}") if exists(self.spark, f"{path}/kind={kind}") else self.spark.createDataFrame([], schema)
        return read(0, "doc_id long, mark long, n long, node long"), read(1, "shard int, data binary, more binary")

    def frequent(self, counts: DataFrame) -> np.ndarray:
        """Sorted leading bits of the tokens in the frequent class."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            low = np.concatenate([np.cumsum(unpack(d), dtype=np.uint32) for d in frame["data"]])
            times = np.concatenate([unpack(d).astype(np.int64) for d in frame["more"]])
            order = np.argsort(low, kind="stable")
            low, times = low[order], times[order]
            edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            total = np.add.reduceat(times, edge)
            often = total >= FREQUENT
            return pd.DataFrame({"key": (int(frame["shard"].iloc[0]) << COUNTED_BITS) | low[edge][often].astype(np.int64), "n": total[often]})

        found = counts.groupBy("shard").applyInPandas(released(run), "key long, n long").orderBy(F.desc("n"), "key").limit(LISTED).select("key")
        return np.sort(found.toArrow()["key"].to_numpy().astype(np.uint64))

    # -- index

    def entries(self, frequent: np.ndarray) -> DataFrame:
        """Packed index entries by shard of their signature."""
        n, bits, num, den = self.n, self.bits, self.num, self.den
        shared = self.spark.sparkContext.broadcast(frequent)
        shift = np.uint64(64 - bits - COUNTED_BITS)

        def out(held):
            sig, node, size, share = (np.concatenate(x) for x in zip(*held))
            sig = mix(sig)  # prefixes hold each set's least hashes: spread them over the shards
            order = np.lexsort((node, 255 - share, sig))
            sig, node, size, share = sig[order], node[order], size[order], share[order]
            kin, kin_rows = (share >= FAMILY), []
            group = np.cumsum(np.concatenate([[True], (sig[1:] != sig[:-1]) | (kin[1:] != kin[:-1])])) - 1 if len(sig) else np.zeros(0, int)
            head = np.searchsorted(group, group)  # of a combination's local members only the first goes on to the shard
            more = kin & (head != np.arange(len(sig))) & (node[head] != node)
            if more.any():
                rows = np.unique(np.stack([node[head[more]], node[more], share[head[more]].astype(np.int64), share[more].astype(np.int64)], 1), axis=0)
                kin_rows = [_join([pack(np.ascontiguousarray(c)) for c in rows.T])]
            keep = ~kin | (head == np.arange(len(sig)))
            sig, node, size, share = sig[keep], node[keep], size[keep], share[keep]
            edges = np.searchsorted(sig >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(edges)).tolist()
            data = [_join([pack(a) for a in (np.diff(sig[i:j], prepend=np.uint64(0)), node[i:j], narrow(size[i:j]), share[i:j])]) for i, j in ((edges[s], edges[s + 1]) for s in full)]
            local = [-1 - int(k) for k in np.random.default_rng(int(node[0]) & 0xFFFF if len(node) else 0).integers(0, 1 << 16, len(kin_rows))]  # any task will do
            return pa.RecordBatch.from_arrays([pa.array(full + local, pa.int32()), pa.array(data + kin_rows, pa.binary())], ["shard", "data"])

        @_errstate
        def run(batches):
            often = shared.value
            held, total = [], 0
            for _, nodes, fresh, values, at in _sets(batches, n):
                key = values >> shift
                place = np.searchsorted(often, key)
                hit = np.zeros(len(key), bool)
                inside = place < len(often)
                hit[inside] = often[place[inside]] == key[inside]
                size = np.diff(at)
                lack = size - (-(-num * size // den))
                rares = np.concatenate([[0], np.cumsum(~hit)])
                r = rares[at[1:]] - rares[at[:-1]]
                use = np.zeros(len(size), bool)
                use[fresh] = True
                row = np.repeat(np.arange(len(size)), size)
                extra = np.clip(r - lack - 1, 0, EXTRA)
                pick = ~hit & use[row] & (rares[:-1] - rares[at[row]] <= (lack + extra)[row])
                names = np.array([x or 0 for x in nodes], np.int64)
                held.append((values[pick], names[row[pick]], size[row[pick]], extra[row[pick]].astype(np.uint8)))
                for i in np.flatnonzero(use & (r <= lack)):
                    q = values[at[i] : at[i + 1]][hit[at[i] : at[i + 1]]]
                    most = int((lack[i] - r[i]) + ((den - num) * size[i] // num - r[i]) + 2)
                    q = q[:most]
                    if len(q) > 1:
                        pair = mix(q[:-1] * np.uint64(0xA24BAED4963EE407) + q[1:])
                        held.append((pair, np.full(len(pair), names[i]), np.full(len(pair), size[i]), np.full(len(pair), FAMILY + int((255 - FAMILY) * (size[i] - r[i]) / size[i]), np.uint8)))
                total += sum(len(h[0]) for h in held[-1:])
                if total > _FLUSH or len(held) > 20_000:
                    yield out(held)
                    held, total = [], 0
            if held:
                yield out(held)

        return self.docs.mapInArrow(run, "shard int, data binary")

    def matches(self, entries: DataFrame) -> DataFrame:
        """kind 0: pairs, their extra tokens (share_a) and shared entries (times); kind 1: two members of a family and the share of frequent tokens of each."""
        num, den = self.num, self.den

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            cols = list(zip(*([unpack(x) for x in _split(d)] for d in frame["data"])))
            if frame["shard"].iloc[0] < 0:
                rows = np.unique(np.stack([np.concatenate(c) for c in cols], 1), axis=0)
                return pd.DataFrame(rows, columns=["a", "b", "share_a", "share_b"]).assign(kind=1, times=1)[["kind", "a", "b", "share_a", "share_b", "times"]]
            with np.errstate(over="ignore"):
                sig = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in cols[0]])
            node, size, share = np.concatenate(cols[1]), np.concatenate([c.astype(np.int64) for c in cols[2]]), np.concatenate(cols[3])
            order = np.lexsort((node, sig))
            sig, node, size, share = sig[order], node[order], size[order], share[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node, size, share = sig[new], node[new], size[new], share[new]
            edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(edge, len(sig)))
            group = np.repeat(np.arange(len(edge)), count)
            several = (count > 1)[group]
            family = several & ((share >= FAMILY) | (count > PAIRED)[group])
            out = []
            paired = np.flatnonzero(several & ~family)
            k = 1
            while len(paired):
                paired = paired[paired + k < len(sig)]
                paired = paired[group[paired + k] == group[paired]]
                near = np.minimum(size[paired], size[paired + k]) * den >= num * np.maximum(size[paired], size[paired + k])
                i = paired[near]
                out.append(np.stack([np.zeros(len(i), np.int64), node[i], node[i + k], np.minimum(share[i], share[i + k]).astype(np.int64), np.zeros(len(i), np.int64)], 1))
                k += 1
            member = np.flatnonzero(family)
            if len(member):
                best = np.lexsort((-share[member].astype(np.int64), group[member]))
                lead = member[best][np.concatenate([[True], np.diff(group[member[best]]) > 0])]
                head = lead[np.searchsorted(group[lead], group[member])]
                out.append(np.stack([np.ones(len(member), np.int64), node[head], node[member], share[head].astype(np.int64), share[member].astype(np.int64)], 1))
            rows, times = np.unique(np.concatenate(out), axis=0, return_counts=True) if out else (np.zeros((0, 5), np.int64), np.zeros(0, np.int64))
            return pd.DataFrame(rows, columns=["kind", "a", "b", "share_a", "share_b"]).assign(times=times)

        return entries.groupBy("shard").applyInPandas(released(run), "kind long, a long, b long, share_a long, share_b long, times long")

    # -- comparison

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """node, n, values (bytes of the sorted hashes) of these nodes (node, first: the doc_id to take it from, or null)."""
        n, listed = self.n, few(nodes)
        wanted = None
        if listed:  # checked: a bounded list of 17 bytes a node
            table = nodes.toArrow().sort_by("node")
            first = table["first"].combine_chunks()
            wanted = self.spark.sparkContext.broadcast((table["node"].to_numpy(), first.fill_null(0).to_numpy(), first.is_null().to_numpy(zero_copy_only=False)))

        @_errstate
        def run(batches):
            for block, names, fresh, values, at in _sets(batches, n):
                if wanted is not None:
                    known, first, free = wanted.value
                    docs = block.column("doc_id").fill_null(0).to_numpy()
                    mine = np.array([x or 0 for x in names], np.int64)
                    place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                    ok = (known[place] == mine) & (free[place] | (first[place] == docs)) & (np.diff(at) > 0) if len(known) else np.zeros(len(mine), bool)
                    fresh = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in fresh], pa.int64()), pa.array([int(at[i + 1] - at[i]) for i in fresh], pa.int64()), pa.array([values[at[i] : at[i + 1]].tobytes() for i in fresh], pa.binary())], ["node", "n", "values"])

        rows = self.docs.mapInArrow(run, "node long, n long, values binary")
        return rows if listed else rows.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold."""
        num, den = self.num, self.den

        def run(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("va"), batch.column("vb")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[place] == x).sum())
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], ["a", "b", "ok"])

        a = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
        b = sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, ok boolean").filter("ok").select("a", "b")

    def across(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between members (node, family, root) of different roots in a family; tiles of outsiders against tiles of all."""
        num, den = self.num, self.den
        size = members.groupBy("family", "root").count()
        total = size.groupBy("family").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("main"))
        total = total.filter(F.col("all") > F.col("main.count")).select("family", "all", F.col("main.root").alias("main"), (F.col("all") - F.col("main.count")).alias("out"))
        tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
        rows = members.join(total, "family").withColumns({"nt": tiles("all"), "no": tiles("out")})
        spread = F.xxhash64("node")
        outsiders = rows.filter("root <> main").withColumn("o", F.pmod(spread, "no")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nt") - 1))).withColumn("outside", F.lit(True))
        everyone = rows.withColumn("t", F.pmod(spread, "nt")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).withColumn("outside", F.lit(False))
        cols = ["family", F.col("o").cast("int").alias("o"), F.col("t").cast("int").alias("t"), "node", "root", "outside"]
        placed = outsiders.select(*cols).unionByName(everyone.select(*cols)).join(sets, "node")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            left, right = frame[frame["outside"]], frame[~frame["outside"]]
            got = []
            if len(left) and len(right):
                overlap = _overlaps(left["values"], right["values"])
                union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None] - overlap
                ok = (den * overlap >= num * union) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None])
                i, j = np.nonzero(ok)
                got = pd.DataFrame({"a": left["node"].to_numpy()[i], "b": right["node"].to_numpy()[j], "root": right["root"].to_numpy()[j]})
                got = got.drop_duplicates(["a", "root"])[["a", "b"]]
            return got if len(got) else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

        return placed.groupBy("family", "o", "t").applyInPandas(released(run), "a long, b long")

    def run(self) -> DataFrame:
        """doc_id, mark, n of every document, and of its component (if that has several rows) the best row: the smallest doc_id, then mark."""
        documents, counts = self.scan()
        frequent = self.frequent(counts)
        entries = self.entries(frequent)
        remove(self.spark, f"{self.scanned_path}/kind=1")
        found = self.matches(entries).groupBy("kind", "a", "b", "share_a", "share_b").agg(F.sum("times").alias("times"))
        found = stage_small(found.filter("kind = 1 or times > share_a"), "jaccard-matches")
        pairs, kin = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1")
        family = components(kin.select("a", "b"))  # node, root
        share = kin.select(F.col("b").alias("node"), F.col("share_b").alias("share")).union(kin.select("a", "share_a")).groupBy("node").agg(F.max("share").alias("share"))
        members = stage_small(family.join(share, "node").withColumnRenamed("root", "family"), "jaccard-families")
        heads = members.groupBy("family").agg(F.max_by("node", F.struct("share", (-F.col("node")).alias("o"))).alias("head"))
        stars = members.join(heads, "family").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        todo = stage_small(pairs.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
        nodes = todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct()
        nodes = stage_small(documents.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("first")), "jaccard-nodes")
        sets = stage(self.whole_sets(nodes), "jaccard-sets")
        links = stage_small(self.linked(todo, sets), "jaccard-links", heavy=True)
        roots = components(links)
        placed = stage_small(members.join(roots, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root")), "jaccard-members")
        if not placed.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").isEmpty():
            more = stage_small(self.across(placed, sets), "jaccard-links", heavy=True)
            roots = components(links.union(more))
        drop_stage(sets)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
        classes = documents.filter("node is not null").groupBy("node").agg(best.alias("best"), F.count("*").alias("rows"))
        classes = stage_small(classes.join(roots, "node", "left").filter("rows > 1 or root is not null"), "jaccard-classes")  # the others are their own
        linked = classes.filter("root is not null")
        least = stage_small(linked.groupBy("root").agg(F.min("best").alias("least")), "jaccard-least")
        named = lookup(classes, least, "root", "node").select("node", F.coalesce("least", "best").alias("best"))
        return lookup(documents, stage_small(named, "jaccard-named"), "node")


def _overlaps(left, right) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (bytes of sorted hashes): a product of incidence matrices, by column blocks."""
    a, b = ([np.frombuffer(v, np.uint64) for v in side] for side in (left, right))
    ta, tb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ta, tb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    out = np.zeros((len(a), len(b)), np.float32)
    ca, cb = np.searchsorted(common, ta), np.searchsorted(common, tb)
    ina, inb = ca < len(common), cb < len(common)
    ina[ina] = common[ca[ina]] == ta[ina]
    inb[inb] = common[cb[inb]] == tb[inb]
    for at in range(0, len(common), 4096):
        width = min(4096, len(common) - at)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c, ok in ((x, ra, ca, ina), (y, rb, cb, inb)):
            use = ok & (c >= at) & (c < at + width)
            m[r[use], c[use] - at] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def join_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id linked with it, itself included)."""
    found = _Join(docs, n, threshold).run()
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Rows of docs, all columns, one of each component: that with the smallest doc_id (null after all others)."""
    found = _Join(docs, n, threshold).run().filter("best is not null")
    stays = F.expr("doc_id <=> best.doc_id and mark = best.mark")
    decided = found.groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1")
    return rows_kept(docs, stage_small(decided, "jaccard-decided"))
