"""The pipeline's stages take effect, keep clean documents and hold against brute force where they are exact."""

from unittest import mock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

import corpus_pipeline
from schism.llm import common, language, quality

from .test_dedup import brute_components, brute_dedup

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = function(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        counts.append(len(after))
        assert after <= set(before)
        gone = set(before) - after
        if name in ("quality", "language"):
            assert len(gone & good) <= 0.01 * len(good)
        elif name == "exact dedup":
            assert after == {d for d, keep, _, _ in brute_dedup(before.items()) if d == keep}
        else:
            roots = brute_components(before.items(), 5, 80, 100)
            assert after == {d for d, (_, root) in roots.items() if d == root}
    assert counts[0] > counts[1] and counts[2] > counts[3] > counts[4] - 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(packed.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_odd_tables(spark, odd, none):
    """Null and repeated ids, null, blank and very long texts, clashing columns, an empty table: through all stages."""
    again = odd.union(odd.filter("doc_id in (1, 10) or doc_id is null"))
    for docs in (again, none):
        before, kept = docs, docs
        for name, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, before, "/root/testdata/sf0.001").cache()
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            rows, own = before.collect(), kept.collect()
            assert set(map(str, own)) <= set(map(str, rows))
            if name == "exact dedup":
                texts = [(r.text or "").encode().lower() for r in own]
                assert len(set(texts)) == len(texts) and set(texts) == {(r.text or "").encode().lower() for r in rows}
            before = kept
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
        assert packed.filter("piece = 0").count() == kept.count()


def test_filters_of_an_empty_table(spark, odd, none):
    from schism.llm import language, quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert quality.keep(none, quality.fit(docs, labels)).count() == 0 and language.keep(none, language.fit(docs)).count() == 0


def test_stages_give_heaps_back(spark, odd):
    """Each stage collects the executors' garbage before it begins and before its last pass, and reads few rows at once."""
    key, collectors = "spark.sql.parquet.columnarReaderBatchSize", spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(c.getCollectionCount() for c in collectors() if "Old" in c.getName() or "MarkSweep" in c.getName())
    before = spark.conf.get(key)
    try:
        for (name, function), part in zip(corpus_pipeline.STAGES, ("quality.keep", "language.keep", "exact_dedup.keep_unique", "jaccard_join.keep_one", "packing.pack_documents"), strict=True):
            spark.conf.set(key, "4096")
            began = full()
            with mock.patch.object(quality, "fit"), mock.patch.object(language, "fit"), mock.patch(f"corpus_pipeline.{part}", side_effect=lambda docs, *a, **b: docs) as own:
                assert function(spark, odd, SF) is odd and own.call_count == 1
            assert full() - began >= 2 and int(spark.conf.get(key)) == common.READ_ROWS, name
    finally:
        spark.conf.set(key, before)


def test_filters_work_on_small_pieces():
    """What quality and language make of texts is bounded by 256 KB of text, and doesn't depend on how texts are cut."""
    texts = [f"the quick {i} brown fox " * 40 for i in range(900)] + ["", "x", "ä ö " * 200_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    sizes = []

    class Docs:
        """Stands for a table: only what `mapInArrow` is given counts."""

        columns, schema, sparkSession = ["doc_id", "text"], [], None

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def __getattr__(self, name):
            return lambda *a, **b: self

    def wanted(block):
        sizes.append((block.num_rows, pc.binary_length(block.column("text")).to_numpy().sum()))
        return np.ones(block.num_rows, bool)

    docs = Docs()
    with mock.patch.multiple(quality, small_batches=mock.DEFAULT, spread=lambda d: d, F=mock.DEFAULT):
        quality.filtered(docs, wanted)
    assert sum(b.num_rows for b in docs.run([batch])) == len(texts) == sum(n for n, _ in sizes)
    assert all(size <= 1 << 18 or n == 1 for n, size in sizes)

    model = language.Model(["a", "b"], np.random.default_rng(0).standard_normal((1 << 10, 2)), np.zeros(2), 1.0, 0.0)
    whole, cut = (np.concatenate([language._predict(b, model)[1] for b in common.blocks([batch], most=most)]) for most in (1 << 30, common.PIECE))
    assert np.allclose(whole, cut, rtol=0, atol=1e-9)
