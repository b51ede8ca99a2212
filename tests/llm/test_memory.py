"""What a worker keeps between tasks, and how small the index of the Jaccard join is packed."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("querywatch.llm")
import public_tokenizers  # noqa: E402

from querywatch.llm import _work, byte_bpe, jaccard_join, mixing, toxicity  # noqa: E402


def test_caches_of_other_stages_go_when_a_task_begins():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    byte_bpe.merged(path)
    assert list(_work.lean(iter, "byte_bpe")(iter([1, 2]))) == [1, 2] and byte_bpe.merged.cache_info().currsize == 1
    assert list(_work.lean(iter)(iter([3]))) == [3]
    assert byte_bpe.merged.cache_info().currsize == byte_bpe.load_ranks.cache_info().currsize == 0
    assert byte_bpe.merged(path).of([b"the"])  # and come back when asked for


def test_tasks_get_the_index_without_the_counts_of_its_examples():
    examples = [(i, i % 2, (np.array([i % 5, 5 + i % 3]), np.array([1, 2]))) for i in range(40)]
    index = toxicity.Index(np.full(8, 5), 40, examples)
    queries = [e[2] for e in examples]
    sent = pickle.loads(pickle.dumps(index))
    assert all(len(e) == 2 for e in sent.examples) and sent.score(queries) == index.score(queries)


def test_keys_are_packed_small_and_meet_as_without_packing():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(60)]
    texts += [t.replace(" w1", " v1", 3) for t in texts[:30]] + [" ".join(rng.choice(words, 9000))]
    batch = pa.RecordBatch.from_arrays([pa.array([{"row_id": i, "doc_id": i} for i in range(len(texts))]), pa.array(texts)], names=["row", "text"])
    packed = pa.Table.from_batches(jaccard_join._index(iter([batch]), 3)).sort_by("bucket").combine_chunks()
    sets = jaccard_join.shingle_sets([t.encode() for t in texts])
    keys = [(k, int(key), jaccard_join.signature(s)[0]) for s in sets for k in jaccard_join.bands(len(s)) for key in jaccard_join.keys_of(s, k)[0].tolist()]
    size = sum(len(x.as_py()) for c in ("classes", "members") for x in packed.column(c))
    assert size < 6 * len(keys)
    met = pa.Table.from_batches(jaccard_join._meet(iter(packed.to_batches()))).filter(pa.compute.field("kind") == 1)
    by = {}
    for k, key, c1 in keys:
        by.setdefault(key, set()).add((k, c1))
    want = sorted((k, c1, len(v)) for v in by.values() if len({c for _, c in v}) > 1 for k, c1 in v)
    assert want and sorted(zip(met["band"].to_pylist(), met["c1"].to_pylist(), met["met"].to_pylist())) == want


def test_a_reference_stands_for_255_members_at_most():
    cls = np.zeros(3, jaccard_join.CLASS)
    cls["c1"] = 10, 20, 30
    got = jaccard_join.references(cls, np.repeat([0, 2], [600, 2]))
    assert got["c1"].tolist() == [10, 10, 10, 30] and got["keys"].tolist() == [255, 255, 90, 2]


def test_mixing_passes_its_leaves_without_python_workers(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, F.lit("s")).alias("source"))
    rows = mixing.mix(docs, mixing.Target(share=1.0))
    assert "LocalTableScan" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "ExistingRDD" not in plan
    assert rows.count() == 20
