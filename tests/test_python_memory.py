"""Python steps hold a bounded part of an Arrow batch, and give what they gave at once."""

import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from textmill.functions import arrays, python_text
from textmill.operators import retrieval
from textmill.plans import registry


def peak(f):
    """(result, MB at the most)"""
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("digest", ["blake2b", "md5"])
def test_winnowing_of_a_long_text(digest):
    text = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 300_000))
    got, most = peak(lambda: python_text.winnow(text, digest=digest))
    of = (lambda g: hashlib.blake2b(g, digest_size=8).digest()) if digest == "blake2b" else lambda g: hashlib.md5(g).digest()[:8]
    h = np.array([int.from_bytes(of(text[i : i + 50].encode())) for i in range(len(text) - 49)], np.uint64)
    assert got == np.unique(np.lib.stride_tricks.sliding_window_view(h, 25).min(axis=1)).view(np.int64).tolist() and most < 20
    assert python_text.winnow("short", digest=digest) == [int.from_bytes(of(b"short"), signed=True)] and python_text.winnow(" ", digest=digest) == []


def test_nearest_of_a_large_batch():
    r = np.random.default_rng(3)
    x, q = r.normal(size=(6000, 8)), r.normal(size=(1500, 8))
    x[5] = np.nan
    x[9] = x[40]
    q /= np.linalg.norm(q, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(x.tolist())], ["id", "v"])
    step = retrieval._nearest(SimpleNamespace(value=(q, pa.array(range(1500)))), "id", "v", "q", 3, 6)
    got, most = peak(lambda: pa.Table.from_batches(step(iter([batch]))).to_pydict())
    assert most < 120
    s = np.round(x / np.linalg.norm(x, axis=1)[:, None] @ q.T, 6)
    for k in (0, 700, 1499):
        want = sorted((-v, str(i)) for i, v in enumerate(np.where(np.isnan(s[:, k]), np.inf, s[:, k])))[:3]
        assert {str(i) for i, o in zip(got["id"], got["q"], strict=True) if o == k} == {i for _, i in want}


def test_sentences_do_not_leave_python(spark):
    df = registry.QUERIES["sentence_windows"](spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    for x in df.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(20), "doc_id").collect():
        found = python_text.sentences(x.text)[6 * x.window : 6 * x.window + 6]
        assert (x.sentences, x.chars) == (len(found), sum(map(len, found)))


def test_characters_are_counted_a_megabyte_at_a_time():
    offs = np.arange(0, 9 << 20, 1000)
    ranges = list(arrays.steps(offs))
    assert [i for i, _ in ranges[1:]] == [j for _, j in ranges[:-1]] and ranges[-1][1] == len(offs) - 1
    assert max(offs[j] - offs[i] for i, j in ranges) <= 1 << 20
