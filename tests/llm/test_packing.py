import gc
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioquery.llm.packing import BLOCK, SLICE, WINDOW, Packer, pack, round_robin, served_before, slices
from folioquery.llm.tokens import encoder

from .cases import ODD, documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900_000), min_size=1, max_size=12))
def test_deficit_stays_small_and_states_meet(totals):
    totals, whole = tuple(totals), sum(totals)
    windows = -(-whole // WINDOW)
    last = None
    for block in range(-(-windows // BLOCK)):
        rows = round_robin(block, totals)
        assert last is None or (rows[0] == last).all()
        assert (np.diff(rows, axis=0) >= 0).all()
        size = np.minimum(WINDOW * (np.arange(len(rows)) + block * BLOCK), whole)
        assert (rows.sum(axis=1) == size).all()
        assert np.abs(rows - np.outer(size / whole, totals)).max() <= 3 + len(totals) / 2
        last = rows[-1]
    assert tuple(last) == totals and served_before(0, totals) == [0] * len(totals)


def test_ids_are_those_of_the_tokenizer(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder()
    texts = [t or "" for t in ODD[:8]] + ["it's  they'll\t\n\n x_1 ½² ٣ “quote” z \x1c á 日本 I'm ___ 12ab34", "a\r\n  b   "]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 3000]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, sf_dir, parts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD[:8], *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 6000)]
    docs = documents(spark, texts, sources=("a", "a", None, "b", "a")).repartition(parts).withColumn("start", F.lit("clash"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(piece.tobytes()) == r.ids_crc32
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(own)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
    assert padding == 0 and sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(at == WINDOW for at in (sum(r.length for r in rows) for rows in by_sequence.values())) == sum(map(len, ids.values())) // WINDOW


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["x y"]).unionByName(documents(spark, ["x y"]))
    assert sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in pack(docs).collect())[0][:2] == (0, 0)
    assert pack(docs).agg(F.sum("length")).first()[0] == 2 * pack(documents(spark, ["x y"])).agg(F.sum("length")).first()[0]
    assert pack(docs.limit(0)).count() == 0


def test_ids_are_not_shuffled(spark, sf_dir):
    """The offsets of queues and partitions are broadcast to the ids, which stay in place."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_queue_of_a_block_is_laid_out_once_for_all_its_runs():
    packer = Packer((300 * WINDOW, 5, 100 * WINDOW + 77))
    for queue, total in enumerate(packer.totals):
        for start in range(0, total, 40_000):
            length = min(40_000, total - start)
            pieces = list(packer.pieces(queue, start, length))
            assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]]
            assert sum(p[1] for p in pieces) == length
    assert packer.column.cache_info().misses <= 3 * packer.blocks


def test_worker_memory_follows_neither_batches_nor_tasks():
    rows = pa.RecordBatch.from_arrays([pa.array(range(3 * SLICE + 7))], names=["doc_id"])
    cut = list(slices(iter([rows, rows.slice(0, 0), rows.slice(5, 2)])))
    assert [b.num_rows for b in cut] == [SLICE, SLICE, SLICE, 7, 2]
    assert [v for b in cut for v in b.column(0).to_pylist()] == [*range(3 * SLICE + 7), 5, 6]
    gc.disable()
    try:
        packer = Packer((3_000_000, 70_000))
        assert sum(n for _, n, _, _ in packer.pieces(0, 100, 50_000)) == 50_000
        gone = weakref.ref(packer)
        del packer
        assert gone() is None  # a task's tables go with the task
    finally:
        gc.enable()


def test_long_runs_of_spaces_are_encoded():
    encode = encoder()
    for run in (" " * 2_000_000, "\n" * 1_000_000, " \t" * 600_000):
        assert encode(run + "x") == encode(run[:-1]) + encode(run[-1] + "x")
    text = "a  b" + " " * 12_000 + "c's _1 \n" * 3
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u2").tolist() == ids
