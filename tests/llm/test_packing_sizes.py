"""What packing shuffles and how many files its result has."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")


def test_only_tails_that_may_be_cut_are_shuffled_with_their_ids(spark):
    from tokenizers import Tokenizer

    from tidewatch.llm import op1_packing

    rng = random.Random(11)
    texts = {i: " ".join(rng.choice(["the", "packing", "of", "tails", "é", "x" * 9]) for _ in range(rng.choice([1, 2, 3, 40, 100, 700, 1500]))) for i in range(700)}
    texts |= {1000: "", 1001: "", 1002: "of " * 5000}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5, "doc_id")
    path = P.path("byte_bpe_50k.json")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("211", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        packed = op1_packing.pack(docs, path)
        assert packed.rdd.getNumPartitions() <= 211 // 2  # all 211 of the join before
        rows = packed.collect()
        tails = op1_packing.materialise(op1_packing.tokenize(docs, path, 0, op1_packing.SIZE), "tails")
        histogram = {x["r"]: x["n"] for x in tails.where("r > 0").groupBy("r").agg(F.count("*").alias("n")).collect()}
        covered = op1_packing.make_plan(histogram).covered
        assert any(covered.values()) and any(covered[r] < n for r, n in histogram.items())
        for r in op1_packing.placed(tails, covered).collect():
            free = r.r > 0 and r["rank"] + r.ranked_before >= covered[r.r]
            assert (r.tail is not None) == free and (not free or len(r.tail) == 2 * r.r)
        assert op1_packing.placed(tails, covered).count() == len(texts)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    encode = Tokenizer.from_file(path).encode
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert any(r.length < r.doc_tokens % 1024 for r in rows)  # a tail that was cut
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0


def test_texts_are_read_in_short_batches_only_while_they_are_encoded(spark, monkeypatch):
    from tidewatch.llm import op1_packing

    reader = "spark.sql.parquet.columnarReaderBatchSize"
    before, seen = spark.conf.get(reader), []
    monkeypatch.setattr(op1_packing, "materialise", lambda df, name, f=op1_packing.materialise: (seen.append(spark.conf.get(reader)), f(df, name))[1])
    docs = spark.createDataFrame([(1, "one text")], "doc_id long, text string")
    assert op1_packing.pack(docs, P.path("byte_bpe_50k.json")).count() > 0
    assert seen == [str(op1_packing.READ_ROWS)] and spark.conf.get(reader) == before
