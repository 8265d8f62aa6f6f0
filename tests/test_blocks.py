"""Native byte operators on odd blocks, against the plain functions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import transforms as T
from blockloom.operators import blocks, ordering


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    data = [b"", b"a", bytes(range(256)), bytes(40_000), b"mississippi", "naïve 日本".encode(), bytes([255]) * 20, bytes(rng.randrange(4) for _ in range(500))]
    return data, spark.createDataFrame(list(enumerate(map(bytearray, data))), "id bigint, data binary")


def test_splitting(odd, spark):
    data, df = odd
    cut = blocks.split_blocks(df, "id", "data", 1024).orderBy("id", "block_id").collect()
    for i, d in enumerate(data):
        mine = [bytes(r.payload) for r in cut if r.id == i]
        assert b"".join(mine) == d and all(len(m) == 1024 for m in mine[:-1])
    for size in (1000, 8, 1025):
        with pytest.raises(ValueError):
            blocks.split_blocks(df, "id", "data", size)


def test_closed_forms_equal_the_encoders(odd):
    data, df = odd
    rows = blocks.byte_rows(df, "id", F.col("data"))
    n = F.col("n")
    found = {r.id: r for r in blocks.runs(rows, "id").groupBy("id").agg(F.sum(blocks.rlt_bytes(n)).alias("rlt"), F.sum(blocks.zrlt_bytes(F.col("val"), n)).alias("zrlt")).collect()}
    for i, d in enumerate(data):
        if d:
            assert found[i].rlt == len(T.rlt_encode(d)) and found[i].zrlt == len(T.zrlt_encode(d))


def test_profiles_equal_the_relational_form(odd, monkeypatch):
    data, df = odd
    for piece in (blocks.PIECE, 7):
        for d in data:
            block = np.frombuffer(d, np.uint8)
            monkeypatch.setattr(blocks, "PIECE", piece)
            kinds, times = blocks._run_counts(block)
            plain = Counter((len(list(g)) << 8) + v for v, g in itertools.groupby(d))
            assert dict(zip(kinds.tolist(), times.tolist())) == plain and blocks._byte_counts(block).tolist() == [d.count(v) for v in range(256)]
    monkeypatch.undo()
    df = df.union(df.sparkSession.createDataFrame([(90, None), (0, bytearray(b"twice"))], df.schema))
    rows = {r.id: r for r in blocks.profile(df, "id", F.col("data")).collect()}
    assert sorted(rows) == [0, *range(1, len(data))] and rows[0].n_in == 5
    assert [rows[i].n_in for i in range(1, len(data))] == [len(d) for d in data[1:]]
    pairs = Counter(p for d in [*data, b"twice"] for p in zip(b"\0" + d, d))
    found = {(r.prev, r.val): r.cnt for r in blocks.order1_counts(df, F.col("data")).where("val IS NOT NULL").collect()}
    assert found == pairs
    none = df.where("id < 0")
    assert blocks.profile(none, "id", F.col("data")).count() == 0 and blocks.order1_counts(none, F.col("data")).where("prev IS NOT NULL").count() == 0


def test_relational_transforms_equal_the_encoders(odd):
    data, df = odd
    small = df.where("length(data) <= 600")
    ranks = {}
    for r in blocks.move_to_front(blocks.byte_rows(small, "id", F.col("data")), "id").orderBy("id", "pos").collect():
        ranks.setdefault(r.id, bytearray()).append(r["rank"])
    bwt = {r.id: (bytes.fromhex(r.bwt), r.primary_index) for r in blocks.bwt_rows(small, "id", F.col("data")).collect()}
    for i, d in enumerate(data):
        if 0 < len(d) <= 600:
            assert bytes(ranks[i]) == T.mtf_encode(d) and bwt[i] == T.bwt_encode(d)


def test_multiset(spark):
    a = ordering.Multiset.of(spark.createDataFrame([(v,) for v in [5, 1, 5, 9, None, -3]], "v bigint"), F.col("v"))
    b = ordering.Multiset.of(spark.createDataFrame([(v,) for v in [5, 5, 5, 1]], "v bigint"), F.col("v"))
    asked = spark.createDataFrame([(v,) for v in [-3, 1, 4, 5, 9]], "value bigint")
    assert {r.value: r["rank"] for r in a.rank(asked).collect()} == {-3: 0, 1: 1, 4: -1, 5: 2, 9: 4}
    assert sorted(r.value for r in a.remove(b).to_rows().collect()) == [-3, 9]
    assert {r.value: r.cnt for r in a.add(b).counts.collect()} == {-3: 1, 1: 2, 5: 5, 9: 1}
    none = a.remove(a)
    assert tuple(none.ends().first()) == (None, None) and none.size().first()[0] == 0
