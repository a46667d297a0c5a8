import numpy as np
import pytest
from llm_helpers import tuples
from pyspark.sql import functions as F

from lodestar.llm import code_search
from lodestar.llm.code_search import search


def expected(rows, k, bits):
    codes = {i: np.array([x is not None and x > 0 for x in v[:bits]]) for i, v in rows
             if i is not None and v is not None and len(v) >= bits}
    out = []
    for q in codes:
        if q % 10 == 0:
            near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:k]
            out += [(q, i, d, rank) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("k,bits,segment", [(1, 16, None), (5, 16, 5), (10, 20, 4), (400, 16, 8)])
def test_against_all_pairs(spark, k, bits, segment):
    rng = np.random.default_rng(bits + k)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a hot code
    rows += [(500, None), (None, rows[0][1]), (510, [1.0]), (520, [None] * 24), (530, []), (3, rows[3][1])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, code string")
    got = search(frame, F.col("vec_id") % 10 == 0, k=k, bits=bits, segment=segment)
    assert tuples(got, "query_id", "neighbour_id", "distance", "rank") == expected(rows, k, bits)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(10, [1.0] * 8)], "vec_id long, embedding array<double>")
    assert tuples(search(none, F.lit(True), bits=8)) == tuples(search(one, F.lit(True), bits=8)) == []


@pytest.mark.parametrize("k,bits,segment", [(5, 64, None), (30, 20, 7)])
def test_blocks_of_codes_together_answer_like_one(spark, monkeypatch, k, bits, segment):
    monkeypatch.setattr(code_search, "CODES", 60)
    monkeypatch.setattr(code_search, "QUERIES", 7)
    rng = np.random.default_rng(bits)
    rows = [(i, rng.normal(size=bits).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(frame, F.col("vec_id") % 10 == 0, k=k, bits=bits, segment=segment)
    assert tuples(got, "query_id", "neighbour_id", "distance", "rank") == expected(rows, k, bits)


def test_segments_are_evened_out(spark, monkeypatch):
    """524,288 codes would be numbered by 20 bits: the last of four segments had 4, which a sixteenth of all codes share."""
    seen, cut = [], code_search.signs
    monkeypatch.setattr(code_search, "signs", lambda v, bits, segment: seen.append(segment) or cut(v, bits, segment))
    frame = spark.range(1 << 19).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    monkeypatch.setattr(code_search, "CODES", 1 << 19)
    frame = frame.withColumn("embedding", F.array_repeat(F.lit(1.0), 64))
    assert search(frame, F.lit(False)).count() == 0
    assert seen == [16]
