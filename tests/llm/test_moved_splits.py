"""Near duplicates where file splits move between jobs."""

from llm_helpers import PROSE

from lodestar.llm import stages as pipeline

SPLIT = "spark.sql.files.maxPartitionBytes"


def test_copies_go_where_splits_move_between_jobs(spark, tmp_path, monkeypatch):
    copies = [(i, PROSE) for i in range(0, 60, 3)]
    others = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(60) if i % 3]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string").repartition(12, "doc_id")
    docs.write.parquet(str(tmp_path / "docs"))
    join, before = pipeline.ngram_join.ngram_join, spark.conf.get(SPLIT)

    def moved(*args, **kwargs):
        out = pipeline.written(join(*args, **kwargs))
        spark.conf.set(SPLIT, "4000")
        return out

    monkeypatch.setattr(pipeline.ngram_join, "ngram_join", moved)
    try:
        left = pipeline.one_per_group(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    finally:
        spark.conf.set(SPLIT, before)
    assert sorted(r.doc_id for r in left) == sorted([0] + [i for i, _ in others])
