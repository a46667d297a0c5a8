import re
from collections import Counter

import pytest
from llm_helpers import AWKWARD, blank_words
from test_ngram_join import expected as groups
from test_secret_scan import PLANTED
from test_secret_scan import expected as secrets
from test_toxicity import corpus

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, topic string, rate string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(10_000 + i, t, "en", f"s{i % 3}", len(t), "x", "y") for i, t, _ in corpus(300, 5)]
    rows += [(r[0], r[1], r[2], r[3], None, "x", "y") for r in AWKWARD]
    rows += [(20_000 + i, t, None, "s1", len(t), None, None) for i, t in enumerate(PLANTED)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10_000 + i, label) for i, _, label in corpus(300, 5)],
                          "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def step(spark, path, name, rows, direct=False):
    docs = spark.createDataFrame(rows, COLUMNS)
    out = dict(pipeline.STAGES)[name](spark, docs if direct else pipeline.written(docs), path)
    assert name == "packing" or out.columns == docs.columns
    return [tuple(r) for r in out.collect()]


def test_order_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_toxic_documents_go(spark, folder):
    path, rows = folder
    toxic = {10_000 + i for i, _, label in corpus(300, 5) if label}
    left = Counter(step(spark, path, "toxicity", rows))
    want = Counter(r for r in rows if r[0] not in toxic)
    assert sum((left - want).values()) <= 4 and sum((want - left).values()) == 0


@pytest.mark.parametrize("direct", [False, True])
def test_one_document_of_each_group_stays(spark, folder, direct):
    path, rows = folder
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    stays = {component for _, _, component in groups([(i, r[1]) for i, r in enumerate(ordered)])}
    left = step(spark, path, "near_duplicates", rows, direct)
    assert Counter(r[0] for r in left) == Counter(ordered[i][0] for i in stays)
    assert not Counter(left) - Counter(rows)


def test_secrets_are_masked_and_nothing_else(spark, folder):
    path, rows = folder
    want = []
    for r in rows:
        out, at = "", 0
        for start, _, end, _ in secrets(r[1]):
            if start >= at:
                out, at = out + r[1][at:start] + "[SECRET]", end
            at = max(at, end)
        text = None if r[1] is None else out + r[1][at:]
        want.append((r[0], text, *r[2:4], len(text) if at else r[4], *r[5:]))
    assert Counter(step(spark, path, "secrets", rows)) == Counter(want)


def test_mix_samples_rows(spark, folder):
    path, rows = folder
    left = Counter(step(spark, path, "mixing", rows))
    assert not left - Counter(rows) and 0 < sum(left.values()) < len(rows)


def test_columns_of_any_name_are_carried(spark, folder):
    """Extra columns may have the names that the stages would give to helpers of their own."""
    path, rows = folder
    names = ["__row", "__score", "__no_text", "__hit", "__rate", "__source", "__lang", "__topic"]
    docs = pipeline.written(spark.createDataFrame([(*r[:5], *range(8)) for r in rows], COLUMNS.split(", topic")[0] + "".join(
        f", {n} int" for n in names)))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(range(8))], name


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_input(spark, folder, name):
    assert step(spark, folder[0], name, []) == []


def test_whole_run_packs_what_is_left(spark, folder):
    path, rows = folder
    out = pipeline.run(spark, path).collect()
    sizes = Counter()
    for r in out:
        sizes[r.doc_id] += r.length
    texts = {r[0]: r[1] for r in rows}
    for doc, size in sizes.items():
        n = len(blank_words(texts[doc]))
        masked = re.search("[0-9a-f]{16}|AKIA|[=:]", texts[doc] or "")
        assert doc is None or masked or size == n + bool(n)
    assert 0 < len(sizes) < len(rows)
