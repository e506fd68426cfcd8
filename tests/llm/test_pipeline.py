"""The corpus pipeline: contracts of its stages, and what each of them must decide."""

import __spark_entry__
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_shrink(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after


def test_run_and_its_registration(spark, sf_dir):
    found = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    rows = found.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) > 0
    assert all(0 < r["taken"] <= 2 * r["size"] for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    prose = " ".join(f"word{k % 23}x{k}" for k in range(120))
    key = "AKIA" + "Z7Q2" * 5
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + " tail", None, None, None), (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", "a", 0), (None, f"my key is {key} and nothing else", "en", "b", 9), (5, "long " * 30_000, "en", "b", 9)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    names = ["size", "score", "row_key", "node", "label", "key"]
    docs = spark.createDataFrame([(*r, *"abcdef") for r in rows], fields + "".join(f", {n} string" for n in names))
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept, none = stage(spark, docs, sf_dir), stage(spark, nothing, sf_dir)
        assert kept.columns == docs.columns and none.columns == docs.columns and none.count() == 0, name
        docs = kept.cache()
    left = docs.collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left)
    assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]  # of the copies one, blank rows all
    assert not any(key in (r["text"] or "") for r in left) and {r["score"] for r in left} == {"b"}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert all(0 < r["taken"] <= 2 * r["size"] for r in mixed.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf_dir).count() == 0
