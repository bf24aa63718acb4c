"""The stages over the smallest data: what goes, and that all else stays."""
import corpus_pipeline as pipeline

from . import brute
from .conftest import DATA
from clubsieve.llm import queries


def test_stages(spark, tmp_path):
    docs = queries.table(spark, DATA, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r for r in before.collect()}, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["near_copies"]
    leaders = {c for _, _, c in brute.near_copies([(i, r.text) for i, r in before.items()])}
    assert sorted(r.doc_id for r in after) == sorted(leaders)
    before, after = seen["substrings"]
    left = {k[0]: k for k in brute.substrings([(i, r.text) for i, r in before.items()])}
    for r in after:
        assert r.text == before[r.doc_id].text if left[r.doc_id][2] == 0 else brute.sha(r.text) == left[r.doc_id][3]
    before, after = seen["secrets"]
    for r in after:
        assert not brute.secrets(r.text) and r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or "[secret]" in r.text)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows and extra columns that bear the names operators add."""
    labels = [(i, 1, int(i % 2)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = lambda i: " ".join(f"word{i}x{k}" for k in range(50))
    rows = [(i, ("you idiot and moron " * 3 if i % 2 else "") + plain(i), None, "web", 1, "a", "b", "c", 9) for i in range(40)]
    odd = [(None, None), (None, "no id"), (None, "no id"), (50, None), (51, ""), (60, plain(60) + " password=hunter22"), (60, plain(60) + " password=hunter22")]
    rows += [(i, t, "en", None, None, "a", "b", "c", 9) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, is_toxic string, n_words string, spans string, n int")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and [tuple(r) for r in docs.select("is_toxic", "n_words", "spans", "n").distinct().collect()] == [("a", "b", "c", 9)], name
        if name == "toxicity":
            assert sorted(r.doc_id for r in docs.where("doc_id < 40").collect()) == list(range(0, 40, 2))
    left = docs.collect()
    assert sorted((r.text or "") for r in left if r.doc_id is None) == ["", "no id", "no id"]
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [*range(0, 40, 2), 50, 60]
    assert [(r.text, r.n_chars) for r in left if r.doc_id == 60] == [(plain(60) + " [secret]", len(plain(60)) + 9)]
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(left)
    assert pipeline.STAGES[1][1](spark, docs.limit(0), str(tmp_path)).collect() == []
