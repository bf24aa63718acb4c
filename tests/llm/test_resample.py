"""Importance resampling against a plain version and, over the registered query, against SQL."""
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from .conftest import DATA
from clubsieve.llm import queries, resample


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    corpus, wanted = Counter(), Counter()
    for _, t in docs:
        corpus.update(features(t))
    for t in target:
        wanted.update(features(t))
    all_s, all_t = sum(corpus.values()), sum(wanted.values())
    rows = []
    for i, t in docs:
        f = features(t)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (all_s + buckets) / ((corpus[b] + 1) * (all_t + buckets)))) for b in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[:percent * len(fit) // 100]
    return rows, [(k + 1, r[0], r[4]) for k, r in enumerate(drawn)]


def compare(got, docs, target, **parameters):
    rows, drawn = plain(docs, target, **parameters)
    assert Counter((r.id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    assert sorted((r["rank"], r.id, r.score) for r in got if r["rank"]) == drawn


def test_query(run, documents, spark):
    target = [r.text for r in queries.table(spark, DATA, "benchmark").collect()]
    got = run("op13_resample")
    rows, drawn = plain(documents, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, n, w, s) for i, _, n, w, s in rows)
    assert sorted((r["rank"], r.doc_id) for r in got if r["rank"]) == [d[:2] for d in drawn] and drawn
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert Counter(con.execute(queries.RESAMPLE_SQL).fetchall()) == Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got)


ROWS = [(1, None), (2, ""), (3, "!!! --"), (4, "Été ÉTÉ İ 日本 12-x " * 9), (5, "same same same row " * 8), (5, "same same same row " * 8), (None, "no id but words " * 7), (6, "w " * 30_000), (7, "z" * 500 + " tail " * 30)]
ROWS += [(10 + i, " ".join(f"w{(i * k) % 17}" for k in range(25 + i % 3))) for i in range(80)]
TARGET = ["w1 w2 w3 été", None, "row no"]


@pytest.mark.parametrize("longest, head", [(1, 0), (1, 5), (2, 0), (2, 4), (3, 4), (1, 1000)])
def test_any_head_gives_exact_totals(spark, longest, head):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id bigint, text string, score int").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample.resample(docs, target, longest=longest, buckets=97, percent=30, head=head, head_pairs=head).collect()
    compare(got, ROWS, TARGET, longest=longest, buckets=97, percent=30)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none).collect() == []
    compare(resample.resample(docs, none).collect(), ROWS, [])
