"""The Kneser-Ney filter against a plain version, held-out labels, and the pipeline."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import kneser_ney, queries
from tests.llm.conftest import documents


def _plain_model(texts):
    """Probabilities by dictionaries, order by order."""
    found = Counter(int(c) for t in texts for c in kneser_ney.codes(t))
    c3 = {(c >> 12, c >> 6 & 63, c & 63): n for c, n in found.items()}
    c2, c1 = Counter(), Counter()
    for _, c, d in c3:
        c2[c, d] += 1
    for _, d in c2:
        c1[d,] += 1

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        if 0 in n[:3]:
            return [0.5, 0.75, 0.75]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) for k in range(3)]

    def order(counts, below):
        d = discounts(counts)
        total, spare = defaultdict(float), defaultdict(float)
        for key, n in counts.items():
            total[key[:-1]] += n
            spare[key[:-1]] += d[min(n, 3) - 1]

        def p(*key):
            context, low = key[:-1], below(*key[1:])
            if not total[context]:
                return low
            n = counts.get(key, 0)
            return ((n - d[min(n, 3) - 1] if n else 0) + spare[context] * low) / total[context]

        return p

    return order(c3, order(c2, order(c1, lambda: 1 / 64)))


def test_costs_equal_the_plain_model(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    table = kneser_ney.fit(kneser_ney.sequence_counts(docs))
    p = _plain_model(texts)
    for code in [*range(0, 64**3, 61), *kneser_ney.codes(texts[0]).tolist()]:
        want = -math.log(p(code >> 12, code >> 6 & 63, code & 63)) * kneser_ney.UNIT
        assert abs(table[code] - want) <= 2
    sums = np.exp(-table.astype(np.float64) / kneser_ney.UNIT).reshape(-1, 64).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)  # probabilities of every context


def test_limits_take_in_neighbours_until_they_are_enough(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "ENOUGH_DOCS", 50)
    rows = [("en", 10 + i % 3, 5 + i / 100) for i in range(100)]  # lengths of four digits: 5.00 to 5.99
    rows += [("en", 200, 3 + i / 1000) for i in range(60)]
    rows += [("fr", 200, 2.0 + i / 10) for i in range(10)]
    rows += [(None, 200, 1.0)] * 3
    scores = spark.createDataFrame(rows, "lang string, n long, score double")
    found = {(rest, lang, length): upper for rest, lang, length, upper in kneser_ney.limits(scores)}
    assert found[False, "en", 4] == pytest.approx(5.991) and found[False, "en", 8] == pytest.approx(3.06)
    assert found[False, "en", 9] == pytest.approx(3.06)  # longer ones than any: the next shorter
    assert found[False, "en", 1] == pytest.approx(5.991)  # shorter ones than any: the next longer
    assert found[True, None, 8] == pytest.approx(3.06)
    assert found[False, "fr", 8] == pytest.approx(3.06)  # too few: that of all together, which is higher
    assert found[False, "fr", 4] == pytest.approx(5.991)
    assert not [k for k in found if k[:2] == (False, None)]  # a language with three documents
    assert kneser_ney.limits(scores.limit(3)) == []


def test_repeats_and_marks_become_symbols():
    plain, repeats = kneser_ney.codes("spam ham egg"), kneser_ney.codes("spam spam spam")
    assert len(repeats) == len("spam") + 2 + 1 and len(plain) == len("spam ham egg") + 1
    assert len(kneser_ney.codes(None)) == len(kneser_ney.codes("")) == 1
    assert len(kneser_ney.codes("a\x01\x02\x03b")) == 6


def test_held_out_labels(spark):
    """Trained on every second labelled document, judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = kneser_ney.judged(docs, labels.filter("doc_id % 2 = 0")).select("row.doc_id", "keep")
    other = labels.filter("doc_id % 2 = 1").join(rows, "doc_id")
    found = {(r.quality, r.keep): r["count"] for r in other.groupBy("quality", "keep").count().collect()}
    good = found.get((1, True), 0) / (found.get((1, True), 0) + found.get((1, False), 0))
    bad = found.get((0, False), 0) / (found.get((0, True), 0) + found.get((0, False), 0))
    assert good > 0.99 and bad > 0.9


def test_odd_documents_and_labels(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(0, 1, "x"), (1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (77, 1, "x")],
        "doc_id bigint, quality int, lang string",
    )
    rows = kneser_ney.judged(odd, labels)
    assert rows.count() == odd.count()
    assert rows.filter("coalesce(row.text, '') = '' and not keep").count() == 0
    assert kneser_ney.trusted_ids(labels).orderBy("doc_id").collect() == [(0,), (77,)]
    assert kneser_ney.kept(odd, labels).columns == odd.columns
    for few in (labels, labels.filter("false")):
        unjudged = kneser_ney.judged(odd, few)
        assert unjudged.filter("keep and limit is null").count() == odd.count()
    trusted = documents(spark, [(100 + i, f"a plain sentence of good text, number {i}", "en", "s") for i in range(40)])
    both = odd.select(*trusted.columns).union(trusted)
    known = spark.range(100, 140).selectExpr("id as doc_id", "1 as quality")
    rows = kneser_ney.judged(both, known)
    assert rows.filter("limit is null").count() == 0 and rows.filter("not keep").count() > 0
    assert rows.filter("row.doc_id >= 100 and not keep").count() == 0
    assert rows.filter("coalesce(row.text, '') = '' and not keep").count() == 0
    assert kneser_ney.judged(nothing, labels).count() == 0


def test_trusted_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "1 as quality")
    assert 700 < kneser_ney.trusted_ids(labels, bound=1000).count() < 1300


def test_all_trusted_documents_count(spark):
    labels = spark.range(2_100_000).selectExpr("id as doc_id", "1 as quality")
    assert kneser_ney.trusted_ids(labels).count() == 2_100_000


def test_query_covers_the_table(spark, small):
    got = queries.op9_kneser_ney_quality(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()


# --- pipeline -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, small), f"test-{name}")
        out.append(docs)
    return out


def test_every_stage_takes_effect_on_its_own_input(spark, small, steps):
    raw, judged, cleaned, single, mixed, encoded = steps
    for table in steps[1:5]:
        assert table.columns == raw.columns
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert judged.count() == kneser_ney.judged(raw, labels).filter("keep").count() < raw.count()
    assert cleaned.count() == judged.count()
    assert cleaned.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert single.count() == single.select("doc_id").distinct().count() <= cleaned.count()
    assert single.exceptAll(cleaned).count() == 0
    assert mixed.select("doc_id").distinct().exceptAll(single.select("doc_id")).count() == 0
    assert encoded.count() == mixed.count() and encoded.filter("not lossless").count() == 0


def test_run_is_its_stages(spark, small, steps):
    got = corpus_pipeline.run(spark, small)
    assert got.exceptAll(steps[-1]).count() == steps[-1].exceptAll(got).count() == 0


def test_pipeline_of_an_empty_table(spark, small):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
