"""The word model against a plain version, and what it tells that shapes don't."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from logsift.llm import kneser_ney, word_model
from tests.llm.conftest import documents


def _words(text):
    return ["<s>", *(text or "").encode().split(), "</s>"]


def _plain_cost(texts):
    """The cost of a text under the model of texts, by dictionaries; pairs and words that occur once have no terms."""
    c2 = Counter(t for x in texts for t in zip(_words(x), _words(x)[1:]))
    c1 = Counter(b for _, b in c2)

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        if 0 in n[:3]:
            return [0.5, 0.75, 0.75]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) for k in range(3)]

    d1, d2 = discounts(c1), discounts(c2)
    total = Counter()
    for (a, _), n in c2.items():
        total[a] += n
    known = {w for w in {*c1, *total} if c1[w] >= 2 or total[w] >= 2}
    mass = sum(c1.values())
    seen = {w: c1[w] - d1[min(c1[w], 3) - 1] for w in known if c1[w]}
    unseen = (mass - sum(seen.values())) / mass / (len({*c1, *total}) + 1)
    taken = defaultdict(float)  # of each context, by pairs that have terms
    for (a, _), n in c2.items():
        if n >= 2:
            taken[a] += n - d2[min(n, 3) - 1]

    def p(a, b):
        one = seen[b] / mass + unseen if b in seen else unseen
        if a not in known or not total[a]:
            return one
        left = (total[a] - taken[a]) / total[a]
        n = c2[a, b]
        return (n - d2[min(n, 3) - 1]) / total[a] + left * one if n >= 2 and b in known else left * one

    return lambda text: -sum(math.log(p(*t)) for t in zip(_words(text), _words(text)[1:]))


def test_word_costs_equal_the_plain_model(spark, small, odd):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    asked = [*texts[20:], "", None, "of the the the", "never seen words", *(r.text for r in odd.collect())]
    train = spark.createDataFrame([(t,) for t in [*texts[:40], *texts[:5], "", None]], "text string").repartition(3)
    model = word_model.fit(train)
    rows = [(i, -i, t) for i, t in enumerate(asked)]
    docs = spark.createDataFrame([*rows, *rows[:5]], "k1 bigint, k2 bigint, text string")  # repeated rows count once
    plain = _plain_cost([*texts[:40], *texts[:5], "", None])
    for hot, rounds in ((word_model.HOT, 3), (7, 2), (0, 1)):
        got = {r.k1: r for r in word_model.costs(docs.repartition(4), model, hot, rounds).collect()}
        assert len(got) == len(asked)
        for i, _, text in rows:
            assert got[i].k2 == -i and got[i].n == len((text or "").encode().split()) + 1
            assert abs(got[i].cost / word_model.UNIT - plain(text)) <= 1e-5 * got[i].n


def test_every_pair_costs_what_the_plain_model_says(spark):
    texts = ["a b a b c", "a b d", "c a b", "b c c a", "e a b c", "a b"] * 2 + ["f g", "h"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    words = sorted({w for t in texts for w in t.split()})
    model = word_model.fit(train)
    pairs = [(a, b) for a in words for b in [*words, None]]  # None: the end
    asked = [f"{a} {b}" if b else a for a, b in pairs] + words
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(asked)], "k1 bigint, k2 bigint, text string")
    cost = {asked[r.k1]: r.cost / word_model.UNIT for r in word_model.costs(docs, model).collect()}
    plain = _plain_cost(texts)
    for text, found in cost.items():
        assert abs(found - plain(text)) < 1e-4


def test_nothing_trusted(spark):
    none = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame([(1, 2, "a b"), (3, 4, None)], "k1 bigint, k2 bigint, text string")
    model = word_model.fit(none)
    assert model.terms.count() == 0
    got = sorted(tuple(r) for r in word_model.costs(docs, model).collect())
    assert got == [(1, 2, 3, 0), (3, 4, 1, 0)]


def test_words_in_a_wrong_order_are_rejected(spark):
    """The letters and their sequences are those of good text; only the order of the words is not."""
    random = np.random.default_rng(1)
    names = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("ran", "vel", "dok", "pim")]
    follow = {w: [names[i] for i in random.choice(20, 3, replace=False)] for w in names}

    def prose():
        words = [names[random.integers(20)]]
        while len(words) < 60:
            words.append(follow[words[-1]][random.integers(3)])
        return words

    good = [(i, " ".join(prose()), "en", "s") for i in range(600)]
    bad = [(1000 + i, " ".join(random.permutation(prose()).tolist()), "en", "s") for i in range(50)]
    labels = spark.range(500).selectExpr("id as doc_id", "1 as quality")
    rows = kneser_ney.judged(documents(spark, good + bad), labels)
    found = {r.doc_id: r.keep for r in rows.select("row.doc_id", "keep").collect()}
    assert sum(found[d] for d, *_ in good) >= 590
    assert sum(found[d] for d, *_ in bad) <= 2
    # the words alone tell them
    assert rows.filter(F.col("row.doc_id") >= 1000).filter("word_score > word_limit").count() >= 48
    assert rows.filter(F.col("row.doc_id") < 1000).filter("word_score > word_limit").count() <= 10
