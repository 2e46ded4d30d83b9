"""The audit of filters against a plain walk through every order."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.llm import filter_audit
from tests.llm.conftest import documents

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _failures(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = "A" if len(words) < 50 else ""
    fails += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    fails += "D" if re.search("[#$%&*|]", text) else ""
    smaller = doc_id is not None and any(
        i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows
    )
    return fails + ("E" if smaller else "")


def _plain(rows, labels):
    """Every order walked document by document."""
    failing = [(_failures(r[0], r[1], rows), r) for r in rows]
    out = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(f, r) for f, r in failing if (r[3] or "") == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shapley[letter] += len(gone)
                marks = [labels.get(r[0], (0, 0)) if r[0] is not None else (0, 0) for _, r in gone]
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for f, _ in mine) - len(gone),
                    sum(f == letter for f, _ in mine),
                    sum(m[0] for m in marks),
                    sum(m[1] for m in marks),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _got(rows):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows.collect()}


def test_odd_documents(spark, odd):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    labels = spark.createDataFrame(
        [(0, 1, 0, "x"), (0, 0, 1, "x"), (7, 1, None, "x"), (None, 1, 1, "x"), (9, None, 1, "x"), (99, 1, 1, "x")],
        "doc_id bigint, quality int, toxic int, part string",
    )
    marks = {0: (1, 1), 7: (1, 0), 9: (0, 1)}
    got = filter_audit.audit(odd, labels)
    assert _got(got) == _plain(rows, marks) and got.count() == 600 * len({r[3] or "" for r in rows})


def test_copies_over_parts_and_rows_without_identity(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(3, good, "en", "a"), (1, good, "en", "b"), (1, good, "en", "b"), (None, good, "en", "a")]
    rows += [(5, good, "en", "a"), (5, good + " $", "en", "a"), (0, good + " $", "en", None), (7, "X " * 80, "en", "c")]
    rows += [(i, None if i % 2 else "", "en", "b") for i in range(20, 30)]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert _got(filter_audit.audit(documents(spark, rows), none)) == _plain(rows, {})


def test_nothing(spark, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(nothing, none).count() == 0


def test_weights_count_orders():
    for n in (1, 2, 5):
        edges = filter_audit.edge_weights(n)
        walked = Counter()
        for order in itertools.permutations(range(n)):
            state = 0
            for f in order:
                walked[state, f] += 1
                state |= 1 << f
        assert edges == dict(walked)
    with pytest.raises(ValueError):
        filter_audit.edge_weights(8)


def test_other_filters(spark):
    """The lattice takes any conditions: two filters have two orders."""
    docs = documents(spark, [(i, "a" * (i % 7) + "b" * (i % 3), "en", "s") for i in range(60)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit(docs, none, {"S": lambda text: F.char_length(text) < 3})
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in rows.collect()}
    assert set(got) == {("SE", 1), ("SE", 2), ("ES", 1), ("ES", 2)}
    assert got["SE", 2][0] == got["ES", 2][0] == 60 - got["ES", 1][1] - got["ES", 2][1]
