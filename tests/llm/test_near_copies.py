"""The near copies that stay out of the corpus are those of the exact similarity."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from logsift.llm import near_copies
from logsift.llm.common import written
from tests.llm.conftest import documents


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _plain_kept(rows):
    """The smallest id of each group that pairs of similarity 0.8 connect."""
    sets, label = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}


def test_copies_just_over_the_similarity_go_and_others_stay(spark, odd, nothing):
    random = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(3000)]
    rows = []
    for g in range(120):
        base = [vocabulary[i] for i in random.integers(0, 3000, 300)]
        other = list(base)
        # 10 changed words leave a similarity of about 0.71, 6 of about 0.82
        for place in random.choice(300, (4, 6, 7, 10)[g % 4], replace=False):
            other[place] = "changed"
        rows += [(1000 - 2 * g, " ".join(base), "en", "s"), (999 - 2 * g, " ".join(other).upper(), "en", "s")]
    line = "one line that is said again and again by them "
    for g in range(6):  # what is not repeated differs
        own = [vocabulary[i] for i in random.integers(0, 3000, 40)]
        rows.append((2000 + g, line * 200 + " ".join(own), "en", "s"))
    hot = [vocabulary[i] for i in random.integers(0, 3000, 200)]
    rows += [(3000 + i, " ".join([*hot, f"end{i}"]), "en", "s") for i in range(60)]
    rows += [(4000, "", "en", "s"), (4001, None, "en", "s"), (4002, "few words", "en", "s"), (4003, "Few  words", "en", "s")]
    want = _plain_kept(rows)
    got = [r.doc_id for r in near_copies.one_of_each(documents(spark, rows)).collect()]
    assert len(got) == len(set(got))
    # of the 120 pairs and more at 0.8 or over, the bands miss one in ten thousand
    assert set(got) == want
    stay = near_copies.one_of_each(odd)
    assert stay.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stay.collect())
    assert [i[1] for i in ids if not i[0]] == [0, 2, 5, 6, 8, 9, 9, 10, 11]
    assert [i[2] for i in ids if i[0]] == ["no identity at all here"]
    assert near_copies.one_of_each(nothing).count() == 0


def _page_sets(spark, rows):
    found = near_copies.signatures(documents(spark, rows), 5, "doc_id", "text")
    nodes = found.select(F.struct("s1", "s2").alias("node"), "doc", "size", "k1", "k2")
    sets = near_copies._sets(documents(spark, rows), nodes.select("node", "k1", "k2"), 5, "doc_id", "text")
    nodes = nodes.dropDuplicates(["node"]).select("node", "doc", "size", F.col("node").alias("label"))
    return written(nodes, "n"), written(sets, "s")


def test_pages_of_a_template_below_the_similarity_are_not_verified_pair_by_pair(spark):
    random = np.random.default_rng(8)
    base = [f"w{i}" for i in random.integers(0, 5000, 160)]
    rows = []
    for page in range(2000):
        own = [f"p{page}x{i}" for i in range(20 + page % 20)]  # 160 shared words, similarities of 0.60 to 0.75
        rows.append((page, " ".join(base + own), "en", "s"))
    nodes, sets = _page_sets(spark, rows)
    assert near_copies._open_pairs(nodes.drop("doc"), sets, 0.8).count() <= 3 * 2000


def test_the_rare_shingles_lose_no_pair(spark):
    random = np.random.default_rng(9)
    base = [f"w{i}" for i in random.integers(0, 5000, 120)]
    rows = []
    for page in range(150):
        words = list(base[: 120 - int(random.integers(0, 40))])
        for place in random.integers(0, len(words), int(random.integers(0, 6))):
            words[place] = f"v{random.integers(0, 40)}"
        rows.append((page, " ".join(words), "en", "s"))
    rows += [(900 + i, " ".join("abcdefg"[: i + 1]), "en", "s") for i in range(7)]
    nodes, sets = _page_sets(spark, rows)
    pairs = near_copies._verified(near_copies._open_pairs(nodes.drop("doc"), sets, 0.8), sets, 0.8)
    names = {tuple(r.node): r.doc for r in nodes.collect()}
    got = {tuple(sorted((names[tuple(r.u)], names[tuple(r.v)]))) for r in pairs.collect()}
    plain = {names[tuple(r.node)]: _shingles(next(t for i, t, *_ in rows if i == r.doc)) for r in nodes.collect()}
    want = {
        (i, j)
        for i, j in itertools.combinations(sorted(plain), 2)
        if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) - 1e-9
    }
    assert got == want and len(want) > 500
