"""Near-duplicate classes, components, line spread and the mix against plain versions."""

import itertools
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from logsift.llm import components, line_spread, mixing, queries, simhash
from tests.llm.conftest import documents


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()


def _plain_fingerprint(text, size=3):
    words = _lower(text).split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    grams = grams or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_classes(fps, tau):
    """Of each row the smallest row number that links reach."""
    label = list(range(len(fps)))
    a = np.array(fps, dtype=np.uint64)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= tau) + i + 1:
            x, y = root(i), root(int(j))
            label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def _check_classes(docs, got):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [_plain_fingerprint(t) for _, t in rows]
    classes = _plain_classes(fps, 3)
    least = {}
    for (doc, _), c in zip(rows, classes):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    want = [(d, format(f, "016x"), least.get(c)) for (d, _), f, c in zip(rows, fps, classes)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_classes_of_the_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _check_classes(docs, queries.op4_simhash_near_dedup(spark, small))


def test_classes_of_odd_documents(spark, odd, nothing):
    _check_classes(odd, simhash.near_classes(odd))
    assert simhash.near_classes(nothing).count() == 0


@pytest.mark.parametrize("tau", [0, 1, 3, 6, 10])
def test_every_link_is_found(spark, tau):
    random = np.random.default_rng(tau)
    seeds = random.integers(0, 1 << 63, 40).astype(np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in random.choice(64, random.integers(0, 12), False))) for s in seeds for _ in range(12)]
    fps = sorted({int(x) for x in [*seeds, *near]})
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, 0) for x in signed], "fp bigint, fp2 bigint")
    got = {r.fp: r.label_fp for r in simhash.linked_classes(nodes, tau).collect()}
    want = defaultdict(set)
    for x, c in zip(signed, _plain_classes(fps, tau)):
        want[c].add(x)
    found = defaultdict(set)
    for x, label in got.items():
        found[label].add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_a_hot_key_is_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    fps = [x for x in range(200)]  # all upper bits equal
    nodes = spark.createDataFrame([(x, 0) for x in fps], "fp bigint, fp2 bigint")
    rows = simhash.listed(nodes, [simhash.Partition(tuple(range(32, 64)), 0)])
    cells = simhash._in_cells(rows)
    met = set()
    for group in cells.groupBy("a", "b").agg({"fp": "collect_set"}).collect():
        assert len(group[2]) <= 6 * 8
        met |= set(itertools.combinations(sorted(group[2]), 2))
    assert len(met) == 200 * 199 // 2


def test_thresholds_satisfy_the_pigeonhole():
    random = np.random.default_rng(0)
    bits = random.random((3000, 64)) < random.uniform(0.1, 0.9, 64)
    bits[:, 10:14] = bits[:, [9]]  # correlated
    both = bits.astype(float).T @ bits
    for n, tau in itertools.product((3000, 10**7), (1, 3, 8, 10)):
        chosen = simhash.allocate(n, both * n / 3000, tau)
        used = [b for p in chosen for b in p.bits]
        assert len(used) == len(set(used))
        # every way to spread tau differing bits leaves one partition within its threshold
        assert sum(p.threshold + 1 for p in chosen) == tau + 1
    assert len({9, 10, 11, 12, 13} & set(next(g for g in simhash.group_bits(3000, both, 4) if 9 in g))) >= 4


def test_components_settle(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)] + [(130, 200)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (3, 2), (500, 501)], "u bigint, v bigint")
    got = {r.node: r.label for r in components.components(links).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 100, 500: 500, 501: 500}
    assert got == want
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert components.components(none).count() == 0


def test_one_of_each_group_stays(spark, odd, nothing):
    random = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(3000)]

    def text():
        return [vocabulary[i] for i in random.integers(0, 3000, 400)]

    rows, groups = [], []
    for g in range(30):
        base = text()
        for c in range(4):
            words = list(base)
            for place in random.choice(400, 0 if c == 1 else 4, replace=False):
                words[place] = "changed"
            groups.append(g)
            rows.append((1000 - len(rows), " ".join(words), "en", "s"))
    docs = documents(spark, rows)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    seeds = (simhash.SEED, simhash.SECOND_SEED)
    pairs = np.array([simhash.fingerprint(r[1], 5, seeds) for r in rows], dtype=np.uint64)
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        apart = np.bitwise_count(pairs[i] ^ pairs[j])
        if apart[0] <= 12 and apart.sum() <= 23:
            assert groups[i] == groups[j]
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    least = defaultdict(lambda: 10**9)
    for (doc, *_), c in zip(rows, label):
        least[c] = min(least[c], doc)
    assert kept == set(least.values())
    assert len(kept) <= 33  # 30 groups, whose copies have a similarity of 0.8 and more
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stay.collect())
    # 1 copies 0, 3 and 4 and a null one are as empty as 2, 7 copies 6
    assert [i[1] for i in ids if not i[0]] == [0, 2, 5, 6, 8, 9, 9, 10, 11]
    assert [i[2] for i in ids if i[0]] == ["no identity at all here"]
    assert simhash.one_of_each(nothing).count() == 0


# --- lines ---------------------------------------------------------------------------------------


def _by_sql(docs, **options):
    settings = {"min_sites": line_spread.MIN_SITES} | options
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text", "lang", "source").toArrow())
    return con.sql(line_spread.ORACLE.format(docs="given", **settings)).fetchall()


def _cleaned_rows(docs, **options):
    rows = line_spread.without_spread_lines(docs, **options)
    chosen = rows.select("row.doc_id", "row.lang", "row.source", "clean", "n_lines", "n_removed")
    return [tuple(r) for r in chosen.collect()]


def _same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_lines_on_many_sites_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = [tuple(r) for r in queries.op2_line_spread(spark, small).collect()]
    _same(got, [tuple(r) for r in _by_sql(docs)])
    assert any(r[5] for r in got)


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = []
    for line, sites in enumerate([58, 59, 60, 61, 62, 90, 30, 1]):
        for s in range(sites):
            for again in range(2):  # many documents of a site count once
                rows.append((len(rows), f"own text of document {len(rows)}, longer than the line\nline {line}  \n", "en", f"site{s}"))
    docs = documents(spark, rows)
    got = _cleaned_rows(docs, min_sites=60)
    _same(got, _by_sql(docs, min_sites=60))
    assert {r[5] for r in got} == {0, 1} and sum(r[5] for r in got) == 2 * (60 + 61 + 62 + 90)


def test_copies_of_documents_are_left_alone(spark):
    copies = [(i, "a whole document\nthat is copied\neverywhere", "en", f"s{i}") for i in range(12)]
    pages = [(100 + i, f"page number {i} with its own words\nthat is copied", "en", f"s{i}") for i in range(3)]
    got = {r[0]: r[3] for r in _cleaned_rows(documents(spark, copies + pages))}
    assert all(got[i] == copies[0][1] for i in range(12))
    assert got[101] == "page number 1 with its own words"


def test_texts_of_many_lines_take_linear_time(spark):
    lines = [f"own line {i}" if i % 2 else "a notice" for i in range(80_000)]
    pages = [(i, f"page {i}\na notice", "en", f"s{i}") for i in range(12)]
    docs = documents(spark, [(100, "\n".join(lines), "en", "s0"), *pages])
    line_spread.without_spread_lines(docs).count()
    start = time.perf_counter()
    got = {r[0]: r for r in _cleaned_rows(docs)}
    assert time.perf_counter() - start < 15  # a quadratic way takes minutes on a slow machine
    assert got[100][3] == "\n".join(lines[1::2]) and got[100][4:] == (80_000, 40_000)


def test_lines_of_odd_documents(spark, odd, nothing):
    _same(_cleaned_rows(odd, min_sites=2), _by_sql(odd, min_sites=2))
    assert line_spread.cleaned(odd).columns == odd.columns
    assert line_spread.cleaned(odd).count() == odd.count()
    assert line_spread.cleaned(nothing).count() == 0


# --- mix ------------------------------------------------------------------------------------------


def _plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full


def _check_mix(docs, plan):
    rows = plan.collect()
    texts = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.select("doc_id", "source", "text").collect()]
    assert sorted(map(repr, ((r.doc, r.source, r.size) for r in rows))) == sorted(map(repr, texts))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.times <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.times
        largest[r.source] = max(largest[r.source], r.size)
    goal = _plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    return rows


def _plan(docs):
    keyed = mixing.mix(docs)
    k1, _ = mixing.row_keys("doc_id", "source", "text")
    sources = docs.select(k1.alias("k1"), "source").distinct()
    return keyed.join(sources, "k1")


def test_mix_meets_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = _check_mix(docs, _plan(docs))
    again = {(r.doc, r.times) for r in _plan(docs.repartition(9)).collect()}
    assert again == {(r.doc, r.times) for r in rows}
    got = queries.op8_pivotal_mix(spark, small)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mixing.mixed(docs).count() == sum(r.times for r in rows)


def test_mix_of_odd_documents(spark, odd, nothing):
    rows = _check_mix(odd, _plan(odd))
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.times for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_rounding_keeps_probabilities(spark):
    """Over many units with the same probability, that share of them is taken."""
    units = spark.range(6000).selectExpr(
        "'s' as source", "struct(xxhash64(id) as h, id) as id", "cast(1 + id % 7 as double) as size", "0.3 as p"
    ).withColumn("p", mixing.F.col("p").cast("double"))
    rows = mixing.rounded(units).collect()
    assert len(rows) == 6000
    taken = sum((1 + r.id.id % 7) * r.extra for r in rows)
    whole = sum((1 + i % 7) * 0.3 for i in range(6000))
    assert abs(taken - whole) <= 3.5
    assert 0.27 < sum(r.extra for r in rows) / 6000 < 0.33
