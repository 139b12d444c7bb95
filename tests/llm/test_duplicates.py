from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapforge.llm import common, components, exact, minhash, passages
from mapforge.llm.shingles import as_bytes, shingle_sets, signatures, windows, word_hashes


def near_brute(texts, percent=75):
    """components by all pairs: {doc: (size, component)}; rows with one id are one document."""
    sets = collections.defaultdict(list)
    for i, t in texts:
        if i is not None:
            w = as_bytes(t).lower().split()
            sets[i].append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_duplicates_by_all_pairs(spark):
    got = minhash.near_duplicates(documents(spark)).collect()
    want = near_brute([(r[0], r[1]) for r in rows()])
    assert len(got) == len(rows())
    for r in got:
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert {r.n_shingles for r in got if r.doc_id in (50, 51, 52)} == {0} and {r.n_shingles for r in got if r.doc_id in (53, 54, 56)} == {1}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Most copies are not similar enough to the group's smallest one: the links among the rest are found as well."""
    rnd = random.Random(4)
    base = prose(rnd, 60).split()
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = prose(rnd, 1)
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == near_brute(texts)


def test_one_of_each_group_stays(spark):
    want = near_brute([(r[0], r[1]) for r in rows()])
    got = minhash.one_of_each(documents(spark))
    assert got.columns == documents(spark).columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(r[0] for r in rows() if r[0] is None or want[r[0]] == r[0])


def test_signatures_agree_as_often_as_sets():
    rnd = random.Random(2)
    words = [str(rnd.random()) for _ in range(400)]
    v, b = shingle_sets([" ".join(words), " ".join(words[100:])])
    sig = signatures(v, b, 2000)
    x, y = set(v[b[0] : b[1]].tolist()), set(v[b[1] : b[2]].tolist())
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.04


def test_the_guaranteed_distance_shares_a_bucket(spark):
    rnd = np.random.default_rng(1)
    one = rnd.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
    rows_ = [(0, one.tobytes())]
    for i in range(1, 60):
        other = one.copy()
        at = rnd.permutation(minhash.SYMBOLS)[: minhash.GUARANTEED]
        other[at] ^= rnd.integers(1, 1 << 16, len(at), dtype=np.uint16)
        rows_.append((i, other.tobytes()))
    keys = collections.defaultdict(set)
    for r in minhash.bucket_keys(spark.createDataFrame(rows_, "doc_id long, sig binary")).collect():
        keys[r.doc_id].add(r.key)
    assert all(keys[0] & keys[i] for i in range(1, 60))


@pytest.mark.parametrize("finish", [0, 10**6])
def test_components(spark, finish):
    rnd = random.Random(finish)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(9)] + [(7, 7), (None, 3)]
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = a, b
            for n in (x, y):
                up.setdefault(n, n)
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    got = components.components(spark.createDataFrame(edges, "a long, b long"), finish=finish)
    assert sorted((r.node, r.component) for r in got.collect()) == sorted((n, top(n)) for n in up)


def exact_brute(texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((len(t or ""), i is not None, -(i or 0)))
    return {k: (len(v), max(v)) for k, v in groups.items()}


@pytest.mark.parametrize("page, bits", [(32_000_000, None), (200, 10)])
def test_exact_duplicates(spark, page, bits):
    got = exact.exact_duplicates(documents(spark), page=page, bits=bits).collect()
    texts = [(r[0], r[1]) for r in rows()]
    want = exact_brute(texts)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(texts) and {r.text_sha256 for r in got} == set(by_hash)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(set(by_hash))
    for r in got:
        n, (_, has, neg) = by_hash[r.text_sha256]
        assert r.group_size == n and r.keep_id == (-neg if has else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert exact.exact_duplicates(empty(spark)).count() == 0


def test_without_duplicates_has_one_row_for_each_text(spark):
    got = exact.without_duplicates(documents(spark)).collect()
    left = collections.Counter(re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in got if r.doc_id is not None)
    assert set(left.values()) == {1}
    assert sum(r.doc_id is None for r in got) == 2


def test_a_copy_goes_even_if_its_doc_id_has_another_text(spark):
    df = spark.createDataFrame([(1, "a copy"), (5, "a copy"), (5, "another text"), (5, "another text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact.without_duplicates(df).collect()) == [(1, "a copy"), (5, "another text")]


def test_the_directory_doubles():
    d = exact.Directory({i: 10 for i in range(16)}, 4, 25)
    assert d.depth == 3 and len(d.entries) == 8 and all(d.size(b) <= 25 for b in set(d.entries)) and sum(d.size(b) for b in set(d.entries)) == 160
    hot = exact.Directory({5: 1000, 9: 1}, 4, 25)
    b = hot.entries[5 >> (4 - hot.depth)]
    assert hot.size(b) == 1000 and hot.pages(b) == 40


def test_chains_prefer_order():
    frags = [(0, 10, 0), (12, 10, 13), (30, 10, 200), (40, 10, 44)]
    assert passages.chains(frags)[0] == [0, 1, 3]
    assert sorted(sum(passages.chains(frags), [])) == [0, 1, 2, 3]


def test_chain_scores_are_those_of_all_pairs():
    rnd = random.Random(6)
    for _ in range(20):
        frags = [(rnd.randrange(200), rnd.randint(8, 20), rnd.randrange(200)) for _ in range(12)]
        best, order = {}, sorted(range(12), key=lambda i: frags[i][0])
        for i in order:
            x, m, y = frags[i]
            before = [best[j] - passages.GAP_COST * ((x - frags[j][0] - frags[j][1]) + (y - frags[j][2] - frags[j][1])) for j in best if frags[j][0] + frags[j][1] <= x and frags[j][2] + frags[j][1] <= y]
            best[i] = m + max([0, *before])
        chain = passages.chains(frags)[0]
        got = sum(frags[i][1] for i in chain) - sum(passages.GAP_COST * ((frags[b][0] - frags[a][0] - frags[a][1]) + (frags[b][2] - frags[a][2] - frags[a][1])) for a, b in zip(chain, chain[1:]))
        assert abs(got - max(best.values())) < 1e-9


def test_winnowing_leaves_no_gap():
    h = np.random.default_rng(0).integers(0, 2**64, 300, dtype=np.uint64)
    at = passages.picked(h, 12)
    assert at[0] < 12 and at[-1] >= 288 and np.diff(at).max() <= 12
    assert passages.picked(h[:5], 12).tolist() == [int(h[:5].argmin())] and len(passages.picked(h[:0], 12)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=12), st.integers(1, 5), st.integers(1, 5), st.integers(2, 50))
def test_winnowing_of_many_texts_is_that_of_each(counts, k, winnow, words):
    hashes = np.random.default_rng(len(counts)).integers(1, words, sum(counts)).astype(np.uint64)
    rolled = windows(hashes, k)
    at, text = passages.picked_of_all(rolled, np.array(counts), k, winnow)
    want, begin = [], 0
    for i, n in enumerate(counts):
        if n >= k:
            want += [(int(a), i) for a in passages.picked(windows(hashes[begin : begin + n], k), winnow)]
        begin += n
    assert list(zip(at.tolist(), text.tolist())) == want
    found = rolled[(np.cumsum(counts) - counts)[text] + at] if len(at) else rolled[:0]
    first = {}
    for h, t, a in zip(found.tolist(), text.tolist(), at.tolist()):
        first.setdefault((t, h), a)
    assert passages.since_first(found, text, at).tolist() == [a - first[t, h] for h, t, a in zip(found.tolist(), text.tolist(), at.tolist())]


def test_runs_have_equal_hashes_when_their_words_are_equal():
    w = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    w[200:260] = w[20:80]
    for m in (1, 7, 20, 50):
        h = passages._rolled(w, m)
        assert len(h) == 301 - m and (h[200 : 261 - m] == h[20 : 81 - m]).all() and len(set(h.tolist())) == len(h) - 61 + m


def test_repeated_passages_are_found_and_the_rest_left_alone(spark):
    got = passages.repeated_passages(documents(spark)).collect()
    words = {r[0]: as_bytes(r[1]).lower().split() for r in rows()}
    for i in (41, 42, 43):
        mine = [r for r in got if r.doc_id == i and r.source_id == 40]
        assert mine and min(r.start for r in mine) == 40 and max(r.stop for r in mine) == 110
    for r in got:
        assert r.source_id < r.doc_id and r.passage_stop - r.passage_start >= 50
        assert r.matched >= 0.8 * (r.stop - r.start)
    flagged = {r.doc_id for r in got}
    assert 40 not in flagged and not flagged & {0, 1, 5, 7, 8, 9, 10, 11, 50, 51, 52, 53, 54, 57, 60}
    assert {20, 21, 22} <= flagged and words[20] == words[0]
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_a_passage_with_changed_words_is_one(spark):
    rnd = random.Random(8)
    p = prose(rnd, 90).split()
    q = list(p)
    q[25], q[60] = "other", "words"
    del q[44]
    df = spark.createDataFrame([(1, prose(rnd, 30) + " " + " ".join(p)), (2, " ".join(q) + " " + prose(rnd, 30))], "doc_id long, text string")
    r = passages.repeated_passages(df).collect()
    assert len(r) == 1 and r[0].passage_start <= 1 and 88 <= r[0].passage_stop <= 91 and r[0].matched >= 86


def unique(*counts):
    """Runs of words that occur once."""
    names = (f"w{i}" for i in range(sum(counts)))
    return [[next(names) for _ in range(n)] for n in counts]


def found_words(got, doc):
    return {i for r in got if r.doc_id == doc for i in range(r.start, r.stop)}


def test_passages_on_both_sides_of_a_gap_are_judged_by_themselves(spark):
    rows, want = [], {}
    for c, n in enumerate((60, 100, 200)):
        p1, p2, gap, other = unique(n, n, 150, 150)
        name = lambda ws, c=c: " ".join(f"{w}c{c}" for w in ws)
        rows += [(10 * c, name(p1 + p2)), (10 * c + 1, name(p1 + gap + p2)), (10 * c + 2, name(p1 + other + p2))]
        want |= {10 * c + d: {*range(n), *range(n + 150, 2 * n + 150)} for d in (1, 2)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {d: found_words(got, d) for d in want} == want


def test_a_passage_is_found_whose_parts_stand_in_smaller_documents(spark):
    rows, want = [], {}
    for c in range(20):
        half = 25 if c % 2 else 30
        l1, l2, a, b, x, y = unique(half, half, 40, 40, 30, 30)
        name = lambda ws, c=c: " ".join(f"{w}c{c}" for w in ws)
        rows += [(10 * c, name(l1 + a)), (10 * c + 1, name(b + l2)), (10 * c + 2, name(x + l1 + l2)), (10 * c + 3, name(l1 + l2 + y))]
        want |= {10 * c + 3: set(range(2 * half))}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(want[d] <= found_words(got, d) for d in want)


def test_text_that_repeats_inside_its_source_is_found(spark):
    p, *gaps = unique(60, *[60] * 6)
    source = [w for i, gap in zip((41, 30, 20, 10, 0), gaps) for w in p[i : i + 19] + gap] + p + gaps[-1]
    got = passages.repeated_passages(spark.createDataFrame([(1, " ".join(source)), (2, " ".join(p))], "doc_id long, text string")).collect()
    assert found_words(got, 2) == set(range(60))


def test_passages_with_many_changed_words_are_found(spark):
    rnd, rows, n = random.Random(9), [], 0
    for size in (60, 100):
        for every in (6, 8, 10, 15):
            for _ in range(5):
                p, a, b, c, d, changes = unique(size, 40, 40, 40, 40, size)
                at = rnd.randrange(every)
                q = [changes[i] if i % every == at else w for i, w in enumerate(p)]
                rows += [(2 * n, " ".join(f"{w}c{n}" for w in a + p + b)), (2 * n + 1, " ".join(f"{w}c{n}" for w in c + q + d))]
                n += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 2 * n, 2))
    assert all(36 <= r.start and r.stop <= len(rows[r.doc_id][1].split()) - 36 for r in got)


def test_removing_passages_keeps_the_rest(spark):
    assert passages.without("a b  c\nd e", [(1, 3)]) == "a d e" and passages.without("a b", [(0, 2)]) == ""
    docs = documents(spark)
    left = {r.doc_id: r.text for r in passages.removed_passages(docs).collect() if r.doc_id is not None}
    before = {r[0]: r[1] for r in rows()}
    assert left[40] == before[40] and left[41].split() == before[41].split()[:40] + before[41].split()[110:]
    assert 20 not in left and left[50] is None and left[60] == before[60]
    assert passages.removed_passages(docs).columns == docs.columns


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def in_earlier_documents(docs, least):
    """Brute force: of each document, the words inside a run of `least` words that a smaller doc_id has as well."""
    runs = {}
    for d, w in docs.items():
        for i in range(len(w) - least + 1):
            runs.setdefault(tuple(w[i : i + least]), set()).add(d)
    return {d: {j for i in range(len(w) - least + 1) if min(runs[tuple(w[i : i + least])]) < d for j in range(i, i + least)} for d, w in docs.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages_against_brute_force(spark, seed):
    """Every word of an exact repeat of 50 words is found, periodic text and hubs' own repeats included; and what is found matches."""
    rnd = random.Random(seed)
    fresh = (f"w{i}" for i in range(10**6))
    pool = [[next(fresh) for _ in range(rnd.randint(15, 90))] for _ in range(8)]
    common = [next(fresh) for _ in range(6)]
    docs = {}
    for d in range(60):
        w = []
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.random()
            if kind < 0.45:
                w += rnd.choice(pool)
            elif kind < 0.6:
                w += ["round", "again"] * rnd.randint(5, 80)
            elif kind < 0.7:
                w += [rnd.choice(common) for _ in range(rnd.randint(5, 60))]
            else:
                w += [next(fresh) for _ in range(rnd.randint(1, 80))]
        docs[d] = w
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    want = in_earlier_documents(docs, 50)
    for d in docs:
        assert want[d] <= found_words(got, d), d
    for r in got:
        assert r.source_id < r.doc_id and 0 <= r.start < r.stop <= len(docs[r.doc_id]) and r.passage_stop - r.passage_start >= 50
        assert r.matched >= 0.8 * max(r.stop - r.start, r.source_stop - r.source_start)
        assert lcs(docs[r.doc_id][r.start : r.stop], docs[r.source_id][r.source_start : r.source_stop]) >= r.matched


def test_words_that_go_round_make_few_chains(spark):
    """300 times the same two words match their source on 276 diagonals of 50 words; about one for each 50 words is left."""
    p = ["round", "again"] * 300
    df = spark.createDataFrame([(d, " ".join([f"a{d}", *p, f"b{d}"])) for d in range(5)], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert len(got) <= 4 * 16 and all(found_words(got, d) >= set(range(1, 601)) for d in range(1, 5))


def test_joins_are_by_hash_where_parts_are_small(spark, monkeypatch):
    """Seeds and runs are joined without sorting them; the session has its own setting again afterwards."""
    key, seen = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", {}

    def noted(df, name):
        seen[name] = spark.conf.get(key)
        return common.saved(df, name)

    monkeypatch.setattr(passages, "saved", noted)
    before = spark.conf.get(key)
    p = " ".join(f"p{i}" for i in range(90))
    got = passages.repeated_passages(spark.createDataFrame([(d, p) for d in range(3)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and spark.conf.get(key) == before == seen["chains"]
    assert seen["shared"] == seen["matched-runs"] == str(common.HASHED_BYTES)


def test_pieces_of_passages_against_brute_force(spark):
    """Pieces begin and end anywhere, so that seeds' first holders end inside the runs that later documents share."""
    rnd = random.Random(9)
    pool = [[f"w{i}x{j}" for j in range(150)] for i in range(3)]
    docs = {}
    for d in range(70):
        w = []
        for n in range(rnd.randint(1, 4)):
            a = rnd.randrange(100)
            w += [*rnd.choice(pool)[a : a + rnd.randint(44, 100)], f"d{d}n{n}"][: 10**6 if rnd.random() < 0.5 else -1]
        docs[d] = w
    got = passages.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).collect()
    want = in_earlier_documents(docs, 50)
    assert all(want[d] <= found_words(got, d) for d in docs)


def test_two_texts_of_a_doc_id_are_not_taken_for_one_run(spark):
    """The two texts with id 0 have the halves of a passage in the places of the whole; only id 1 has a run of 50 words of it."""
    p = [f"p{i}" for i in range(80)]
    rows = [(0, p[:40] + [f"a{i}" for i in range(40)]), (0, [f"b{i}" for i in range(36)] + p[36:]), (1, p), (2, p)]
    got = passages.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert any((r.doc_id, r.source_id, r.start, r.stop) == (2, 1, 0, 80) for r in got)


def test_covering_keeps_what_is_covered():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randint(1, 12)
        x, m = np.array([rnd.randrange(120) for _ in range(n)]), np.array([rnd.randrange(4, 40) for _ in range(n)])
        keep, starts, ends = passages.covering(x, m, 15)
        words = lambda at: {w for i in at for w in range(x[i], x[i] + m[i])}
        long = [i for i in range(n) if m[i] >= 15]
        assert words([i for i in keep if m[i] >= 15]) == words(long) == {w for a, b in zip(starts, ends) for w in range(a, b)}
        assert {i for i in range(n) if m[i] < 15} <= set(keep.tolist())


def test_removed_passages_with_columns_of_the_operators_names(spark):
    p = " ".join(unique(60)[0])
    rows = [(1, p, [1], "x", 1, "r"), (2, p + " more", [2], None, 2, "s"), (3, None, None, "z", 3, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>, row string, of int, `passage.start` string").select("*", F.array(F.lit(1)).alias("filled"))
    out = passages.removed_passages(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, tuple(r.spans or ()), r.row, r.of) for r in out.collect()} == {(1, p, (1,), "x", 1), (2, "more", (2,), None, 2), (3, None, (), "z", 3)}


def test_a_large_directory_is_made_at_once():
    """2 ** 18 entries; splits take time in proportion to the entries, not to their square."""
    d = exact.Directory({i: 10 for i in range(1 << 18)}, 18, 15)
    assert d.depth == 18 and len(d.entries) == len(set(d.entries.tolist())) == 1 << 18
    assert [b for _, b, _, _ in d.rows()] == d.entries.tolist()


def largest_share(df):
    """Rows of the fullest partition over the mean of all."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / (sum(n) / df.rdd.getNumPartitions())


def test_rows_without_a_key_are_dealt_evenly(spark):
    """Joins that leave most rows alone: no partition has over twice the mean, although nothing is broadcast."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("-1", "false", "8")):
            spark.conf.set(k, v)
        left = common.saved(spark.range(8000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v")).repartition(4), "left")
        right = spark.range(0, 8000, 10).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
        out = common.left_by_key(left, right, "k")
        assert out.count() == 8000 and out.filter("w = k + 1").count() == 800 and out.filter("w is null").count() == 7200
        assert largest_share(out) < 2
        words = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(2000)]
        docs = spark.createDataFrame([(i if i % 3 else None, words[i // 2 * 2] if i < 200 else w) for i, w in enumerate(words)], "doc_id long, text string")
        assert largest_share(minhash.near_duplicates(docs)) < 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aAbé \n\t\x0b\x1f\u00a0☃"), max_size=40) | st.sampled_from(["x" * 63, "X" * 64 + " " + "x" * 65, "x" * 200 + "y", " ", "a" * 8 + " " + "a" * 9]), max_size=6))
def test_equal_words_have_equal_hashes_and_others_not(texts):
    got, counts = word_hashes(texts)
    words = [as_bytes(t).lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(got) == len(flat) and len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
