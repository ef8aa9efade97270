import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reliefspark.llm import ann, common, exact_dedup, license_scan, lm, packed, packing, piece_bpe, quality, simhash, substring_dedup, warc

DOCS = "doc_id long, text string, text_sha256 string, fp long, repeated_spans int, length int"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "su", "no") for b in ("ra", "pe", "di", "vo", "xu", "zan", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    base = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base += [(100 + i, base[i % 3][1]) for i in range(20)] + [(200, None), (201, ""), (202, " \t\n"), (203, prose(rng, 9000)), (None, base[0][1]), (5, base[5][1])]
    base += [(300, base[0][1].replace(" ", "\n\t")), (301, base[7][1].upper()), (302, "é 😀 ▁ x")]
    return base


# --- shared ---


def test_components_against_union_find(spark):
    rng = random.Random(1)
    e = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(7, 7), (1000, 1000)] + [(500, 500 + k) for k in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert not common.connected_components(spark.createDataFrame([], "a long, b long")).count()


def test_packed_integers():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), np.array([5]), rng.integers(0, 2**40, 100), np.array([-3, 2**62, -(2**63)])):
        assert (packed.unpack_ints(packed.pack_ints(a)) == a).all()
    s = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (packed.unpack_sorted(packed.pack_sorted(s)) == s).all()
    assert sum(e - a for _, a, e in packed.slices(s, 64, 3)) == len(s)


# --- 1 licence scan ---


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(3)
    return license_scan.train([prose(rng, 20).encode() for _ in range(200)])


@pytest.mark.parametrize("text,family", [("Distributed under the MIT license", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("code is licensed under the Apache License, Version 2.0 (the License)", "apache"), ("GNU Lesser General Public License v3", "lgpl"), ("(c) 2012 Somebody, all rights reserved", "proprietary"), ("This program is under the GNU General Public License version 2", "gpl")])
def test_licences_in_other_words(licence_model, text, family):
    found = licence_model.classify(license_scan.words_of(text.encode()))
    assert found[0] == family and found[3]


@pytest.mark.parametrize("text", ["My license plate is blue and the public garden is free.", "All seats are reserved for members of the club and guests.", "kara lope software midi", ""])
def test_no_licence(licence_model, text):
    found = license_scan.scan_text(licence_model, text.encode())
    assert not [f for f in found if f["confirmed"]]


@pytest.mark.parametrize("n", [20, 40, 80, 400])
def test_licences_within_prose(licence_model, n):
    rng = random.Random(n)
    for notice, family in (("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the GNU GPL v2 or later.", "gpl")):
        for _ in range(5):
            k = rng.randint(0, n)
            found = license_scan.scan_text(licence_model, (prose(rng, k) + " " + notice + " " + prose(rng, n - k)).encode())
            assert {f["family"] for f in found if f["confirmed"]} == {family}
    both = license_scan.scan_text(licence_model, (prose(rng, n) + " Released under the MIT License. " + prose(rng, 3) + " Licensed under CC BY-SA 4.0. " + prose(rng, n)).encode())
    assert {f["family"] for f in both if f["confirmed"]} == {"mit", "cc-by-sa"}


@pytest.mark.parametrize("columns", [40, 72, 1000])
def test_wrapped_notices_are_one_paragraph(licence_model, columns):
    import textwrap

    for family, templates in license_scan.TEMPLATES.items():
        parts = ["some words of prose stand before this one here.", max(templates, key=len), "and some more words after it all."]
        text = "\n\n".join("\n".join(textwrap.wrap(p, columns)) for p in parts)
        assert {x["family"] for x in license_scan.scan_text(licence_model, text.encode()) if x["confirmed"]} == {family}


def test_notice_without_its_usual_words(licence_model):
    """The classifier sees every paragraph: no word is asked for before."""
    found = license_scan.scan_text(licence_model, b"with or without modification, are permitted provided that the following conditions are met")
    assert [(x["family"], x["confirmed"]) for x in found] == [("bsd", True)]


def test_running_sums_equal_single_windows(licence_model):
    rng = random.Random(6)
    w = license_scan.words_of((prose(rng, 50) + " Released under the MIT License. " + prose(rng, 30)).encode())
    memo = common.WordHashes()
    h = np.array([memo[x] for x in w], np.uint64)
    begin = np.arange(0, len(w) - 8)
    at, family, chance = licence_model.likely(h, begin, begin + 8)
    alone = {k: licence_model.classify(w[k : k + 8]) for k in begin.tolist()}
    assert {k for k, x in alone.items() if x} == set(at.tolist()) and len(at)
    assert all(alone[k][0] == licence_model.families[f] and abs(alone[k][1] - p) < 1e-9 for k, f, p in zip(at.tolist(), family.tolist(), chance.tolist(), strict=True))


def test_scan_finds_the_planted_line(spark):
    got = license_scan.scan(table(spark, [(901, "x " * 400 + "Licensed under CC BY 4.0. " + "y " * 400)])).collect()
    assert got[0].families == ["cc-by"]


def test_scan_table(spark, rows):
    more = [(900, "kara mipe\nReleased under the MIT License.\nrudi"), (901, "x " * 400 + "Licensed under CC BY 4.0. " + "y " * 400)]
    got = license_scan.scan(table(spark, rows + more)).collect()
    assert len(got) == len(rows) + 2
    by = {r.doc_id: r for r in got}
    assert by[900].families == ["mit"] and by[900].licences[0].start == 10
    assert by[200].families == [] and by[203].licences == []
    assert not license_scan.scan(table(spark, [])).count()


# --- 2 exact dedup ---


def test_filter_is_lossless():
    rng = np.random.default_rng(3)
    for bits in (20, 44, 64):
        parts = [rng.integers(0, 1 << min(bits, 63), n, dtype=np.uint64) for n in (0, 1, 700, 3000)] + [np.full(100_000, 9, np.uint64)]
        filters = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.of(p, bits).to_bytes()) for p in parts]
        keys, counts = exact_dedup.CountingQuotientFilter.merge(filters).items()
        want = np.unique(np.concatenate(parts), return_counts=True)
        assert (keys == want[0]).all() and (counts.astype(np.int64) == want[1]).all()


def test_exact_duplicates(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_ENTRIES", 8)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect())
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    want = []
    for k, (i, _) in enumerate(rows):
        same = [j for q, (j, _) in enumerate(rows) if norm[q] == norm[k]]
        keep = min((j for j in same if j is not None), default=None)
        first = next(q for q, (j, _) in enumerate(rows) if norm[q] == norm[k] and j == keep)  # of rows that share id and text one stays
        want.append((i is None, i or 0, keep, len(same), k == first, hashlib.sha256(norm[k].encode()).hexdigest()))
    assert got == sorted(want)
    assert not exact_dedup.exact_duplicates(table(spark, [])).count()
    assert exact_dedup.drop_exact_duplicates(table(spark, rows)).columns == table(spark, []).columns


def test_rows_are_dropped_by_their_own_text(spark):
    rows = [(1, "a"), (2, "b"), (2, "a"), (3, "c"), (3, "c"), (None, "z"), (None, "z"), (None, "b"), (4, None), (5, ""), (6, "q")]
    left = exact_dedup.drop_exact_duplicates(table(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c"), (None, "z"), (4, None), (6, "q")]))
    assert sum(r.kept for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()) == 6
    assert not exact_dedup.drop_exact_duplicates(table(spark, [])).count()


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(20)
    t = prose(rng, 80)
    rows = [(1, t), (2, t + " x"), (1, prose(rng, 9)), (None, t + " y"), (2, prose(rng, 9)), (None, "z z"), (None, None), (9, "")]
    left = simhash.drop_near_duplicates(table(spark, rows))
    assert left.columns == table(spark, []).columns
    assert sorted(map(str, [tuple(r) for r in left.select("doc_id", "text").collect()])) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[7]]))
    assert not simhash.drop_near_duplicates(table(spark, [])).count()


# --- 3 nearest neighbours ---


def vectors(spark, v):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1, 2) for i, x in v], "vec_id long, embedding array<float>, rank int, score int")


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:340] = x[0]  # a group of copies
    v = list(enumerate(x.tolist())) + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (None, x[1].tolist()), (4, x[4].tolist())]
    got = ann.nearest(vectors(spark, v)).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(lists) == set(range(0, 900, 20))
    hits = 0
    for q, found in lists.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        assert len(found) == 20 and np.allclose([s[i] for i, _ in found], [b for _, b in found])
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({i for i, _ in found} & set(want.tolist()))
    assert hits / (20 * len(lists)) >= 0.9
    assert [i for i, _ in lists[0]] == list(range(300, 320))


def test_nearest_over_many_areas(spark, monkeypatch):
    """Areas, vectors and queries dealt into many parts: recall as before, and no query without its whole list."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "ASK_ROWS", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 12)) * 2
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 12))).astype(np.float32).astype(float)
    got = ann.nearest(vectors(spark, list(enumerate(x.tolist())))).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(lists[q]) == list(range(1, 21))
        hits += len(set(lists[q].values()) & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hits / (20 * len(lists)) >= 0.9


def test_vectors_of_other_lengths_take_part(spark):
    got = ann.nearest(vectors(spark, [(0, [1, 0]), (1, [3]), (2, [2, 5, 1]), (20, [0, 1]), (21, [0, 2])])).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 1, 3.0), (2, 2, 2.0), (3, 20, 0.0), (4, 21, 0.0)]


def test_nearest_of_few(spark):
    got = ann.nearest(vectors(spark, [(0, [1, 0]), (1, [0, 1]), (20, [1, 1])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert not ann.nearest(vectors(spark, [])).count()


# --- 4 packing ---


def test_best_fit_holds_and_is_tight():
    rng = np.random.default_rng(6)
    n = rng.integers(1, 8193, 3000)
    bins, offsets, sizes = packing.best_fit(n)
    used = np.bincount(bins, n)
    assert (used <= sizes).all() and n.sum() / sizes.sum() > 0.97 and set(sizes.tolist()) <= set(packing.CAPACITIES)
    order = np.lexsort((offsets, bins))
    same = bins[order][1:] == bins[order][:-1]
    assert ((offsets[order][:-1] + n[order][:-1])[same] == offsets[order][1:][same]).all()
    assert all(s == min(c for c in packing.CAPACITIES if c >= u) for s, u in zip(sizes, used, strict=True))
    assert packing.best_fit([])[0].size == 0 and packing.best_fit([3])[2].tolist() == [512]


def least_cost(lengths, sizes, overhead):
    """Over all ways to share the lengths out to bins."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in sizes if c >= u) + overhead for u in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= max(sizes):
                bins[j] += lengths[k]
                go(k + 1, bins)
                bins[j] -= lengths[k]
        bins.append(lengths[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("sizes,overhead", [((8, 12, 20), 1), ((5, 9, 10, 30), 0), ((16, 24), 4)])
def test_best_fit_against_every_way(sizes, overhead):
    rng = random.Random(sum(sizes))
    ratios, largest_only = [], []
    for _ in range(60):
        n = [rng.randint(1, max(sizes)) for _ in range(rng.randint(1, 7))]
        final = packing.best_fit(n, sizes, overhead)[2]
        want = least_cost(n, sizes, overhead)
        ratios.append((final.sum() + overhead * len(final)) / want)
        order = np.argsort(-np.array(n), kind="stable")
        largest_only.append(packing._plan(np.array(n), order, sorted(sizes), overhead, False)[0] / want)
    assert min(ratios) >= 1 and np.mean(ratios) < 1.02 and max(ratios) <= 1.25 and np.mean(ratios) < np.mean(largest_only)


def test_sizes_are_chosen_by_what_they_would_hold():
    bins, _, final = packing.best_fit([10, 10, 10, 600, 600, 5000, 5000], (64, 1300, 5100, 8192), 16)
    assert sorted(final.tolist()) == [1300, 5100, 5100]


def test_pack_documents(spark, rows):
    got = packing.pack_documents(table(spark, rows)).collect()
    want = sorted((i is None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total[203] == 9000 and sum(r.length for r in got) == sum(w[2] for w in want)
    assert all(r.bin_id is None for r in got if not r.length) and len([r for r in got if r.doc_id == 203]) == 2
    assert not packing.pack_documents(table(spark, [])).count()


# --- 5 SimHash ---


def brute_fingerprint(t, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def chains(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash(spark, rows):
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows if i is not None}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = chains(fps, 2)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert not simhash.near_duplicates(table(spark, [])).count()


@pytest.mark.parametrize("full", [1, 128])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_lose_none(spark, monkeypatch, full, distance):
    monkeypatch.setattr(simhash, "CELL_MAX", full)
    rng = random.Random(8)
    fps = {}
    for i in range(250):
        f = rng.getrandbits(64) if i % 5 == 0 else fps[i - 1]
        for _ in range(rng.randint(0, 3)):
            f ^= 1 << rng.randrange(64)
        fps[i] = f
    first = {}
    for i, f in fps.items():
        first.setdefault(f, i)
    df = spark.createDataFrame([(simhash._signed(f), i) for f, i in first.items()], "fp long, id long")
    found = {r.node: r.component for r in common.connected_components(simhash.links(df, distance)).collect()}
    want = chains({i: f for f, i in first.items()}, distance)
    assert {i: found.get(i, i) for i in want} == want


def test_parity_sketch_is_a_lower_bound():
    rng = random.Random(4)
    for n in (0, 1, 4, 5, 30, 900, 3000):
        w = prose(rng, n).split()[:n]
        v = [x if rng.random() > 0.03 else x + "s" for x in w]
        sets = [simhash.shingles(" ".join(x).encode(), 5) for x in (w, v)]
        memo = common.WordHashes()
        hashes = [simhash.shingle_hashes(np.array([memo[x.encode()] for x in t], np.uint64), 5) for t in (w, v)]
        assert [len(x) for x in hashes] == [len(x) for x in sets]
        apart = int(np.bitwise_count(np.bitwise_xor(*map(simhash.parity_sketch, hashes))).sum())
        alone, both = len(sets[0] ^ sets[1]), len(sets[0] | sets[1])
        assert apart <= alone and (not both or abs(alone - (len(sets[0]) + len(sets[1])) * simhash.most_alone(1 - alone / both)) < 1e-6)


def test_sketches_of_other_lengths_are_a_lower_bound():
    rng = np.random.default_rng(5)
    for n in (0, 1, 900, 1024, 1025, 3000, 70_000):
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for extra in (0, 1, n // 5):
            a, b = common, np.concatenate([common, rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
            x, y = simhash.parity_sketch(a), simhash.parity_sketch(b)
            assert len(x) * 64 >= max(n, 1024) and simhash.sketches_apart(x.tobytes(), y.tobytes()) <= extra
    # texts with nothing in common are told apart at every length
    for n in (300, 3000, 30_000):
        x, y = (simhash.parity_sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64)).tobytes() for _ in range(2))
        assert simhash.sketches_apart(x, y) > 2 * n * simhash.most_alone(0.8)


def test_rows_get_the_shingles_before_theirs(spark):
    prefix = np.arange(10, 16, dtype=np.int64)
    sigs = spark.createDataFrame([(1, prefix.tobytes()), (1, prefix.tobytes()), (2, prefix[:1].tobytes())], "id long, prefix binary")
    rows = spark.createDataFrame([(15, 1, 5), (10, 1, 0), (12, 1, 2), (10, 2, 0)], "cell long, id long, i int")
    got = {(r.id, r.i): [b and int.from_bytes(b, "little") for b in (r.b1, r.b2, r.b3)] for r in simhash._with_before(rows, sigs).collect()}
    assert got == {(1, 5): [14, 13, 12], (1, 0): [None] * 3, (1, 2): [11, 10, None], (2, 0): [None] * 3}


def test_similar_documents(spark):
    rng = random.Random(9)
    base = [prose(rng, 300) for _ in range(40)]
    docs = list(enumerate(base))
    near = []
    for i in range(20):
        w = base[i].split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed" + str(rng.random())[2:6]
        docs.append((100 + i, " ".join(w)))
        near.append((i, 100 + i))
    docs += [(200 + k, base[30] + f" end{k}") for k in range(80)] + [(400, None), (401, ""), (402, "one"), (None, base[0])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, docs)).collect()}
    for i, j in near:
        a, b = simhash.shingles(base[i].encode(), 5), simhash.shingles(dict(docs)[j].encode(), 5)
        if len(a & b) / len(a | b) >= 0.8:
            assert got[j] == i
    assert all(got[200 + k] == 30 for k in range(80)) and got[401] == 400 and 402 not in got and 25 not in got
    kept = simhash.drop_near_duplicates(table(spark, docs))
    assert kept.columns == table(spark, []).columns and 225 not in {r.doc_id for r in kept.collect()}


def test_near_stage_goes_by_simhash(spark):
    """Of each component of op5 at most one row stays, though the sets of shingles differ; texts with other edits go as before."""
    import corpus_pipeline

    rng = random.Random(21)
    verse, t = prose(rng, 13) + " ", prose(rng, 300)
    rows = [(k, verse * 60 + prose(rng, 12)) for k in range(1, 5)] + [(10, t), (11, t + " " + prose(rng, 20)), (20, prose(rng, 50)), (None, None), (30, " ")]
    one, other = simhash.shingles(rows[0][1].encode(), 5), simhash.shingles(rows[1][1].encode(), 5)
    assert len(one & other) / len(one | other) < 0.8
    left = corpus_pipeline.near(spark, table(spark, rows), "")
    assert left.columns == table(spark, []).columns and sorted(r.doc_id for r in left.collect()) == [1, 10, 20, 30]
    assert not corpus_pipeline.near(spark, table(spark, []), "").count()


def test_full_cells_try_every_pair(spark, monkeypatch):
    """Pairs that differ from the first of their cell and from each other pair, in a cell of more than PAIRS_MAX rows."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    none = (None, None, None)
    rows = [(1, i // 2 if i < 10 else i, i, 0, 0, 0, 100, *none) for i in range(50)] + [(2, 60, 60, 0, 0, 0, 100, 9, 8, 7), (2, 61, 61, 0, 0, 0, 100, 6, 5, None)]
    rows += [(3, 70, 70, 1, 0, 0, 100, 4, None, None), (3, 71, 71, 1, 0, 0, 100, 2, 4, None)]  # left to cell 4, which would have them
    df = spark.createDataFrame(rows, "cell long, component long, id long, i int, o long, p long, s int, b1 long, b2 long, b3 long")
    got = [tuple(r) for r in simhash._every_pair(df, 0.8).collect()]
    component = {i: k for _, k, i, *_ in rows}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(50) for b in range(a) if component[a] != component[b]} | {(61, 60)}


def test_similar_blocks_equal_brute_force(spark):
    """Blocks appended, cut off or replaced, and a passage that many share: components as by comparing every pair."""
    rng = random.Random(12)
    docs, common_part = [], prose(rng, 40)
    for k in range(120):
        w = prose(rng, rng.choice((40, 200))).split()
        new = prose(rng, int(len(w) * rng.choice((0.1, 0.15, 0.19, 0.23, 0.3)))).split()
        at = rng.randrange(len(w) - len(new))
        other = (w + new, w[: len(w) - len(new)], w[:at] + new[: len(new) // 2] + w[at + len(new) // 2 :])[k % 3]
        docs += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(other)), (3 * k + 2, common_part + " " + prose(rng, 60))]
    sets = [simhash.shingles(t.encode(), 5) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, docs)).collect()}
    assert {i: got.get(i, i) for i in parent} == {i: find(i) for i in parent} and 20 < len(got) < 200


# --- 6 WARC ---


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")


def test_warc_roundtrip(spark):
    rng = random.Random(10)
    p = [(i, f"http://a.example/{i}", prose(rng, 50)) for i in range(40)] + [(50 + i, None, "same é") for i in range(30)] + [(90, "http://b c", None), (91, "", ""), (3, "u", prose(rng, 3)), (95, "u", "x" * 300_000)]
    got = warc.read_archives(common.materialize(warc.write_archives(pages(spark, p), archive_bytes=2000), "a")).collect()
    assert len(got) == len(p)
    top = {}
    for i, _, h in p:
        top[h or ""] = max(i, top.get(h or "", -1))
    for r in got:
        match = [h or "" for i, _, h in p if i == r.page_id and len((h or "").encode()) == r.payload_bytes and warc.base32_sha1((h or "").encode()) == r.payload_digest]
        assert match
        keep = top[match[0]]
        assert (r.record_type, r.refers_to) == (("response", None) if keep == r.page_id else ("revisit", keep))
        assert r.record_type == "revisit" or bytes(r.payload).decode() == match[0]
    assert not warc.roundtrip(pages(spark, [])).count()


def test_warc_damage():
    a = warc.Archive([b"<html>" * 50])
    a.append(warc.write_record(1, "http://x", b"<html>" * 90, None, 540, warc.base32_sha1(b"<html>" * 90)))
    data = a.bytes()
    record = next(iter(warc.frames(data)))
    assert warc.parse_record(record)["payload"] == b"<html>" * 90 and data[:4] == (0x184D2A5D).to_bytes(4, "little")
    for bad in (data[:-3], data[:-30], data + b"xx", data[:60] + b"\0\0\0\0" + data[64:]):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"WARC-Type", b"WARC Type"), (b"<html><html>", b"<html><htmk>")):
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(old, new))


# --- 7 quality ---


def test_quality_held_out(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        t = prose(rng, 60)
        docs.append((i, t if good else rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "%%% "), t.replace(" ", " | ")])))
        labels.append((i, int(good), 0))
    docs += [(900, None), (901, ""), (None, "kara"), (902, prose(rng, 30000))]
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5000, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table(spark, docs), lab).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    empty = spark.createDataFrame([], lab.schema)
    assert {r.score for r in quality.quality_scores(table(spark, docs[:5]), empty).collect()} == {0.5}
    assert not quality.quality_scores(table(spark, []), lab).count()
    assert quality.keep_quality(table(spark, docs), lab).columns == table(spark, []).columns


def test_every_pair_has_its_loss():
    rng = np.random.default_rng(3)
    y, s = (rng.random(300) < 0.7).astype(np.int64), rng.normal(0, 3, 300)
    d = s[y == 1][:, None] - s[y == 0]
    loss, slopes = quality._pair_loss(quality._histogram(y, s))
    k, share = quality._places(s)
    k = k + y * (len(slopes) // 2)
    got = slopes[k] * (1 - share / quality.PARTS) + slopes[k + 1] * share / quality.PARTS
    want = np.zeros(300)
    wrong = 1 / (1 + np.exp(d)) / d.size
    want[y == 1], want[y == 0] = -wrong.sum(axis=1), wrong.sum(axis=0)
    assert abs(loss - np.logaddexp(0, -d).mean()) < 1e-3 and np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_every_label_counts(spark, monkeypatch):
    """The only rejected documents come after 10,000 others by hash of doc_id; a table of features gives what the driver's rows give."""
    ids = [r.id for r in spark.range(13500).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()]
    assert len(ids) > 10_100
    rng = random.Random(5)
    junk = set(ids[-40:])
    docs = [(i, "!!! $$$ ### " * 4 if i in junk else prose(rng, 4)) for i in ids] + [(20000, "### !!! " * 6), (20001, prose(rng, 4))]
    lab = spark.createDataFrame([(i, int(i not in junk)) for i in ids], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(table(spark, docs), lab).collect()}
    assert got[20000] < 0.3 < got[20001] and len(quality.keep_quality(table(spark, docs), lab).where("doc_id < 20000").collect()) == len(ids) - 40
    some, lab = table(spark, docs[-300:]), lab.where(F.col("doc_id").isin(ids[-300:]))
    few = [(r.doc_id, r.score, r.above_quantile) for r in quality.quality_scores(some, lab).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality, "DRIVER_ROWS", 0)
    for r, (i, score, above) in zip(quality.quality_scores(some, lab).orderBy("doc_id").collect(), few, strict=True):
        assert r.doc_id == i and abs(r.score - score) < 1e-9 and r.above_quantile == above


# --- 8 substring dedup ---


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (h * 2 + int(substring_dedup.GEAR[b])) % (1 << 16)
        want.append(h)
    assert substring_dedup.gear_hash(data).tolist() == want


def test_chunks_survive_insertions():
    rng = random.Random(12)
    t = prose(rng, 2000).encode()
    a, b = t, t[:3000] + b"inserted words here " + t[3000:]
    parts = []
    for x in (a, b):
        ends = substring_dedup.chunk_ends(x)[0]
        assert ends[-1] == len(x)
        parts.append({x[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)})
    assert len(parts[0] - parts[1]) <= 6
    long = "".join(rng.choice("éèêçñ😀梦") for _ in range(9000)).encode()
    ends = substring_dedup.chunk_ends(long)[0].tolist()
    assert len(ends) > 5 and all(long[s:e].decode() for s, e in zip([0, *ends[:-1]], ends, strict=True))


def brute_spans(docs, least):
    """Chunks in windows that stand, chunk by chunk, in a text of a smaller id or earlier in the same text: byte ranges by row."""
    last = substring_dedup.LAST
    texts = [(last if i is None else i, (t or "").encode()) for i, t in docs]
    chunks, windows = [], {}
    for i, t in texts:
        ends, words = substring_dedup.chunk_ends(t)
        starts, n = [0, *ends.tolist()][: len(ends)], np.diff(words, prepend=0)
        parts = [t[a:e].rstrip() for a, e in zip(starts, ends.tolist(), strict=True)]
        units = [max(int(x), (int(e) - a) // 32) for x, a, e in zip(n, starts, ends, strict=True)]
        own = []
        ranges = [(k, next((e for e in range(k + 1, len(parts) + 1) if sum(units[k:e]) >= least), None)) for k in range(len(parts))]
        ranges += [(k, len(parts)) for k in range(len(parts)) if sum(units[k:]) >= least][-1:]
        for k, e in ranges:
            if e:
                own.append((k, e, tuple(parts[k:e])))
                windows[own[-1][2]] = min(i, windows.get(own[-1][2], last))
        chunks.append((starts, ends.tolist(), own))
    out = []
    for (i, _), (starts, ends, own) in zip(texts, chunks, strict=True):
        cut, before = set(), {}
        for k, e, key in own:
            before.setdefault(key, e)
            if windows[key] < i or before[key] <= k:
                cut |= set(range(k, e))
        ranges = []
        for k in sorted(cut):
            if ranges and ranges[-1][1] == starts[k]:
                ranges[-1][1] = ends[k]
            else:
                ranges.append([starts[k], ends[k]])
        out.append(ranges)
    return out


def test_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(substring_dedup, "PART_ENTRIES", 50)
    rng = random.Random(15)
    parts = [prose(rng, n) for n in (8, 12, 23, 24, 30, 55, 90)] + ["same words " * 40, "梦" * 900, ""]
    docs = [(i, rng.choice(" \n").join(rng.choice([*parts, prose(rng, rng.randint(1, 60))]) for _ in range(rng.randint(1, 6)))) for i in range(90)]
    docs += [(7, docs[8][1]), (None, docs[3][1]), (91, None)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.text, [[s.start, s.end] for s in r.repeated_spans or []]) for r in substring_dedup.substring_dedup(table(spark, docs)).collect()), key=str)
    want = []
    for (i, t), ranges in zip(docs, brute_spans(docs, substring_dedup.MIN_WORDS), strict=True):
        data = (t or "").encode()
        edges = [0, *(x for r in ranges for x in r), len(data)]
        want.append((-1 if i is None else i, t if not ranges else b"".join(data[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)).decode(), ranges))
    assert got == sorted(want, key=str) and 30 < sum(bool(w[2]) for w in want) < 93


def test_insertions_leave_spans_where_they_were(spark):
    rng = random.Random(16)
    text = prose(rng, 400)
    w = text.split()
    docs = [(1, text), (2, " ".join([*w[:100], "newly", "put", "words", *w[100:]])), (3, " ".join(w[200:]))]
    cut = {r.doc_id: r.text for r in substring_dedup.substring_dedup(table(spark, docs)).collect()}
    assert cut[1] == text and "newly put words" in cut[2] and len(cut[2].split()) < 25 and len(cut[3].split()) < 12


@pytest.mark.parametrize("n", [51, 60])
def test_passages_of_just_over_50_words(n):
    """Passages of n words, other text around them: how often a window lies in both."""
    rng = random.Random(n)
    found = 0
    for _ in range(400):
        p = prose(rng, n)
        keys = []
        for _ in range(2):
            t = (prose(rng, 40) + " " + p + " " + prose(rng, 40)).encode()
            ends, words = substring_dedup.chunk_ends(t)
            keys.append(set(substring_dedup.windows(substring_dedup.digests(t, ends), np.diff(words, prepend=0), substring_dedup.MIN_WORDS)[2].tolist()))
        found += bool(keys[0] & keys[1])
    assert found >= 398


def test_passages_are_cut_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(13)
    passage = prose(rng, 70)
    docs = [(i, prose(rng, 80) + ("\n" if i % 2 else " ") + passage + "\n" + prose(rng, 40)) for i in range(12)]
    clean = [(50 + i, prose(rng, 150)) for i in range(10)]
    docs += clean + [(80, passage + "\n" + passage), (90, None), (91, ""), (None, clean[0][1]), (50, clean[0][1])]
    got = substring_dedup.substring_dedup(table(spark, docs)).collect()
    assert len(got) == len(docs)
    core = " ".join(passage.split()[15:55])
    assert sum(core in (r.text or "") for r in got) == 1
    first = next(r for r in got if r.doc_id == 0)
    assert first.text == docs[0][1] and first.repeated_spans is None
    texts = dict(clean)
    assert all(r.text == texts[r.doc_id] for r in got if r.doc_id in texts)
    assert next(r for r in got if r.doc_id is None).text == ""
    assert all(r.repeated_spans[0].first_doc_id == 0 for r in got if r.doc_id in range(1, 12))
    assert not substring_dedup.substring_dedup(table(spark, [])).count()


# --- 9 pieces ---


def test_pieces_equal_the_library(spark, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.load(path)
    rng = random.Random(14)
    parts = [" ", "  ", "▁", "\n", "é", "😀", "梦", "ing", "<s>", "<0x41>", "the", "\0", "0", "﻿", *own.pieces[300:400]]
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [" " * n + "x" for n in range(60)] + ["theing" * 4000]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids)
    got = piece_bpe.tokenize(table(spark, rows)).collect()
    for r in got:
        t = [t or "" for i, t in rows if i == r.doc_id]
        assert r.ids in [sp.encode(x, add_bos=True, add_eos=True) for x in t] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(r.ids).encode()).hexdigest()
    assert not piece_bpe.tokenize(table(spark, [])).count()


# --- 10 scores ---


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_counting(spark, rows, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 200)
    some = [r for r in rows if r[0] is not None and r[0] != 203 and r[0] != 5]
    got = {r.doc_id: r for r in lm.backoff_scores(table(spark, some), order=order).collect()}
    from collections import Counter

    docs = {i: [b"<s>", *(t or "").encode().lower().split()] for i, t in some}
    count = {i: Counter(tuple(w[max(0, k - n + 1) : k + 1]) for n in range(1, order + 1) for k in range(len(w)) if n == 1 or k >= n - 1) for i, w in docs.items()}
    total = sum(count.values(), Counter())
    words = sum(len(w) - 1 for w in docs.values())
    for i, w in docs.items():
        score = 0.0
        for k in range(1, len(w)):
            top = min(order, k + 1)
            for n in range(top, 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                c = total[gram] - count[i][gram]
                if n == 1:
                    value = max(c, 0.5) / max(words - len(w) + 1, 1)
                elif c > 0:
                    value = c / (total[gram[:-1]] - count[i][gram[:-1]])
                else:
                    continue
                score += np.log10(value) + (top - n) * np.log10(0.4)
                break
        assert got[i].n_words == len(w) - 1 and abs(got[i].log10_score - score) < 1e-6
    assert got[200].log10_score == 0 and got[200].mean_log10 is None
    assert not lm.backoff_scores(table(spark, [])).count()


# --- pipeline and queries ---


def test_registered_model_is_of_trigrams(spark):
    """The last word of document 0 follows from the trigram that document 1 holds; the first and second give up one order each."""
    docs = [(0, "one two three"), (1, "zero one two three"), (2, "nil two four")]
    got = {r.doc_id: r.log10_score for r in lm.backoff_scores(table(spark, docs)).collect()}
    assert lm.HASH_BITS == 64 and lm.ORDER == 3 and abs(got[0] - np.log10(0.4 * 1 / 7 * 0.4)) < 1e-9


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.materialize(stage(spark, docs, sf), "stage")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == names and 0 < after.count() <= docs.count()
            docs = after
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_ten_queries():
    from reliefspark.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q.startswith("op")) == list(range(1, 11)) and "pipeline" in QUERIES
