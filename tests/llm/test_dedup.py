"""SimHash groups, line and passage removal, and vector links against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import prose, table

from offerloom.llm import embeddings, graph, lines, simhash, suffixes


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(7, 7)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = roots(linked, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_groups_against_all_pairs(spark):
    texts = prose(5, 90)
    rows = simhash.simhash_groups(table(spark, texts)).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in rows} == {
        i: (f"{fps[i]:016x}", want[i], want[i] == i) for i in fps}


def test_balls_link_one_and_two_bits_but_not_three(spark):
    base = 0x7FFF0F0F12345678
    fps = [base, base ^ 1, base ^ (1 << 63) ^ 2 ^ 1, base ^ 0b111000000]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    got = roots(signed, [(r.a, r.b) for r in links])
    assert got[signed[0]] == got[signed[1]] == got[signed[2]] != got[signed[3]]


def test_simhash_null_ids_repeated_rows_and_no_rows(spark):
    docs = table(spark, ["one two three four"] * 3 + ["other words stand here now"], ids=[None, 4, 4, None])
    assert simhash.simhash_groups(docs).where("kept and doc_id = 4").count() == 2
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True)], key=str)
    assert simhash.simhash_groups(table(spark, [])).count() == 0


def test_very_long_text_has_the_plain_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    words = text.encode().split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == want


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if len(key(x)) < 20 or len(holders[key(x)]) < 3 or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_a_plain_loop(spark, seed):
    texts = prose(seed, 120)
    got = lines.dedup_lines(table(spark, texts), passed=("source",)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == plain_lines(list(enumerate(texts)))
    assert {r.doc_id: r.source for r in got} == {i: f"s{i % 3}" for i in range(len(texts))}


def test_lines_of_repeated_ids_long_texts_and_no_rows(spark):
    shared = "this line is found in many documents"
    texts = [shared + "\nx", shared + "\ny", shared.upper(), shared, "\n".join([shared, "z"] * 20_000), "é" * 20, "É" * 20, "é" * 20]
    ids = [1, 1, 2, 3, 0, 5, 6, 7]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(table(spark, texts, ids=ids)).collect())
    assert got == plain_lines(list(zip(ids, texts)))
    assert lines.dedup_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_array_orders_every_text(letters):
    rng = random.Random(letters)
    for n in (1, 2, 7, 64, 900):
        text = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
        order = suffixes.suffix_array(text)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        shown = [raw[i:i + suffixes.PASSAGE] for i in order]
        assert shown == sorted(shown)


@pytest.mark.parametrize("seed", [1, 4])
def test_passages_against_all_windows(spark, seed):
    texts = prose(seed, 80) + ["ab" * 300, "ab" * 200, "a" * 500, "a" * 49, "a" * 50, "é" * 30, "x" + "é" * 40]
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.drop_passages(table(spark, texts)).collect()}
    assert got == suffixes.brute_force(dict(enumerate(texts)))


def test_passages_cut_at_pieces_null_ids_and_no_rows(spark, monkeypatch):
    rng = random.Random(9)
    raw = bytes(rng.randrange(97, 100) for _ in range(3000))
    whole = {raw[i:i + 50]: 0 for i in range(len(raw) - 49)}
    key, start, count = suffixes.window_runs(raw)
    by_window = {raw[i:i + 50]: k for k, s, c in zip(key, start, count) for i in range(s, s + c)}
    assert set(by_window) == set(whole) and count.sum() == len(raw) - 49
    monkeypatch.setattr(suffixes, "PIECE", 130)
    key, start, count = suffixes.window_runs(raw)
    assert {raw[i:i + 50]: k for k, s, c in zip(key, start, count) for i in range(s, s + c)} == by_window
    text = raw[:200].decode()
    got = suffixes.drop_passages(table(spark, [text, text, text + "!", text], ids=[None, 3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 200), (-1, 200), (3, 0), (3, 0)]
    assert suffixes.drop_passages(table(spark, [])).count() == 0


def plain_vectors(rows):
    """n_links and component of (id, vector, label) rows."""
    ok = [i for i, (_, v, label) in enumerate(rows)
          if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for n, i in enumerate(ok):
        for j in ok[n + 1:]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                pairs.append((i, j))
    found = roots(range(len(rows)), pairs)
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    return {rows[i][0]: (links[i], rows[found[i]][0]) for i in range(len(rows))}


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, component_id int")


@pytest.mark.parametrize("sizes", [(1500, 1024), (20, 16), (7, 5)])
def test_vectors_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(8)
    seeds = rng.normal(size=(12, 6))
    rows = []
    for i in range(240):
        v = seeds[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.0, 0.08, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3.0])], int(rng.choice([1, 1, 2]))))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 6, 1), (303, [1.0, None] * 3, 1), (304, [float("nan")] * 6, 2), (305, [float("inf")] * 6, 2),
             (306, rows[0][1], None), (307, rows[0][1], rows[0][2]), (308, rows[0][1][:5], rows[0][2]), (309, [-0.0, 1.0] * 3, 2), (310, [0.0, 1.0] * 3, 2)]
    out = embeddings.near_vectors(vectors(spark, rows), cell_rows=sizes[0], block_rows=sizes[1]).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_vectors_of_one_hot_group_ids_that_repeat_and_no_rows(spark):
    hot = [(i, [1.0, i / 1000, 0.0], 1) for i in range(60)] + [(5, [0.0, 0.0, 1.0], 1), (None, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1)]
    out = embeddings.near_vectors(vectors(spark, hot), cell_rows=9, block_rows=8).collect()
    group = [r for r in out if r.component_id == 0]
    assert len(group) == 61 and all(r.n_links == 60 for r in group)
    assert sorted((r.vec_id or -1, r.n_links) for r in out if r.component_id != 0) == [(-1, 0), (5, 0)]
    assert embeddings.near_vectors(vectors(spark, [])).count() == 0
