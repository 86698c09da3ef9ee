"""BPE against the library, periodic runs and spelling variants against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, table
from test_texts import random_texts
from tokenizers import Tokenizer

from offerloom.llm import bpe, parts, periods, spelling
from offerloom.llm.queries import QUERIES

ODD = [None, "", " ", "\n", "a\nb", "a\n\nb", "a\n b", " a", "a ", "a  b", "a\t b", "it's we'll  don't\r\n", "\x1c a \x1d\x85b\xa0  c",
       "x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> ", "a <|endoftext|>b c", "<|endoftext|", "<|endoftext|><|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(bpe.VOCABULARY)
    out.no_truncation()
    out.no_padding()
    return out


def split(flat, counts):
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_bpe_ids_and_texts_are_those_of_the_library(spark, library):
    texts = random_texts(11, 800, 90) + prose(3, 60) + ODD + ["word " * 30_000]
    rows = {r.doc_id: r for r in bpe.encode_bpe(table(spark, texts).repartition(5), with_text=True).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (list(rows[i].ids), rows[i].text) == (want, library.decode(want, skip_special_tokens=False)), text
    again = bpe.decode_bpe(bpe.encode_bpe(table(spark, texts)))
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_of_every_character(library):
    coder = bpe.ByteBpe(bpe.VOCABULARY)
    texts = [c + "a" + c + " " + c for c in map(chr, range(0x11000)) if not "\ud800" <= c <= "\udfff"]
    assert split(*coder.parts.encode(pa.array(texts))) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_long_words_is_merged_rank_by_rank(library, monkeypatch):
    coder, rng = bpe.ByteBpe(bpe.VOCABULARY), random.Random(2)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 50_001, "=" * 3_000 + "-" * 777, "ab" * 9_000]
    assert split(*coder.encode_texts(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = [w.encode() for t in texts[:1] for w in (t[i:i + 40] for i in range(0, 9_000, 40))]
    short = split(*coder.merge_words(words))
    monkeypatch.setattr(bpe, "LONG", 2)
    assert split(*coder.merge_words(words)) == short


def test_bpe_of_a_small_cache_repeats_null_ids_and_no_rows(spark, library, monkeypatch):
    coder = bpe.ByteBpe(bpe.VOCABULARY)
    monkeypatch.setattr(parts, "CACHED", 3)
    texts = prose(8, 20)
    for _ in range(2):
        assert split(*coder.parts.encode(pa.array(texts))) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = table(spark, ["b c", None, "b c"], ids=[3, None, 3])
    assert sorted(((r.doc_id, len(r.ids), r.text) for r in bpe.encode_bpe(docs, with_text=True).collect()), key=str) == [(3, 2, "b c"), (3, 2, "b c"), (None, 0, "")]
    assert bpe.encode_bpe(table(spark, [])).count() == 0 and bpe.decode_bpe(bpe.encode_bpe(table(spark, []))).count() == 0
    odd = spark.createDataFrame([(1, [99_999, -4, None]), (2, None), (3, [220, 127])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_bpe(odd).collect()} == {1: "", 2: "", 3: library.decode([220, 127], skip_special_tokens=False)}


def test_bpe_query_has_the_digests_of_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (rows[doc_id].n_tokens, rows[doc_id].ids_sha256, rows[doc_id].decoded_sha256) == (len(ids), *want)


def plain_runs(words, least=periods.LEAST):
    """Every maximal stretch by comparing all words at every distance; a stretch keeps its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at >= 2 * q and end - at + q >= least:
                found.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repetitive(rng, n):
    """Words of nested and neighbouring repetitions over a few letters."""
    out = []
    while len(out) < n:
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40]))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(1, 6) + ["x"]
        block = unit * rng.randint(1, 7)
        out += block[: rng.randint(len(block) // 2, len(block))]
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_repetitive_words_against_all_distances(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng, rng.randint(0, 700)) for _ in range(25)] + [[rng.choice("ab") for _ in range(600)], ["a"] * 500, list("abaababaabaab" * 40)]
    texts += [(["a"] * 60 + [str(i) for i in range(25)]) * 4, (["a", "b"] * 50 + ["c"]) * 5 + ["d"], []]
    codes, sizes = [], [len(t) + 1 for t in texts]
    for i, t in enumerate(texts):
        codes += [ord(w) if len(w) == 1 else 1000 + int(w) for w in t] + [10_000 + i]
    starts, lengths, found = periods.find_runs(np.array(codes), np.array(sizes))
    got, ends = [[] for _ in texts], np.cumsum(sizes)
    for s, n, q in zip(starts.tolist(), lengths.tolist(), found.tolist()):
        doc = int(np.searchsorted(ends, s, side="right"))
        got[doc].append((s - int(ends[doc]) + sizes[doc], n, q))
    for t, mine in zip(texts, got):
        assert sorted(mine) == plain_runs(t, least=0), t


def test_runs_of_one_giant_document():
    rng = random.Random(7)
    unit = [rng.randrange(1 << 30) for _ in range(90_001)]
    codes = [*range(-50, 0), *(unit * 4)[:300_000], *range(-99, -51), *([5, 6] * 400), -1000]
    starts, lengths, found = periods.find_runs(np.array(codes), np.array([len(codes)]))
    assert list(zip(starts, lengths, found)) == [(50, 300_000, 90_001), (300_098, 800, 2)]


def test_run_rows_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a\x1fb c\x85d\xa0e", "x " * 24, " x\n" * 23, "é ß\t" * 30, *[" ".join(repetitive(rng, 300)) for _ in range(20)]]
    texts += [texts[-1], "one two three " * 20_000]
    rows = {r.doc_id: r for r in periods.periodic_runs(table(spark, texts).repartition(3)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts[:-1]):
        words = (text or "").encode().split()
        runs = plain_runs(words)
        assert ([tuple(r) for r in rows[i].runs], rows[i].n_words, rows[i].collapsed.encode()) == (runs, len(words), plain_collapsed(words, runs))
    assert [tuple(r) for r in rows[len(texts) - 1].runs] == [(0, 60_000, 3)] and rows[len(texts) - 1].collapsed == "one two three"
    repeated = periods.periodic_runs(table(spark, ["b " * 30] * 2, ids=[None, None])).collect()
    assert [r.collapsed for r in repeated] == ["b", "b"] and periods.periodic_runs(table(spark, [])).count() == 0


def test_periods_query_against_plain_code(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op11_periods"](spark, folder).collect()}
    assert len(rows) == len(docs) and any(r.n_runs > 1 for r in rows.values())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for doc_id, text in docs:
        words = plain_planted(doc_id, (text or "").encode().split())
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        want = (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(plain_collapsed(words, runs)))
        r = rows[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want


def plain_forms(counted, factor=10):
    """word -> (form, root, n_near, form_n), by the words and gaps that each word leaves behind."""
    gaps = defaultdict(set)
    for w in counted:
        for i in range(len(w)):
            gaps[(w[:i], w[i + 1:])].add(w)
    near = {w: set() for w in counted}
    for w in counted:
        for i in range(len(w)):
            near[w] |= gaps[(w[:i], w[i + 1:])] - {w}
            if (shorter := w[:i] + w[i + 1:]) in counted:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in counted.items():
        best = min(near[w], key=lambda x: (-counted[x], x), default=None)
        form[w] = best if best is not None and counted[best] >= factor * n else None
    out = {}
    for w in counted:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, len(near[w]), counted.get(form[w]))
    return out


def forms_of(rows):
    return {r.word: (r.form, r.root, r.n_near, r.form_n) for r in rows}


def test_forms_of_random_words_against_gaps(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)} | {"".join(rng.choice("etaoins") for _ in range(rng.randint(6, 8))) for _ in range(900)}
    words |= {"", "É", "漢字", "漢字a", "x" * 12_000, "x" * 12_001, "x" * 11_999 + "y"}
    counted = {w: rng.choice([1, 2, 9, 10, 100, 101, 5_000]) for w in words}
    frame = spark.createDataFrame([(w, n, "extra", 1) for w, n in counted.items()] + [(None, 5, "", 2)], "word string, n long, Word string, near int")
    want = plain_forms(counted)
    assert forms_of(spelling.spelling_forms(frame).collect()) == want
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "GUESTS", 2)
    rows = spelling.spelling_forms(frame).collect()
    assert len(rows) == len(counted) and forms_of(rows) == want
    for k in (3, 7):
        monkeypatch.setattr(spelling, "round", lambda x, k=k: k + 15, raising=False)
        assert forms_of(spelling.spelling_forms(frame).collect()) == want


def test_forms_follow_chains_to_their_end(spark):
    chain = ["a" * i for i in range(8, 20)]
    frame = spark.createDataFrame([(w, 10 ** i) for i, w in enumerate(chain)], "word string, n long")
    rows = {r.word: r for r in spelling.spelling_forms(frame).collect()}
    assert {r.root for r in rows.values()} == {chain[-1]} and rows[chain[0]].form == chain[1] and rows[chain[-1]].form is None
    assert spelling.spelling_forms(frame.limit(0)).count() == 0


def test_word_table_of_odd_texts(spark):
    texts = [None, "", "ÉCOLEabc écoleabc Écoleabc", "écoleABC,écoleabc", "letters×letters÷x", "letters×letters÷X 漢字letters", "abcdefg1abcdefg", "short", "longer " * 30_000]
    rows = {r.word: r.n for r in spelling.word_table(table(spark, texts + texts[:1])).collect()}
    assert rows == {"écoleabc": 3, "Écoleabc": 2, "letters×letters÷x": 2, "abcdefg": 2}
    assert spelling.word_table(table(spark, [])).count() == 0


def test_spelling_query_against_plain_code(spark):
    folder = "/root/testdata/sf0.001"
    counted = Counter()
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counted[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    counted = {w: n for w, n in counted.items() if n >= 2 and len(w) >= 7}
    rows = QUERIES["op12_spelling"](spark, folder).collect()
    assert {r.word: r.n for r in rows} == counted and len(rows) == len(counted)
    assert forms_of(rows) == plain_forms(counted) and any(r.form for r in rows)
