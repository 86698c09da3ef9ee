"""Piece encoding, token files, licenses, mixing and sketches against libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, table
from tokenizers import Tokenizer

from offerloom.llm import licenses, mixing, parts, pieces, sketches, token_files

ALPHABETS = ["abcdefghijklmnop etaoins   ", "the and ing tion . , ! ? 12 340 ", "éü漢字 あ ñ ç ß😀\n\t  ", "aaaa    ", "thereandinghoustion"]


def random_texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, most))) for _ in range(n // 2)] + [
        "".join(rng.choice(a) for _ in range(rng.randint(0, most))) for a in (rng.choice(ALPHABETS) for _ in range(n // 2))]


def test_pieces_are_those_of_the_library():
    coder = pieces.model(pieces.MODEL)
    for text in random_texts(1, 1500, 60):
        got = np.frombuffer(coder.encode_normal(coder.normalize(text)), "<i4")
        assert got.tolist() == coder.processor.encode(text), text
        assert coder.decode(got) == text == coder.processor.decode(got.tolist())
    texts = random_texts(9, 600, 90) + ["", " ", "a", " a", "a ", "a  b", "a\t b\n c", "x\u2581y z", "word " * 99 + "end"]
    assert [np.frombuffer(r, "<i4").tolist() for r in coder.encode(texts)] == coder.processor.encode(texts)


@pytest.mark.parametrize("fan", [2, 64])
def test_giant_texts_are_scanned_in_chunks(spark, fan):
    coder = pieces.model(pieces.MODEL)
    texts = random_texts(2, 24, 1200) + ["thereandinghoustion" * 120, "漢字" * 400, " " * 700, "the cat " * 200, None, "", "a"]
    texts += [texts[-7]]
    docs = table(spark, texts)
    encoded = pieces.encode_pieces(docs.union(docs.where("doc_id = 24")), chunk=130, fan=fan, with_text=fan == 2)
    rows = (encoded if fan == 2 else pieces.decode_pieces(encoded)).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(texts)), 24])
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == coder.processor.encode(text) and r.text == text


def test_transfer_matrices_combine_in_any_order():
    coder = pieces.model(pieces.MODEL)
    text = coder.normalize("thereandinghoustionunderstandingthe" * 12)
    near, cuts = 2 * coder.longest, range(0, 400, 70)
    chunks = [(text[max(0, lo - near):lo + 70 + near], min(lo, near), min(lo, near) + min(70, len(text) - lo)) for lo in cuts if lo < len(text)]
    m = [coder.transfer(*c) for c in chunks]
    left = pieces.combine(m)
    right = pieces.combine([pieces.combine(m[:2]), pieces.combine([m[2], pieces.combine(m[3:])])])
    assert (left == right).all() and (left[0] == 0).any()


def test_pieces_of_no_rows_and_null_ids(spark):
    assert pieces.encode_pieces(table(spark, [])).count() == 0
    got = pieces.encode_pieces(table(spark, ["x y", "x y", None], ids=[None, None, 1])).collect()
    assert sorted((r.doc_id or -1, len(r.ids)) for r in got) == [(-1, 2), (-1, 2), (1, 0)]


@pytest.mark.parametrize("width", [1, 3, 8, 13, 15, 16, 17, 24, 31, 32])
def test_packed_ids_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, n)
        payload = token_files.pack(ids, width)
        assert len(payload) == -(-n * width // 8)
        for start in (0, 1, 5, n // 2, n):
            count = max(0, n - start)
            assert token_files.unpack(payload, width, start, count).tolist() == ids[start:start + count].tolist()


def test_token_files_hold_the_library_ids(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(token_files.VOCABULARY)
    texts = random_texts(4, 200, 200) + prose(6, 60) + [
        "a  b", " a", "a ", "a\n b", "a \nb", "a\n\nb c", "x<|endoftext|>y z", "it's we'll  don't", "a  b  c", "\x1c a \x1d", "word " * 30_000]
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    folder = str(tmp_path / "files")
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    out = {r.doc_id: r for r in token_files.token_table(table(spark, texts, ids=ids), folder=folder).collect()}
    start = 0
    want = {}
    for doc_id, text in sorted(zip(ids, texts)):
        want[doc_id] = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        r = out[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[doc_id]), zlib.crc32(want[doc_id].tobytes())), text
        start += len(want[doc_id])
    for r in token_files.read_token_files(spark, folder).collect():
        assert r.ids == want[r.doc_id].tobytes() and r.start == out[r.doc_id].start
    blocks = spark.read.parquet(folder).orderBy("shard", "block").collect()
    shard = [b for b in blocks if b.shard == blocks[len(blocks) // 2].shard]
    whole = np.concatenate([want[d] for b in shard for d in b.doc_ids])
    for at, n in ((0, 10), (len(whole) // 3, 1500), (len(whole) - 4, 4), (0, 0)):
        assert token_files.read_ids(spark, folder, shard[0].shard, at, n).tolist() == whole[at:at + n].tolist()


def test_token_files_of_a_small_cache_null_ids_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(parts, "CACHED", 3)
    library, texts = Tokenizer.from_file(token_files.VOCABULARY), prose(7, 20)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        flat, counts = token_files.encoder(token_files.VOCABULARY).encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    assert token_files.token_table(table(spark, [])).count() == 0
    got = token_files.token_table(table(spark, ["b", None, "b"], ids=[3, None, 3])).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 1), (1, 3, 2), (3, 3, 2)]


def plain_licenses(text):
    words = licenses._words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    hits = []
    for line in (text or "").split("\n"):
        held, spaced = set(licenses._words(line)), f" {' '.join(licenses._words(line))} "
        for (label, template), keys in zip(licenses.TEMPLATES, licenses.KEYS):
            need = set(licenses._words(template))
            share = 1 if len(licenses._words(template)) <= licenses.WHOLE else licenses.CONTAINED
            if len(need & held) >= share * len(need) - 1e-9 and all(f" {k} " in spaced for k in keys):
                hits.append((len(need & held) / len(need), label))
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted({x for _, x in places} | {x for _, x in hits})), 1.0 if places else max((s for s, _ in hits), default=0.0))


def test_licenses_against_a_plain_scan(spark):
    rng = random.Random(3)
    statements = [t for _, t in licenses.TEMPLATES] + ["GNU general\nPUBLIC licenſe", "apache-license", "cc by cc by  CC/BY", "MIT License mit license", "xmit license"]
    texts = prose(8, 30)
    for s in statements:
        words = s.split(" ")
        for drop in range(4):
            kept = [w for i, w in enumerate(words) if i not in set(rng.sample(range(len(words)), min(drop, len(words))))]
            texts.append("Some prose here.\n" + " ".join(kept) + " é\nmore prose")
    texts += ["", None, "cc by " * 30_000, "\n" * 50, "GNU General Public", "gnu\tgeneral public license", "GNU GENERAL PUBLIC LICENSE"]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert got == {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_each_statement_on_a_line_has_its_own_label_only(spark):
    own = dict(enumerate(licenses.TEMPLATES)) | {99: ("cc-by", "Licensed under CC BY 4.0")}
    rows = {r.doc_id: r.labels for r in licenses.scan_licenses(table(spark, [t for _, t in own.values()], ids=list(own))).collect()}
    base = {i: {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {' '.join(licenses._words(t))} "} for i, (_, t) in own.items()}
    assert rows == {i: ",".join(sorted({label} | base[i])) for i, (label, _) in own.items()}
    no_own = licenses.scan_licenses(table(spark, ["it was released under the usual license", "Licensed under CC BY-ND 4.0"])).collect()
    assert [r.labels for r in sorted(no_own)] == ["", "cc-by"]


def test_license_words_are_ordered_rarest_first(spark):
    texts = ["the license\nthe license", "of the license", "the", "permission"]
    order = licenses.token_order(table(spark, texts))
    assert order[-2:] == ["license", "the"] and order.index("permission") > order.index("redistribution")


def plain_mix(texts, sources):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = defaultdict(int)
    for s, n in zip(sources, sizes):
        total[s] += n
    named = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    left, open_, goal = 1.5 * sum(sizes), set(named), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not full:
            goal |= {s: weight[s] * level for s in open_}
            break
        goal |= {s: 2.0 * total[s] for s in full}
        left -= sum(2.0 * total[s] for s in full)
        open_ -= full
    return sizes, total, goal


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets_within_one_document(spark, seed):
    rng = random.Random(seed)
    texts = prose(seed, 200) + ["long " * 20_000]
    sources = [rng.choice(["a", "b", "b", "b", "B", "ä", "z" * 9, None, ""]) for _ in texts]
    rows = mixing.mix(table(spark, texts, sources), passed=("lang",)).collect()
    sizes, total, goal = plain_mix(texts, sources)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert (r.size, r.source, r.source_size) == (sizes[r.doc_id], sources[r.doc_id], total[r.source]) and r.lang == "en"
        assert r.target == pytest.approx(goal[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= largest[s]
    again = mixing.mix(table(spark, texts, sources).repartition(5)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_targets_of_many_small_sources(spark):
    rng = random.Random(12)
    for _ in range(4):
        sizes = {f"s{i}": rng.randint(1, 9) ** rng.randint(1, 5) for i in range(rng.randint(1, 25))}
        table_ = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table_).collect()}
        _, _, goal = plain_mix(["w " * n for n in sizes.values()], list(sizes))
        assert got == pytest.approx(goal) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_is_nested_and_defined_without_words(spark):
    texts, sources = prose(4, 150), ["s"] * 158
    docs = table(spark, texts, sources[: len(texts)])
    some = {r.doc_id for r in mixing.mix(docs, share=0.3).where("copies > 0").collect()}
    more = {r.doc_id for r in mixing.mix(docs, share=0.6).where("copies > 0").collect()}
    assert some < more
    blank = mixing.mix(table(spark, [None, "", " "], ["a", None, "a"])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in blank)
    assert mixing.mix(table(spark, [])).count() == 0


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_edit(texts):
    out = []
    for i, text in enumerate(texts):
        half = len(text) // 2
        out.append(text[: len(text) - half] + texts[(i + 1) % len(texts)][:half])
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_estimate_the_true_likeness(spark):
    texts = [t or "" for t in prose(11, 120, words=90)]
    rows = {r.doc_id: r for r in sketches.edited_pairs(table(spark, texts)).collect()}
    edits = plain_edit(texts)
    errors = []
    for i, text in enumerate(texts):
        r, true, edited, following = rows[i], plain_shingles(text), plain_shingles(edits[i]), plain_shingles(texts[(i + 1) % len(texts)])
        assert (r.n_chars, r.edited) == (len(text), edits[i])
        exact = max(len(true | edited), len(true | following)) <= sketches.KEPT
        assert r.near_edited == pytest.approx(jaccard(true, edited), abs=1e-9 if exact else 0.2)
        assert r.near_next == pytest.approx(jaccard(true, following), abs=1e-9 if exact else 0.2)
        errors.append(abs(r.near_edited - jaccard(true, edited)))
    assert np.mean(errors) < 0.04


def test_sketches_merge_and_estimate_counts_and_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1500:])
    docs = table(spark, [a, b, a + " " + " ".join(words[2996:]), "one two", "", None])
    rows = {r.doc_id: r for r in sketches.fingerprints(docs).collect()}
    assert rows[0].n_shingles == pytest.approx(2996, rel=0.35) and rows[3].n_shingles == 1 and rows[4].n_shingles == rows[5].n_shingles == 0
    pair = spark.createDataFrame([(rows[0].sketch, rows[1].sketch)], "a array<bigint>, b array<bigint>")
    from pyspark.sql import functions as F

    found = pair.select(
        sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c"),
        sketches.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert found.r == pytest.approx(1496 / 3996, abs=0.15) and found.c == pytest.approx(0.5, abs=0.2)
    joined = set(rows[0].sketch) | set(rows[1].sketch)
    assert found.m == sorted(joined)[: sketches.KEPT]


def test_sketches_of_single_repeated_null_and_no_rows(spark):
    one = sketches.edited_pairs(table(spark, ["ab cd"], ids=[9])).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(9, "ab ab")]
    got = sketches.edited_pairs(table(spark, ["aaaa", "bbbb", "bbbb", None, "é漢"], ids=[2, 5, 5, None, -1])).collect()
    assert sorted((str(r.doc_id), r.edited) for r in got) == [("-1", "éa"), ("2", "aabb"), ("5", "bb"), ("None", "")]
    assert sketches.edited_pairs(table(spark, [])).count() == 0


def test_equal_texts_print_equal_fingerprints(spark):
    from pyspark.sql import functions as F

    docs = table(spark, ["a b c d e f g"] * 2 + ["a  b\tc d e f g", "a b c d e f h"])
    printed = [r.p for r in sketches.fingerprints(docs).orderBy("doc_id").select(sketches.printed(F.col("sketch")).alias("p")).collect()]
    assert printed[0] == printed[1] == printed[2] != printed[3] and len(printed[0]) == 3 * 12
    assert hashlib.md5(printed[0].encode()).hexdigest() != hashlib.md5(printed[3].encode()).hexdigest()


def test_wrapped_license_statements_get_their_own_label_only(spark):
    filler = "some words of a document that has nothing to do with it and goes on for a while " * 6
    texts, want = [], []
    for label, text in licenses.TEMPLATES:
        for width, sign in ((72, ""), (72, " * "), (30, "# ")):
            lines = textwrap.wrap(text, width)
            texts.append(filler + "\n" + "\n".join(sign + line for line in lines) + "\n" + filler)
            want.append(label)
    others = {
        "Licensed under CC BY 4.0": "", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "released under the same license": "", "": "", "\n\n": "",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl",
    }
    rows = {r.doc_id: r for r in licenses.license_statements(table(spark, [*texts, *others, None])).collect()}
    assert [rows[i].labels for i in range(len(rows))] == [*want, *others.values(), ""]
    assert all((r.score >= licenses.CONTAINED) == bool(r.labels) for r in rows.values())
