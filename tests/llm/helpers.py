"""Small tables for the operators of the subpackage."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, sources=None, ids=None):
    """Documents from texts, with extra columns whose names clash with results and with one another but for case."""
    rows = []
    for i, text in enumerate(texts):
        doc_id = ids[i] if ids else i
        rows.append((doc_id, text, "en", sources[i] if sources else f"s{i % 3}", None if text is None else len(text), 7, "x", "y", 1.5))
    return spark.createDataFrame(rows, SCHEMA + ", component_id int, TEXT string, h string, score double")


def prose(seed: int, n: int, words: int = 60) -> list[str]:
    """Texts over a small vocabulary, with copies, near copies, shared lines, blanks and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    common = [line(9) for _ in range(3)]
    out: list[str] = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            parts = rng.choice(out).split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            out.append(" ".join(parts))
        else:
            body = [line(rng.randint(1, words)) for _ in range(rng.randint(1, 4))]
            if kind < 0.7:
                body.insert(rng.randrange(len(body) + 1), "  " + rng.choice(common).upper() + "\t")
            out.append("\n".join(body))
    return [None, "", "   \t\n", "a", "É ß 漢字 😀 naïve", *out, *out[:1] * 3]
