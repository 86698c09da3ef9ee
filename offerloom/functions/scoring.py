"""Navigation scores: token score, greedy assignment, qualifier guard, search intent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import c, tokens, words_array

# Words skipped when search tokens are built.
SEARCH_STOP = ["a", "al", "de", "del", "el", "en", "la", "las", "los", "para", "por", "y"]
# Qualifiers that must be matched literally.
LITERAL = [
    "igg", "igm", "iga", "ige", "igd", "pcr", "rna", "dna", "suero", "serum", "plasma", "sangre", "blood",
    "orina", "urine", "saliva", "heces", "stool", "nasal", "semen", "lcr", "total", "totales", "libre",
    "libres", "directa", "indirecta", "beta", "alfa", "alpha", "sin", "con", "contraste", "reposo",
    "esfuerzo", "pediatrico", "izquierdo", "derecho", "izquierda", "derecha", "bilateral", "matutina",
    "ayuno", "24", "horas", "minutos", "serico", "serica", "sericos", "sericas", "salival", "urinario",
    "urinaria", "urinarios", "urinarias", "fecal", "fecales", "arterial", "venoso", "venosa", "capilar",
    "plasmatico", "plasmatica", "with", "without", "contrast", "left", "right", "transtoracico",
    "transesofagico", "doppler",
]
# Families whose members exclude each other.
QUALIFIER_FAMILIES = [
    ["igg", "igm", "iga", "ige", "igd"],
    ["total", "totales", "libre", "libres"],
    ["directa", "indirecta"],
    ["sin", "con"],
    ["reposo", "esfuerzo"],
    ["izquierdo", "izquierda", "derecho", "derecha", "bilateral", "left", "right"],
    ["transtoracico", "transesofagico"],
]
# Wordings that only name a specimen.
SPECIMEN_ONLY = "^((analisis|estudios?|examen(es)?|pruebas?)( de| en)? )?%s$"


def search_tokens(normalized) -> Column:
    stop = words_array(SEARCH_STOP)
    return F.filter(tokens(normalized), lambda w: ~F.array_contains(stop, w))


def token_score(query, candidate) -> Column:
    """0-100: equal, long prefix, adjacent swap inside a prefix, or few edits; literals are immune."""
    q, t = c(query), c(candidate)
    lq, lt = F.length(q), F.length(t)
    literal = words_array(LITERAL)
    immune = F.array_contains(literal, q) | F.array_contains(literal, t) | F.concat(q, t).rlike("[0-9]")
    prefix = F.substring(t, F.lit(1), lq)
    # q equals the prefix with letters i and i+1 exchanged
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(lq - 1, F.lit(1))),
        lambda i: (q != prefix)
        & (q == F.concat(F.substring(prefix, F.lit(1), i - 1), F.substring(prefix, i + 1, F.lit(1)),
                         F.substring(prefix, i, F.lit(1)), F.substring(prefix, i + 2, lq))),
    )
    edits2, edits3 = F.levenshtein(q, t, 2), F.levenshtein(q, t, 3)
    edits = F.when(F.least(lq, lt) >= 12, edits3).otherwise(edits2)
    close = (edits >= 0) & (edits / F.greatest(lq, lt) <= 0.24)
    return (
        F.when(q == t, 100)
        .when((lq < 5) | (lt < 5) | immune, 0)
        .when(F.startswith(t, q) & (lq / lt >= 0.55), 80)
        .when((lq < 7) | (lt < 7), 0)
        .when((lt > lq) & (lq / lt >= F.lit(1.0) / 3) & swap, 50)
        .when(close, 70 - edits * 8)
        .otherwise(0)
    )


def assignment_score(query_tokens: Column, term_tokens: Column) -> Column:
    """Each query token takes the best unused term token; mean minus the length difference."""
    nq, nt = F.size(query_tokens), F.size(term_tokens)
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("used"), F.lit(False).alias("failed"))

    def step(state: Column, word: Column) -> Column:
        options = F.transform(
            term_tokens,
            lambda t, i: F.struct(
                F.when(F.array_contains(state["used"], i), F.lit(0)).otherwise(token_score(word, t)).alias("s"),
                (-i).alias("at"),
            ),
        )
        best = F.array_max(options)
        miss = best.isNull() | (best["s"] <= 0)
        return F.struct(
            (state["total"] + F.when(miss, 0).otherwise(best["s"])).alias("total"),
            F.when(miss, state["used"]).otherwise(F.concat(state["used"], F.array(-best["at"]))).alias("used"),
            (state["failed"] | miss).alias("failed"),
        )

    folded = F.aggregate(query_tokens, start, step, lambda s: F.when(s["failed"], F.lit(None)).otherwise(s["total"]))
    usable = (nq > 0) & (nq <= nt)
    return F.when(usable & folded.isNotNull(), folded / nq - (nt - nq)).otherwise(F.lit(0.0))


def preserves_qualifiers(query, candidate) -> Column:
    """Literal words, digits and single letters survive, and no rival of the same family appears."""
    q, t = search_tokens(query), search_tokens(candidate)
    literal = words_array(LITERAL)
    kept = F.forall(
        q,
        lambda w: ~(F.array_contains(literal, w) | w.rlike("[0-9]") | (F.length(w) == 1)) | F.array_contains(t, w),
    )
    out = kept
    for family in QUALIFIER_FAMILIES:
        members = words_array(family)
        asked = F.arrays_overlap(q, members)
        rival = F.exists(members, lambda w: F.array_contains(t, w) & ~F.array_contains(q, w))
        out = out & ~(asked & rival)
    return out


def specimen_intent(normalized) -> Column:
    text = c(normalized)
    return F.when(text.rlike(SPECIMEN_ONLY % "sangre"), "blood").when(text.rlike(SPECIMEN_ONLY % "orina"), "urine")
