"""Text expressions: every function takes and returns Columns, so all of it runs in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Ligatures and letters that unaccent to more than one letter.
MULTI_LETTER = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH"}
# Letters without a decomposition.
SINGLE_LETTER = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "ð": "d", "Ð": "D"}

# Function words ignored when labels are compared.
STOPWORDS = [
    "a", "al", "como", "con", "de", "del", "desde", "el", "en", "entre", "esta", "este", "estos",
    "la", "las", "los", "para", "por", "que", "sin", "sobre", "sus", "un", "una", "uno", "y",
]
# Articles dropped by the article fold.
ARTICLES = ["el", "la", "los", "las", "un", "una", "unos", "unas"]
# Venue words ignored when branch names are compared.
VENUE_WORDS = [
    "laboratorio", "laboratorios", "medico", "medicos", "medica", "del", "de", "la", "el", "los", "las", "sucursal", "plaza", "lr", "l", "r",
]


def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0x00C0, 0x0180):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        base = SINGLE_LETTER.get(letter, base)
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def c(value) -> Column:
    """A column from a name or a Column."""
    return F.col(value) if isinstance(value, str) else value


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def fold_accents(text) -> Column:
    folded = F.translate(c(text), ACCENTED, PLAIN)
    folded = reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), MULTI_LETTER.items(), folded)
    # as many bytes as letters: nothing to fold, which spares most labels eight passes
    return F.when(F.octet_length(c(text)) == F.char_length(c(text)), c(text)).otherwise(folded)


def norm_text(text) -> Column:
    """Accents folded, lower case, runs of other characters as one space; never null."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(c(text), F.lit("")))), "[^a-z0-9]+", " "))


def tokens(normalized) -> Column:
    """Words of an already normalized text (empty array for the empty text)."""
    return F.filter(F.split(c(normalized), " "), lambda w: w != "")


def repair_text(text, rounds: int = 1) -> Column:
    """Undo UTF-8 read as Latin-1, only where markers exist and no character would be lost."""
    out = c(text)
    for _ in range(rounds):
        broken = out.rlike("[ÃÂâ]") & ~out.rlike("[^\\x{00}-\\x{FF}]")
        # encode() refuses characters outside the charset, so the guard must also shape its input
        decoded = F.decode(F.encode(F.when(broken, out), "ISO-8859-1"), "UTF-8")
        out = F.when(broken & ~decoded.contains("�"), decoded).otherwise(out)
    return out


# --- trigrams -----------------------------------------------------------------------------------

def ordered_trigrams(normalized) -> Column:
    """Word trigrams in reading order, each word padded by two blanks before and one after."""
    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, 3))
    return F.flatten(F.transform(tokens(normalized), of_word))


def trigrams(normalized) -> Column:
    return F.array_distinct(ordered_trigrams(normalized))


def set_similarity(left_set: Column, right_set: Column) -> Column:
    """Jaccard of two distinct arrays as FLOAT: single precision keeps the threshold edges."""
    return similarity_of(F.size(F.array_intersect(left_set, right_set)), F.size(left_set), F.size(right_set))


def similarity_of(common: Column, left: Column, right: Column) -> Column:
    """``set_similarity`` from the sizes of the common part and of both sets."""
    union = left + right - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0)).cast("float")


def trgm_similarity(left, right) -> Column:
    """Set similarity of the word trigrams of two normalized texts."""
    return set_similarity(trigrams(left), trigrams(right))


def shared_positions(needle_set: Column, hay_ordered: Column) -> Column:
    """1-based positions of the ordered trigrams that the set holds."""
    marked = F.transform(hay_ordered, lambda g, i: F.when(F.array_contains(needle_set, g), i + 1))
    return F.filter(marked, lambda p: p.isNotNull())


def extent_similarity(needle_set: Column, hay_ordered: Column, positions: Column | None = None) -> Column:
    """Best similarity between a trigram set and any continuous extent of ordered trigrams.

    The best extent starts and ends on a shared trigram, so only those positions are paired. Without
    a repeated trigram the two set sizes follow from the positions alone. Pass the positions as an
    evaluated column (see ``evaluated``): lambdas re-evaluate whatever expression they close over.
    """
    positions = shared_positions(needle_set, hay_ordered) if positions is None else positions
    size = F.size(needle_set)

    def by_position(start: Column, i: Column) -> Column:
        def extent(end: Column, j: Column) -> Column:
            common = j - i + 1
            return F.when(j >= i, common / (size + (end - start + 1) - common))
        return F.array_max(F.transform(positions, extent))

    def by_sets(start: Column) -> Column:
        def extent(end: Column) -> Column:
            part = F.array_distinct(F.slice(hay_ordered, start, end - start + 1))
            common = F.size(F.array_intersect(part, needle_set))
            return common / (size + F.size(part) - common)
        return F.array_max(F.transform(F.filter(positions, lambda e: e >= start), extent))

    best = F.when(
        F.size(F.array_distinct(hay_ordered)) == F.size(hay_ordered), F.array_max(F.transform(positions, by_position))
    ).otherwise(F.array_max(F.transform(positions, by_sets)))
    return F.coalesce(best, F.lit(0.0)).cast("float")


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A one-row generator keeps the optimizer from copying the expressions into later filters and
    lambdas, where array expressions would run again for every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def trgm_word_similarity(needle, haystack) -> Column:
    return extent_similarity(trigrams(needle), ordered_trigrams(haystack))


def word_similarities(df: DataFrame, needle, haystack, name: str) -> DataFrame:
    """``trgm_word_similarity`` of every row as a new column, for whole tables: trigrams and positions are computed once a row."""
    grams = evaluated(df, _needle=trigrams(needle), _hay=ordered_trigrams(haystack))
    placed = evaluated(grams, _at=shared_positions(F.col("_needle"), F.col("_hay")))
    return placed.withColumn(name, extent_similarity(F.col("_needle"), F.col("_hay"), F.col("_at"))).drop("_needle", "_hay", "_at")


def char3_set(normalized) -> Column:
    """Unpadded three-character windows over the whole text; a shorter text is its own gram."""
    text = c(normalized)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, 3))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def char3_jaccard(left, right) -> Column:
    left_set, right_set = char3_set(left), char3_set(right)
    common = F.size(F.array_intersect(left_set, right_set))
    union = F.size(left_set) + F.size(right_set) - common
    empty = (F.size(left_set) == 0) | (F.size(right_set) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.round(common / union, 6))


# --- tokens -------------------------------------------------------------------------------------

def meaningful_tokens(normalized, min_length: int = 3, drop=STOPWORDS) -> Column:
    stop = words_array(drop)
    return F.array_distinct(F.filter(tokens(normalized), lambda w: (F.length(w) >= min_length) & ~F.array_contains(stop, w)))


def token_overlap(left, right) -> Column:
    """Some meaningful token equals or prefixes one of the other side; true if either has none."""
    a, b = meaningful_tokens(left), meaningful_tokens(right)
    hit = F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    return (F.size(a) == 0) | (F.size(b) == 0) | hit


def initialism(normalized, min_words: int = 0, max_words: int | None = None) -> Column:
    """First letters of the alphabetic content words; null when the word count is out of bounds.

    One pass of an expression over the text: each word is replaced by its first letter or by nothing.
    """
    stop = [w for w in STOPWORDS if len(w) >= 3]
    content = f"(?!(?=[{''.join(dict.fromkeys(w[0] for w in stop))}])(?:{'|'.join(stop)})(?: |$))([a-z])[a-z]{{2,}}+(?= |$)"
    letters = F.nullif(F.regexp_replace(c(normalized), f"(?:{content}|[^ ]++) ?+| ", "$1"), F.lit(""))
    if min_words <= 1 and max_words is None:
        return letters
    return F.when(F.length(letters).between(min_words, 2**31 - 1 if max_words is None else max_words), letters)


def article_fold(normalized) -> Column:
    return F.array_join(F.filter(tokens(normalized), lambda w: ~w.isin(*ARTICLES)), " ")


def branch_similarity(left, right) -> Column:
    """Shared tokens over the larger token set, venue words ignored."""
    return shared_part(meaningful_tokens(left, 1, VENUE_WORDS), meaningful_tokens(right, 1, VENUE_WORDS))


def shared_part(left, right) -> Column:
    """Shared tokens of two arrays over the larger one; zero if one is empty."""
    a, b = c(left), c(right)
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def lexical_evidence(query, term, drop=STOPWORDS) -> tuple[Column, Column]:
    """(coverage or null, sorted unmatched tokens) of a query by a term, both normalized."""
    q, t = meaningful_tokens(query, 3, drop), meaningful_tokens(term, 3, drop)
    covered = F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 3))
    return covered, F.array_sort(F.array_except(q, t))


# --- ids, slugs, addresses ----------------------------------------------------------------------

def slugify(text) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("source"))


def host_source_key(host, prefix: str = "generic_", limit: int = 80) -> Column:
    """Source key of a website host; a long host keeps a hash so that keys stay unique."""
    clean = F.regexp_replace(F.translate(c(host), "-.", "__"), "[^a-z0-9_]", "")
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit("provider"))
    short = F.concat(F.substring(clean, 1, limit - len(prefix) - 13), F.lit("_"), F.left(F.sha2(c(host), 256), F.lit(12)))
    return F.concat(F.lit(prefix), F.when(F.length(clean) + len(prefix) <= limit, clean).otherwise(short))


def stable_id(kind, url, name) -> Column:
    """Content-derived id of (kind, url, normalized name): replays give the same id."""
    return F.left(F.sha2(F.concat_ws("|", c(kind), c(url), norm_text(name)), 256), F.lit(32))


def display_address(line1, line2, locality, postal_code) -> Column:
    def clean(x):
        return F.nullif(F.trim(c(x)), F.lit(""))
    code = clean(postal_code)
    joined = F.concat_ws(", ", clean(line1), clean(line2), clean(locality), F.when(code.isNotNull(), F.concat(F.lit("C.P. "), code)))
    return F.when(clean(line1).isNotNull(), joined)
