"""DuckDB expression builders for the oracles, written independently of the Spark expressions."""

from __future__ import annotations


def norm(x: str) -> str:
    folded = f"coalesce({x}, '')"
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l")):
        folded = f"replace({folded}, '{letter}', '{plain}')"
    return f"trim(regexp_replace(lower(strip_accents({folded})), '[^a-z0-9]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def tri_ordered(x: str) -> str:
    return f"flatten(list_transform({toks(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


def tri(x: str) -> str:
    return f"list_distinct({tri_ordered(x)})"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CAST(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END AS FLOAT)"


def word_sim(a_set: str, b_ordered: str) -> str:
    pos = f"list_filter(range(1, len({b_ordered}) + 1), lambda k: list_contains({a_set}, {b_ordered}[k]))"
    both = "(y - x + 1)"
    simple = (f"list_max(list_transform({pos}, lambda p, x: list_max(list_transform({pos}, lambda q, y: "
              f"CASE WHEN y >= x THEN {both}::DOUBLE / (len({a_set}) + (q - p + 1) - {both}) END))))")
    extent = f"list_distinct(list_slice({b_ordered}, s, e))"
    shared = f"len(list_intersect({extent}, {a_set}))"
    full = (f"list_max(list_transform({pos}, lambda s: "
            f"list_max(list_transform({pos}, lambda e: CASE WHEN e >= s THEN {shared}::DOUBLE / (len({a_set}) + len({extent}) - {shared}) END))))")
    return f"CAST(coalesce(CASE WHEN len(list_distinct({b_ordered})) = len({b_ordered}) THEN {simple} ELSE {full} END, 0) AS FLOAT)"


def char3(x: str) -> str:
    return (f"CASE WHEN {x} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({x}) - 2, 1) + 1), "
            f"lambda i: substr({x}, i, 3))) END")


def string_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def haversine(lat1, lon1, lat2, lon2) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371000.0 * asin(sqrt(CASE WHEN {lat1} + {lon1} + {lat2} + {lon2} IS NOT NULL THEN least(1.0, {h}) END))"
