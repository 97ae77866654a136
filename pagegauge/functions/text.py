"""Text expressions. Every function takes and returns Spark columns.

Whitespace, word boundaries and "any character" are spelled out as explicit
character classes, because Java's own classes differ in detail from the web
platform's: Java's \\s misses the no-break space, its \\b counts accented
letters as word characters, and its $ also matches before a final line break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Whitespace of the web platform, as characters and as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# A run of whitespace that is not one plain space already.
SPACE_RUN = f"{SPACE_CLASS.replace(' ', '', 1)}{SPACE_CLASS}*| {SPACE_CLASS}+"
_WORD = "[A-Za-z0-9_]"
WORD_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
LAZY_GAP = r"([^\n\r\x{2028}\x{2029}]*?)"


def spark_pattern(pattern: str) -> str:
    """Fill the {b} {s} {gap} placeholders of a fixed pattern for Java."""
    return (
        pattern.replace("{b}", WORD_BOUNDARY).replace("{s}", SPACE_CLASS).replace("{gap}", LAZY_GAP)
    )


def js_trim(col: Column) -> Column:
    """Strip web whitespace from both ends."""
    return F.trim(col, F.lit(SPACE_CHARS))


def collapse_space(col: Column) -> Column:
    """Every run of whitespace becomes one space; ends are trimmed."""
    return js_trim(F.regexp_replace(col, SPACE_RUN, " "))


def strip_tags(col: Column) -> Column:
    """Replace every tag by a space."""
    return F.regexp_replace(col, "<[^>]+>", " ")


def decode_entities(col: Column) -> Column:
    """Decode the six entities that the plain-text extract knows, in this order."""
    for entity, char in (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def utf16_length(col: Column) -> Column:
    """String length in UTF-16 units, the unit of the web platform."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def longer_than(col: Column, n: int) -> Column:
    """utf16_length(col) > n, encoding only texts near the limit.

    A text has between one and two UTF-16 units per code point, so most texts
    are decided by their code point count alone.
    """
    points = F.length(col)
    return (
        F.when(points > n, True).when(points * 2 <= n, False).otherwise(utf16_length(col) > n)
    )


def truncate(col: Column, n: int, suffix: str = "…") -> Column:
    """First n characters, then the suffix, if the text is longer than that."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def nullif_blank(col: Column) -> Column:
    return F.when(col != "", col)


def first_sentence(col: Column) -> Column:
    """Up to the first . ! or ? that ends a word; otherwise the whole line."""
    flat = collapse_space(col)
    sentence = F.regexp_extract(flat, r"(?s)^(.+?[.!?])(?: |\z)", 1)
    return F.coalesce(nullif_blank(js_trim(sentence)), nullif_blank(flat))


def first_line(col: Column, n: int | None = None) -> Column:
    """The first line, spaces collapsed: n characters of it (None: all)."""
    line = collapse_space(F.substring_index(col, "\n", 1))
    return line if n is None else F.substring(line, 1, n)


def first_json_object(col: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return nullif_blank(F.regexp_extract(col, r"(?s)\{.*\}", 0))


def clamp01(col: Column) -> Column:
    # greatest and least skip nulls, so a missing number is kept apart.
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def format_count(col: Column) -> Column:
    """'' for none, the number up to 999, else 999+."""
    return (
        F.when(F.coalesce(col, F.lit(0)) <= 0, "").when(col > 999, "999+").otherwise(col.cast("string"))
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sql_text(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_contains(col: str, phrases: list[str]) -> list[str]:
    return [f"contains({col}, {sql_text(p)})" for p in phrases]


# The next three take the name of a column. They write one SQL expression, which
# Spark parses once, instead of one call into the JVM per phrase.

def contains_any(col: str | Column, phrases: list[str]) -> Column:
    if isinstance(col, str):
        return F.expr("(" + " OR ".join(_sql_contains(col, phrases)) + ")")
    return any_of([F.contains(col, F.lit(p)) for p in phrases])


def count_phrases(col: str, phrases: list[str]) -> Column:
    """How many different phrases occur. `contains` only: no regex, no UDF."""
    return F.expr("(" + " + ".join(f"int({c})" for c in _sql_contains(col, phrases)) + ")")


def more_than(col: str, phrases: list[str], n: int) -> Column:
    """More than n different phrases occur.

    If none of the first len - n phrases is there, the rest cannot make it more
    than n, so most texts are searched for those only.
    """
    first = contains_any(col, phrases[: len(phrases) - n])
    return first & (count_phrases(col, phrases) > n)


def matches(col: str, pattern: str, needs: list[str] | None = None) -> Column:
    """Regex test that runs only where one of the literals in `needs` occurs.

    Boundary look-arounds make these regexes slow on texts without a match;
    the literal test is cheap and rules out nearly all of them.
    """
    hit = f"rlike({col}, {sql_text(spark_pattern(pattern))})"
    return F.expr(f"({' OR '.join(_sql_contains(col, needs))}) AND {hit}" if needs else hit)


def present(conditions: list[tuple[Column, str]]) -> Column:
    """Array of the names whose condition holds, in the given order.

    array_remove rather than a lambda filter keeps the projection in codegen.
    """
    named = [F.when(cond, F.lit(name)).otherwise(F.lit("")) for cond, name in conditions]
    return F.array_remove(F.array(*named), "")


# --- hashes -----------------------------------------------------------------

def _utf16_units(col: Column) -> Column:
    """UTF-16 units as bigints; an empty text gives an empty array."""
    quads = F.regexp_extract_all(F.hex(F.encode(col, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    return F.transform(quads, lambda q: F.conv(q, 16, 10).cast("bigint"))


def fnv1a_hex(col: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as 8 hex digits."""
    folded = F.aggregate(
        _utf16_units(col), F.lit(2166136261).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295)),
    )
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def hash31(col: Column) -> Column:
    """h = 31 h + unit, kept to a signed 32-bit integer."""
    folded = F.aggregate(
        _utf16_units(col), F.lit(0).cast("bigint"),
        lambda h, u: (h * 31 + u).bitwiseAND(F.lit(4294967295)),
    )
    return (folded + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648


def fingerprint(url: Column, title: Column) -> Column:
    """Chunk fingerprint: hash of url + title; a missing part counts as ''."""
    return fnv1a_hex(F.concat(F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))


def let(value: Column, use) -> Column:
    """use(value) with `value` computed once, for expressions inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
