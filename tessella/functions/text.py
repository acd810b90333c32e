"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trim takes off in the data this engine reads: not only spaces (fixed value).
TRIM = " \t\n\r\x00\x0b"

# Words that carry no meaning of their own, by the operator that leaves them out.
ADAPTIVE_STOP_WORDS = "com como das dos essa esse esta este nas nos para por que uma and for from how the what with".split()
RERANK_STOP_WORDS = "a ao as como da de do e em é o os para por qual que um uma".split()
SIGNIFICANT_STOP_WORDS = "a ao aos as como da das de do dos e ela ele em é explique funciona o os para pergunta por qual que se serve um uma".split()
NAMED_TERM_IGNORED = "como qual explique para que uma um o a".split()
LEXICAL_STOP_WORDS = "a as como da das de do dos e em explique funciona o os para por qual que uma é algoritmo classe complexidade".split()
PROTECTED_IGNORED = "A As O Os Um Uma".split()
# What starts a new claim behind a conjunction, and what negates, by language.
CLAIM_VERBS = {"pt": ("e", "foi|é|era|possui|tem|representa|criou|aceita"), "en": ("and", "is|was|has|does|represents|created|accepts")}
NEGATIONS = {"pt": "não|nunca|jamais|sem", "en": "is not|was not|has no|does not have|never|without"}


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: the optimizer would copy it to each use, lambda bodies included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(TRIM))


def normalized(x: Column) -> Column:
    """Line ends as \\n, no NUL, runs of blanks as one space, at most one empty line, trimmed."""
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, "\\x00", "")
    x = F.regexp_replace(x, "[\t ]+", " ")
    return trimmed(F.regexp_replace(x, "\n{3,}", "\n\n"))


@lru_cache(1)
def _compositions() -> str:
    """`decomposed:composed` of every letter of the Latin, Greek and Cyrillic blocks that Unicode decomposes."""
    pairs = ((unicodedata.normalize("NFD", c), c) for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]))
    return ",".join(f"{d}:{c}" for d, c in pairs if len(d) > 1 and unicodedata.normalize("NFC", d) == c)


def composed(x: Column) -> Column:
    """Letters with marks behind them as one character each (normal form C of Latin, Greek and Cyrillic). Texts without marks are left alone."""
    table = F.str_to_map(F.lit(_compositions()), F.lit(","), F.lit(":"))
    clusters = F.regexp_extract_all(x, F.lit(r"(?s).\p{M}*"), F.lit(0))
    return F.when(x.rlike(r"\p{M}"), F.array_join(F.transform(clusters, lambda c: F.when(F.length(c) > 1, F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")).otherwise(x)


def comparable(x: Column) -> Column:
    """Composed, in lower case, letters, numbers and single spaces only."""
    x = F.regexp_replace(F.lower(composed(trimmed(x))), r"[^\p{L}\p{N}\s]+", " ")
    return trimmed(F.regexp_replace(x, r"(?U)\s+", " "))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def _among(w: Column, stop: list[str]) -> Column:
    return w.isin(stop)


def rerank_terms(x: Column) -> Column:
    """Distinct words of at least two characters, without stop words, in order."""
    return F.array_distinct(F.filter(words(comparable(x)), lambda w: (F.length(w) >= 2) & ~_among(w, RERANK_STOP_WORDS)))


def adaptive_terms(x: Column) -> Column:
    parts = F.split(F.lower(x), r"[^\p{L}\p{N}_-]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~_among(w, ADAPTIVE_STOP_WORDS)))


def significant_terms(x: Column) -> Column:
    keep = lambda w: ~_among(w, SIGNIFICANT_STOP_WORDS) & ((F.length(w) >= 3) | w.rlike(r"\p{Nd}"))
    return F.array_distinct(F.filter(words(comparable(x)), keep))


#: O(...), numbers, capitalised identifiers with an optional bracket, a letter with a bracket (fixed value).
PROTECTED = r"(?U)\bO\([^\)]+\)|\b\d+(?:[.,]\d+)?\b|\b[A-Z][A-Za-z0-9_-]{1,}(?:\[[^\]]+\])?|\b[A-Za-z]\[[^\]]+\]"
#: A capital letter, letters or digits, and parts behind - or _ (fixed value).
NAMED = r"(?U)\b[\p{Lu}][\p{L}\p{N}]*(?:[-_][\p{L}\p{N}]+)*\b"


def protected_terms(x: Column) -> Column:
    """Numbers, formulas and identifiers that an answer must not change, in comparable form."""
    found = F.filter(F.regexp_extract_all(x, F.lit(PROTECTED), F.lit(0)), lambda t: ~_among(t, PROTECTED_IGNORED))
    return F.array_distinct(F.transform(found, comparable))


def named_terms(x: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(NAMED), F.lit(0)))
    return F.filter(found, lambda t: ~_among(F.lower(t), NAMED_TERM_IGNORED))


def contains_any_case(x: Column, y: Column) -> Column:
    return F.contains(F.lower(x), F.lower(y))


def claims(x: Column, language: str = "pt") -> Column:
    """Statements: split behind . ! ? ; (not in numbers), at line ends, and at a conjunction before a verb."""
    conjunction, verbs = CLAIM_VERBS[language]
    split = rf"(?U)(?<=[.!?;])(?<!\d[.!?;])\s+|\R+|\s+{conjunction}\s+(?=(?:{verbs})\b)"
    return F.filter(F.transform(F.split(trimmed(x), split), trimmed), lambda c: c != "")


def sentences(x: Column) -> Column:
    return F.split(x, r"(?U)(?<=[.!?;])(?<!\d[.!?;])\s+|\R+")


def is_negated(x: Column, language: str = "pt") -> Column:
    return x.rlike(rf"(?U)\b(?:{NEGATIONS[language]})\b")


def token_estimate(x: Column, characters_a_token: float = 4) -> Column:
    if characters_a_token <= 0:
        raise ValueError("characters_a_token must be positive")
    return F.greatest(F.lit(1), F.ceil(F.length(x) / characters_a_token)).cast("int")


def lexical_tokens(x: Column) -> Column:
    """All tokens in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda t: ~_among(t, LEXICAL_STOP_WORDS))


def escape_attribute(x: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def escape_delimiters(x: Column) -> Column:
    """Neutralise the prompt's own tags in text; everything else stays readable."""
    for name in ("CONTEXT", "SOURCE", "QUESTION"):
        x = F.replace(x, F.lit(f"<{name}"), F.lit(f"&lt;{name}"))
        x = F.replace(x, F.lit(f"</{name}>"), F.lit(f"&lt;/{name}&gt;"))
    return x


def sha256_of(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256)


# Fixed values of the noise rules.
MIN_LETTERS, MIN_TEXT_RATIO, MIN_LENGTH, MAX_ISOLATED, MAX_SPACE_GROUPS, SPARSE_ISOLATED = 2, 0.25, 3, 0.60, 2, 0.40


def noise(x: Column, enabled: bool = True) -> Column:
    """struct<kind, exclude, reason, confidence> of a block of laid-out text; the first rule that holds decides."""
    decision = lambda kind, reason, sure: F.struct(F.lit(kind).alias("kind"), F.lit(kind != "content").alias("exclude"), F.lit(reason).cast("string").alias("reason"), F.lit(sure).cast("double").alias("confidence"))
    content = decision("content", None, None)
    if not enabled:
        return content
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)

    def measured(x: Column) -> Column:
        compact, tokens, lines = F.regexp_replace(x, r"(?U)\s+", ""), words(x), F.filter(F.split(x, r"\R"), lambda t: t != "")
        return F.struct(
            x.alias("x"),
            count(compact, r"\p{L}").alias("letters"),
            count(compact, r"\p{N}").alias("digits"),
            F.greatest(F.lit(1), F.length(compact)).alias("visible"),
            F.size(tokens).alias("tokens"),
            F.size(F.filter(tokens, lambda t: F.length(F.btrim(t, F.lit(".,:;|()[]{}"))) == 1)).alias("isolated"),
            F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}{3,}"))).alias("natural"),
            count(x, r"\h{2,}").alias("gaps"),
            F.size(lines).alias("lines"),
            F.size(F.filter(lines, lambda t: trimmed(t).rlike(r"^[\p{L}\p{N}]$"))).alias("single"),
        )

    def judged(m: Column) -> Column:
        x, letters, digits = m["x"], m["letters"], m["digits"]
        ratio, isolated = letters / m["visible"], part(m["isolated"], m["tokens"])
        return (
            F.when((x == "") | (F.length(x) < MIN_LENGTH), decision("unknown", "block_too_short", 0.95))
            .when((digits >= 3) & (letters == 0) & x.rlike(r"(?U)^[\p{N}\s.,;:+\-]+$"), decision("diagram_text", "numeric_only_layout", 1.0))
            .when((m["lines"] >= 3) & (m["single"] == m["lines"]), decision("figure_text", "isolated_character_lines", 1.0))
            .when((m["tokens"] >= 3) & (isolated >= MAX_ISOLATED) & (m["natural"] == 0), decision("diagram_text", "isolated_token_sequence", 0.98))
            .when((m["gaps"] > MAX_SPACE_GROUPS) & (m["natural"] < 2) & (isolated >= SPARSE_ISOLATED), decision("diagram_text", "sparse_layout_columns", 0.95))
            .when((letters < MIN_LETTERS) & ((digits > 0) | (ratio < MIN_TEXT_RATIO)), decision("unknown", "insufficient_alphabetic_content", 0.90))
            .when((ratio < MIN_TEXT_RATIO) & (m["natural"] < 2), decision("unknown", "low_natural_language_density", 0.85))
            .otherwise(content)
        )

    return let(trimmed(x), lambda t: let(measured(t), judged))
