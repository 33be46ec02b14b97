"""Column functions over text. All are built-in expressions, so they stay in generated code.

White space, digits and word borders are ASCII's unless ``wide`` asks for Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

SENTENCE = r"[^.!?]*[.!?]|[^.!?]+"
LINE = r"\R|[\x1c-\x1e]"
WHITE = " \t\n\r\f\x0b"
REFERENCE = r"doi:|https?://|\b(?:isbn|issn|pp\.|vol\.|et al\.)\b|\([0-9]{4}\)"
#: What a match of REFERENCE contains one of.
REFERENCE_HINTS = ["doi:", "http", "isbn", "issn", "pp.", "vol.", "et al.", "("]
ABBREVIATION = r"(^|[^0-9A-Za-z_])(Dr|Mr|Mrs|Ms|Prof|Fig|Figs|Eq|No|Vol|vs|cf|al|etc|approx|St|e\.g|i\.e)\."


def _re(pattern: str, wide: bool) -> str:
    return f"(?U){pattern}" if wide else pattern


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, where the value is worked out once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def contains_one(s: Column, parts: list[str]) -> Column:
    """Whether ``s``, which must be cheap to name, contains one of the strings: plain searches of bytes, some twenty times as fast as an alternation."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(s, p))


def strip(s: Column, wide: bool = False) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "") if wide else F.trim(s, F.lit(WHITE))


def cut(s: Column, n: int = 140) -> Column:
    """At most n characters, the last an ellipsis where some are missing; NULL is empty."""
    s = F.coalesce(s, F.lit(""))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def preview(s: Column, n: int = 100) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def strip_tags(s: Column) -> Column:
    """Without what stands between < and >, without any >; an open < drops the rest."""
    return F.replace(F.regexp_replace(s, "<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def dedup_key(s: Column, wide: bool = False) -> Column:
    """Lower case, citation numbers in brackets left out, white space collapsed."""
    cited = lambda low: F.regexp_replace(low, _re(r"\[\s*[\d]{1,4}\s*\]|\(\s*[\d]{1,4}\s*\)", wide), " ")
    spaced = lambda bare: F.regexp_replace(bare, _re(r"\s+", wide), " ")
    if wide:
        return strip(spaced(cited(F.lower(s))), wide)
    # most sentences have no bracket and single blanks only: these are not rewritten
    bare = bound(F.lower(s), lambda low: F.when(contains_one(low, ["[", "("]), cited(low)).otherwise(low))
    return strip(bound(bare, lambda b: F.when(contains_one(b, ["\n", "  ", *WHITE.strip(" \n")]), spaced(b)).otherwise(b)))


def as_question(s: Column, wide: bool = False) -> Column:
    q = F.regexp_replace(strip(s, wide), r"\.\z", "")
    return F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))


def has_any(low: Column, phrases: list[str]) -> Column:
    """Whether a phrase occurs; the alternation is only tried where one of the phrases' hints does."""
    return bound(low, lambda s: contains_one(s, L.hints(phrases)) & s.rlike(L.any_of(phrases)))


def will_infinitive(low: Column) -> Column:
    return low.rlike("will (?:" + "|".join(L.WILL_VERBS) + ")")


def category(s: Column) -> Column:
    low, (first, *rest) = F.lower(s), L.CATEGORIES
    out = F.when(low.rlike(first[1]), first[0])
    for name, pattern in rest:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unspecified")


def looks_like_reference(s: Column) -> Column:
    return bound(F.lower(s), lambda low: contains_one(low, REFERENCE_HINTS) & low.rlike(REFERENCE)) | (F.regexp_count(s, F.lit("[0-9]+")) >= 6)


def count_phrases(low: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur (each counts once); plain searches in generated code."""
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0)).cast("bigint")


def rule_features(s: Column) -> Column:
    low = F.lower(s)
    return F.struct(
        count_phrases(low, [*L.FUTURE, L.COUNTED_TWICE]).alias("hook_cnt"),
        count_phrases(F.concat(F.lit(" "), low, F.lit(" ")), L.COUNTED_MODALS).alias("modal_cnt"),
        will_infinitive(low).cast("bigint").alias("will_inf"),
    )


def sentences(text: Column, mode: str = "naive", wide: bool = False) -> Column:
    """The sentences of a text in order, blank ones left out.

    ``naive`` ends one at every full stop, exclamation and question mark; ``smart`` takes a
    run of marks as one end and knows abbreviations.
    """
    text = F.coalesce(text, F.lit(""))
    if mode == "naive":
        parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    elif mode == "smart":
        held = F.regexp_replace(text, ABBREVIATION, "$1$2\u0001")
        ended = F.split(F.regexp_replace(held, r"([.!?]+)(?=\s|\z)", "$1\u0002"), "\u0002")
        parts = F.transform(ended, lambda p: F.replace(p, F.lit("\u0001"), F.lit(".")))
    else:
        raise ValueError("mode is naive or smart")
    return F.filter(F.transform(parts, lambda p: strip(p, wide)), lambda p: p != "")


def sparkline(values: Column, width: int = 20) -> Column:
    """The last ``width`` values as bars; one bar each and no padding where all are equal, blanks where there are none."""
    bars = " ▁▂▃▄▅▆▇█"
    v = F.slice(values, F.greatest(F.size(values) - width + 1, F.lit(1)), F.lit(width))
    lo, hi = F.array_min(v), F.array_max(v)
    bar = lambda x: F.substring(F.lit(bars), F.floor((x - lo) / (hi - lo + 1e-9) * 7).cast("int") + 2, F.lit(1))
    drawn = F.array_join(F.transform(v, bar), "")
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(" " * width)).when(hi - lo < 1e-9, F.repeat(F.lit("█"), F.size(v))).otherwise(F.rpad(drawn, width, " "))
