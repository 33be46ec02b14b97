"""Texts to sections and sentences, row by row: no shuffle."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X


Gate = Callable[..., Column] | None

#: What every line that switches contains one of: the first need of each rule, without the words that a group puts before it.
HINTS = L.hints([p for _, needs in L.SECTIONS for p in re.sub(r"\(.*?\) ", "", needs[0]).split("|")])


def line_section(low: Column) -> Column:
    """The section that a line (lower case) switches to, NULL where it goes on; most lines have no hint of one."""
    out = None
    for name, needs in L.SECTIONS:
        hit = low.rlike(needs[0])
        for more in needs[1:]:
            hit = hit & low.rlike(more)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(X.contains_one(low, HINTS), out)


def split_sections(text: Column, wide: bool = False) -> Column:
    """MAP of all sections to their lines, each ended by a line feed.

    The lines are put on end with a mark before each that switches, and cut at the marks; a
    section is all pieces that its name begins. This takes one pass, where a fold over the
    lines or a window over exploded lines would copy or shuffle the text. What is used more
    than once is bound by a lambda, so that no plan holds it twice. The two control
    characters that mark are left out of texts.
    """
    lines = F.filter(F.transform(F.split(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001")), F.lit("\u0002")), X.LINE), lambda x: X.strip(x, wide)), lambda x: x != "")
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    said = F.transform(both, lambda x: F.concat(F.coalesce(F.concat(F.lit("\u0001"), line_section(x["low"]), F.lit("\u0002")), F.lit("")), x["line"], F.lit("\n")))
    pieces = F.split(F.concat(F.lit("introduction\u0002"), F.array_join(said, "")), "\u0001")
    names = F.array(*map(F.lit, L.SECTION_NAMES))
    body = lambda p, name: F.array_join(F.transform(F.filter(p, lambda x: F.startswith(x, F.concat(name, F.lit("\u0002")))), lambda x: F.substr(x, F.length(name) + 2)), "")
    return F.transform(F.array(pieces), lambda p: F.map_from_arrays(names, F.transform(names, lambda name: body(p, name))))[0]


def explode_sentences(docs: DataFrame, text: Column, mode: str = "naive", wide: bool = False) -> DataFrame:
    """(doc_id, sent_index, sent, key) of the sentences of ``text``; ``key`` is what repetitions are told by.

    The generator is an outer one and its empty rows are dropped afterwards: for a plain one
    Catalyst infers a filter on the array's size, which would split every text once more.
    """
    keyed = F.transform(X.sentences(text, mode, wide), lambda s: F.struct(s.alias("sent"), X.dedup_key(s).alias("key")))
    return docs.select("doc_id", F.posexplode_outer(keyed).alias("sent_index", "s")).where("s is not null").select("doc_id", "sent_index", "s.sent", "s.key")


def explode_parts(docs: DataFrame, parts: dict[str, Column], mode: str = "naive", wide: bool = False, gates: dict[str, tuple[Gate, Gate]] | None = None) -> DataFrame:
    """(doc_id, part, sent_index, sent, key) of the sentences of several texts of each document, in one pass; one row without a part for a document that has none.

    ``gates`` say by part which sentences are wanted: by the sentence, and by it and its key.
    Others don't become rows, and what the first rules out gets no key.
    """
    def own(name: str, text: Column) -> Column:
        early, late = (gates or {}).get(name, (None, None))
        x = F.transform(X.sentences(text, mode, wide), lambda s, i: F.struct(i.alias("sent_index"), s.alias("sent")))
        x = x if early is None else F.filter(x, lambda x: early(x["sent"]))
        x = F.transform(x, lambda x: F.struct(F.lit(name).alias("part"), x["sent_index"].alias("sent_index"), x["sent"].alias("sent"), X.dedup_key(x["sent"]).alias("key")))
        return x if late is None else F.filter(x, lambda x: late(x["sent"], x["key"]))

    return docs.select("doc_id", F.explode_outer(F.concat(*[own(n, t) for n, t in parts.items()])).alias("s")).select("doc_id", "s.*")


def question_bucket(s: Column) -> Column:
    """The text that questions are looked for in."""
    return F.concat_ws("\n", *[s[n] for n in ("introduction", "related", "discussion", "conclusion")])


def limitation_bucket(s: Column) -> Column:
    return F.when(s["limitations"] != "", s["limitations"]).otherwise(s["discussion"])


def base_text(abstract: Column, text: Column, wide: bool = False) -> Column:
    empty = F.lit("")
    return X.strip(F.concat(F.coalesce(abstract, empty), F.lit("\n"), F.coalesce(text, empty)), wide)
