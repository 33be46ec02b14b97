"""Cue phrases as data. Each line of a table is ``head: tail | tail``; an empty head or tail is allowed."""

from __future__ import annotations


def expand(table: str) -> list[str]:
    out = []
    for line in filter(None, map(str.strip, table.splitlines())):
        head, _, tails = line.partition(":")
        out += [f"{head.strip()} {t.strip()}".strip() for t in tails.split("|")]
    return out


FUTURE = expand("""
    future: experiments | studies | work | research should
    further: experiments | studies | study | work | research should | investigation will | investigation is warranted
    in: the future | future studies | future work
    is: unclear | unknown
    unclear: whether
    remain: to be determined
    remains: unknown | an open question | to be determined | to be explored
    not been: examined
    not yet: examined | explored | understood
    yet to be: determined | elucidated
    warrants: further investigation | investigation
    merits: further investigation
    requires: additional investigation
    needs: confirmation | to be explored | to be investigated
    needed: to determine
    required: to determine
    calls for: additional studies | future work
    should be: addressed | clarified | compared | confirmed | examined | explored | extended | improved | investigated | replicated | tested | validated
    will: clarify | elucidate | be critical | be essential | be important
    next: direction | directions | step | steps
    open: question | questions
    outstanding: question | questions
""")
#: The feature counter counts this phrase twice, as the original list names it twice.
COUNTED_TWICE = "should be validated"
QUESTION = expand("""
    we: aim to | analyzed whether | ask | attempt to | evaluate whether | examine the hypothesis | examine whether | explore whether | hypothesize | intend to | investigate | seek to | strive to | test whether
    our: central question | main question | research question
    the: aim of this study | goal of this study | objective of this study | purpose of this study | purpose of this work
    this study: asks | evaluates | investigates
    this paper: examines | investigates
    this research: aims to | focuses on
    this work: explores
""")
LIMIT = expand("""
    : limitation | limitations | limited by | constraints | restricted to | confounding | uncertainty | variability | heterogeneity | cannot
    absence: of
    lack: of
    did: not
    could: not
    not: generalizable
    may: bias
    bias: may
    potential: bias
    missing: data
    incomplete: data
    measurement: error
    sample: size
    small: sample
    future: work
    threats: to validity
    scope: of this study
    beyond: the scope
    was not: addressed | evaluated
    should be: interpreted with caution
    requires: cautious interpretation
""")
MODAL = "critical | could | expected | important | may | might | need to | needed | needs to | remain | remains | require | required | requires | should | warrant | will".split(" | ")
COUNTED_MODALS = [f" {m} " for m in "will could may might need requires should".split()]
WILL_VERBS = "assess characterize clarify compare determine elucidate examine investigate map measure quantify replicate reveal test validate".split()

#: (section, all of these alternations); the first rule that a line meets wins.
SECTIONS = [
    ("introduction", ["introduction"]),
    ("related", ["background|related work"]),
    ("methods", ["methodology|methods"]),
    ("results", ["findings|outcomes|results"]),
    ("discussion", ["analysis|discussion|interpretation"]),
    ("conclusion", ["closing remarks|conclusion|overall|summary"]),
    ("limitations", ["constraints|limitations|threats to validity"]),
    ("future", ["future", "direction|plan|prospect|work"]),
    ("future", ["outlook|perspective"]),
    ("future", ["next step|path forward"]),
    ("future", ["(?:open|outstanding|remaining) question"]),
    ("future", ["applications|implication|significance"]),
]
SECTION_NAMES = list(dict.fromkeys(s for s, _ in SECTIONS))
CATEGORIES = [("mechanism", "mechanism|oligomer"), ("structure", "structural|structure"), ("regulation", "post-translational|regulat"), ("validation", "replicate|validate"), ("generalization", "generaliz|other species")]
CATEGORY_NAMES = [c for c, _ in CATEGORIES] + ["unspecified"]
PROTOTYPES = {
    "future": ["future studies should examine", "future work will be important to", "further research is needed to", "further investigation is warranted", "it remains to be determined whether", "additional experiments are required to clarify", "this question remains open", "it is unclear whether and requires study", "this should be validated in future studies", "the next step is to test"],
    "limit": ["a limitation of this study is", "generalizability is limited", "the small sample size limits", "there is a risk of bias", "we could not control for confounding", "results should be interpreted with caution"],
    "rq": ["our central research question is", "the goal of this study is", "we ask whether", "we aim to determine whether", "we investigate whether"],
}
SIMILAR = 0.62


def any_of(phrases: list[str]) -> str:
    return "|".join(sorted(phrases, key=lambda p: (-len(p), p)))


def hints(phrases: list[str], least: int = 5) -> list[str]:
    """A few strings of which every phrase contains one, so that a text without any has no phrase.

    Words of at least ``least`` letters that most phrases share come first; phrases without such a word are their own.
    """
    left, out = set(phrases), []
    words = sorted({w for p in phrases for w in p.split() if len(w) >= least})
    while left and words:
        best = max(words, key=lambda w: (sum(w in p for p in left), len(w)))
        if not any(best in p for p in left):
            break
        out.append(best)
        left = {p for p in left if best not in p}
    return out + sorted(p for p in left if not any(o != p and o in p for o in left))
