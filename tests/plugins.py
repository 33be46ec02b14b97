"""What a caller would plug in: deterministic stand-ins for models and services."""

import json
import re


def letters(texts):
    """A vector of the counts of letters."""
    return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


def capitals(text):
    return [(w, "CAPITAL") for w in re.findall(r"\b[A-Z]\w*", text)]


def work(doi, title):
    return json.dumps({"id": f"W:{title}", "title": title, "cited_by_count": 3})
