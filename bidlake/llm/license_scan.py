"""Operator 3: licence notices and identifier tags.

One Aho-Corasick pass over the words of a text finds notice phrases and the words
of identifier tags; the expression after a tag is put in reverse Polish order by a
shunting-yard parser and evaluated: ``with`` ties a licence to its exception, ``and``
keeps all duties of both sides, ``or`` the easier side.

Defined results: null and empty texts have no words, places or labels and score 0;
overlapping places all count; rows without an id and equal rows get results of their own; texts are read
whole, in time in proportion to their length and places; an empty table gives no rows. Only
the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .common import alnum_words, id_and_bytes, map_rows, schema_of

# Phrases of the contract, then those of the method, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "cc by": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "public domain": "public-domain",
    "the unlicense": "unlicense", "all rights reserved": "proprietary", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
# Families of identifiers, and how freely each may be reused (0 to 1).
FAMILIES = ("lgpl", "agpl", "gpl", "mit", "apache", "bsd", "mpl", "epl", "isc", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "unlicense", "public-domain", "proprietary")
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0}
UNKNOWN = 0.1
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: What stands at the place of a tag, from its first word on.
EXPRESSION = re.compile(rb"(?i:spdx)-(?i:license)-(?i:identifier)\s*:[ \t]*([^\r\n]*)")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")

OUTPUT = schema_of(
    doc_id="long", n_words="long", n_base="long", first_word="long", last_word="long", base_labels="string", labels="string",
    score="double", expression="string", freedom="double",
)


#: What may follow a family's name in an identifier: a version, the number of clauses, and how later versions count.
IDENTIFIER = re.compile(rf"({'|'.join(sorted(FAMILIES, key=len, reverse=True))})(?:-v?[0-9]+(?:\.[0-9]+)*)?(?:-clause(?:-[a-z]+)*)?(?:-only|-or-later|\+)?")


def family(identifier: str) -> str:
    """The family of an identifier by its whole name and version; of an unknown one, itself in lower case."""
    low = identifier.lower()
    m = IDENTIFIER.fullmatch(low)
    return m[1] if m else low


def to_rpn(text: str) -> list[str]:
    """Shunting yard over a licence expression. It ends before the first token that no
    expression can hold at that place, so prose after a tag does no harm."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether what came last is an operand
    for token in TOKEN.findall(text):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()  # an operator without its right side
    out.extend(t for t in reversed(stack) if t != "(")
    return out


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """Freedom of the whole expression and the families it names (not the exceptions)."""
    stack: list[tuple[float, list[str]]] = []
    for token in rpn:
        if token not in PRECEDENCE:
            f = family(token)
            stack.append((FREEDOM.get(f, UNKNOWN), [f]))
            continue
        if len(stack) < 2:
            break
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(1.0, a + 0.1), left))
        elif token == "and":
            stack.append((min(a, b), left + right))
        else:
            stack.append((max(a, b), left + right))
    return stack[-1] if stack else (0.0, [])


def _scanner(notices: dict[str, str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in [*notices.items(), (TAG, "")]:
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, label, False))
    for phrase, label in BASE.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, label, True))
    automaton.make_automaton()

    def row(doc_id, body):
        words = alnum_words(body)
        # one code point for each byte: the automaton sees the words apart by single spaces
        text = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
        base, labels, tags, seen = set(), set(), set(), []
        for end, (length, label, in_base) in automaton.iter(text):
            seen.append((end - length + 1, label, in_base))
        places = []
        if seen:
            starts = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])  # of each word, less the first space
            for (_, label, in_base), at in zip(seen, np.searchsorted(starts, [x[0] for x in seen]).tolist(), strict=True):
                if in_base:
                    places.append(at)
                    base.add(label)
                if label:
                    labels.add(label)
                else:
                    tags.add(at)
        expressions, freedom = [], None
        for at, word in enumerate(WORD.finditer(body) if tags else ()):
            m = EXPRESSION.match(body, word.start()) if at in tags else None
            rpn = to_rpn(m.group(1).decode("utf-8", "replace")) if m else []
            if rpn:
                value, found = evaluate(rpn)
                labels.update(found)
                expressions.append(" ".join(rpn))
                freedom = value if freedom is None else min(freedom, value)
        if freedom is None and labels:
            freedom = min(FREEDOM.get(x, UNKNOWN) for x in labels)
        score = 1.0 if expressions else 0.9 if base else 0.6 if labels else 0.0
        return (
            doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, "; ".join(expressions) or None, freedom,
        )

    return row


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """``notices`` are phrases (words in lower case, one space apart) beside the base ones, with their labels. One row per document: places and labels of the base phrases, all labels, ``score`` (how
    sure the licence is: 1 for a parsed tag, 0.9 for a base phrase, 0.6 for another notice),
    the tags' expressions in reverse Polish order and ``freedom``, the strictest of them."""
    return map_rows(id_and_bytes(docs, id_col, text_col), partial(_scanner, notices), OUTPUT)
