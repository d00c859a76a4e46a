"""Licence scans: phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser.

A text is lower-cased (A to Z) and cut into words of ASCII letters, digits and anything that is not ASCII.  The words,
joined by one space, go once through an automaton of all phrases and tags, each between two spaces, so a phrase is
found wherever its words stand one after another, whatever marks or line breaks lie between them.

A tag (``SPDX-License-Identifier:``, ``"license": "..."``, ``License = ...``) announces an expression.  It is read from
the text itself, after the tag: names of licences, ``and``, ``or``, ``with``, ``+`` and parentheses.  The parser takes the
longest beginning of what follows that is a whole expression, so ordinary prose after a tag ends it or gives none.
Evaluating an expression gives the licences it names and what a user must accept: of ``or`` the easier side, of ``and``
the harder one, and ``with`` an exception makes a copyleft licence one grade easier.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxmill.llm import bytetext
from boxmill.llm.ship import ship

# fixed values: phrases whose places are counted, and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# fixed values: further phrases of names and notices
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# fixed values: words that announce an expression, if a colon or an equals sign follows
TAGS = ["spdx license identifier", "license expression", "license", "licence"]

FREE, PERMISSIVE, WEAK, STRONG, LIMITED = range(5)
GRADES = ["public domain", "permissive", "weak copyleft", "copyleft", "limited use"]

# fixed values: licence identifiers in lower case, by what they ask of a user
IDENTIFIERS = {
    FREE: ["0bsd", "cc0-1.0", "unlicense", "wtfpl", "mit-0", "blessing"],
    PERMISSIVE: [
        "mit", "apache", "apache-1.1", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "zlib",
        "bsl-1.0", "ncsa", "postgresql", "python-2.0", "psf-2.0", "x11", "ofl-1.1", "ms-pl", "unicode-3.0", "openssl",
        "artistic-2.0", "cc-by-3.0", "cc-by-4.0",
    ],
    WEAK: [
        "lgpl-2.0-only", "lgpl-2.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only",
        "lgpl-3.0-or-later", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "cddl-1.1", "cpl-1.0", "eupl-1.2",
    ],
    STRONG: [
        "gpl", "gpl-1.0-only", "gpl-1.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only",
        "gpl-3.0-or-later", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "gfdl-1.3-only", "gfdl-1.3-or-later",
        "cc-by-sa-3.0", "cc-by-sa-4.0", "osl-3.0",
    ],
    LIMITED: [
        "cc-by-nc-3.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "sspl-1.0", "busl-1.1",
        "json", "proprietary",
    ],
}
GRADE_OF = {name: grade for grade, names in IDENTIFIERS.items() for name in names}

# fixed values: exceptions that may stand after "with"
EXCEPTIONS = {
    "llvm-exception", "classpath-exception-2.0", "gcc-exception-3.1", "autoconf-exception-3.0", "bison-exception-2.2",
    "font-exception-2.0", "linux-syscall-note", "openssl-exception", "bootloader-exception", "libtool-exception",
}

# grade of a label that a phrase gives
_LOOSE = {
    "gpl": STRONG, "lgpl": WEAK, "agpl": STRONG, "gfdl": STRONG, "mpl": WEAK, "epl": WEAK, "bsl": PERMISSIVE, "cc0": FREE,
    "artistic": PERMISSIVE, "cc-by": PERMISSIVE, "cc-by-sa": STRONG, "cc-by-nc": LIMITED, "cc-by-nd": LIMITED,
    "cc-by-nc-sa": LIMITED, "cc-by-nc-nd": LIMITED, "all-rights-reserved": LIMITED,
}

# how far a label is believed that a base phrase, another phrase, or an expression gives
BELIEF = {"base": 0.6, "notice": 0.8, "expression": 0.95}

_BEGIN = re.compile(rb"[\"'\s]*[:=]\s*[\"'\[{]*")
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9](?:[a-z0-9.:-]*[a-z0-9])?)(\+)?)")
_CUSTOM = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_ALONE = 9


class Expression:
    """What a (part of an) expression says: its words, the licences it names, the grade of what it asks."""

    def __init__(self, words: Iterable[str], names: set[str], grade: int, rank: int = _ALONE):
        self.words = words if isinstance(words, deque) else deque(words)
        self.names, self.grade, self.rank = names, grade, rank

    @property
    def text(self) -> str:
        return " ".join(self.words).replace("( ", "(").replace(" )", ")")


def _named(word: str, plus: bool) -> Expression | None:
    if word in GRADE_OF or _CUSTOM.fullmatch(word):
        return Expression([word + "+" * plus], {word}, GRADE_OF.get(word, LIMITED))
    return None


def _joined(operator: str, left: Expression, right: Expression) -> Expression:
    """The two operands as one; both are used up."""
    rank = _RANK[operator]
    for side in (left, right):
        if side.rank < rank:
            side.words.appendleft("(")
            side.words.append(")")
    # the shorter side moves, so deep nesting costs no more than long rows
    if len(left.words) < len(right.words):
        right.words.extendleft([operator.upper(), *reversed(left.words)])
        words = right.words
    else:
        left.words.extend([operator.upper(), *right.words])
        words = left.words
    if operator == "with":
        grade = left.grade - 1 if left.grade in (WEAK, STRONG) else left.grade
    else:
        left.names |= right.names
        grade = (min if operator == "or" else max)(left.grade, right.grade)
    return Expression(words, left.names, grade, rank)


def _tokens(text: bytes, at: int) -> list:
    """Operators, parentheses and operands of the longest whole expression that begins at ``at``."""
    found, whole, depth = [], 0, 0
    operand, single, exempt = False, False, False  # after an operand, after one licence, after "with"
    while (token := _TOKEN.match(text, at)) is not None:
        bracket, word, plus = token.groups()
        word = word.decode("ascii") if word else None
        if bracket == b"(":
            if operand or exempt:
                break
            depth += 1
            found.append("(")
        elif bracket == b")":
            if not operand or not depth:
                break
            depth -= 1
            single = False
            found.append(")")
        elif operand:
            if word not in _RANK or plus or word == "with" and not single:
                break
            found.append(word)
            operand, exempt = False, word == "with"
        else:
            if exempt:
                value = Expression([word], set(), FREE) if word in EXCEPTIONS and not plus else None
            else:
                value = _named(word, bool(plus))
            if value is None:
                break
            found.append(value)
            operand, single, exempt = True, not exempt, False
        at = token.end()
        if operand and not depth:
            whole = len(found)
    return found[:whole]


def parse(text: bytes, at: int = 0) -> Expression | None:
    """The longest beginning of ``text[at:]`` (lower case) that is a whole expression, evaluated; None if there is none.

    Two stacks: operators wait on one until an operator of no higher rank, a parenthesis or the end lets them take
    their operands from the other.
    """
    values: list[Expression] = []
    waiting: list[str] = []

    def settle(rank: int) -> None:
        while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= rank:
            right, left = values.pop(), values.pop()
            values.append(_joined(waiting.pop(), left, right))

    for token in _tokens(text, at):
        if isinstance(token, Expression):
            values.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            settle(0)
            waiting.pop()
        else:
            settle(_RANK[token])
            waiting.append(token)
    settle(0)
    return values[0] if values else None


def automaton():
    """Aho-Corasick automaton of all phrases and tags; a value is (kind, label or None, number of words)."""
    import ahocorasick

    kinds = [("tag", dict.fromkeys(TAGS)), ("notice", NOTICES), ("base", BASE)]
    found = ahocorasick.Automaton()
    for kind, phrases in kinds:
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


# bytes that belong to words stay, all others become a space
_KEPT = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def _word_ends(cleared: bytes) -> np.ndarray:
    """Where each word ends, by its number."""
    clear = np.frombuffer(cleared, np.uint8) == 32
    return np.flatnonzero(~clear & np.append(clear[1:], True)) + 1


def scan(text: str | bytes | None, found) -> dict:
    """What a text says of licences; ``found`` is ``automaton()``.  See ``scan_licences`` for the fields."""
    raw = (text.encode("utf-8") if isinstance(text, str) else text or b"").lower()
    cleared = raw.translate(_KEPT)
    words = cleared.split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, labels, expressions, ends = [], {}, [], None
    before, counted = 0, 0
    for end, (kind, label, size) in found.iter(joined):
        counted += joined.count(" ", before, end)  # spaces before this end: words up to here
        before = end
        start = counted - size
        if kind == "tag":
            ends = _word_ends(cleared) if ends is None else ends
            begin = _BEGIN.match(raw, int(ends[counted - 1]))
            if begin is not None and (made := parse(raw, begin.end())) is not None:
                expressions.append((start, made))
            continue
        labels.setdefault(label, set()).add(kind)
        if kind == "base":
            places.append((start, label))
    doubt, grade = 1.0, None
    for _, made in expressions:
        for name in made.names:
            labels.setdefault(name, set()).add("expression")
        grade = made.grade if grade is None else max(grade, made.grade)
    for label, kinds in labels.items():
        doubt *= 1 - max(BELIEF[k] for k in kinds)
        if "expression" not in kinds:
            own = _LOOSE.get(label, GRADE_OF.get(label))
            grade = own if grade is None else max(grade, own)
    return {
        "n_words": len(words),
        "places": [{"word": at, "label": label} for at, label in sorted(places)],
        "labels": sorted(labels),
        "expressions": [{"word": at, "expression": x.text, "terms": GRADES[x.grade]} for at, x in sorted(expressions, key=lambda x: x[0])],
        "terms": None if grade is None else GRADES[grade],
        "score": 1 - doubt,
    }


_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
_STATED = pa.struct([("word", pa.int64()), ("expression", pa.string()), ("terms", pa.string())])
_FIELDS = [
    ("n_words", pa.int64(), "long"),
    ("places", pa.list_(_PLACE), "array<struct<word: long, label: string>>"),
    ("labels", pa.list_(pa.string()), "array<string>"),
    ("expressions", pa.list_(_STATED), "array<struct<word: long, expression: string, terms: string>>"),
    ("terms", pa.string(), "string"),
    ("score", pa.float64(), "double"),
]


def _rows(batches, text: str, carry: list[str]):
    found = automaton()
    for batch in batches:
        for piece in bytetext.slices(batch, text):
            column = piece.column(piece.schema.get_field_index(text)).cast(pa.binary())
            rows = [scan(x, found) for x in column.to_pylist()]
            kept = [piece.column(piece.schema.get_field_index(c)) for c in carry]
            made = [pa.array([r[name] for r in rows], kind) for name, kind, _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*carry, *[name for name, _, _ in _FIELDS]])


def scan_licences(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all but the text) and, for every row, what its whole text says of licences.

    ``n_words``; ``places``: word number (from 0) and label of every place of a base phrase; ``labels``: distinct, of base
    phrases, other phrases and licences that expressions name, sorted; ``expressions``: word number of the tag, normalised
    expression and its terms; ``terms``: the hardest of all that the text names, NULL without any; ``score``: 0 without a
    label, otherwise one less the product of the doubts of all labels.

    A NULL or empty text has no words and no labels.  Rows are independent of each other, repeated ones included.
    Columns of ``docs`` that are called as a column made here are replaced.
    """
    ship()
    made = [name for name, _, _ in _FIELDS]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in made and (carry is not None or c != text)]
    clear = "_text"
    while clear in docs.columns:
        clear += "_"
    bare = docs.select(*[docs[c] for c in kept], docs[text].cast("string").alias(clear))
    kinds = {f.name: f.dataType.simpleString() for f in bare.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], *[f"{name} {kind}" for name, _, kind in _FIELDS]])
    return bare.mapInArrow(lambda batches: _rows(batches, clear, kept), schema)
