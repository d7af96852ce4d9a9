"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlake.llm.common import batches, text_rows

#: The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further names with their labels, written as words (lower case, punctuation read as spaces).
NAMES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "boost software license": "bsl", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by": "cc-by", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "unlicense": "unlicense", "zlib license": "zlib",
    "all rights reserved": "proprietary",
}
#: Sentences of licence notices, with the label they prove by themselves (None: they only support a name).
NOTICES = {
    "licensed under": None, "released under": None, "distributed under the terms of": None, "subject to the terms of": None,
    "under the terms of the": None, "free software you can redistribute it": "gpl",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc", "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
#: Families of licence ids in expressions, by the start of the lower-case id.
FAMILIES = [
    ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"),
    ("isc", "isc"), ("bsl", "bsl"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"),
    ("unlicense", "unlicense"), ("zlib", "zlib"), ("0bsd", "bsd"), ("artistic", "artistic"), ("busl", "busl"), ("cddl", "cddl"),
    ("eupl", "eupl"), ("gfdl", "gfdl"), ("ncsa", "ncsa"), ("ofl", "ofl"), ("postgresql", "postgresql"), ("psf", "psf"), ("python", "psf"),
    ("sspl", "sspl"), ("wtfpl", "wtfpl"), ("x11", "x11"),
]
PERMISSIVE = {"apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "unlicense", "zlib", "ncsa", "postgresql", "psf", "wtfpl", "x11"}
#: How sure a finding is: a valid tag, a name with a notice, a bare name, a tag that cannot be parsed, a bare notice.
SURE = {"tag": 1.0, "notice": 0.9, "name": 0.7, "broken": 0.5, "hint": 0.2}

NOT_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())
_TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


# Exceptions that lift the duty to share works linked with the licensed one, and others that do not.
LINKING = frozenset(
    """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 ecos-exception-2.0
    fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
    i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception llvm-exception ocaml-lgpl-linking-exception
    openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception wxwindows-exception-3.1""".split()
)
OTHER_EXCEPTIONS = frozenset("gpl-cc-1.0 linux-syscall-note mif-exception openvpn-openssl-exception u-boot-exception-2.0 universal-foss-exception-1.0".split())

_PLAIN_WORD = re.compile(r"[A-Za-z][a-z]*[.:]?")


def family(name: str) -> str | None:
    """The label of a licence id: its family, an own licence's reference, or None for an unknown id.

    An id is a family's name alone or with a version or variant behind a hyphen, as ``MIT``, ``MIT-0`` or ``GPL-2.0+``.
    """
    low = name.lower().rstrip(".:")
    if re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", low):
        return low
    for start, label in FAMILIES:
        if re.fullmatch(rf"{start}(-[a-z0-9.-]+)?\+?", low):
            return label
    return None


def _is_exception(name: str) -> bool:
    return name.lower().rstrip(".:") in LINKING | OTHER_EXCEPTIONS


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a licence expression by the shunting-yard method (with before and before or); None if it
    is malformed or names an unknown licence or exception.

    Text after the expression, as comment ends, is left out; so is an operator that only a plain word follows, as in
    ``MIT and more text``. A plain word cannot be part of an expression, so the expression ends before the operator.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True  # an id or "(" is expected
    before: tuple[list[str], list[str]] | None = None  # both stacks before the last operator

    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand:
            known = _is_exception(token) if held and held[-1] == "with" else family(token) is not None
            if token == "(" and not (held and held[-1] == "with"):
                held.append(token)
            elif known:
                out.append(token.rstrip(".:"))
                operand = False
            elif before is not None and _PLAIN_WORD.fullmatch(token) and low not in _RANK:
                (out, held), operand = before, False
                break
            else:
                return None
        elif low in _RANK:
            before = list(out), list(held)
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # it closes something before the expression
            held.pop()
        else:
            break
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """Labels of all licences named, and whether the whole can be met by permissive licences alone: either side of an
    or, both sides of an and; an exception for linked works after with lifts the duty to share them, another one does not."""
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _RANK:
            (b, q), (a, p) = stack.pop(), stack.pop()
            stack.append((a, p or q) if token == "with" else (a | b, p or q if token == "or" else p and q))
        elif _is_exception(token):
            stack.append((set(), token.lower() in LINKING))
        else:
            label = family(token)
            stack.append(({label}, label in PERMISSIVE))
    return stack.pop()


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NAMES, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, spans) of one text."""
    words = text.encode("utf-8", "replace").translate(NOT_WORD).split()
    # One space around every word; the bytes of other alphabets stay single characters.
    line = f" {b' '.join(words).decode('latin-1')} "
    base, places, labels, kinds, spans = set(), [], set(), set(), []
    tagged = False
    for end, phrase in automaton().iter(line):
        begin = end - len(phrase)  # of the phrase's first letter
        if phrase in BASE:
            places.append(begin)
            base.add(BASE[phrase])
            kinds.add("name")
        elif phrase in NAMES:
            labels.add(NAMES[phrase])
            kinds.add("name")
        elif phrase == TAG:
            tagged = True
        else:
            kinds.add("hint")
            if NOTICES[phrase]:
                labels.add(NOTICES[phrase])
                kinds.add("name")
        spans.append((begin, phrase))
    score = SURE["notice"] if {"name", "hint"} <= kinds else max((SURE[k] for k in kinds), default=0.0)
    permissive = None
    for match in _TAG_TEXT.finditer(text) if tagged else ():
        rpn = parse_expression(match.group(1))
        if rpn is None:
            score = max(score, SURE["broken"])
        else:
            named, free = evaluate(rpn)
            labels |= named
            permissive = free if permissive is None else permissive and free
            score = max(score, SURE["tag"])
    labels |= base
    if spans:
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        word_at = lambda p: int(np.searchsorted(gaps, p)) - 1
        first, last = (word_at(min(places)), word_at(max(places))) if places else (None, None)
        evidence = [f"{word_at(p)}:{phrase}" for p, phrase in sorted(spans)]
    else:
        first, last, evidence = None, None, []
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive, evidence


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, evidence.

    ``evidence`` lists word:phrase for every phrase found; ``permissive`` is null without a valid tag. Texts are read
    whole. Null or empty texts have no words, no labels and score 0. Rows that repeat an id, and rows without one, are
    scanned like others; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()),
        ("evidence", pa.list_(pa.string())),
    ])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            yield from batches(schema, ((i, *scan(t.as_py())) for i, t in zip(ids, texts)))

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, permissive boolean, evidence array<string>",
    ).withColumnRenamed("id", id_col)
