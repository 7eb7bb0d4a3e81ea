"""Licence scan: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads expressions.

The words of a text are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased. The automaton runs over the words joined by single spaces, so a phrase is found
where its words stand consecutively, whatever separates them. Where it meets the words of an
identifier tag, the rest of that line of the original text is parsed as an expression of
identifiers with AND, OR, WITH and parentheses.

Defined cases: a null or empty text has no word, no place, no label and score 0; rows that
repeat are each scanned; a null id stays null; texts of any length are scanned whole; an
expression that does not parse gives the identifiers that it names, without an obligation;
columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import column, slices, text_buffer

# Base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Words of notices that name a licence family without one of the base phrases.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "all rights reserved": "proprietary",
}
TAG_PHRASES = ("spdx license identifier",)

# Families of identifiers by prefix (of two that fit, the first counts), with the weight of their obligations (0 to 1).
FAMILIES = [
    ("agpl", "agpl", 1.0), ("lgpl", "lgpl", 0.6), ("gpl", "gpl", 0.8), ("apache", "apache", 0.2), ("mit", "mit", 0.1), ("bsd", "bsd", 0.1), ("isc", "isc", 0.1),
    ("mpl", "mpl", 0.5), ("epl", "epl", 0.5), ("cc-by-nc", "cc-by-nc", 0.9), ("cc-by-sa", "cc-by-sa", 0.6), ("cc-by-nd", "cc-by-nd", 0.7), ("cc-by", "cc-by", 0.2), ("cc0", "cc0", 0.0), ("unlicense", "public-domain", 0.0), ("0bsd", "bsd", 0.0), ("zlib", "zlib", 0.1),
]
#: How much of an obligation stays under an exception; how much each kind of evidence weighs.
EXCEPTION_KEEPS = 0.5
EVIDENCE = {"base": 0.6, "notice": 0.7, "tag": 0.95}

_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else 0x20 if _SEPARATOR.match(bytes([b])) else b) for b in range(256))
_GAP = rb"[^0-9A-Za-z\x80-\xff]"
_TAG = re.compile(rb"(?i)(?<![0-9a-z\x80-\xff])spdx" + _GAP + rb"+license" + _GAP + rb"+identifier(?![0-9a-z\x80-\xff])\s*:?[ \t]*([^\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: an expression as a list in postfix order. ValueError if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRECEDENCE:
            if not operand:
                raise ValueError(f"operator {token} lacks its left side")
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("an operator is missing before (")
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or not operand:
                raise ValueError("unbalanced )")
            held.pop()
        else:
            if operand:
                raise ValueError(f"an operator is missing before {token}")
            out.append(token)
            operand = True
    if not operand or "(" in held:
        raise ValueError("the expression ends too early")
    return out + held[::-1]


def family(identifier: str) -> tuple[str | None, float]:
    """Label and obligation of an identifier: a family's name alone or before what is no letter, or a version such as v2; words that only begin like one are none."""
    low = identifier.lower()
    return next(((name, weight) for prefix, name, weight in FAMILIES if re.match(rf"{re.escape(prefix)}(?:$|[^a-z]|v[0-9])", low)), (None, 0.5))


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    """Families named and the obligation: AND takes the heavier side, OR the lighter, WITH eases its left side."""
    stack: list[tuple[frozenset[str], float]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left[0], left[1] * EXCEPTION_KEEPS))
            else:
                stack.append((left[0] | right[0], (max if token == "and" else min)(left[1], right[1])))
        else:
            name, weight = family(token)
            stack.append((frozenset([name] if name else []), weight))
    return stack[0]


def read_tags(raw: bytes) -> tuple[set[str], float | None, list[str]]:
    """Labels, the heaviest obligation and the parsed expressions (postfix) of all tags of a text."""
    labels: set[str] = set()
    heaviest, parsed = None, []
    for found in _TAG.finditer(raw):
        line = re.split(r"[*/#<>\"';,]", found[1].decode("utf-8", "replace"))[0].strip().rstrip(".")
        try:
            postfix = to_postfix(line)
        except ValueError:
            labels |= {name for t in _TOKEN.findall(line) if t.lower() not in _PRECEDENCE and (name := family(t)[0])}
            continue
        names, weight = evaluate(postfix)
        labels |= names
        heaviest = weight if heaviest is None else max(heaviest, weight)
        parsed.append(" ".join(postfix))
    return labels, heaviest, parsed


def build_automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES.items()), ("tag", ((t, None) for t in TAG_PHRASES)), ("base", BASE_PHRASES.items())):
        for phrase, label in phrases:
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


def scan_text(raw: bytes, automaton) -> dict:
    words = raw.translate(_TABLE).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    notices: dict[int, tuple[int, str]] = {}  # by place: of phrases that start together the longest counts
    tagged = False
    kept, counted, at = 1.0, 0, 0
    for end, (kind, label, length) in automaton.iter(line):
        if kind == "base":
            begin = end - length  # the space before the phrase
            counted += line.count(" ", at, begin) if begin >= at else -line.count(" ", begin, at)
            at = begin
            starts.append(counted)
            base.add(label)
            kept *= 1 - EVIDENCE["base"]
        elif kind == "notice":
            notices[end - length] = max(notices.get(end - length, (0, "")), (length, label))
        else:
            tagged = True
    labels |= {label for _, label in notices.values()}
    kept *= (1 - EVIDENCE["notice"]) ** len(notices)
    obligation, parsed = None, []
    if tagged:
        more, obligation, parsed = read_tags(raw)
        labels |= more
        kept *= 1 - EVIDENCE["tag"] * bool(more)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts) if starts else None,
        "last_word": max(starts) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": 1 - kept,
        "obligation": obligation,
        "expressions": parsed,
    }


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "obligation": pa.float64(), "expressions": pa.list_(pa.string())}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places, labels, parsed expressions and a score of each text; one pass, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for batch in slices(batches, "text"):
            data, at = text_buffer(column(batch, "text"))
            raw, at = data.tobytes(), at.tolist()
            rows = [scan_text(raw[s:e], automaton) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array([r[k] for r in rows], t) for k, t in _FIELDS.items())], ["id", *_FIELDS])

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text")
    kind = dict(narrow.dtypes)["id"]
    out = narrow.mapInArrow(scan, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, obligation double, expressions array<string>")
    return out.withColumnRenamed("id", id_col)
