"""License scans: Aho-Corasick over words, shunting-yard over identifier expressions.

A text becomes its lower-case words with one space between; one automaton finds all
phrases in it, whole words only. Where the identifier tag stands, the expression behind
it is read from the text, parsed and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import text_or_empty

#: Bytes that are no word characters become spaces, A-Z become lower case.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "creative-commons",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "non commercial": "non-commercial",
    "noncommercial": "non-commercial",
    "proprietary and confidential": "proprietary",
}
TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.ASCII | re.IGNORECASE)
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9.+-]+))", re.ASCII)

PERMISSIVE, WEAK, UNKNOWN, STRONG, CLOSED = 1.0, 0.6, 0.4, 0.2, 0.0
#: First rule whose pattern a lower-case label or identifier matches.
FAMILIES = [
    (re.compile(r"reserved|proprietary|non-commercial|.*-n[cd]\b"), CLOSED),
    (re.compile(r"lgpl|mpl|epl|cddl|cc-by-sa"), WEAK),
    (re.compile(r"a?gpl|sspl|eupl"), STRONG),
    (re.compile(r"mit|apache|bsd|0bsd|isc|zlib|unlicense|cc0|cc-by|public-domain|boost|bsl"), PERMISSIVE),
]
#: Higher binds tighter.
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        found = ahocorasick.Automaton()
        for phrase in [*BASE_PHRASES, *NOTICE_PHRASES, TAG_PHRASE]:
            found.add_word(f" {phrase} ", phrase)
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def openness(label: str) -> float:
    return next((score for pattern, score in FAMILIES if pattern.match(label)), UNKNOWN)


def evaluate(expression: str) -> tuple[list[str], float | None]:
    """Identifiers and score of the longest well-formed beginning of an expression; (no identifiers, None) if there is none.

    Both sides of `and` bind: the smaller score. `or` leaves the choice: the larger.
    `with` an exception, which is no license and is not named: at least the score of weak licenses.
    """
    output: list[tuple[float, bool]] = []
    operators: list[str] = []
    names: list[str] = []

    def apply(op: str) -> None:
        b, a = output.pop(), output.pop()
        output.append((max(a[0], WEAK) if op == "with" else min(a[0], b[0]) if op == "and" else max(a[0], b[0]), True))

    at, operand, exception = 0, True, False
    while match := TOKEN.match(expression, at):
        bracket, word = match[1], (match[2] or "").lower()
        if bracket == "(" and operand and not exception:
            operators.append("(")
        elif bracket == ")" and not operand and "(" in operators:
            while (op := operators.pop()) != "(":
                apply(op)
        elif word in PRECEDENCE and not operand:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[word]:
                apply(operators.pop())
            operators.append(word)
            operand, exception = True, word == "with"
        elif word and word not in PRECEDENCE and operand:
            output.append((openness(word), True))
            if not exception:
                names.append(word)
            operand = exception = False
        else:
            break
        at = match.end()
    while operators and operand:  # an operator or bracket without what must follow
        operand = operators.pop() == "("
    while operators:
        if (op := operators.pop()) != "(":
            apply(op)
    return names, output[0][0] if output else None


def scan(text: str) -> tuple[int, list[int], set[str], set[str], float]:
    """Number of words, starts of base phrases, base labels, all labels, score."""
    words = text.encode("utf-8", "replace").translate(WORD_BYTES).split()
    if not words:
        return 0, [], set(), set(), PERMISSIVE
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base, labels, tagged, at, before = [], set(), set(), False, 0, 0
    hits = sorted((end + 1 - len(phrase) - 2, phrase) for end, phrase in automaton().iter(line))
    for start, phrase in hits:
        before += line.count(" ", at, start)
        at = start
        if phrase in BASE_PHRASES:
            starts.append(before)
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG_PHRASE:
            tagged = True
        else:
            labels.add(NOTICE_PHRASES[phrase])
    scores = [openness(x) for x in base | labels]
    if tagged:
        for match in TAG.finditer(text):
            names, score = evaluate(match[1])
            labels.update(names)
            scores += [] if score is None else [score]
    return len(words), starts, base, base | labels, min(scores, default=PERMISSIVE)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: words, places of the base phrases, labels and a score of openness from 0 to 1.

    The score is the smallest of all labels and expressions found, 1 if there are none. Null
    texts count as empty: no words, null first_word and last_word, empty labels. Repeated rows
    and null ids each keep their row; an empty table gives no rows. Other columns are not
    read. No row leaves its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([len(f[1]) for f in found], pa.int64()),
                pa.array([min(f[1], default=None) for f in found], pa.int64()),
                pa.array([max(f[1], default=None) for f in found], pa.int64()),
                pa.array([",".join(sorted(f[2])) for f in found], pa.string()),
                pa.array([",".join(sorted(f[3])) for f in found], pa.string()),
                pa.array([f[4] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
