"""Secret scans: Aho-Corasick keywords, anchored patterns at their hits, checksums.

One automaton over the lower-cased text finds every place where a secret could begin.
A pattern is tried only there, so texts without keywords cost one pass. Every pattern
starts with its keyword, hence trying it at the hits in order, past the last match's end,
finds what a leftmost non-overlapping search of the whole text finds. Runs of hexadecimal
digits have no keyword of their own: every four digits are one, built from a rule, and a
hit is widened to its whole run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import text_or_empty

#: Kinds in the order in which spans that start together are listed. The first three are the base.
KINDS = ("assign", "access", "hex", "forge", "registry", "private_key")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
FORGE = re.compile(r"gh[opsur]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
# Up to the END line, whatever header lines come before the key; without one, header lines and what may be a key's digits.
PRIVATE_KEY = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\s*(?:[A-Za-z-]+:[^\n]*\n)*[A-Za-z0-9+/=\s]*)",
    re.ASCII,
)
DIGITS_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = frozenset("0123456789abcdef")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

#: Keywords in lower case and the kind they begin.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "forge": ("gho_", "ghp_", "ghs_", "ghu_", "ghr_"),
    "registry": ("npm_",),
    "private_key": ("-----begin ",),
}
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum_holds(match: re.Match) -> bool:
    """Whether the last six digits are the CRC-32 of the thirty before them, in base 62."""
    value = 0
    for c in match[2]:
        value = value * 62 + DIGITS_62.index(c)
    return value == zlib.crc32(match[1].encode())


#: Pattern and test of the kinds that a keyword begins.
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= ASSIGN_CHARS),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_CHARS),
    "forge": (FORGE, checksum_holds),
    "registry": (REGISTRY, checksum_holds),
    "private_key": (PRIVATE_KEY, lambda m: True),
}

_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        found = ahocorasick.Automaton()
        for digits in product(sorted(HEX), repeat=4):
            found.add_word("".join(digits), ("hex", 4))
        for kind, words in KEYWORDS.items():
            for word in words:
                found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def lowered(text: str) -> str:
    """`text` with letters in lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII_LOWER)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    spans, past = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(lowered(text)):
        start = last + 1 - size
        if start < past[kind]:
            continue
        if kind == "hex":
            end = start
            while end < len(text) and text[end] in HEX:
                end += 1
            if end == start:
                continue
            while start > past["hex"] and text[start - 1] in HEX:
                start -= 1
            past["hex"] = end
            if end - start >= HEX_CHARS:
                spans.append(("hex", start, end))
            continue
        pattern, test = RULES[kind]
        if match := pattern.match(text, start):
            past[kind] = match.end()
            if test(match):
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each stretch that spans cover replaced by the kind of its first span."""
    out, at, open_end = [], 0, -1
    for kind, start, end in spans:
        if start >= open_end:
            out += [text[at:start], f"[{kind} removed]"]
        open_end = max(open_end, end)
        at = open_end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, a digest of the base spans, all spans, and on demand the text without them.

    A null or empty text has no spans, and the digest is that of the empty string. Repeated
    rows and null ids each keep their row; an empty table gives no rows. Other columns are
    not read. No row leaves its partition, so no key can become hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, texts = {k: [] for k in BASE}, [], [], []
            for value in batch.column(1):
                text = value.as_py()
                found = find_secrets(text)
                base = [s for s in found if s[0] in BASE]
                for kind in BASE:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                if with_text:
                    texts.append(redacted(text, found) if found else text)
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "clean_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", clean_text string" * with_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret in its text replaced; all rows and columns stay, the length column, if there is one, is counted anew where the text changed.

    Null and empty texts stay as they are, and whole texts are read, however long. Rows do not
    depend on each other, so repeated rows stay repeated. An empty table gives no rows.
    """
    at, length_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            clean = []
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if text and (found := find_secrets(text)):
                    hit[i] = True
                    clean.append(redacted(text, found))
            mask = pa.array(hit)
            out = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(batch.column(at), mask, pa.array(clean, batch.schema.field(at).type)))
            if length_at is not None:
                kind = batch.schema.field(length_at).type
                out = out.set_column(length_at, batch.schema.field(length_at), pc.replace_with_mask(batch.column(length_at), mask, pa.array([len(t) for t in clean], kind)))
            yield out

    return docs.mapInArrow(run, docs.schema)
