"""Quality rules by distribution divergence.

Every document gets two histograms, of character classes and of its language's common
words. A language's reference is the sum of the histograms of all its documents that pass
the base rules. A document is rejected if its Jensen-Shannon distance to the reference is
too large; short documents are judged on the base rules alone, as their histograms say
little. Only histograms meet in an aggregation, one row per known language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import LOWER_ASCII, store

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document is rejected, and the counts from which each is judged.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.3, 500
MAX_WORD_DISTANCE, MIN_JUDGED_WORDS = 0.28, 100

SYMBOLS = b"#*$%&|<>"
CHAR_CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "other_punctuation", "symbol", "control", "beyond_ascii")

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by at from this have or an not which but he his they had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
OTHER = "other"


def _class_table() -> bytes:
    def kind(c: int) -> str:
        if c >= 0x80:
            return "beyond_ascii"
        ch = chr(c)
        if ch.islower():
            return "lower"
        if ch.isupper():
            return "upper"
        if ch.isdigit():
            return "digit"
        if ch == "\n":
            return "newline"
        if ch in " \t\x0b\x0c\r":
            return "space"
        if ch in ".,;:!?'\"-()":
            return "sentence"
        if ch.encode() in SYMBOLS:
            return "symbol"
        return "other_punctuation" if ch.isprintable() else "control"

    return bytes(CHAR_CLASSES.index(kind(c)) for c in range(256))


CLASS_OF_BYTE = np.frombuffer(_class_table(), dtype=np.uint8)
_WORD_CLASS = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
COMMON_COUNT = len(COMMON_WORDS["en"])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words that the text has twice or more. `window`: a power of two."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    size = 1
    while size < window:  # numbers of windows twice as long, from pairs of numbers
        pairs = ids[:-size] * (ids.max() + 1) + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
    often = np.bincount(ids)[ids] > 1
    if not often.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:-window] += often
    edges[window:] -= often
    return int((edges[:-1].cumsum() > 0).sum())


def measures(text: str, lang: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; histograms of bytes by class and of common words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF_BYTE, weights=counts, minlength=len(CHAR_CLASSES)).astype(np.int64)
    spaces = int(sum(counts[c] for c in b" \t\n\x0b\x0c\r"))
    lines, seen, dup = (raw.split(b"\n") if counts[10] else []), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    table = _WORD_CLASS.get(lang)
    common = np.zeros(COMMON_COUNT + 1, dtype=np.int64)  # the last counts all other words
    if table and words:
        low = raw.translate(LOWER_ASCII).split()
        common += np.bincount(np.fromiter((table.get(w, COMMON_COUNT) for w in low), dtype=np.int64, count=len(low)), minlength=COMMON_COUNT + 1)
    return [len(words), len(text) - spaces, int(sum(counts[c] for c in SYMBOLS)), dup, repeated_words(words)], classes, common


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row of measures and histograms per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, commons = [], [], []
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                numbers, chars, common = measures(text.as_py(), lang)
                rows.append(numbers)
                classes.append(chars)
                commons.append(common)
            numbers = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
            columns = [batch.column(0), batch.column(2), *(pa.array(numbers[:, k]) for k in range(5)), pa.array([x.tolist() for x in classes], pa.list_(pa.int64())), pa.array([x.tolist() for x in commons], pa.list_(pa.int64())), pa.array([int(x.sum()) for x in classes], pa.int64()), pa.array([int(x.sum()) for x in commons], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common", "chars_total", "common_total"])

    known = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(OTHER)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), known.alias("lang"))
    return picked.mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>, chars_total long, common_total long")


def jensen_shannon(p: str, q: str) -> F.Column:
    """Jensen-Shannon distance, base 2, of two array columns of counts, whose sums the columns `<name>_total` hold; null if either is all zero."""
    return F.expr(f"""
        sqrt(greatest(0D, aggregate(
            zip_with({p}, {q}, (x, y) -> named_struct('x', try_divide(x, {p}_total), 'y', try_divide(y, {q}_total))),
            0D,
            (s, t) -> s + if(t.x > 0, t.x * log2(2 * t.x / (t.x + t.y)), 0D) / 2 + if(t.y > 0, t.y * log2(2 * t.y / (t.x + t.y)), 0D) / 2)))
    """)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Measures, base_failed and kept for every row of `docs`, with both distances.

    base_failed: under 20 words, or over 30% of the words in repeated windows. kept is false
    if base_failed; else true unless a histogram with counts enough is too far from its
    language's reference. Null texts count as empty. Languages that have no word list share
    one character reference and are not judged on words. Repeated rows, null ids and ties
    each keep a row; an empty table gives no rows. Other columns are not read.
    """
    rows = store(describe(docs, id_col, text_col, lang_col), "quality-rows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    good = rows.where("not base_failed").groupBy("lang")
    sums = good.agg(F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CHAR_CLASSES))]).alias("ref_chars"), F.array(*[F.sum(F.col("common")[i]) for i in range(COMMON_COUNT + 1)]).alias("ref_common"), *[F.sum(f"{c}_total").alias(f"ref_{c}_total") for c in ("chars", "common")])
    out = rows.join(F.broadcast(sums), "lang", "left")  # a row for each known language at most
    out = out.withColumn("char_distance", jensen_shannon("chars", "ref_chars")).withColumn("word_distance", jensen_shannon("common", "ref_common"))
    far_chars = (F.col("chars_total") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far_words = (F.col("common_total") >= MIN_JUDGED_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    kept = ~F.col("base_failed") & ~F.coalesce(far_chars, F.lit(False)) & ~F.coalesce(far_words, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")
