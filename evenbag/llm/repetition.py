"""Quality rules: repetition coverage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Of all word characters, the most that the commonest n-gram of so many words may
#: make up, if it occurs three times or more (published shares).
MAX_TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: The most that may lie in n-grams of so many words that occur twice or more; words
#: of repeated lines are left to the line rule (published shares).
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The most that may lie in lines equal to an earlier one, if there are so many of
#: these: a header that comes once more, as in a footer, rejects no short text.
MAX_LINE_SHARE, MIN_DUP_LINES = 0.20, 2
#: Occurrences from which an n-gram counts as the commonest.
TOP_TIMES = 3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, {}, base_failed boolean, kept boolean"


def _chars(b: bytes) -> int:
    """Code points of UTF-8."""
    return len(b.decode("utf-8", "surrogatepass")) if not b.isascii() else len(b)


def ngrams(codes: np.ndarray, lengths: list[int]):
    """For each length n, in rising order: n and the hashes of all n-grams. codes: a
    64-bit hash of each word. An n-gram's hash rolls on by one factor and one word."""
    rolled, size = codes.copy(), 1
    with np.errstate(over="ignore"):
        for want in lengths:
            while size < want and size < len(codes):
                rolled = rolled[:-1] * _FACTOR + codes[size:]
                size += 1
            yield want, rolled if size == want <= len(codes) else rolled[:0]


def covered(rolled: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Which of n words lie in an n-gram that occurs twice or more; None if none."""
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return None
    at = np.flatnonzero(np.isin(rolled, twice))
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


def top_chars(rolled: np.ndarray, sums: np.ndarray, size: int) -> int:
    """The most characters (all occurrences together) of an n-gram that occurs
    TOP_TIMES or more. sums: of the words' characters, up to each."""
    found, first, count = np.unique(rolled, return_index=True, return_counts=True)
    often = count >= TOP_TIMES
    at = first[often]
    return int((count[often] * (sums[at + size] - sums[at])).max(initial=0))


def measure(text: bytes | None, shares: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE, top_shares: dict[int, float] | None = None) -> tuple:
    """The figures of one whole text, in the order of SCHEMA without the id."""
    shares, top_shares = shares or MAX_NGRAM_SHARE, top_shares or MAX_TOP_SHARE
    text = text or b""
    words = text.split()
    n = len(words)
    word_chars = _chars(text.translate(None, SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [(line, line.split()) for line in text.split(b"\n")]
    times = Counter(line for line, inside in lines if inside)
    dup_lines = dup_line_chars = 0
    if any(k > 1 for k in times.values()):
        dup_lines = sum(times.values()) - len(times)
        dup_line_chars = sum((k - 1) * _chars(line.translate(None, SPACE)) for line, k in times.items())
    # Ours, not Python's hash(): it is the same in every worker.
    codes = word_codes(words)
    top, inside, repeat_words = dict.fromkeys(top_shares, 0), dict.fromkeys(shares, 0), 0
    sums = own = None
    for size, rolled in ngrams(codes, sorted({WINDOW, *shares, *top_shares})):
        cover = covered(rolled, n, size)
        if cover is None:  # a longer n-gram repeats only where a shorter does
            break
        if sums is None:
            sums = np.cumsum([0, *map(_chars, words)])
            own = np.repeat([times[line] < 2 for line, _ in lines], [len(w) for _, w in lines])
        if size == WINDOW:
            repeat_words = int(cover.sum())
        if size in shares:
            inside[size] = int(np.diff(sums)[cover & own].sum())
        if size in top_shares:
            top[size] = top_chars(rolled, sums, size)
    base_failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    limits = [(dup_line_chars * (dup_lines >= MIN_DUP_LINES), line_share), *((top[k], v) for k, v in top_shares.items()), *((inside[k], v) for k, v in shares.items())]
    bad = any(c > share * word_chars for c, share in limits)
    return n, word_chars, symbols, dup_lines, repeat_words, dup_line_chars, *top.values(), *inside.values(), base_failed, not base_failed and not bad


def word_codes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    known: dict[bytes, int] = {}
    out = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = xxh3_64_intdigest(w)
        out.append(c)
    return np.array(out, np.uint64)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE, top_shares: dict[int, float] | None = None) -> DataFrame:
    """One row of figures and verdicts per row of docs; no shuffle.

    Base rules: fewer than 10 words, or over 20 % of the words in repeated 5-word
    windows. The method's, as shares of all word characters: those in lines equal to
    an earlier one, if there are two or more; those of the commonest n-gram of 2 to 4 words, all its
    occurrences together; those in n-grams of 5 to 10 words that occur twice or more,
    without the words of lines that occur twice or more (a header line is judged
    once, as a line). Words are runs of other than 0x20 and 0x09-0x0D; lines end at
    \\n only and are compared as they are. A null or empty text has no words, so it
    fails. Texts are measured whole. Null and repeated ids each keep their row, other
    columns are not read, no rows give none."""
    shares, top_shares = shares or MAX_NGRAM_SHARE, top_shares or MAX_TOP_SHARE
    schema = SCHEMA.format(", ".join([*(f"top_{k}gram_chars long" for k in top_shares), *(f"dup_{k}gram_chars long" for k in shares)]))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            found = [measure(t.as_py(), shares, line_share, top_shares) for t in b.column(1).cast(pa.binary())]
            arrays = [pa.array(c, pa.bool_() if k >= len(names) - 3 else pa.int64()) for k, c in enumerate(zip(*found))]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names)

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).mapInArrow(run, schema)
