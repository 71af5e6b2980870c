r"""Substring dedup by line and paragraph hashing.

A text's units are its lines (paragraphs, at \n), of whatever length, and runs of RUN
words, across lines: of each WINDOW successive runs the one of the smallest hash, so
that any passage of RUN + WINDOW - 1 words has a unit of its own wherever it is
spliced in and however its lines are broken. In words of more than LONG_WORD
characters (scripts without spaces, base64) runs of characters are taken alike. Units
are normalised (A-Z lower-cased, white space joined), hashed and grouped over all
documents; of each digest the earliest ranked occurrence stays, the others are put
together to the passages that go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh

#: Words of a run, and successive runs of which one at least is a unit: no more than
#: words of a run, so that the units inside a passage touch.
RUN, WINDOW = 20, 20
#: The same in characters, for words of more than LONG_WORD characters.
CHAR_RUN, CHAR_WINDOW, LONG_WORD = 24, 24, 46
#: What op5 calls a passage: at least so many words. Shorter lines that repeat
#: (headings, licence lines) are found too, and go with least=1.
LEAST = 20
#: Characters that stand for a word of a passage without spaces.
CHARS_A_WORD = 2
#: Bytes of texts that are cut into units at once (or one longer text).
LOT = 1 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.where(_SPACE, 0, np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64))
_FACTOR = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)
UNITS = "doc_id long, text_key long, begin int, end int, word int, n_words int, d1 long, d2 long"


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor % (1 << 64), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) >> np.uint64(1)


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """The smallest (or largest) of each `size` successive items, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def runs(items: np.ndarray, group: np.ndarray, size: int, window: int) -> np.ndarray:
    """Begins of the runs of `size` items (hashes) that are the smallest of some
    `window` successive runs of their group, groups standing one after the other.
    Ties are all taken, so what is a unit is seen from `window` runs to either side
    only; but of runs that are equal one by one (a word over and over) the first."""
    n, last = len(items) - size + 1, size + window - 2
    if len(items) <= last:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * _powers(_FACTOR, len(items)), dtype=np.uint64)])
        found = _mixed((sums[size:] - sums[:-size]) * _powers(pow(_FACTOR, -1, 1 << 64), n))
    found[group[size - 1 :] != group[:n]] = _NONE
    least = _sliding(found, window, np.minimum)
    least[group[last:] != group[: len(least)]] = 0
    ends = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate([ends, least, ends]), window, np.maximum)
    chosen = (most == found) & (found != _NONE)
    chosen[1:] &= (found[1:] != found[:-1]) | (group[1:n] != group[: n - 1])
    return np.flatnonzero(chosen)


def units(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(text, begin, end, word, words, digest) of all units of the texts: offsets in
    code points, the number of the first word, how many words (0 for a run of
    characters), and 128 bits as two longs."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    flat = b"".join(x for t in texts for x in ((t or b"").lower(), b"\n"))
    b = np.frombuffer(flat, np.uint8)
    space = _SPACE[b]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts) :]
    text_end = np.cumsum(sizes)
    owner = np.searchsorted(text_end, starts, "right")
    line = np.searchsorted(np.flatnonzero(b == 10), starts)
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((b & 0xC0) != 0x80)])
    first_word = np.searchsorted(starts, text_end - sizes)
    with np.errstate(over="ignore"):
        scaled = _BYTE[b] * _powers(_FACTOR, len(b))
        inverse = _powers(pow(_FACTOR, -1, 1 << 64), len(b))
        hashes = _mixed(np.add.reduceat(scaled, starts) * inverse[starts]) if len(starts) else np.zeros(0, np.uint64)
    del scaled, inverse
    # The normalised text: words with one space between.
    length = ends - starts
    place = np.cumsum(length + 1) - length - 1
    plain = np.full(int((length + 1).sum()), 0x20, np.uint8)
    plain[np.repeat(place - np.cumsum(length) + length, length) + np.arange(length.sum())] = b[~space]
    whole = plain.tobytes()

    line_first = np.flatnonzero(np.diff(line, prepend=-1))
    line_last = np.append(line_first[1:], len(starts)) - 1 if len(starts) else line_first
    run_first = runs(hashes, owner, RUN, WINDOW)
    low, high = np.concatenate([line_first, run_first]), np.concatenate([line_last, run_first + RUN - 1])
    digests = [xxhash.xxh3_128_digest(whole[i:j]) for i, j in zip(place[low].tolist(), (place[high] + length[high]).tolist())]
    row, count = owner[low], high - low + 1
    begin, end = chars[starts[low]], chars[ends[high]]

    long = np.flatnonzero(chars[ends] - chars[starts] > LONG_WORD)
    if len(long):
        words = [flat[starts[k] : ends[k]].decode("utf-8", "surrogatepass") for k in long]
        of = np.repeat(np.arange(len(long)), [len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            at = runs(_mixed(codes * np.uint64(_FACTOR)), of, CHAR_RUN, CHAR_WINDOW)
        inside = at - np.searchsorted(of, of[at])
        digests += [xxhash.xxh3_128_digest(words[k][i : i + CHAR_RUN]) for k, i in zip(of[at].tolist(), inside.tolist())]
        word = long[of[at]]
        low, row, count = np.concatenate([low, word]), np.concatenate([row, owner[word]]), np.concatenate([count, np.zeros(len(at), np.int64)])
        begin = np.concatenate([begin, chars[starts[word]] + inside])
        end = np.concatenate([end, chars[starts[word]] + inside + CHAR_RUN])
    before = chars[text_end - sizes]
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return row, begin - before[row], end - before[row], low - first_word[row], count, pairs


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units of all rows of docs, as UNITS says; text_key tells the texts of one
    id apart, the 128-bit digest is d1, d2."""

    def run(batches):
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1), b.column(2).cast(pa.binary())
            held, size, first = [], 0, 0
            for k, t in enumerate(texts):
                held.append(t.as_py())
                size += len(held[-1] or b"")
                if size > LOT or k == len(texts) - 1:
                    row, begin, end, word, count, pairs = units(held)
                    at = pa.array(row + first)
                    small = [pa.array(x.astype(np.int32)) for x in (begin, end, word, count)]
                    yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), *small, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], [x.split()[0] for x in UNITS.split(", ")])
                    held, size, first = [], 0, k + 1

    text = col(docs, text_col)
    return docs.select(col(docs, id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, UNITS)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units to remove: those of unit_table() of which an earlier occurrence
    stays, with `first` (none, doc_id, text_key, begin of that one).

    Occurrences rank by id, null last, then by text_key and offset. A digest's rows
    are never gathered: its first occurrence and count are aggregated before the
    shuffle, and only digests that repeat are joined back. One that overlaps the
    occurrence that stays is not removed."""
    all_units = cut(unit_table(docs, id_col, text_col))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "begin")
    heads = all_units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    heads = cut(heads.filter("n > 1").drop("n"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    overlaps = same & (F.col("begin") < F.col("first.begin") + F.col("end") - F.col("begin"))
    return all_units.join(heads, ["d1", "d2"]).filter(~overlaps).drop("d1", "d2")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """One row per passage to remove: doc_id, text_key, begin, end (code points of the
    original text, end exclusive), n_words, n_units, first_doc_id and first_begin
    (where its first unit stands first).

    A passage is a stretch of repeated units that touch or overlap. Those of fewer
    than `least` words stay (of passages without spaces, fewer than CHARS_A_WORD
    times as many characters); 1 spares none, also a line of one word goes. n_words
    is 0 inside one long word. Repeats inside one document go too. Rows that repeat
    whole (same id and text) are one document, as are their passages; other rows are
    told apart, also if their ids are null or repeat. Null and empty texts have no
    units; other columns are not read; no rows give none."""
    x = repeated_units(docs, id_col, text_col).distinct()
    before = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end", "word").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("word") + F.col("n_words")).over(before)
    touches = (F.col("begin") <= F.max("end").over(before)) | ((F.col("n_words") > 0) & (F.col("word") <= reach))
    x = x.withColumn("opens", F.when(touches, 0).otherwise(1))
    upto = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end", "word").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("passage", F.sum("opens").over(upto))
    words = F.when(F.max("n_words") > 0, F.max(F.col("word") + F.col("n_words")) - F.min("word")).otherwise(0)
    head = F.min(F.struct("begin", "first"))
    x = x.groupBy("doc_id", "text_key", "passage").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), words.alias("n_words"), F.count("*").alias("n_units"), head.alias("head"))
    long = (F.col("n_words") >= least) | ((F.col("n_words") == 0) & (F.col("end") - F.col("begin") >= CHARS_A_WORD * least))
    return x.filter(long).select("doc_id", "text_key", "begin", "end", "n_words", "n_units", F.col("head.first.doc_id").alias("first_doc_id"), F.col("head.first.begin").alias("first_begin"))


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """docs with the passages cut out of the text, and removed_spans: the (begin, end)
    that went, by the original text; null where none did. All rows and columns stay;
    of rows that share an id each loses what is its own text's."""
    spans = passages(docs, id_col, text_col, least).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    key, own, found = fresh(docs, "span_doc", "span_text", "spans")
    text = col(docs, text_col)
    match = col(docs, id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(own))
    x = docs.join(spans.select(F.col("doc_id").alias(key), F.col("text_key").alias(own), F.col("spans").alias(found)), match, "left")
    spans_ = F.col(found)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(acc, s):
        return F.struct(F.concat(acc.kept, F.substring(text, acc.at + 1, s.begin - acc.at)).alias("kept"), s.end.alias("at"))

    left = F.aggregate(spans_, start, step, lambda acc: F.concat(acc.kept, F.substring(text, acc.at + 1, F.length(text))))
    removed, = fresh(docs, "removed_spans")
    return x.select(*(F.when(spans_.isNull(), text).otherwise(left).alias(c) if c == text_col else col(docs, c) for c in docs.columns), spans_.alias(removed))
