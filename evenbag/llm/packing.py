"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import col

MAX_TOKENS = 4096
END_ID = 2
#: Cost of a piece of n tokens in one sequence: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 1 << 20
#: Words whose ids a worker remembers.
KNOWN_WORDS = 150_000
#: Texts on which a tokenizer must show that words may be encoded one by one.
PROBES = ["The quick, Brown fox. JUMPS over", "\u00c9cole \u00dcber na\u00efve gar\u00e7on, \u00df. \u00ff", " a  b   c ", "x\ny\n\nz \n w", "don't it's 'll 12345 a1b2 3.14, (x) [y] {z} a-b a_b", "caf\u00e9. na\u00efve, \u65e5\u672c\u8a9e \u0440\u0443\u0441 \U0001f600 \t end"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kept(path: str) -> WordIds:
    """This worker's WordIds: tasks that follow in the same worker go on with it."""
    own = sys.modules.setdefault("_evenbag_worker", types.ModuleType("_evenbag_worker")).__dict__
    if path not in own:
        own[path] = WordIds(path)
    return own[path]


class WordIds:
    """Token ids of texts. If the tokenizer, on PROBES at least, never joins or looks
    across a space or newline, each different word of a lot of texts is encoded once;
    else texts are encoded whole.

    Words of Latin letters, with a full stop or comma at most, go to the tokenizer's
    model at once, in lower case and as its byte letters, as its normalizer and
    splitter would hand them on (this too is probed), and are remembered; others go
    through the whole of it."""

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole, self.known, self.cores = Tokenizer.from_file(path), known, {"": b""}
        self.model, letters = self.whole.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.tails = {"": b""} | {c: array("i", self._ids(c)).tobytes() for c in ".,"}
        self.by_word, self.simple = True, re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch
        if not self._probed():
            self.simple = lambda word: None
            self.by_word = self._probed()
        self.cores = {"": b""}

    def _ids(self, text: str | None) -> list[int]:
        return self.whole.encode(text or "", add_special_tokens=False).ids

    def _probed(self) -> bool:
        self.cores = {"": b""}
        return all(list(got) == self._ids(t) for t, got in zip(PROBES, self(pa.array(PROBES))))

    def _simple(self, core: str, tail: str) -> bytes:
        letters = core.lower()
        ids = self.cores.get(letters)
        if ids is None:
            raw = letters if letters.isascii() else letters.translate(self.bytes)
            ids = self.cores[letters] = array("i", [t.id for t in self.model.tokenize(raw)]).tobytes()
        return ids + self.tails[tail]

    def _encode(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if len(self.cores) > self.known:
            self.cores = {"": b""}
        cores, rest = self.cores, []
        ids = list(map(cores.get, words))
        for k in [k for k, found in enumerate(ids) if found is None]:
            if m := self.simple(words[k]):
                ids[k] = cores[words[k]] = self._simple(*m.groups())
            else:
                rest.append(k)
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            e = self.whole.encode(" ".join(words[k] for k in some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(words[k]) + 1 for k in some[:-1])])
            first = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            count = np.bincount(np.searchsorted(begin, first, "right") - 1, minlength=len(some))
            flat, end = np.array(e.ids, np.int32).tobytes(), 0
            for k, n in zip(some, (4 * count).tolist()):
                ids[k] = flat[end : end + n]
                end += n
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.int32), length

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        if not self.by_word:
            return [np.array(self._ids(t), np.int32) for t in texts.to_pylist()]
        words = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        flat, length = self._encode(coded.dictionary.to_numpy(zero_copy_only=False))
        at = coded.indices.to_numpy()
        begin, n = np.cumsum(length) - length, length[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        last = np.where(last > 0, ends[last - 1], 0) if len(ends) else last
        return np.split(ids, last[:-1])


def _lots(texts: pa.Array, most: int = 1 << 22):
    """Slices of texts of at most about `most` bytes, or of one longer text."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield texts[at:end]
        at = end


def pack(lengths: list[int], sequences: int, size: int = MAX_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Packs documents into `sequences` sequences of exactly `size` tokens.

    Returns pieces (document, start, length, sequence), in the order in which they
    stand, and what is left (document, start, length). Documents longer than size
    are cut into full pieces and a rest. Pieces go, in descending cost, each to
    the lowest-cost sequence with room for the whole of it. Then what found no
    room is cut to fill the gaps, the lowest-cost sequence first. There must be
    size * sequences tokens at least."""
    pieces = [(min(size, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, size)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    room, cost = np.full(sequences, size, np.int64), np.zeros(sequences)
    out, later = [], []
    for n, d, s in pieces:
        fits = np.where(room >= n, cost, np.inf)
        best = int(fits.argmin()) if sequences else 0
        if not sequences or fits[best] == np.inf:
            later.append((n, d, s))
            continue
        room[best] -= n
        cost[best] += linear * n + quadratic * n * n
        out.append((d, s, n, best))
    heap = [(cost[k], k) for k in range(sequences) if room[k]]
    heapq.heapify(heap)
    later.reverse()
    while heap:
        _, k = heapq.heappop(heap)
        while room[k]:
            n, d, s = later.pop()
            here = int(min(n, room[k]))
            out.append((d, s, here, k))
            room[k] -= here
            if n > here:
                later.append((n - here, d, s + here))
    return out, [(d, s, n) for n, d, s in reversed(later)]


def _powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = MAX_TOKENS, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids) of all documents' token ids, each ending with end_id.

    Each task packs the documents of its partition, group by group of about
    group_tokens tokens, so nothing is shuffled and memory is bounded by a group
    and a document. Sequences have exactly `size` tokens; what a group leaves goes
    into the next one, and a partition's last tokens, fewer than size, into
    sequences whose lengths are powers of two: there is no padding at all. A
    sequence_id holds the partition in its upper bits.

    A null or empty text is the id end_id alone. Nulls and repeats among doc_id
    are allowed, each row is a document; other columns are not read; no rows give
    none. Reruns over the same files agree."""
    path = path or tokenizer_path()

    def run(batches):
        ids_of, top = _kept(path), TaskContext.get().partitionId() << 36
        made, held, total = 0, [], 0  # held: (doc_id, doc_tokens, first, ids)

        def emit(found, made):
            """found: (held index, start, length, sequence), in order of offset."""
            used: dict[int, int] = {}
            cols: list[list] = [[] for _ in range(8)]
            for d, s, n, k in found:
                doc, doc_tokens, first, ids = held[d]
                part = ids[s : s + n]
                for c, v in zip(cols, (doc, first + s, n, zlib.crc32(part.astype("<u4").tobytes()), doc_tokens, top + made + k, used.get(k, 0), part if with_ids else None)):
                    c.append(v)
                used[k] = used.get(k, 0) + n
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for b in batches:
            texts = (x for lot in _lots(b.column(1)) for x in ids_of(lot))
            for doc, found_ids in zip(b.column(0).to_pylist(), texts):
                ids = np.append(found_ids, np.int32(end_id))
                held.append((doc, len(ids), 0, ids))
                total += len(ids)
                if total >= group_tokens:
                    found, left = pack([len(h[3]) for h in held], total // size, size, linear, quadratic)
                    yield emit(found, made)
                    made += total // size
                    held = [(held[d][0], held[d][1], held[d][2] + s, held[d][3][s : s + n].copy()) for d, s, n in left]
                    total %= size
        if held:
            found, left = pack([len(h[3]) for h in held], total // size, size, linear, quadratic)
            k = total // size
            left.reverse()
            for room in _powers(total % size):
                while room:
                    d, s, n = left.pop()
                    here = min(n, room)
                    found.append((d, s, here, k))
                    room -= here
                    if n > here:
                        left.append((d, s + here, n - here))
                k += 1
            yield emit(found, made)

    slim = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return slim.mapInArrow(run, SCHEMA)
