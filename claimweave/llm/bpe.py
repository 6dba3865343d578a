"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. A batch of texts becomes one
array of code points; a table maps each to a class, and each class is a
transition function over the few states in which a piece can stand.
Composing functions is associative, so a doubling scan gives the state
after every code point at once; it ends as soon as every prefix is a
constant function, after about as many steps as the longest run of
ambiguous letters has bits. Boundaries follow from neighbouring states and
classes. The slices then go through a bounded cache in front of the pair
merging, and their offsets are returned for decoding.

Defined cases: a null or empty text has no ids and decodes to no bytes.
Any other columns of the input are ignored. Texts are encoded whole; the
memory of a task is bounded by its longest text plus ``CHUNK_CHARS``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm.tables import in_workers, table

#: Code points that a task handles at a time, unless one text is longer.
CHUNK_CHARS = 1 << 20
#: Pieces in each of the two generations that a worker remembers.
CACHE_PIECES = 100_000
#: Rows of a batch that are Python strings at a time.
ROWS = 256
#: Pieces longer than this merge with a heap.
HEAP_BYTES = 96

# Classes of code points. The first six can take part in a contraction.
_STMD, _R, _V, _E, _L, _LETTER, _NUMBER, _OTHER, _QUOTE, _BLANK, _WHITE, _START = range(12)
# States: what the piece at hand is, after a code point.
_AT_START, _LETTERS, _NUMBERS, _OTHERS, _AT_BLANK, _AT_WHITE, _QUOTED, _QUOTED_E, _QUOTED_L, _CONTRACTED, _CONTRACTED2 = range(11)
_STATES = 11


def _step(kind: int, state: int) -> int:
    """The state after a code point of class ``kind``, from ``state``."""
    if kind == _START:
        return _AT_START
    if kind == _BLANK:
        return _AT_BLANK
    if kind == _WHITE:
        return _AT_WHITE
    if kind == _NUMBER:
        return _NUMBERS
    if kind == _OTHER:
        return _OTHERS
    if kind == _QUOTE:  # begins a piece unless it prolongs others or takes a blank before it
        return _OTHERS if state in (_OTHERS, _QUOTED, _AT_BLANK) else _QUOTED
    if state == _QUOTED:
        return {_STMD: _CONTRACTED, _R: _QUOTED_E, _V: _QUOTED_E, _L: _QUOTED_L}.get(kind, _LETTERS)
    if (state, kind) in ((_QUOTED_E, _E), (_QUOTED_L, _L)):
        return _CONTRACTED2
    return _LETTERS


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, is constant, value at the start) over all functions that can arise."""
    functions: dict[tuple[int, ...], int] = {}

    def number(f: tuple[int, ...]) -> int:
        return functions.setdefault(f, len(functions))

    of_class = [number(tuple(_step(kind, s) for s in range(_STATES))) for kind in range(12)]
    done = 0
    while done < len(functions):
        done = len(functions)
        known = list(functions)
        for f in known:
            for g in known:
                number(tuple(g[s] for s in f))
    known = list(functions)
    compose = np.array([[functions[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    return np.array(of_class, dtype=np.uint8), compose, np.array([len(set(f)) == 1 for f in known]), np.array([f[_AT_START] for f in known], dtype=np.uint8)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from its general category and the White_Space property."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            out[code] = _LETTER
        elif category[0] == "N":
            out[code] = _NUMBER
        elif category[0] == "Z":
            out[code] = _WHITE
    out[[*range(9, 14), 0x85]] = _WHITE
    out[ord(" ")], out[ord("'")] = _BLANK, _QUOTE
    for letters, kind in (("stmd", _STMD), ("r", _R), ("v", _V), ("e", _E), ("l", _L)):
        for letter in letters:
            out[ord(letter)] = kind
    return out


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The state after each code point, by a doubling scan of composed transition functions."""
    of_class, compose, constant, value = _monoid()
    ids = of_class[kinds]
    open_ = np.flatnonzero(~constant[ids])
    reach = 1
    while open_.size and reach < len(ids):
        far = open_ >= reach
        at = open_[far]
        if not at.size:
            break
        # Values on the right-hand side are read before any is replaced.
        ids[at] = compose[ids[at - reach], ids[at]]
        open_ = at[~constant[ids[at]]]
        reach *= 2
    return value[ids]


def boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``text``, the concatenation of texts that begin at ``starts``; in order, with the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not codes.size:
        return np.zeros(1, dtype=np.int64)
    # A mark before each text makes the state start anew.
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[starts] = True
    begins = begins[:-1]
    kinds = class_table()[codes]
    places = np.arange(len(codes)) + np.cumsum(begins)
    marked = np.full(len(codes) + int(begins.sum()), _START, dtype=np.uint8)
    marked[places] = kinds
    state = scan_states(marked)
    here, before = state[places], state[places - 1]
    after = np.full(len(codes), _START, dtype=np.uint8)  # the class of the next code point in the same text
    after[:-1] = np.where(begins[1:], _START, kinds[1:])
    white = (kinds == _BLANK) | (kinds == _WHITE)
    white_before = (before == _AT_BLANK) | (before == _AT_WHITE)
    ends_run = ~((after == _BLANK) | (after == _WHITE) | (after == _START))
    letter = kinds <= _LETTER
    # A letter prolongs letters, or the contraction that it completes.
    joins = letter & ((before == _LETTERS) | (here == _CONTRACTED) | (here == _CONTRACTED2))
    # r, v or l after a quote opens a contraction only if its second letter follows.
    half = letter & ((here == _QUOTED_E) | (here == _QUOTED_L))
    second = ((here == _QUOTED_E) & (after == _E)) | ((here == _QUOTED_L) & (after == _L))
    joins |= half & second
    # An unfinished contraction was letters after all.
    joins |= letter & ((before == _QUOTED_E) | (before == _QUOTED_L))
    joins |= (kinds == _NUMBER) & (before == _NUMBERS)
    joins |= ((kinds == _OTHER) | (kinds == _QUOTE)) & ((before == _OTHERS) | (before == _QUOTED))
    joins |= ~white & (before == _AT_BLANK)
    first = np.where(white, ~white_before | ends_run, ~joins) | begins
    return np.append(np.flatnonzero(first), len(codes))


class Merges(dict):
    """Maps a piece (str) to its ids as packed little-endian unsigned 32-bit integers; a bounded cache of two generations."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.older: dict[str, bytes] = {}
        self.packed = {piece: rank.to_bytes(4, "little") for piece, rank in self.ranks.items()}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode("utf-8", "replace")
            out = self.packed.get(data) or b"".join(map(self.packed.__getitem__, self.merge(data)))
            if len(data) > HEAP_BYTES:
                return out
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def merge(self, data: bytes) -> list[bytes]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if len(data) > HEAP_BYTES:
            return self._merge_long(data)
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 31
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        n, get = len(data), self.ranks.get
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if j >= n or get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p is not None]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_texts(texts: list[str], coder: Merges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, offset of each piece in code points) of each text."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        some = texts[at:end]
        whole = "".join(some)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        bounds = boundaries(whole, starts[:-1][starts[:-1] < len(whole)])
        cuts = np.searchsorted(bounds, starts)
        places = bounds.tolist()
        pieces = [whole[a:b] for a, b in zip(places, places[1:], strict=False)]
        for i in range(len(some)):
            a, b = cuts[i], cuts[i + 1]
            ids = np.frombuffer(b"".join([coder[p] for p in pieces[a:b]]), dtype="<u4")
            yield ids, bounds[a:b] - starts[i]
        at = end


def decode_ids(ids: np.ndarray, coder: Merges) -> bytes:
    return b"".join(map(coder.bytes_of.__getitem__, ids.tolist()))


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and piece_offsets (where each piece begins, in code points) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                coded = list(encode_texts(_texts(some.column(1)), coder))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([c[0].astype(np.int32) for c in coded], pa.list_(pa.int32())), pa.array([c[1].astype(np.int32) for c in coded], pa.list_(pa.int32()))], [id_col, "ids", "piece_offsets"])

    kind = dict(docs.dtypes)[id_col]
    return in_workers(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, piece_offsets array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows that ``encode`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(vocabulary)
        for batch in batches:
            texts = [decode_ids(np.asarray(ids or [], dtype=np.int64), coder).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return in_workers(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens and the digests of the ids and of the bytes that they decode to, and the columns in ``carry``; encodes and decodes each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some, counts, of_ids, of_bytes = batch.slice(at, ROWS), [], [], []
                for ids, _ in encode_texts(_texts(some.column(1)), coder):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode_ids(ids, coder)).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), *some.columns[2:]], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *carry])

    kind = dict(docs.dtypes)
    more = "".join(f", `{c}` {kind[c]}" for c in carry)
    return in_workers(docs.select(id_col, text_col, *carry), run, f"`{id_col}` {kind[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_vocabulary())
