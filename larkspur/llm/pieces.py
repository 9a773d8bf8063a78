"""SentencePiece encoding and decoding by streaming Viterbi.

``Stream`` takes a text in pieces of any size.  Going forward over the symbols
it keeps, for each boundary, the last piece of the best segmentation up to it
(the backpointer), in a window of the longest piece's length.  All ways to go on
start from a boundary in the window; once their backpointer paths meet in one
boundary, everything before it is settled, its ids are committed and the rest
of the window alone stays.

For unigram models the best segmentation has the greatest sum of scores.  For
models trained by pair merges (the public file is one) the sum of scores is
*not* what the format defines; there a segmentation is right if each piece and
each two neighbours, encoded by merges, stay what they are.  Exactly one piece
can end such a segmentation at each boundary, so the same pass with the same
backpointers gives the ids of the merge algorithm.

Texts are stored with a space before them and spaces as U+2581, as the model's
normaliser (identity) does; symbols without a piece become their UTF-8 bytes.
Decoding restores the text exactly, but for a U+2581 of the text itself, which
the format can't tell from a space.  Null and empty texts have no ids.  Texts
may be of any length (repeated rows each get their ids; of pieces of equal score
the one further left is merged first; columns of any name pass through; an empty
table gives an empty result): a task holds one chunk of texts, and its equal parts,
between symbols that no piece holds side by side, are encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import GOLDEN, U64, flat, mix, ranges, text_chunks

#: Where the public tokenizers lie; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Text bytes encoded at once by a task.
CHUNK = 1 << 20
#: Distinct parts of texts, and pairs of pieces, that a worker remembers.
REMEMBERED, REMEMBERED_PAIRS = 60_000, 150_000
#: Bytes of a part that is remembered.
LONGEST_REMEMBERED = 64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed 32-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model file: pieces, scores and kinds."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
    UNIGRAM, MERGES = 1, 2

    def __init__(self, raw: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.byte_of: dict[int, int] = {}
        self.byte_id = [None] * 256
        self.ids: dict[str, int] = {}
        self.controls: set[int] = set()
        self.unknown, self.kind, self.prefix = 0, self.UNIGRAM, True
        for number, value in _fields(raw):
            if number == 1:
                self._piece(value)
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, self.UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep white space are supported")
        if self.kind not in (self.UNIGRAM, self.MERGES):
            raise ValueError(f"model type {self.kind}")
        self.longest = max(map(len, self.ids), default=1)
        self.low = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}

    def _piece(self, raw: bytes) -> None:
        one = dict(_fields(raw))
        text, kind = one.get(1, b"").decode(), one.get(3, self.NORMAL)
        i = len(self.text)
        self.text.append(text)
        self.score.append(float(np.frombuffer(one[2], "<f4")[0]) if 2 in one else 0.0)
        if kind == self.BYTE:
            self.byte_id[int(text[3:5], 16)] = i
            self.byte_of[i] = int(text[3:5], 16)
        elif kind == self.UNKNOWN:
            self.unknown = i
        elif kind == self.CONTROL:
            self.controls.add(i)
        else:
            self.ids[text] = i

    def merged(self, text: str) -> list[int | str]:
        """Pieces of a short text by merges: always the neighbours whose joint piece has the best score, leftmost first."""
        part = list(text)
        while True:
            best, at = None, -1
            for k in range(len(part) - 1):
                i = self.ids.get(part[k] + part[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.ids.get(p, p) for p in part]
            part[at : at + 2] = [part[at] + part[at + 1]]

    @cached_property
    def inside(self) -> set[str]:
        """Neighbours that some piece holds."""
        return {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}

    @cached_property
    def ends(self) -> dict:
        """Pieces by their symbols from the last to the first, as nested dicts; "" holds the id.  Pieces that merges take apart are left out."""
        root: dict = {}
        for text, i in self.ids.items():
            if self.kind == self.MERGES and self.merged(text) != [i]:
                continue
            node = root
            for symbol in reversed(text):
                node = node.setdefault(symbol, {})
            node[""] = i
        return root

    def pair(self, a: int, b: int) -> bool:
        """Whether two pieces in a row stay what they are when their joint text is merged."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return found

    def fallback(self, symbol: str) -> list[int]:
        """Ids of a symbol without a piece."""
        raw = symbol.encode("utf-8", "surrogatepass")
        return [self.byte_id[b] for b in raw] if all(self.byte_id[b] is not None for b in raw) else [self.unknown]


class Stream:
    """Encodes a text that comes in parts; ``feed`` and ``finish`` return the ids that are settled."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.window = ""  #: symbols since the last committed boundary
        self.last: list[int | str | None] = [None]  #: last piece (or symbol without one) up to each boundary
        self.total = [0.0]
        self.before: int | str | None = None  #: the piece that was committed last

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        for symbol in part:
            self.window += symbol
            self._extend()
            if len(self.window) >= 2 * self.pieces.longest:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        return self._take(len(self.window))

    def _extend(self) -> None:
        p, text, n = self.pieces, self.window, len(self.window)
        ending, node = [], p.ends
        for k in range(n - 1, max(-1, n - 1 - p.longest), -1):
            node = node.get(text[k])
            if node is None:
                break
            if (i := node.get("")) is not None:
                ending.append((k, i))
        found, top = text[n - 1], self.total[n - 1] + p.low
        if p.kind == p.UNIGRAM:
            for k, i in ending:
                if k == n - 1 or self.total[k] + p.score[i] > top:
                    found, top = i, self.total[k] + p.score[i]
        else:
            for k, i in reversed(ending):
                before = self.last[k] if k else self.before
                # A symbol without a piece merges with nothing.
                if before is None or isinstance(before, str) or p.pair(before, i):
                    found = i
                    break
        self.last.append(found)
        self.total.append(top)

    def _size(self, found: int | str) -> int:
        return 1 if isinstance(found, str) else len(self.pieces.text[found])

    def _commit(self) -> list[int]:
        """Commits up to the latest boundary that all open paths share.

        What comes next starts at one of the last ``longest`` boundaries; the
        paths back from them are followed, rightmost first, until one is left.
        """
        n = len(self.window)
        open_ = set(range(max(0, n - self.pieces.longest + 1), n + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(top - self._size(self.last[top]))
        (at,) = open_
        return self._take(at)

    def _take(self, at: int) -> list[int]:
        found, end = [], at
        while end:
            found.append(self.last[end])
            end -= self._size(self.last[end])
        found.reverse()
        if found:
            self.before = found[-1]
        low = self.total[at]
        self.window, self.last, self.total = self.window[at:], [None, *self.last[at + 1 :]], [t - low for t in self.total[at:]]
        return [i for x in found for i in ([x] if isinstance(x, int) else self.pieces.fallback(x))]


def encode(pieces: Pieces, text: str, part: int = 1 << 16) -> list[int]:
    """Ids of a text, fed in parts."""
    if not text:
        return []
    stream = Stream(pieces)
    symbols = (SPACE if pieces.prefix else "") + text.replace(" ", SPACE)
    return [i for lo in range(0, len(symbols), part) for i in stream.feed(symbols[lo : lo + part])] + stream.finish()


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(bytes((b,)) if (b := pieces.byte_of.get(i)) is not None else b"" if i in pieces.controls else pieces.text[i].encode() for i in ids)
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if pieces.prefix and text.startswith(" ") else text


class Decoder:
    """``decode`` for a column: the bytes of all ids are gathered at once."""

    def __init__(self, pieces: Pieces):
        each = [bytes((pieces.byte_of[i],)) if i in pieces.byte_of else b"" if i in pieces.controls else t.encode() for i, t in enumerate(pieces.text)]
        self.prefix = pieces.prefix
        self.size = np.array([len(x) for x in each], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def decode(self, column: pa.ListArray) -> pa.Array:
        ids = np.asarray(column.flatten()).astype(np.int64)
        raw = self.data[ranges(self.start[ids], self.size[ids])].tobytes()
        counts = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array([t[1:] if self.prefix and t.startswith(" ") else t for t in texts], pa.string())


class Lockstep:
    """``Stream`` for many parts at once, as long as they fit into its window: all take their next symbol together (models of merges).

    A window of less than twice the longest piece isn't committed before its
    end, so for such parts the forward pass and the way back along the pointers
    are those of ``Stream``, step by step.
    """

    NONE = -1
    SLOTS = 1 << 20  #: of the cache of pairs, each with the last pair that fell on it
    BITS = 20

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.window = 2 * pieces.longest - 1
        whole = [(t, i) for t, i in pieces.ids.items() if pieces.merged(t) == [i]]
        found = np.array([self._hash(t) for t, _ in whole], np.uint64)
        order = np.argsort(found)
        self.hashes, self.ids = found[order], np.array([i for _, i in whole], np.int64)[order]
        self.sizes = np.array([len(t) for t in pieces.text], np.int64)
        self.powers = np.full(pieces.longest + 1, GOLDEN, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.cached, self.value = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)
        self.maybe = np.zeros(1 << self.BITS, bool)  # by the first bits of a hash, whether some piece has them
        self.maybe[self.hashes >> U64(64 - self.BITS)] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(GOLDEN) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = (mix(key.view(np.uint64)) & U64(self.SLOTS - 1)).astype(np.int64)
        new = np.unique(key[self.cached[slot] != key])
        if not len(new):
            return self.value[slot]
        right = np.array([self.pieces.pair(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
        at = (mix(new.view(np.uint64)) & U64(self.SLOTS - 1)).astype(np.int64)
        spot = np.minimum(np.searchsorted(new, key), len(new) - 1)
        out = np.where(new[spot] == key, right[spot], self.value[slot])
        self.cached[at], self.value[at] = new, right
        return out

    def encode(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, how many each has, and which parts hold a symbol without a piece (their ids are not to be used)."""
        order = np.argsort(-size, kind="stable")
        starts = (np.cumsum(size) - size)[order]
        size, n, longest = size[order], len(size), int(size.max())
        codes = np.zeros((longest + 1, n), np.uint64)
        row = np.repeat(np.arange(n), size)
        codes[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1, row] = symbols[ranges(starts, size)].astype(np.uint64) + U64(1)
        for j in range(1, longest + 1):  # hashes of prefixes
            codes[j] += codes[j - 1] * GOLDEN
        last = np.full((longest + 1, n), self.NONE, np.int64)
        for j in range(1, longest + 1):
            left = np.arange(int(np.searchsorted(-size, -j, "right")))  # sorted by length: those that have a j-th symbol
            for s in range(min(j, self.pieces.longest), 0, -1):
                h = codes[j, left] - codes[j - s, left] * self.powers[s]
                likely = np.flatnonzero(self.maybe[h >> U64(64 - self.BITS)])
                h = h[likely]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                is_piece = self.hashes[at] == h
                rows, piece = left[likely[is_piece]], self.ids[at[is_piece]]
                if not len(rows):
                    continue
                if j > s:
                    before = last[j - s, rows]
                    ok = before == self.NONE
                    ok[~ok] = self.pair(before[~ok], piece[~ok])
                    rows, piece = rows[ok], piece[ok]
                last[j, rows] = piece
                left = left[last[j, left] == self.NONE]
                if not len(left):
                    break
        out, end = np.full((longest, n), self.NONE, np.int64), size.copy()
        lost = np.zeros(n, bool)
        for step in range(longest - 1, -1, -1):  # back along the pointers, last piece first
            live = np.flatnonzero(end > 0)
            if not len(live):
                break
            piece = last[end[live], live]
            lost[live[piece == self.NONE]] = True
            out[step, live] = piece
            end[live] -= np.where(piece == self.NONE, 1, self.sizes[piece])
        back = np.argsort(order)
        out = out.T[back]
        there = out != self.NONE
        return out[there], there.sum(1), lost[back]


class Encoder:
    """Encodes texts by their distinct parts, and remembers a bounded number of them.

    Between two symbols that no piece holds side by side all paths meet, so the
    parts on either side are encoded on their own.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lockstep = Lockstep(pieces) if pieces.kind == Pieces.MERGES else None
        symbols = sorted({c for x in pieces.inside for c in x})
        number = {c: k for k, c in enumerate(symbols, 1)}
        self.number = np.zeros(0x110000, np.int64)  # of the symbols that pieces hold; 0 for all others
        self.number[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.inside = np.zeros((len(symbols) + 1, len(symbols) + 1), bool)
        for x in pieces.inside:
            self.inside[number[x[0]], number[x[1]]] = True
        self.known = pa.array([], pa.large_binary())
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Drops what is remembered of texts: a worker keeps its encoder from task to task, also when others follow."""
        self.known = pa.array([], pa.large_binary())
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pieces.pairs.clear()

    def alone(self, part: str) -> list[int]:
        stream = Stream(self.pieces)
        return stream.feed(part) + stream.finish()

    def learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the parts has, and the ids of all."""
        offsets, data = flat(parts)
        codes = _codes(data)
        length = np.diff(np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets])
        count, alone = np.zeros(len(parts), np.int64), np.ones(len(parts), bool)
        found = np.zeros(0, np.int64)
        if self.lockstep:
            short = np.flatnonzero(length <= self.lockstep.window)
            if len(short):
                starts = (np.cumsum(length) - length)[short]
                found, count[short], lost = self.lockstep.encode(codes[ranges(starts, length[short])], length[short])
                alone[short] = lost
        if not alone.any():
            return count, found.astype(np.int32)
        at = np.cumsum(count) - count
        those = np.flatnonzero(alone).tolist()
        others = [self.alone(parts[k].as_py().decode().replace(" ", SPACE)) for k in those]
        at[alone] = len(found) + np.cumsum([0, *map(len, others)])[:-1]
        count[alone] = [len(x) for x in others]
        every = np.concatenate([found, np.fromiter(chain.from_iterable(others), np.int64)])
        return count, every[ranges(at, count)].astype(np.int32)

    def lookup(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``learn`` for distinct parts of which some are remembered."""
        spot = np.asarray(pc.fill_null(pc.index_in(parts, value_set=self.known), -1)).astype(np.int64)
        new = np.flatnonzero(spot < 0)
        if len(new):
            count, ids = self.learn(parts.take(pa.array(new)))
            spot[new] = len(self.size) + np.arange(len(new))
        else:
            count, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        count, ids = np.concatenate([self.size, count]), np.concatenate([self.ids, ids])
        start, size = (np.cumsum(count) - count)[spot], count[spot]
        found = ids[ranges(start, size)]
        full = len(count) > REMEMBERED  # then only the parts of these texts stay
        stay = np.flatnonzero((np.asarray(pc.binary_length(parts)) <= LONGEST_REMEMBERED) & (full | (spot >= len(self.size))))
        kept = parts.take(pa.array(stay)), size[stay], ids[ranges(start[stay], size[stay])]
        if full:
            self.known, self.size, self.ids = kept
        elif len(stay):
            self.known = pa.concat_arrays([self.known, kept[0]])
            self.size, self.ids = np.concatenate([self.size, kept[1]]), np.concatenate([self.ids, kept[2]])
        return size, found

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text; null is empty."""
        column = pc.replace_substring(column, SPACE, " ")
        offsets, data = flat(column)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(column) + 1), pa.int32()), pa.array([], pa.int32()))
        if self.pieces.prefix:  # a space before each text
            data = np.insert(data, offsets[some], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        number = self.number[_codes(data)]
        starts = np.ones(len(number), bool)
        starts[1:] = ~self.inside[number[:-1], number[1:]]
        begin = np.flatnonzero(data & 0xC0 != 0x80)[starts]
        begin = np.union1d(begin, offsets[some])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        size, ids = self.lookup(words.dictionary)
        which = np.asarray(words.indices).astype(np.int64)
        out = ids[ranges((np.cumsum(size) - size)[which], size[which])]
        total = np.concatenate([[0], np.cumsum(size[which])])
        return pa.ListArray.from_arrays(pa.array(total[np.searchsorted(begin, offsets)], pa.int32()), pa.array(out))


def _codes(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, spaces as U+2581."""
    found = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.where(found == 32, np.uint32(ord(SPACE)), found)


_LOADED: dict = {}


def _loaded(kind: type, raw: bytes):
    """One encoder or decoder for each worker and model."""
    key = kind.__name__, hashlib.sha256(raw).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(Pieces(raw))
    return _LOADED[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds the ids of a text column; a column of that name is replaced."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(load(model))  # the model file, of fixed size
    schema = df.select("*", F.lit(None).cast("array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(Encoder, shared.value)
        for batch in text_chunks(batches, text, CHUNK):
            yield pa.RecordBatch.from_arrays([*batch.columns, encoder.encode(batch.column(text))], names=[*batch.schema.names, out])
        encoder.forget()

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of a column of ids (null: empty); a column of that name is replaced."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(load(model))
    schema = df.select("*", F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _loaded(Decoder, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode(part.column(ids))], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)
