"""Operator 3: SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once into three machines. The normaliser is a transducer of three
states (nothing written yet, in a text, space pending), whose arcs squeeze spaces, write the dummy
prefix and the white-space marks. The piece machine has one arc per piece, and a byte-fallback arc
leads over every other character. Composing them with an input gives a lattice of positions; the best
path in the tropical semiring (min, +) is the encoding, found by one search for both kinds of model, which
differ in the order of its agenda.

* Unigram models weigh an arc with the piece's negative log probability; a state is a position.
* BPE models weigh an arc 0 or infinity: 0 if it is compatible with the piece before it, whose pair must
  be what merging their joined text gives. A segmentation is what the merges give for the whole
  text exactly if all its neighbours are compatible, because the first merge across a border
  would also be the first for that pair alone. So every position has one last piece that is reached at
  finite weight, the state is (position, that piece), and the path of weight 0 is the merge result. No path
  weighs less than 0, so the search goes on from the end of the longest arc of weight 0 and comes back to
  the other arcs of a position, not weighed until then, only if no path leads on from there.

No piece has a white-space mark behind another character (checked when compiling; else a text
is one chunk), so the machines are composed with one chunk of spaces and word at a time: the first
from the normaliser's first state, all others from its second, in which every word ends. The paths of
recent short chunks are kept up to ``CACHE`` entries.

Defined cases: a null text has no tokens and decodes to null, an empty one to empty; malformed
UTF-8 is read as U+FFFD; a literal mark character decodes as a space; repeated rows are encoded
each; an empty table gives an empty result. Models with a normalisation map are refused, since
no public vocabulary at hand has one to check against.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 300_000
SHORT = 48
ROWS = 256
# fixed values of the model format: piece kinds and model types
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")
OTHER = ((-1, 1),)  # the arcs over a character that is no piece


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[i:i + n]
        i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @staticmethod
    def parse(data: bytes) -> Model:
        m = Model([])
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                m.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a normalisation map are not supported")
                m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return m


def _neighbours(own: Iterable[str]) -> list[set[str]]:
    """The characters that stand beside another one in a piece, in groups, the largest first: no piece
    has neighbours of two groups, so a border of two groups is in every path."""
    group: dict[str, set[str]] = {}
    for p in own:
        p = p.lstrip(MARK)
        for a, b in zip(p, p[1:]):
            one, two = sorted((group.setdefault(a, {a}), group.setdefault(b, {b})), key=len)
            if one is not two:
                two |= one
                group.update(dict.fromkeys(one, two))
    return sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), min(g)))


class _Paths(dict):
    """Token bytes of recent chunks. When full, the entries become the old generation, from which
    those still in use are taken back."""

    def __init__(self, solve) -> None:
        self.solve, self.old = solve, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk) or array("i", self.solve(chunk)).tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


# states of the normaliser
START, TEXT, GAP = 0, 1, 2
RUNS = re.compile(" +|[^ ]+")


class Normaliser:
    """(state, whether the character is a space) -> (what is written before it, whether it is written
    itself, the next state)."""

    def __init__(self, m: Model) -> None:
        self.mark = mark = MARK if m.escape else " "
        first = mark if m.dummy_prefix else ""
        self.arcs = {(START, False): (first, True, TEXT), (TEXT, False): ("", True, TEXT), (GAP, False): (mark, True, TEXT)}
        if m.squeeze:
            self.arcs |= {(START, True): ("", False, START), (TEXT, True): ("", False, GAP), (GAP, True): ("", False, GAP)}
        else:
            self.arcs |= {(START, True): (first + mark, False, TEXT), (TEXT, True): (mark, False, TEXT)}

    def compose(self, chunk: str, state: int) -> str:
        """What is written while reading a chunk from a state. In a run of other characters only
        the first arc can leave the text state's loop, so the rest of the run is written as it is."""
        arcs, out = self.arcs, []
        for run in RUNS.findall(chunk):
            if run[0] == " ":
                for _ in run:
                    before, _, state = arcs[state, True]
                    out.append(before)
            else:
                before, _, state = arcs[state, False]
                out += before, run
        return "".join(out)


@dataclass
class Transducer:
    model: Model
    arcs: dict[str, int] = field(default_factory=dict)  # a piece's id, or -1 for a mere prefix of pieces

    def __post_init__(self) -> None:
        m = self.model
        self.unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(m.pieces) if k == BYTE}
        own = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        for p in own:
            for n in range(1, len(p)):
                self.arcs.setdefault(p[:n], -1)
        self.arcs.update(own)
        self.states = self._states()
        self.longest = max(map(len, own), default=1)
        self.normaliser = Normaliser(m)
        self.cost = [-s for _, s, _ in m.pieces]
        self.merged = {p: self.cost[i] for p, i in own.items()}
        # the last one is that of the byte-fallback arc (-1)
        self.cost.append(max((c for c, p in zip(self.cost, m.pieces) if p[2] == NORMAL), default=0.0) + 10)
        self.user = sorted((p for p, _, k in m.pieces if k == USER), key=len, reverse=True)
        joint = {c for p in own if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joint)
        self.whole = bool(self.user) or not m.escape or any(MARK in p.lstrip(MARK) for p in own)
        groups = ["".join(map(re.escape, sorted(g))) for g in _neighbours(own) if not g.isdisjoint(map(chr, range(128)))][1:]
        apart = "".join(rf"|[{g}]+" for g in groups) + (rf"|[{alone}]" if alone else "")
        rest = alone + "".join(groups)
        # spaces go with what follows them; only the end of a text is spaces alone
        self.chunks = re.compile(r"(?s:.+)" if self.whole else rf"[ {MARK}]*(?:[^ {MARK}{rest}]+{apart})|[ {MARK}]+")
        inside = any(MARK in p.lstrip(MARK) for p in own)
        self.parts = re.compile(r"(?s:.+)" if inside else rf"{MARK}*(?:[^{MARK}{rest}]+{apart})|{MARK}+")
        self.users = re.compile("(" + "|".join(map(re.escape, self.user)) + ")") if self.user else None
        self.surface = [self._surface(p, k) for p, _, k in m.pieces]
        self.pairs: dict[int, float] = {}
        self.paths = _Paths(lambda chunk: self.shortest_path(self.normaliser.compose(chunk, TEXT)))
        self.opening = _Paths(lambda chunk: self.shortest_path(self.normaliser.compose(chunk, START)))
        self.written = _Paths(self.shortest_path)

    def _states(self) -> dict:
        """The piece transducer as nested states: character -> (the arcs that end on the way up to it,
        longest first, as (piece, characters), the state after it)."""
        states: dict[str, tuple] = {"": ((), {})}
        for p in sorted(self.arcs, key=len):
            found, before = states[p[:-1]]
            if self.arcs[p] >= 0:
                found = ((self.arcs[p], len(p)), *found)
            elif len(p) == 1:
                found = OTHER
            before[p[-1]] = states[p] = found, {}
        return states[""][1]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def pair_weight(self, a: int, b: int) -> float:
        """0 if merging the joined text of two pieces gives these two pieces, else infinity. Nothing
        merges with a character that is no piece (-1)."""
        if len(self.pairs) >= 4 * CACHE:
            self.pairs.clear()
        stays = a < 0 or b < 0 or self._stays(self.model.pieces[a][0], self.model.pieces[b][0])
        weight = self.pairs[a << 24 | b] = 0.0 if stays else INFINITE
        return weight

    def _stays(self, left: str, right: str) -> bool:
        """Merges best pair first (ties: leftmost) until a merge crosses the border."""
        merged, parts, border = self.merged.get, list(left + right), len(left) - 1
        gain = [merged(x + y, INFINITE) for x, y in zip(parts, parts[1:])]
        while True:
            best = min(gain)
            if best == INFINITE:
                return border == 0 and len(parts) == 2
            at = gain.index(best)
            if at == border:
                return False
            border -= at < border
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = merged(parts[at - 1] + parts[at], INFINITE)
            if at < len(gain):
                gain[at] = merged(parts[at] + parts[at + 1], INFINITE)

    def shortest_path(self, written: str) -> list[int]:
        """Tropical shortest path over the positions of a written chunk: (min, +) relaxation of the arcs
        that leave a position. The agenda holds positions and their arcs not weighed so far (None: not
        looked up): all positions in order, or, where an arc weighs 0 or infinity, those passed on the
        way, the last one on top."""
        states, cost, pairs, longest, n = self.states, self.cost, self.pairs.get, self.longest, len(written)
        bpe = self.model.kind == BPE
        weight, last, came = [INFINITE] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        agenda = [] if bpe else [(i, None) for i in range(n - 1, 0, -1)]
        i, found = 0, None
        while i < n:
            if found is None:
                found, after = OTHER, states
                for c in written[i:i + longest]:
                    arc = after.get(c)
                    if arc is None:
                        break
                    found, after = arc
                found = iter(found)
            here, before = weight[i], last[i] << 24
            for piece, size in found:
                w = pairs(before | piece) if bpe else cost[piece]
                if w is None:
                    w = self.pair_weight(last[i], piece)
                stop = i + size
                if here + w < weight[stop]:
                    weight[stop], last[stop], came[stop] = here + w, piece, i
                    if bpe:  # nothing weighs less: on from there
                        agenda.append((i, found))
                        i, found = stop, None
                        break
            else:
                i, found = agenda.pop() if agenda else (n, None)
        out, at = [], n
        while at > 0:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
            else:  # the byte-fallback arc
                out += reversed(self._fallback(written[at - 1]))
            at = came[at]
        out.reverse()
        return out

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.model.byte_fallback else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        if self.whole:
            text = self.normaliser.compose(text, START)
            blobs = []
            for k, p in enumerate(self.users.split(text) if self.users else [text]):
                if k % 2:
                    blobs.append(array("i", [self.arcs[p]]).tobytes())
                else:
                    blobs += map(self.written.__getitem__, self.parts.findall(p))
        else:
            found = self.chunks.findall(text)
            blobs = [self.opening[found[0]], *map(self.paths.__getitem__, found[1:])] if found else []
        ids = np.frombuffer(b"".join(blobs), np.int32)
        if not self.model.byte_fallback:  # a run of unknown characters is one token
            ids = ids[(ids != self.unknown) | (np.diff(ids, prepend=-1) != 0)]
        return ids

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        if self.model.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def load(model: str | bytes = MODEL) -> Transducer:
    """The transducer of a model file, given by its path or its content."""
    return Transducer(Model.parse(_content(model)))


def _content(model: str | bytes) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


def tokenize(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """One row per document: token_ids, n_tokens, n_byte_tokens and decoded, the text decoded
    from the tokens. The model file is read on the driver and broadcast as it is; each Python
    worker compiles it once and keeps it with the broadcast value."""
    shared = docs.sparkSession.sparkContext.broadcast({"model": _content(model)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "compiled" not in own:
            own["compiled"] = load(own["model"])
        t = own["compiled"]
        is_byte = np.zeros(len(t.model.pieces), bool)
        is_byte[list(t.bytes.values())] = True
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [None if x is None else x.decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                ids = [np.zeros(0, np.int32) if x is None else t.encode(x) for x in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(is_byte[flat])])
                decoded = [None if x is None else t.decode(i.tolist()) for x, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes),
                     pa.array(at[offsets[1:]] - at[offsets[:-1]]), pa.array(decoded, pa.string())],
                    ["doc_id", "token_ids", "n_tokens", "n_byte_tokens", "decoded"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, token_ids array<int>, n_tokens long, n_byte_tokens long, decoded string")


def report(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """Tokens of every document and the digest of the text they decode to."""
    return tokenize(docs, model).select("doc_id", "n_tokens", "n_byte_tokens", "token_ids",
                                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
