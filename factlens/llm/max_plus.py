"""Max-plus parallel scan over the lattice of a SentencePiece model's pieces.

A text is a path of adjacent pieces. A path's weight is the sum of its steps' weights: with a unigram model a step to a
piece weighs the piece's score; with a BPE model it weighs 0 if the piece may follow the one before it (encoding the two
together gives the two) and minus infinity if not, which leaves one path, the one that the merges give.

A text is split into chunks. A boundary's states are the pieces that end at it or lie across it, as offsets from it. A
chunk yields its transfer matrix in the max-plus semiring, from the states of its left boundary to those of its right
one. The matrices' product is associative, so any grouping of neighbours gives the best state at each boundary, and then
each chunk is traced back by itself between its two known states. Pieces never go on over the start of a word (checked
when the model is loaded), so what lies between two word starts has the same best path everywhere: it is kept by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain
from typing import NamedTuple

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NONE = float("-inf")
State = tuple[int, int]  # offsets of a piece's start and end from the boundary
START: State = (0, 0)
#: Characters of a chunk; texts of over two chunks are split.
CHUNK = 4096
#: Units of up to so many characters are remembered.
SHORT = 64
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _splitter(pieces: Iterable[str]) -> re.Pattern:
    """What cuts a text to units: before spaces and, where no piece lies across, between letters and what isn't any."""
    more = re.escape("".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
    letters, others = rf"[^\W\d_{more}]", rf"(?:[^\w{SPACE}]|[\d_{more}])"
    fine = re.compile(f"{SPACE}*(?:{letters}*|{others}*)")
    return re.compile(f"{SPACE}*{letters}+|{SPACE}*{others}+|{SPACE}+") if all(map(fine.fullmatch, pieces)) else _UNITS


class Model(NamedTuple):
    """What a SentencePiece model file says: pieces as (text, score, type), and how texts are prepared."""

    kind: int
    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool
    byte_fallback: bool

    @classmethod
    def read(cls, data: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are (identity, all white space kept) are supported")
        if trained.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(trained.model_type, [(p.piece, p.score, p.type) for p in proto.pieces], norm.add_dummy_prefix, trained.byte_fallback)


class Lattice:
    """Encodes and decodes with one model. `kept` bounds how many word-like units' results are remembered."""

    def __init__(self, model: Model, kept: int = 300_000):
        self.model, self.kept = model, kept
        self.score = {p: s for p, s, t in model.pieces if t in (NORMAL, USER)}
        self.ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
        self.width = max(map(len, self.score), default=1)
        self.begins = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN), 0)
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        self.cuts = not any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.split = (_splitter(self.score) if self.cuts else _UNITS).findall
        self.bpe = model.kind == BPE
        # What each id adds to a text; bytes beyond ASCII need their neighbours.
        self.high = {i for b, i in self.bytes.items() if b > 127}
        self.shown = ["" if t == CONTROL else " ⁇ " if t == UNKNOWN else chr(int(p[3:5], 16)) if t == BYTE else p.replace(SPACE, " ") for p, _, t in model.pieces]
        self._follows: dict[tuple[str, str], bool] = {}
        self._units: dict[str, tuple[float, tuple[int, ...]]] = {}
        # Units' ids, and those of the time before: frequent units outlast the rare ones that are dropped.
        self._unit_ids: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    # -- texts and ids ---------------------------------------------------------------------------------------------

    def prepared(self, text: str) -> str:
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def _ids_of(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        if known is not None:
            return (known,)
        if self.model.byte_fallback and self.bytes:
            return tuple(self.bytes[b] for b in piece.encode())
        return (self.unknown,)

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out: list[str] = []
            raw = bytearray()
            for i in ids:
                if i in self.high:
                    raw.append(int(self.model.pieces[i][0][3:5], 16))
                    continue
                if raw:
                    out.append(raw.decode(errors="replace"))
                    raw.clear()
                out.append(self.shown[i])
            text = "".join(out) + raw.decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    # -- steps -----------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that BPE merges leave of a short text: best score first, then leftmost."""
        parts, get, none = list(text), self.score.get, NONE
        value = [get(text[i : i + 2], none) for i in range(len(text) - 1)]
        while value:
            best = max(value)
            if best == none:
                break
            i = value.index(best)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del value[i]
            if i < len(value):
                value[i] = get(joined + parts[i + 1], none)
            if i:
                value[i - 1] = get(parts[i - 1] + joined, none)
        return parts

    def _weight(self, before: str | None, piece: str) -> float:
        """The weight of the step from the piece before (None: a word starts here, or the text) to piece."""
        if not self.bpe:
            return self.score.get(piece, self.unknown_score)
        key = ("" if before is None else before, piece)
        ok = self._follows.get(key)
        if ok is None:
            if len(self._follows) > 4 * self.kept:
                self._follows.clear()
            ok = self._follows[key] = self.merged(key[0] + piece) == [x for x in key if x]
        return 0.0 if ok else NONE

    def _pieces_at(self, s: str, at: int) -> list[int]:
        """The ends of the pieces that start at `at`; a single character is always one."""
        ends, begins, score = [at + 1], self.begins, self.score
        for end in range(at + 1, min(len(s), at + self.width) + 1):
            piece = s[at:end]
            if piece not in begins:
                break
            if piece in score and end > at + 1:
                ends.append(end)
        return ends

    def _cut(self, s: str, at: int) -> bool:
        return self.cuts and 0 < at < len(s) and s[at] == SPACE != s[at - 1]

    # -- paths -----------------------------------------------------------------------------------------------------

    def _paths(self, s: str, at: int, before: str | None, upto: int) -> dict[int, dict[int, tuple[float, int]]]:
        """Best paths on from position `at` after the piece `before`: for each position reached from a start below `upto`,
        by the last piece's start its weight and the start of the piece before that (-1: none)."""
        found: dict[int, dict[int, tuple[float, int]]] = {at: {-1: (0.0, -1)}}
        for i in range(at, upto):
            here = found.get(i)
            if not here:
                continue
            fresh = self._cut(s, i)
            for end in self._pieces_at(s, i):
                piece, best, best_from = s[i:end], NONE, -1
                for start, (weight, _) in here.items():
                    last = None if fresh else s[start:i] if start >= 0 else before
                    total = weight + self._weight(last, piece)
                    if total > best:
                        best, best_from = total, start
                if best > NONE:
                    there = found.setdefault(end, {})
                    if self.bpe:
                        there[i] = (best, best_from)
                    elif not there or best > next(iter(there.values()))[0]:
                        found[end] = {i: (best, best_from)}
        return found

    def _trace(self, s: str, found: dict, at: int, end: int, start: int) -> list[int]:
        """The ids of the path from `at` whose last piece lies from start to end."""
        pieces = []
        while end > at:
            pieces.append(s[start:end])
            end, start = start, found[end][start][1]
        return [i for piece in reversed(pieces) for i in self._ids_of(piece)]

    def unit(self, s: str) -> tuple[float, tuple[int, ...]]:
        """Weight and ids of the best path over a whole unit, which starts and ends where words or texts do."""
        known = self._units.get(s)
        if known is None:
            if self.bpe and self.cuts and len(s) <= SHORT:
                # The one path that weighs 0 is what the merges leave: quicker found by them than searched for.
                pieces = self.merged(s)
                try:
                    known = 0.0, tuple(map(self.ids.__getitem__, pieces))
                except KeyError:
                    known = 0.0, tuple(i for piece in pieces for i in self._ids_of(piece))
            else:
                found = self._paths(s, 0, None, len(s))
                start = max(found[len(s)], key=lambda k: found[len(s)][k][0])
                known = found[len(s)][start][0], tuple(self._trace(s, found, 0, len(s), start))
            if not self.bpe and len(s) <= SHORT:  # a chunk's weights are needed before its ids
                if len(self._units) >= self.kept:
                    self._units.clear()
                self._units[s] = known
        return known

    def units(self, s: str) -> list[int]:
        """The ids of a stretch from one word start to another, or to the text's end."""
        if 2 * len(self._unit_ids) > self.kept:
            self._older, self._unit_ids = self._unit_ids, {}
        own, known, older = self.split(s), self._unit_ids, self._older
        fresh = set(own).difference(known)
        for u in fresh:
            known[u] = older.get(u) or self.unit(u)[1]
        out = list(chain.from_iterable(map(known.__getitem__, own)))
        for u in fresh:
            if len(u) > SHORT:
                del known[u]
        return out

    # -- chunks ----------------------------------------------------------------------------------------------------

    def states(self, s: str, b: int) -> list[State]:
        """The states of the boundary at position b of s."""
        if b == 0 or self._cut(s, b):
            return [START]
        return [(p - b, q - b) for p in range(max(0, b - self.width), b) for q in self._pieces_at(s, p) if q >= b]

    def _inner(self, s: str, b0: int, b1: int) -> tuple[int, int]:
        """The first and last word start after b0 and up to b1 (-1: none)."""
        first = next((i for i in range(b0 + 1, b1 + 1) if self._cut(s, i)), -1)
        last = next((i for i in range(b1, b0, -1) if self._cut(s, i)), -1)
        return first, last

    def _exits(self, s: str, found: dict, b1: int, end: bool) -> dict[State, tuple[float, int, int]]:
        """The states of boundary b1 that the paths reach: weight, last piece's end and start."""
        out: dict[State, tuple[float, int, int]] = {}
        for q in range(b1, min(len(s), b1 + self.width) + 1):
            for p, (weight, _) in found.get(q, {}).items():
                if p < 0 or p >= b1:
                    continue
                state = START if end or self._cut(s, b1) else (p - b1, q - b1)
                if (not end or q == b1) and (state not in out or weight > out[state][0]):
                    out[state] = (weight, q, p)
        return out

    def transfer(self, s: str, b0: int, b1: int, end: bool) -> dict[State, dict[State, float]]:
        """The transfer matrix of the chunk from b0 to b1 of s, which holds some context on either side. Only entries
        above minus infinity are held."""
        first, last = self._inner(s, b0, b1)
        out: dict[State, dict[State, float]] = {}
        if last > b0:
            middle = sum(self.unit(u)[0] for u in self.split(s[first:last])) if not self.bpe else 0.0
            tail = {START: 0.0} if last == b1 else {x: w for x, (w, _, _) in self._exits(s, self._paths(s, last, None, b1), b1, end).items()}
        for entry in self.states(s, b0):
            q, before = b0 + entry[1], s[b0 + entry[0] : b0 + entry[1]] or None
            if last > b0:
                if q > first:
                    continue
                ends = self._paths(s, q, before, first).get(first, {})
                if ends:
                    head = max(w for w, _ in ends.values())
                    out[entry] = {x: head + middle + w for x, w in tail.items()}
            elif q >= b1:  # the piece lies across the whole chunk
                out[entry] = {START if end else (b0 + entry[0] - b1, q - b1): 0.0}
            else:
                out[entry] = {x: w for x, (w, _, _) in self._exits(s, self._paths(s, q, before, b1), b1, end).items()}
        return {e: row for e, row in out.items() if row}

    def trace(self, s: str, b0: int, b1: int, end: bool, entry: State, exit_: State) -> list[int]:
        """The ids of the pieces that start after the entry piece ends and before b1, on the best path between two
        states: the chunk's own part of the text's ids."""
        q, before = b0 + entry[1], s[b0 + entry[0] : b0 + entry[1]] or None
        first, last = self._inner(s, b0, b1)
        if q >= b1:
            return []
        if last <= b0:
            found = self._paths(s, q, before, b1)
            _, to, start = self._exits(s, found, b1, end)[exit_]
            return self._trace(s, found, q, to, start)
        out: list[int] = []
        if first > q:
            found = self._paths(s, q, before, first)
            start = max(found[first], key=lambda k: found[first][k][0])
            out += self._trace(s, found, q, first, start)
        out += self.units(s[first:last])
        if last < b1:
            found = self._paths(s, last, None, b1)
            _, to, start = self._exits(s, found, b1, end)[exit_]
            out += self._trace(s, found, last, to, start)
        return out

    def encode(self, text: str, chunk: int = CHUNK) -> list[int]:
        """The ids of a text: its chunks' matrices, their scan, and each chunk's trace."""
        s = self.prepared(text)
        if self.cuts and len(s) <= 2 * chunk:  # one chunk: its states are known
            return self.units(s)
        bounds = [*range(0, len(s), chunk), len(s)] if s else [0]
        spans = list(zip(bounds, bounds[1:], strict=False))
        path = scan([self.transfer(s, a, b, b == len(s)) for a, b in spans])
        return [i for (a, b), x, y in zip(spans, path, path[1:], strict=False) for i in self.trace(s, a, b, b == len(s), x, y)]


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices."""
    out: dict = {}
    for i, row in a.items():
        new: dict = {}
        for k, w in row.items():
            for j, v in b.get(k, {}).items():
                if w + v > new.get(j, NONE):
                    new[j] = w + v
        if new:
            out[i] = new
    return out


def scan(matrices: list[dict]) -> list[State]:
    """The best path's state at each boundary, from START to START. Pairs of neighbours are combined until one matrix is
    left; then the states are settled from that whole span down to the single chunks."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        top = levels[-1]
        levels.append([product(*top[i : i + 2]) if i + 1 < len(top) else top[i] for i in range(0, len(top), 2)])
    path = [START, START]
    for below in reversed(levels[:-1]):
        finer = []
        for i in range(0, len(below), 2):
            a, z = path[i // 2], path[i // 2 + 1]
            finer.append(a)
            if i + 1 < len(below):
                finer.append(max((k for k, v in below[i][a].items() if z in below[i + 1].get(k, {})), key=lambda k: below[i][a][k] + below[i + 1][k][z]))
        path = [*finer, path[-1]]
    return path if matrices else [START]
