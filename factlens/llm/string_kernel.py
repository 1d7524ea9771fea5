"""A subsequence string kernel with Nyström landmarks, and a linear support vector machine on its features.

The kernel counts common subsequences of LENGTH characters of two words, each occurrence weighted by DECAY to the power
of the span it takes in either word, so inserted characters and gaps lower a likeness but don't end it. It is normalised
to 1 for equal words and raised to POWER, which parts near likeness from chance (a power of a kernel is one too). Landmarks
are single words. A text's kernel value with a landmark is that of its word that is most like it, so sentences of a text
count as one and long texts aren't taken for toxic ones. The Nyström map takes these values times the inverse root of the
landmarks' own kernel matrix; the support vector machine is linear in it.

Kernel values with landmarks come from the landmarks' subsequences: a table tells for each of them how much it weighs in
each landmark, and a word's values are the sums over its own subsequences. That is the whole kernel, nothing is cut off.
"""

from __future__ import annotations

import re
from itertools import combinations
from typing import NamedTuple

import numpy as np

LENGTH, DECAY, POWER = 3, 0.8, 5
#: Words of over WIDTH characters are read as overlapping windows of that width.
WIDTH = 20
LANDMARKS = 96
_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case without marks at their ends, those of LENGTH characters or more; runs of three or
    more single characters count as one word."""
    found = _WORD.findall(text.lower())
    out = [w for w in found if len(w) >= LENGTH]
    single = [i for i, w in enumerate(found) if len(w) == 1]
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start > 2:
                out.append("".join(found[i] for i in single[start:k]))
            start = k
    if any(len(w) > WIDTH for w in out):
        out = [p for w in out for p in ([w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2)])]
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, 0 beyond their ends, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, sizes.max(initial=0))), np.uint32)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if n:
            out[rows, :n] = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
    return out, sizes


def kernel(a: np.ndarray, b: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Kernel values of the words a (rows of code points) with the words b: a matrix, or with `pairs` row by row."""
    shape = (len(a),) if pairs else (len(a), len(b))
    decay = np.float32(DECAY)
    wide, high = a.shape[1], b.shape[1]
    # same[i][j]: where character i of a equals character j of b (the ends' 0 never does).
    same = [[(((a[:, i] == b[:, j]) & (a[:, i] > 0)) if pairs else ((a[:, i, None] == b[None, :, j]) & (a[:, i, None] > 0))).astype(np.float32) for j in range(high)] for i in range(wide)]
    before = [[np.ones(shape, np.float32)] * (high + 1) for _ in range(wide + 1)]
    total = np.zeros(shape, np.float32)
    for p in range(LENGTH):
        last = p == LENGTH - 1
        now = [[np.zeros(shape, np.float32)] * (high + 1)]
        for i in range(wide):
            row, run = [np.zeros(shape, np.float32)], np.zeros(shape, np.float32)
            for j in range(high):
                hit = same[i][j] * before[i][j]
                if last:
                    total += hit
                    continue
                run = decay * run + decay * decay * hit
                row.append(decay * now[i][j + 1] + run)
            if not last:
                now.append(row)
        before = now
    return total * decay * decay


class Scorer(NamedTuple):
    """Landmarks and the linear machine on kernel values with them: score = 1 / (1 + exp(-slope * (margin - middle)))."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    middle: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Scores of texts by their kernel values (before POWER) with the landmarks."""
        margin = (values.astype(np.float64) ** POWER) @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(self.slope * (self.middle - margin), -30, 30)))


class Subsequences:
    """The landmarks' subsequences of LENGTH characters and what they weigh in each landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.letters = {c: i for i, c in enumerate(sorted({c for m in landmarks for c in m}), 1)}
        self.base = len(self.letters) + 1
        # By code point; the last place stands for all beyond.
        self.letter = np.zeros(max(map(ord, self.letters)) + 2, np.int32)
        self.letter[list(map(ord, self.letters))] = list(self.letters.values())
        weight: dict[int, np.ndarray] = {}
        for k, mark in enumerate(landmarks):
            for at in combinations(range(len(mark)), LENGTH):
                key = self._key([self.letters[mark[i]] for i in at])
                weight.setdefault(key, np.zeros(len(landmarks), np.float32))[k] += DECAY ** (at[-1] - at[0] + 1)
        # Row 0 stands for subsequences that no landmark has.
        self.row = np.zeros(self.base**LENGTH, np.int32)
        self.row[list(weight)] = np.arange(1, len(weight) + 1)
        self.weight = np.stack([np.zeros(len(landmarks), np.float32), *weight.values()])
        codes, _ = _codes(landmarks)
        self.norm = np.sqrt(np.maximum(kernel(codes, codes, pairs=True), 1e-12))

    def _key(self, letters):
        out = 0
        for x in letters:
            out = out * self.base + x
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values of words with the landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes >= LENGTH]):
            at = np.array(list(combinations(range(n), LENGTH)))
            span = (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
            same = np.flatnonzero(sizes == n)
            step = max(1, 60_000 // len(at))
            for low in range(0, len(same), step):
                some = same[low : low + step]
                own = [words[i] for i in some]
                codes, _ = _codes(own)
                letters = self.letter[np.minimum(codes, len(self.letter) - 1)]
                # A character that no landmark has is a 0, and no key holds one.
                row = self.row[self._key([letters[:, at[:, k]] for k in range(LENGTH)])]
                word, sub = np.nonzero(row)
                if len(word):
                    value = self.weight[row[word, sub]] * span[sub][:, None]
                    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    norm = np.sqrt(kernel(codes, codes, pairs=True))
                    out[some[word[starts]]] = np.add.reduceat(value, starts, axis=0) / norm[word[starts]][:, None] / self.norm
        return out


class Reader:
    """Reads texts' kernel values; remembers those of up to `kept` words."""

    def __init__(self, landmarks: list[str], kept: int = 200_000):
        self.subsequences, self.kept = Subsequences(landmarks), kept
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.known = np.zeros((1 << 12, len(self.subsequences.landmarks)), np.float32)

    def values(self, texts: list[str]) -> np.ndarray:
        """Per text its kernel values with the landmarks (zeros where it has no words)."""
        words = [words_of(t) for t in texts]
        if len(self.row) > self.kept:
            self._clear()
        row = self.row
        fresh = list({w for x in words for w in x if w not in row})
        if fresh:
            need = len(row) + len(fresh)
            if need > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(need, 2 * len(self.known)) - len(self.known), self.known.shape[1]), np.float32)])
            self.known[len(row) : need] = self.subsequences.values(fresh)
            row.update(zip(fresh, range(len(row), need), strict=True))
        out = np.zeros((len(texts), self.known.shape[1]), np.float32)
        for i, x in enumerate(words):
            if x:
                out[i] = self.known[np.fromiter(map(row.__getitem__, set(x)), np.int64)].max(axis=0)
        return out


def openings(text: str) -> set[str]:
    """What may become a landmark: a text's words, and the beginnings of its words."""
    words = set(words_of(text))
    return words | {w[:n] for w in words for n in range(4, min(9, len(w)))}


def choose_landmarks(ranked: list[tuple[str, int]], most: int = LANDMARKS) -> list[str]:
    """Landmarks from candidates (word, number of texts with the label that hold it), the most telling first."""
    out: dict[str, int] = {}
    for w, n in ranked:
        # An opening adds nothing to a longer word that the same texts hold.
        if not any((w.startswith(x) or x.startswith(w)) and abs(k - n) <= 0.1 * k for x, k in out.items()):
            out[w] = n
        if len(out) >= most:
            break
    return sorted(out) or ["none"]


def marred(text: str, marks: list[str], at: int) -> str:
    """text with a mark put into each of its words that begin like a landmark of five letters or more; empty if it has none."""
    begin = tuple(m[:5] for m in marks if len(m) > 4)
    words = words_of(text)
    if not begin or not any(w.startswith(begin) for w in words):
        return ""
    return " ".join(w[: 1 + at % 4] + "-.*_"[at % 4] + w[1 + at % 4 :] if w.startswith(begin) else w for w in words)


def _machine(z: np.ndarray, y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine: squared hinge loss by Nesterov's accelerated gradient."""
    side = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, ((y == 0).sum() / max(1, (y == 1).sum())) ** 0.25, 1.0)
    w, b, vw, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    step = 1 / (1 + 2 * cost * (weight @ (np.square(z).sum(1) + 1)) / len(y))
    for r in range(rounds):
        pull = r / (r + 3)
        tw, tb = w + pull * vw, b + pull * vb
        slack = np.maximum(0, 1 - side * (z @ tw + tb)) * side * weight / len(y)
        nw, nb = tw - step * (tw - 2 * cost * z.T @ slack), tb + step * 2 * cost * slack.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of Platt's sigmoid, by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, -np.log((n0 + 1) / (n1 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-a * margin - c, -30, 30)))
        d, h = goal - p, p * (1 - p) + 1e-9
        grad = np.array([(margin * d).sum(), d.sum()])
        hess = np.array([[(margin * margin * h).sum() + 1e-3, (margin * h).sum()], [(margin * h).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        a, c = a + np.clip(move[0], -1, 1), c + np.clip(move[1], -1, 1)
    return max(0.1, float(a))


def fit(marks: list[str], values: np.ndarray, labels: np.ndarray, extra: np.ndarray, cost: float = 5000.0, rounds: int = 2000, folds: int = 5) -> Scorer:
    """A scorer trained on texts' kernel values with the landmarks and their labels; extra: values of marred texts with the
    label. With a single class it gives each text that class's share.

    Scores aren't probabilities: a half lies where F0.5 is best (clean texts count for more than missed ones). That place and
    the slope come from margins of machines that haven't seen the text.
    """
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        return Scorer(marks, np.zeros(len(marks)), float(np.log(share / (1 - share))), 1.0, 0.0)
    own = Subsequences(marks).values(marks).astype(np.float64) ** POWER
    size, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(size, 1e-3)) @ vectors.T
    z = np.concatenate([values, extra]).astype(np.float64) ** POWER @ root
    y = np.concatenate([y, np.ones(len(extra), np.int64)])
    margin, turn = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        rows = np.flatnonzero(turn != k)
        if len(rows) and y[rows].min() != y[rows].max():
            w, b = _machine(z[rows], y[rows], cost, rounds)
            margin[turn == k] = z[turn == k] @ w + b
    order = np.argsort(-margin, kind="stable")
    hits, ranked = np.cumsum(y[order]), margin[order]
    at = int(np.argmax(1.25 * hits / (np.arange(1, len(order) + 1) + 0.25 * hits[-1])))
    w, b = _machine(z, y, cost, rounds)
    return Scorer(marks, root @ w, float(b), _slope(margin, y), float((ranked[at] + ranked[min(at + 1, len(order) - 1)]) / 2))
