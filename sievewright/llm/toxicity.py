"""Toxicity: a support vector machine on a gapped string-subsequence kernel, with Nyström landmarks.

A unit is a folded token (lower case, accents and common letter look-alikes undone, anything but
letters dropped, so ``i.d-i0t`` is ``idiot``) or a run of spaced single letters. Units are compared
with landmark units by the kernel of common subsequences of three characters, in which every gap
and every inserted character costs a factor. Values below a floor count as none, and a unit that
lacks a quarter of a landmark's letters is not compared with it; the tests measure what the second
rule loses. A sentence's kernel row is the largest value of any of its units by landmark; the Nyström
map makes it a feature vector and a linear machine scores it. A logistic curve turns the margin of a
text's worst sentence, and how much of the text speaks against it, into a probability.

Labels belong to whole texts, so the machine learns as in multiple-instance learning: sentences of
clean texts are clean; of a toxic text the sentence that scores worst is toxic, and so are those that
the last fit puts on the toxic side. Landmarks that no clean text has also teach with a letter put in.
Landmarks, kernel rows and the machine come from a bounded, hash-chosen sample of labelled rows, of
texts of a bounded length; probabilities follow the base rate of all labelled rows.

Scoring is one pass over whole texts, on arrays of code points: a long text is read in pieces that end
where a sentence ends (or, in a sentence longer than a piece, at white space), and what the pieces
hold adds up. Letters of all scripts keep apart.

Defined results: a text that is null or empty scores as a text without any suspicious unit; long
tokens are cut into overlapping windows that cover them; with no toxic or no clean row to learn
from every text scores the base rate (0 if there is none); repeated rows score alike; extra columns
are carried through, result columns replace input columns of their name.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, span_hashes
from .langid import bounded_sample, fold

#: Look-alikes of letters.
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

LENGTH = 3
DECAY = 0.75
WINDOW = 24
PIECE = 400_000  # code points looked at together
SHORT = 200  # a text of fewer code points is one sentence
MARK = ord("^")
_SPACE, _DROPPED = 0, 1
_SENTENCE_END = np.array([ord(c) for c in ".!?"], np.uint32)
_TRAILING = np.array([ord(c) for c in "!.,;:?"], np.uint32)


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of the landmarks. Everything else sees all rows."""

    toxic_rows: int = 2000
    clean_rows: int = 2500
    sample_chars: int = 100_000
    landmarks: int = 96
    floor: float = 0.35
    shared_letters: float = 0.75
    penalty: float = 1e-3
    #: Shares in the loss of toxic sentences, clean ones with and without suspicious units, altered landmarks.
    shares: tuple[float, float, float, float] = (1.0, 3.0, 0.3, 0.2)
    alike: float = 0.8
    strong: float = 0.03
    rounds: int = 4
    sample_tasks: int = 24


def fold_letter(c: str) -> int:
    """The letter's code point after folding; 0 for white space, 1 for what is dropped."""
    if c.isspace():
        return _SPACE
    letters = (x for x in unicodedata.normalize("NFKD", c.lower().translate(LOOK_ALIKES)) if x.isalpha())
    return ord(next(letters, chr(_DROPPED)))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first plane: the folded letters, and what kind of word character each is (0 none, 1 letter, 2 other)."""
    every = [chr(k) for k in range(1 << 16)]
    kinds = [1 if c.isalpha() else 2 if c.isalnum() or c == "_" else 0 for c in every]
    return np.fromiter(map(fold_letter, every), np.uint32, 1 << 16), np.array(kinds, np.uint8)


def folded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters and the kinds of code points."""
    letters, kinds = _tables()
    low = np.minimum(points, 0xFFFF)
    out, kind = letters[low], kinds[low]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        distinct, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([fold_letter(chr(p)) for p in distinct], np.uint32)[at]
        kind[far] = np.array([1 if chr(p).isalpha() else 2 if chr(p).isalnum() else 0 for p in distinct], np.uint8)[at]
    return out, kind


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


@dataclass(frozen=True)
class Units:
    """The units of some texts: letters end to end, where each unit stands in them, its text and its
    sentence; and how many tokens each text has."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    tokens: np.ndarray

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.letters[a:b].tobytes().decode("utf-32-le") for a, b in zip(self.starts[which], self.ends[which])]


def units_of(texts: list[str]) -> Units:
    """Of every token the letters, marked at the start, and those of words spelt out letter by letter.

    Units of fewer letters than the kernel compares are left out.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.cumsum(sizes + 1) - sizes - 1
    code, kind = folded(points)
    starts, ends = _runs(code != _SPACE)
    text = np.searchsorted(text_at, starts, "right") - 1
    tokens = np.bincount(text, minlength=len(texts))
    if not len(starts):
        nothing = np.zeros(0, np.int64)
        return Units(code[:0], nothing, nothing, nothing, nothing, tokens)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    parted = np.ones(len(starts), bool)
    parted[1:] = (lines[starts[1:]] > lines[ends[:-1]]) | np.isin(points[ends[:-1] - 1], _SENTENCE_END)
    parted &= (sizes[text] >= SHORT) | np.concatenate(([True], text[1:] != text[:-1]))
    sentence = np.cumsum(parted) - 1
    # letters of a token up to the punctuation that ends it
    place = np.arange(len(points))
    last = np.maximum.reduceat(np.where(np.isin(points, _TRAILING) | (code == _SPACE), -1, place), starts)
    token = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.flatnonzero(code != _SPACE)
    keep = (code[inside] != _DROPPED) & (inside <= last[token])
    letters, owner = code[inside[keep]], token[keep]
    # words spelt out: single letters with one to three other characters between them
    a, b = _runs(kind > 0)
    single = (b - a == 1) & (kind[a] == 1)
    chained = np.zeros(len(a), bool)
    of_text = np.searchsorted(text_at, a, "right")
    chained[1:] = single[1:] & single[:-1] & (a[1:] - b[:-1] <= 3) & (of_text[1:] == of_text[:-1])
    chain = np.cumsum(~chained)[single]
    spelt = a[single]
    first = np.flatnonzero(np.diff(np.concatenate(([-1], chain)))) if len(chain) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate((first, [len(chain)])))
    long_enough = length >= LENGTH
    spelt_in = np.searchsorted(starts, spelt[first[long_enough]], "right") - 1
    letters = np.concatenate((letters, code[spelt[np.repeat(long_enough, length)]]))
    counts = np.concatenate((np.bincount(owner, minlength=len(starts)), length[long_enough]))
    text, sentence = np.concatenate((text, text[spelt_in])), np.concatenate((sentence, sentence[spelt_in]))
    end = np.cumsum(counts)
    keep = counts >= LENGTH
    return Units(letters, (end - counts)[keep], end[keep], text[keep], sentence[keep], tokens)


def windows(unit: str) -> list[str]:
    """The unit with a mark at its start, which counts as a letter; cut if it is long."""
    unit = f"^{unit}"
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[k : k + WINDOW] for k in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def coded(units: list[str]) -> np.ndarray:
    """Code points of windows, one row each, filled up with zeros."""
    out = np.zeros((len(units), WINDOW), np.uint32)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    out[np.arange(WINDOW)[None, :] < lengths[:, None]] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    return out


def letter_masks(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter of the rows; other scripts share bits, which only lets more through."""
    bits = np.where(codes > 0, np.uint64(1) << (codes % np.uint32(64)).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of coded strings row by row: sums over common subsequences of LENGTH characters,
    weighted by DECAY to the length that each spans in both strings."""
    match = ((s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)).astype(np.float32) * DECAY**2
    level = match
    for _ in range(LENGTH - 1):
        summed = level.copy()
        for j in range(1, summed.shape[1]):
            summed[:, j] += DECAY * summed[:, j - 1]
        for k in range(1, summed.shape[2]):
            summed[:, :, k] += DECAY * summed[:, :, k - 1]
        level = np.zeros_like(match)
        level[:, 1:, 1:] = match[:, 1:, 1:] * summed[:, :-1, :-1]
    return level.sum(axis=(1, 2))


class Landmarks:
    """Landmark units and kernel rows against them, normalised to 1 for equal units."""

    def __init__(self, units: list[str], settings: Settings):
        self.units, self.settings = units, settings
        self.codes = coded(units)
        self.lengths = (self.codes > 0).sum(axis=1)
        self.masks = letter_masks(self.codes)
        self.own = subsequence_kernel(self.codes, self.codes)
        self.needed = np.ceil(settings.shared_letters * np.bitwise_count(self.masks)).astype(np.uint8)

    def near(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of units, by their masks, and landmarks that share enough letters."""
        found = [np.flatnonzero(np.bitwise_count(masks & m) >= n) for m, n in zip(self.masks, self.needed)]
        return np.concatenate(found), np.repeat(np.arange(len(found)), list(map(len, found)))

    def values(self, codes: np.ndarray, at: np.ndarray, landmark: np.ndarray) -> np.ndarray:
        """Normalised kernel values of pairs of rows of codes and landmarks."""
        lengths = (codes > 0).sum(axis=1)
        values, own = np.zeros(len(at), np.float32), np.zeros(len(codes), np.float32)
        below = 0
        for width in (5, 6, 7, 8, 10, 12, 16, WINDOW):
            mine = np.flatnonzero((lengths > below) & (lengths <= width))
            for k in range(0, len(mine), 2000):
                part = codes[mine[k : k + 2000], :width]
                own[mine[k : k + 2000]] = subsequence_kernel(part, part)
            chosen = np.flatnonzero((lengths[at] > below) & (lengths[at] <= width))
            order = chosen[np.argsort(self.lengths[landmark[chosen]], kind="stable")]
            for k in range(0, len(order), 2000):
                part = order[k : k + 2000]
                reach = int(self.lengths[landmark[part]].max())
                values[part] = subsequence_kernel(codes[at[part], :width], self.codes[landmark[part], :reach])
            below = width
        return values / np.sqrt(np.maximum(own[at] * self.own[landmark], 1e-12))

    def rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the coded units that come near a landmark: their places and kernel rows."""
        at, landmark = self.near(letter_masks(codes))
        values = self.values(codes, at, landmark)
        keep = values >= self.settings.floor
        places, inverse = np.unique(at[keep], return_inverse=True)
        out = np.zeros((len(places), len(self.units)), np.float32)
        out[inverse, landmark[keep]] = values[keep]
        return places, out

    def rows_of(self, units: list[str]) -> np.ndarray:
        """The kernel rows of unmarked units, zeros where nothing is near; the largest of their windows."""
        cut = [windows(u) for u in units]
        owner = np.repeat(np.arange(len(units)), list(map(len, cut)))
        out = np.zeros((len(units), len(self.units)), np.float32)
        flat = [w for c in cut for w in c]
        for k in range(0, len(flat), 5000):
            places, rows = self.rows(coded(flat[k : k + 5000]))
            np.maximum.at(out, owner[k : k + 5000][places], rows)
        return out


def pieces(texts: list[str | None]):
    """Lists of (which text, a piece of it) of PIECE code points or little more."""
    held, size = [], 0
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                stop = at + PIECE
                cut = max(text.rfind(mark, at + PIECE // 2, stop) + len(mark) - 1 for mark in ("\n", ". ", "! ", "? "))
                while cut <= at and stop < end and not text[stop].isspace():
                    stop += 1
                end = cut + 1 if cut > at else stop
            held.append((k, text[at:end]))
            size += end - at
            at = end
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


class SuspiciousUnits:
    """Which units of texts come near a landmark; a unit that is met again is known by its hash."""

    def __init__(self, landmarks: Landmarks, most: int = 500_000):
        self.landmarks, self.most = landmarks, most
        self._forget()

    def _forget(self) -> None:
        # what is forgotten is computed again when it comes up again
        self.known, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.zeros((0, len(self.landmarks.units)), np.float32)

    def look(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """The places of suspicious units, and their rows in self.rows."""
        n = len(units.starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.known) > self.most or len(self.rows) > self.most // 10:
            self._forget()
        bits = np.uint64(1) << (units.letters % np.uint32(64)).astype(np.uint64)
        edges = np.stack([units.starts, units.ends], axis=1).ravel()
        masks = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), edges)[::2] | np.uint64(1 << MARK % 64)
        distinct, inverse = np.unique(masks, return_inverse=True)
        at, _ = self.landmarks.near(distinct)
        close = np.zeros(len(distinct), bool)
        close[at] = True
        close = np.flatnonzero(close[inverse])
        hashes = span_hashes(units.letters, units.starts[close], units.ends[close])
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(hashes, units, close[first])
        row = self.row_of[np.searchsorted(self.known, hashes)][inverse]
        return close[row >= 0], row[row >= 0]

    def _learn(self, hashes: np.ndarray, units: Units, which: np.ndarray) -> None:
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != hashes
        which, hashes, place = which[new], hashes[new], place[new]
        rows = self._kernel_rows(units, which)
        hot = rows.any(axis=1)
        numbers = np.full(len(hashes), -1)
        numbers[hot] = len(self.rows) + np.arange(int(hot.sum()))
        self.rows = np.concatenate((self.rows, rows[hot]))
        self.known, self.row_of = np.insert(self.known, place, hashes), np.insert(self.row_of, place, numbers)

    def _kernel_rows(self, units: Units, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), len(self.landmarks.units)), np.float32)
        length = units.ends[which] - units.starts[which]
        plain = np.flatnonzero(length < WINDOW)
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            codes = np.zeros((len(part), WINDOW), np.uint32)
            codes[:, 0] = MARK
            column = np.arange(WINDOW - 1)[None, :]
            inside = column < length[part][:, None]
            codes[:, 1:][inside] = units.letters[(units.starts[which[part]][:, None] + column)[inside]]
            places, rows = self.landmarks.rows(codes)
            out[part[places]] = rows
        long = np.flatnonzero(length >= WINDOW)
        out[long] = self.landmarks.rows_of(units.strings(which[long]))
        return out


@dataclass(frozen=True)
class Model:
    landmarks: Landmarks | None
    beta: np.ndarray
    bias: float
    curve: np.ndarray  # weights of the features

    def sums(self, units: Units, which: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of n texts: the worst sentence's margin, how many units are on the toxic side, and
        the evidence of all units."""
        worst, toxic, evidence = np.full(n, self.bias), np.zeros(n), np.zeros(n)
        if len(which):
            order = np.argsort(units.sentence[which], kind="stable")
            which, rows = which[order], rows[order]
            text, sentence = units.text[which], units.sentence[which]
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            np.maximum.at(worst, text[first], np.maximum.reduceat(rows, first, axis=0) @ self.beta + self.bias)
            own = rows @ self.beta
            toxic = np.bincount(text, own + self.bias > 0, n)
            evidence = np.bincount(text, np.maximum(own, 0.0), n)
        return worst, toxic, evidence

    def features(self, worst: np.ndarray, toxic: np.ndarray, evidence: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The worst sentence's margin; of a hundred tokens, those on the toxic side and the evidence of
        all, as logarithms; and 1."""
        tokens = np.maximum(tokens, 1)
        return np.stack([worst, np.log1p(100.0 * toxic / tokens), np.log1p(100.0 * evidence / tokens), np.ones(len(worst))], axis=1)

    def probabilities(self, texts: list[str | None], known: SuspiciousUnits | None) -> np.ndarray:
        worst, toxic, evidence, tokens = np.full(len(texts), self.bias), *np.zeros((3, len(texts)))
        for held in pieces(texts) if known else ():
            owner = np.array([k for k, _ in held])
            units = units_of([piece for _, piece in held])
            which, row = known.look(units)
            part = self.sums(units, which, known.rows[row], len(held))
            np.maximum.at(worst, owner, part[0])
            for total, more in zip((toxic, evidence, tokens), (*part[1:], units.tokens)):
                np.add.at(total, owner, more)
        return 1.0 / (1.0 + np.exp(-np.clip(self.features(worst, toxic, evidence, tokens) @ self.curve, -700, 700)))


def _machine(x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, step: int = 4096) -> np.ndarray:
    """A linear machine with squared hinge loss over the rows ``at`` of x, by Newton steps that take a
    few thousand rows at a time; the last weight is the bias."""
    ridge = penalty * np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    w = np.zeros(len(ridge))
    for _ in range(50):
        left, right = ridge.copy(), np.zeros(len(ridge))
        for k in range(0, len(at), step):
            part = np.hstack([x[at[k : k + step]].astype(float), np.ones((len(at[k : k + step]), 1))])
            side = y[k : k + step]
            active = side * (part @ w) < 1
            a = part[active] * weight[k : k + step][active, None]
            left += a.T @ part[active]
            right += a.T @ side[active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _curve(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with labels drawn in a little."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (p - goal)) + ridge @ w)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _find_landmarks(sample: DataFrame, n1: int, n0: int, s: Settings) -> tuple[list[str], list[str]]:
    """Marked units of toxic texts of the sample, strongest first, none too much like an earlier one;
    and those of them that are common in toxic texts and in no clean one."""

    def distinct_units(batches):
        for batch in batches:
            toxic, unit = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                units = units_of([text])
                mine = {w for u in set(units.strings(np.arange(len(units.starts)))) for w in windows(u)}
                unit.extend(mine)
                toxic.extend([label] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(toxic, pa.int32())], names=["unit", "toxic"])

    counts = sample.mapInArrow(distinct_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate1, rate0 = F.col("a") / F.lit(n1), F.col("b") / F.lit(n0)
    least = max(2, int(0.01 * n1))
    marked = counts.where((F.col("a") >= least) & (rate1 > 4 * rate0)).orderBy(F.desc(F.col("a") - 4.0 * n1 / n0 * F.col("b")), "unit").limit(8 * s.landmarks)
    found = marked.collect()
    ranked = [r["unit"] for r in found]
    if not ranked:
        return [], []
    alike = _gram(ranked, s)
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) < s.landmarks and not (alike[k, chosen] >= s.alike).any():
            chosen.append(k)
    return [ranked[k] for k in chosen], [ranked[k] for k in chosen if found[k]["b"] == 0 and found[k]["a"] >= s.strong * n1]


def _gram(marked: list[str], s: Settings) -> np.ndarray:
    """Kernel values of marked units among each other."""
    out = np.zeros((len(marked), len(marked)))
    places, rows = Landmarks(marked, s).rows(coded(marked))
    out[places] = rows
    return out


def _altered(unit: str) -> list[str]:
    """The marked unit with one letter put in, at each place behind the first."""
    return [unit[:k] + c + unit[k:] for k in range(2, len(unit)) for c in dict.fromkeys((*"xen", unit[k - 1]))]


def _suspicious(sample: DataFrame, landmarks: Landmarks) -> DataFrame:
    """id, toxic, the number of tokens, and the suspicious units of sample(id, toxic, text) with their sentences."""
    shared = sample.sparkSession.sparkContext.broadcast(landmarks)

    def find(batches):
        known = SuspiciousUnits(shared.value)
        for batch in batches:
            tokens, sentences, strings = [], [], []
            for text in batch.column("text").to_pylist():
                units = units_of([text])
                which, _ = known.look(units)
                tokens.append(int(units.tokens[0]))
                sentences.append(units.sentence[which].astype(np.int32))
                strings.append(units.strings(which))
            columns = [pa.array(tokens, pa.int64()), pa.array(sentences, pa.list_(pa.int32())), pa.array(strings, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("toxic"), *columns], names=["id", "toxic", "tokens", "sentences", "units"])

    return sample.mapInArrow(find, "id string, toxic int, tokens long, sentences array<int>, units array<string>")


def _fit(landmarks: Landmarks, strong: list[str], sentence_rows: np.ndarray, of_bag: np.ndarray, bag_label: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The weights of landmarks and the bias, from the kernel rows of sentences and the bags (texts) they
    belong to; None if no sentence of a toxic text is suspicious."""
    s, x, label = landmarks.settings, sentence_rows, bag_label[of_bag]
    gram = _gram(landmarks.units, s)
    gram = (gram + gram.T) / 2
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
    nystrom = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    _, altered = landmarks.rows(coded([v[:WINDOW] for u in strong for v in _altered(u)] or landmarks.units))
    z = np.empty((len(x) + len(altered), len(gram)), np.float32)
    np.matmul(x, nystrom.astype(np.float32), out=z[: len(x)])
    np.matmul(altered, nystrom.astype(np.float32), out=z[len(x) :])
    altered = np.arange(len(x), len(z))
    toxic, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    suspicious = x.any(axis=1)
    margin = x.max(axis=1) - 0.5
    for _ in range(s.rounds):
        order = np.lexsort((-margin, of_bag))
        first = order[np.r_[True, np.diff(of_bag[order]) > 0]]
        witness = np.union1d(first[label[first] == 1], toxic[margin[toxic] > 0])
        witness = witness[suspicious[witness]]
        if not len(witness):
            return None
        parts = [witness, negative[suspicious[negative]], negative[~suspicious[negative]], altered]
        y = np.concatenate([np.full(len(p), side) for p, side in zip(parts, (1.0, -1.0, -1.0, 1.0))])
        weight = np.concatenate([np.full(len(p), share / max(len(p), 1)) for p, share in zip(parts, s.shares)])
        w = _machine(z, np.concatenate(parts), y, weight, s.penalty)
        margin = z[: len(x)] @ w[:-1].astype(np.float32) + w[-1]
    return nystrom @ w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """A model from docs(id, text) and labels(id, toxic); rows with a null in them teach nothing.

    Only ids are joined and sampled; texts are read for the bounded sample alone.
    """
    s = settings or Settings()
    known = labels.where("id is not null and toxic in (0, 1)").select("id", F.col("toxic").cast("int").alias("toxic")).distinct()
    docs = docs.where("id is not null and text is not null").select("id", "text")
    sizes = docs.groupBy("id").agg(F.min(F.length("text")).alias("size"))
    known = known.join(sizes, "id").select("id", "toxic", (F.col("size") <= s.sample_chars).alias("fits"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    everything = sum(counts.values())
    base = counts.get(1, 0) / everything if everything else 0.0
    flat = Model(None, np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, np.log((base + 1e-6) / (1 - base + 1e-6))]))
    if not (counts.get(0) and counts.get(1)):
        return flat
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    fits = known.where("fits").drop("fits")
    ids = bounded_sample(fits.where("toxic = 1"), s.toxic_rows, 1).unionByName(bounded_sample(fits.where("toxic = 0"), s.clean_rows, 2))
    ids = scratch.save(ids, "ids")
    short = docs.where(F.length("text") <= s.sample_chars)
    rows = short.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).repartition(s.sample_tasks, "id")
    sample = scratch.save(rows, "sample")
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    marked, strong = _find_landmarks(sample, taken[1], taken[0], s) if taken.get(0) and taken.get(1) else ([], [])
    if not marked:
        scratch.clean()
        return flat
    landmarks = Landmarks(marked, s)
    frame = _suspicious(sample, landmarks).toPandas().sort_values("id", kind="stable")  # bounded by the sample's rows and their length
    scratch.clean()
    bag_label, tokens = frame["toxic"].to_numpy(), frame["tokens"].to_numpy()
    text = np.repeat(np.arange(len(frame)), frame["units"].map(len))
    distinct, which = np.unique(np.concatenate([np.zeros(0, object), *frame["units"]]), return_inverse=True)
    unit_rows = landmarks.rows_of(distinct.tolist())
    # a text without a suspicious unit is one sentence without any, whose kernel row is the zeros at the end
    none = np.flatnonzero(np.bincount(text, minlength=len(frame)) == 0)
    text = np.concatenate((text, none))
    sentence = np.concatenate((*frame["sentences"], np.zeros(len(none)))).astype(np.int64)
    del frame
    unit_rows = np.concatenate((unit_rows, np.zeros((1, len(marked)), np.float32)))
    which = np.concatenate((which, np.full(len(none), len(distinct)))).astype(np.int64)
    order = np.lexsort((sentence, text))
    text, sentence, which = text[order], sentence[order], which[order]
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
    sentence_rows = np.zeros((len(first), len(marked)), np.float32)
    ends = np.append(first[1:], len(which))
    for k in range(0, len(first), 4096):  # a few thousand sentences at a time
        begin, end = first[k], ends[min(k + 4096, len(first)) - 1]
        sentence_rows[k : k + 4096] = np.maximum.reduceat(unit_rows[which[begin:end]], first[k : k + 4096] - begin, axis=0)
    fitted = _fit(landmarks, strong, sentence_rows, text[first], bag_label)
    if fitted is None:
        return flat
    model = Model(landmarks, *fitted, np.zeros(4))
    worst, own = np.full(len(bag_label), model.bias), (unit_rows @ model.beta)[which]
    np.maximum.at(worst, text[first], sentence_rows @ model.beta + model.bias)
    real = which < len(distinct)
    toxic, evidence = (np.bincount(text[real], v[real], len(bag_label)) for v in (own + model.bias > 0, np.maximum(own, 0.0)))
    seen = model.features(worst, toxic, evidence, tokens)
    share = np.where(bag_label == 1, counts[1] / taken[1], counts[0] / taken[0]) * (len(bag_label) / everything)
    return Model(landmarks, model.beta, model.bias, _curve(seen, bag_label, share))


def _score_batches(shared, text: str):
    def scored(batches):
        model = shared.value
        known = SuspiciousUnits(model.landmarks) if model.landmarks else None
        for batch in batches:
            yield batch, model.probabilities(batch.column(text).to_pylist(), known)

    return scored


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    carried = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    (said,) = fresh(docs, "tox_text")
    scored = _score_batches(shared, said)

    def add(batches):
        for batch, p in scored(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*carried, F.col(text).alias(said)).mapInArrow(add, schema)


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs that score below the threshold; columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = _score_batches(shared, text)

    def keep(batches):
        for batch, p in scored(batches):
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)


def train_on_folds(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """A model from the labels outside fold 0 of 5."""
    known = labels.where(fold("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), "toxic")
    return train(docs.select(F.col("doc_id").alias("id"), "text"), known, settings)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), train_on_folds(docs, labels)).select("doc_id", "held_out", "score", "predicted")
