"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document: good, bad or nothing from measures of its form, clean, toxic or nothing
from its words. Expectation-maximisation over the counts of vote patterns estimates how often each labeller gives each vote to
good, to bad and to toxic documents, which turns a pattern into posteriors. On a bounded sample, posteriors train a hashed
linear scorer of byte trigrams and of the measures behind the votes; the scorer alone judges every document.

Two labellers tell toxic documents. What one of them looks for is learnt from labelled rows (a bounded sample of them, of which
copies count once): hashed words and beginnings of words get weights, and scores of labelled rows that the weights have not
seen tell from where a score votes toxic. The other has a list of words, which is a parameter; where labelled rows say that a
word of it is none, it is left out. Both take part at any number of labels. One that has nothing to look for abstains,
finding no word is no vote for good, and one whose vote is the same for all documents tells nothing and is left out of EM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, shuffle_partitions
from .minhash import shingle_sets
from .words import SPACE, groups_of, mix64, words

#: Documents that train the scorer and labelled rows that teach toxic words, at most.
SAMPLE, LABELLED = 6000, 20_000
#: Features of trigrams, of toxic words; bytes of text in one array.
TRIGRAMS, TOXIC, AT_ONCE = 1024, 1 << 23, 1 << 18
#: Bytes of a word's beginnings, parts of the labelled rows that are held out in turn, standard errors that a weight is lowered by.
BEGINNINGS, FOLDS, ERRORS = (4, 5, 6, 7, 8), 5, 3.0
#: Steps of a weight, score that is toxic where no labels tell, score by the list that is, words of a text that one toxic word
#: may make toxic.
UNIT, THRESHOLD, LISTED, SHORT = 32, 0.25, 0.15, 4
#: Probability of being good from which a document is kept.
GOOD = 0.5
# Words that the list's labeller starts from, unless fit() is given others; frequent function words of four languages.
INSULTS = tuple("idiot moron stupid scum trash loser pathetic worthless disgusting clown".split())
FUNCTION = tuple("the of and to in a is that it for was on as with be by this are at or an he from la de le les et des en un une du que qui pour dans est au par sur pas der die und das den von zu mit sich dem ist nicht ein eine auf für im el los las y una del se con por su no es al como".split())
MARKS, MARKED_BY = "#$%&*@^~|<>{}[]\\=_", "#$%&*@^~!|"
CLASSES = ("good", "bad", "toxic")
#: Labeller: measure, from where it says good (at most or at least; never if None), from where bad or toxic, words that it needs,
#: which class. A measure that is no number is no vote.
LABELLERS = (
    ("marks", 0.003, 0.02, 1, "bad"), ("marked", 0.03, 0.15, 3, "bad"), ("caps", 0.2, 0.5, 1, "bad"), ("shouts", 0.01, 0.1, 1, "bad"),
    ("repeats", 0.02, 0.1, 5, "bad"), ("variety", 0.5, 0.3, 25, "bad"), ("bars", 0.01, 0.05, 5, "bad"), ("function", 0.1, 0.02, 25, "bad"),
    ("lines", 0.2, 0.5, 5, "bad"), ("toxicity", 0.25, 1.0, 1, "toxic"), ("listed", None, 1.0, 1, "toxic"),
)
MEASURES = tuple(x[0] for x in LABELLERS)
#: Measures of toxicity, which are the last ones. Borders between the steps that the scorer sees of a measure, and of these.
OF_WORDS = 2
STEPS, TOXIC_STEPS = (0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5), (1e-9, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
_WIDE = len(STEPS) + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_MARK, _MARKED, _LINE, _EDGE = _bytes_in(MARKS), _bytes_in(MARKED_BY), _bytes_in("\n"), _bytes_in("".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()))
_UPPER, _LETTER = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.array([chr(c).isalpha() and c < 128 or c >= 192 for c in range(256)])


def _word(w: str) -> np.uint64:
    return words(np.frombuffer(w.encode() + b"\n", np.uint8))[2][0]


_BAR, _FUNCTION = _word("|"), np.sort(np.array([_word(w) for w in FUNCTION]))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each with a line feed, and where each ends."""
    return np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8), np.cumsum([len(t) + 1 for t in texts])


def _without_edges(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, ASCII punctuation as blanks."""
    return np.where(_EDGE[data], np.uint8(32), _LOWER[data])


def _one_each(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash occurs first in each text."""
    return np.unique(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1]


def _kinds(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Different hashes in each of n texts."""
    return np.bincount(text[_one_each(text, hashes)], minlength=n)


def form(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, measures but the last OF_WORDS) and the words of each text, split at ASCII white space."""
    data, ends = _joined(texts)
    count = len(texts)
    per = lambda at: np.bincount(np.searchsorted(ends, at, "right"), minlength=count + 1)[:count]
    starts, lengths, hashes = words(data)
    of = np.searchsorted(ends, starts, "right")
    n = np.bincount(of, minlength=count)
    size = np.maximum(1, np.array([len(t) for t in texts]))
    last = starts + lengths - 1
    upper = _UPPER[data] | (np.concatenate(([0], data[:-1])) == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # À to Þ
    shout = data == 33
    shout = shout & np.append(shout[1:], False) & ~np.concatenate(([False], shout[:-1]))
    cleaned_at, _, cleaned = words(_without_edges(data))
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, np.int64)
    lines, _, line_hashes = words(data, _LINE)
    line_of = np.searchsorted(ends, lines, "right")
    n_lines = np.bincount(line_of, minlength=count)
    some, places = np.maximum(1, n), np.searchsorted(_FUNCTION, cleaned).clip(max=len(_FUNCTION) - 1)
    out = [
        per(np.flatnonzero(_MARK[data])) / size,
        per(starts[(lengths > 2) & _MARKED[data[last]] & _MARKED[data[last - 1]]]) / some,
        per(np.flatnonzero(upper)) / np.maximum(1, per(np.flatnonzero(_LETTER[data]))),
        per(np.flatnonzero(shout)) / some,
        per(starts[same]) / np.maximum(1, n - 1),
        _kinds(of, hashes, count) / some,
        per(starts[hashes == _BAR]) / some,
        per(cleaned_at[_FUNCTION[places] == cleaned]) / some,
        np.where(n_lines > 0, 1 - _kinds(line_of, line_hashes, count) / np.maximum(1, n_lines), 0.0),
    ]
    return np.stack(out, 1), n


def votes(values: np.ndarray, n: np.ndarray) -> list[str]:
    """A letter of each labeller for each row of measures: g, the class it is against (b or t), or - for no vote."""
    out = np.full(values.shape, "-", "U1")
    for j, (_, good, against, least, kind) in enumerate(LABELLERS):
        v, sign = values[:, j], 1 if good is None or good < against else -1
        if good is not None:
            out[(n >= least) & (sign * v <= sign * good), j] = "g"
        out[(n >= least) & (sign * v >= sign * against), j] = kind[0]
    return ["".join(x) for x in out]


#: What is added to counts of votes and of classes: so little that a class of few documents stays what their votes say.
FEW = 0.01
#: Share of good documents that a labeller votes against, as far as is known before, and how much that weighs beside all votes.
#: Without it, the votes of a labeller that no other one overlaps with could as well all be wrong.
FALSE, KNOWN = 0.002, 0.1


def posteriors(patterns: dict[str, int], rounds: int = 60) -> dict[str, np.ndarray]:
    """The probabilities of CLASSES for a document with a pattern, by expectation-maximisation over the patterns' counts; votes
    are independent given the class, and what form says of toxic documents is what it says of good ones. A pattern may be good, and what some labeller says that it is; it starts from toxic if one
    says so, else bad if one says so. So classes cannot trade places or split the good ones by some other trait. A labeller that
    says the same of all documents, or nothing, is no evidence."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    letters = np.array([list(k) for k in keys])
    said = np.stack([np.ones(len(keys), bool), *[(letters == c[0]).any(1) for c in CLASSES[1:]]], 1)
    first = np.where(said[:, 2], 2, np.where(said[:, 1], 1, 0))
    cast = np.where(letters == "-", 2, np.where(letters == "g", 0, 1))
    against = np.where((letters == "t").any(0), 2, 1)
    telling = (cast != cast[:1]).any(0)
    cast, against = cast[:, telling], against[telling]
    share = np.where(first[:, None] == np.arange(len(CLASSES))[None], 0.9, 0.05) * said
    share /= share.sum(1, keepdims=True)
    for _ in range(rounds):
        log = np.zeros(share.shape)
        for c in range(len(CLASSES)):
            weight = count * share[:, c]
            log[:, c] = np.log((weight.sum() + FEW) / (count.sum() + len(CLASSES) * FEW))
            for j in range(cast.shape[1]):
                pooled = c != 1 and against[j] == 1  # good and toxic documents
                each = np.bincount(cast[:, j], count * (1 - share[:, 1]) if pooled else weight, 3) + FEW
                if c != against[j] and c != 1:  # known before: the votes of all, but few against
                    usual = (np.bincount(cast[:, j], count, 3) + FEW) * (1, 0, 1)
                    each += KNOWN * count.sum() * ((1 - FALSE) * usual / usual.sum() + (0, FALSE, 0))
                log[:, c] += np.log(each / each.sum())[cast[:, j]]
        share = np.exp(log - log.max(1, keepdims=True)) * said
        share /= share.sum(1, keepdims=True)
    return dict(zip(keys, share))


@dataclass
class Model:
    """The scorer's weights of trigrams and of measures' steps for each class, toxic features with their weights in UNITs, the
    score from which a labeller says toxic, and the hashes of the list's words."""

    trigrams: np.ndarray
    steps: np.ndarray
    bias: np.ndarray
    posterior: dict[str, np.ndarray]
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    threshold: float = THRESHOLD
    listed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each trigram of bytes; a text of fewer than three has none."""
    data, ends = _joined(texts)
    x = data.astype(np.uint32)
    h = ((x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)) >> np.uint32(22)).astype(np.int64)
    at = np.arange(len(h))
    of = np.searchsorted(ends, at, "right")
    inside = at + 3 < np.append(ends, 0)[of]
    return of[inside], h[inside]


def _steps(values: np.ndarray) -> np.ndarray:
    """(texts, measures) features of the measures' steps."""
    borders = [*[STEPS] * (len(MEASURES) - OF_WORDS), *[TOXIC_STEPS] * OF_WORDS]
    return np.stack([j * _WIDE + np.searchsorted(x, np.nan_to_num(values[:, j]), "right") for j, x in enumerate(borders)], 1)


def toxic_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of each word without ASCII punctuation, and its features: the word and its beginnings. A word that is
    too short for a beginning has itself there."""
    data, ends = _joined(texts)
    data = _without_edges(data)
    starts, lengths, hashes = words(data)
    text = np.searchsorted(ends, starts, "right")
    which, eight = np.uint64(TOXIC - 1), np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[starts]
    features = np.empty((1 + len(BEGINNINGS), len(starts)), np.int64)
    features[0] = hashes & which
    for row, n in zip(features[1:], BEGINNINGS):
        begin = mix64((eight & np.uint64((1 << 8 * n) - 1)) + np.uint64(77)) & which
        row[:] = np.where(lengths >= n, begin.astype(np.int64), features[0])
    return text, hashes, features


def _score_of(hit: np.ndarray, weight: np.ndarray, text: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, which hits count) of texts of n words in which the words at hit have weights: a word counts once, and the sum is
    divided by the root of the text's words. One word alone is no evidence in a text of more than SHORT words."""
    hit = hit[_one_each(text[hit], hashes[hit])]
    found = np.bincount(text[hit], minlength=len(n))
    score = np.bincount(text[hit], weight[hit], len(n)) / np.sqrt(n + 10)
    return np.where((found > 1) | (n <= SHORT), score, 0.0), hit


def toxicity(table: np.ndarray, texts: list[bytes], listed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, toxic words, score by the list) of each text. A word weighs as its heaviest feature; toxic words are those that
    weigh a UNIT and more, which many words that toxic texts only use somewhat oftener do not. Each word of the list weighs 1."""
    text, hashes, features = toxic_features(texts)
    n = np.bincount(text, minlength=len(texts))
    weight = table[features].max(0) / UNIT if len(text) else np.zeros(0)
    score, hit = _score_of(np.flatnonzero(weight), weight, text, hashes, n)
    heavy = np.bincount(text[hit[weight[hit] >= 1]], minlength=len(texts))
    by_list = np.zeros(len(texts))
    if listed is not None and len(listed):
        at = np.flatnonzero(listed[np.searchsorted(listed, hashes).clip(max=len(listed) - 1)] == hashes)
        by_list, _ = _score_of(at, np.ones(len(text)), text, hashes, n)
    return score, heavy, by_list


def toxic_weights(toxic: np.ndarray, clean: np.ndarray, toxic_rows: int, clean_rows: int) -> np.ndarray:
    """Weights, in UNITs, of features that so many of the toxic and of the clean rows have: the smoothed logarithm of the ratio of
    their shares less ERRORS standard errors, so that rare or shared features weigh little instead of being cut at a count."""
    ratio = np.log((toxic + 0.5) / (toxic_rows + 1)) - np.log((clean + 0.5) / (clean_rows + 1))
    sure = ratio - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.minimum(255, np.ceil(np.maximum(0, sure) * UNIT)).astype(np.uint8)


def toxic_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The score with the fewest errors on rows that the weights have not seen; THRESHOLD if rejecting nothing has fewer."""
    order = np.argsort(-scores, kind="stable")
    s, gain = scores[order], np.cumsum(2 * toxic[order] - 1)
    last = np.flatnonzero(np.append(s[1:] < s[:-1], True) & (s > 0)) if len(s) else np.zeros(0, np.int64)  # equal scores go together
    if not len(last) or gain[last].max() <= 0:
        return THRESHOLD
    at = last[gain[last].argmax()]
    return float(s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2


def _table(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    table = np.zeros(TOXIC, np.uint8)
    np.maximum.at(table, features, weights)
    return table


def _groups(texts: list[str]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        t = t.encode()
        if group and size + len(t) > AT_ONCE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


class _Measures:
    """The measures of texts under a model, whose table is built once in a task."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, _table(model.toxic, model.weights)
        self.learnt = bool(model.weights.any())

    def groups(self, texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, measures, words, toxic words) of groups of texts; what the model has nothing for is no number."""
        for group in groups_of(texts, AT_ONCE):
            values, n = form(group)
            score, found, listed = toxicity(self.table, group, self.model.listed)
            none = np.full(len(group), np.nan)
            more = score / self.model.threshold if self.learnt else none, listed / LISTED if len(self.model.listed) else none
            yield group, np.concatenate((values, np.stack(more, 1)), 1), n, found


def _count_patterns(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        measures = _Measures(model)
        for b in batches:
            for _, values, n, _ in measures.groups(b.column(0)):
                for k in votes(values[n > 0], n[n > 0]):
                    counts[k] = counts.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    return run


def _training_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = _Measures(model)
        for b in batches:
            for group, values, n, _ in measures.groups(b.column(0)):
                x = np.zeros((len(group), TRIGRAMS + len(MEASURES) * _WIDE), np.float32)
                of, h = _trigrams(group)
                x[:, :TRIGRAMS] = np.bincount(of * TRIGRAMS + h, minlength=len(group) * TRIGRAMS).reshape(-1, TRIGRAMS) / np.maximum(1, np.bincount(of, minlength=len(group)))[:, None]
                np.put_along_axis(x, TRIGRAMS + _steps(values), 1, 1)
                x, some = x[n > 0], n > 0
                yield pa.RecordBatch.from_arrays([pa.array(votes(values[some], n[some]), pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], ["votes", "x"])

    return run


#: Smallest shingle hashes of a text that are kept, those that look a copy up, and the share of them that copies have in common.
SKETCH, LOOK_UP, ALIKE = 64, 4, 0.6


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, sketch)."""
    for b in batches:
        sketches = [s[:SKETCH].view(np.int64) for s in shingle_sets(b.column(1).to_pylist(), 2)]  # sorted
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "sketch"])


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sketch) but for copies of one before: texts whose smallest hashes of word pairs are mostly the same."""
    known: dict[int, list[set[int]]] = {}
    for b in batches:
        new = []
        for sketch in b.column(1).to_pylist():
            mine = set(sketch)
            again = any(len(mine & x) >= ALIKE * max(len(mine), len(x)) for k in sketch[:LOOK_UP] for x in known.get(k, ()))
            new.append(b.column(0)[len(new)].as_py() if not again else None)
            if not again:
                for k in sketch[:LOOK_UP]:
                    known.setdefault(k, []).append(mine)
        yield pa.RecordBatch.from_arrays([pa.array([x for x in new if x is not None], pa.int64())], ["doc_id"])


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged():
        every, at = np.unique(np.concatenate((keys, *waiting)), return_inverse=True)
        return every, np.bincount(at, np.concatenate((counts, np.ones(sum(map(len, waiting)), np.int64))), len(every)).astype(np.int64)

    for b in batches:
        slots, at = np.array(b.column(1).to_pylist(), np.int64), 0
        for group in _groups([t or "" for t in b.column(0).to_pylist()]):
            text, _, features = toxic_features(group)
            pairs = np.unique(text * TOXIC + features)
            waiting.append(pairs % TOXIC * (2 * FOLDS) + slots[at + pairs // TOXIC])
            at += len(group)
            if sum(map(len, waiting)) > 1 << 21:
                (keys, counts), waiting = merged(), []
    keys, counts = merged()
    for i in range(0, len(keys), 1 << 16):
        k = keys[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array((k // (2 * FOLDS)).astype(np.int32)), pa.array((k % (2 * FOLDS)).astype(np.int32)), pa.array(counts[i : i + (1 << 16)])], ["feature", "slot", "n"])


def _held_out(features: np.ndarray, weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            texts, slots = [t or "" for t in b.column(0).to_pylist()], np.array(b.column(1).to_pylist(), np.int64)
            scores = np.zeros(len(texts))
            for fold in set((slots // 2).tolist()):
                if fold not in tables:
                    tables[fold] = _table(features, weights[fold])
                mine = np.flatnonzero(slots // 2 == fold)
                scores[mine] = np.concatenate([toxicity(tables[fold], g)[0] for g in _groups([texts[i] for i in mine])])
            yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(slots % 2)], ["score", "toxic"])

    return run


def _fit_toxic(told: DataFrame, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Features, weights, threshold and which of the listed features stay, from (text, slot), where slot is twice the row's fold,
    plus one if the row is toxic. A listed feature goes if clean rows have it more often, by a standard error at least."""
    rows = np.zeros(2 * FOLDS, np.int64)
    for slot, n in told.groupBy("slot").count().collect():
        rows[slot] = n
    t, c = int(rows[1::2].sum()), int(rows[::2].sum())
    if not t or not c:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), THRESHOLD, np.ones(len(listed), bool)
    each = [F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2 * FOLDS)]
    toxic, clean = ("+".join(f"n{i}" for i in range(k, 2 * FOLDS, 2)) for k in (1, 0))
    # one error fewer than a weight asks for, as a feature may weigh more where a fold is left out
    sure = f"ln((t + 0.5) / {t + 1}) - ln((c + 0.5) / {c + 1}) > {ERRORS - 1} * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))"
    counts = told.mapInArrow(_toxic_counts, "feature int, slot int, n long").groupBy("feature").agg(*each)
    found = counts.withColumns({"t": F.expr(toxic), "c": F.expr(clean)}).where(F.expr(sure) | F.col("feature").isin(listed.tolist())).drop("t", "c").toArrow()
    features = found.column("feature").to_numpy().astype(np.int64)
    n = np.stack([found.column(f"n{i}").to_numpy() for i in range(2 * FOLDS)]).astype(np.int64)
    fit_on = lambda slots: toxic_weights(n[slots][1::2].sum(0), n[slots][::2].sum(0), int(rows[slots][1::2].sum()), int(rows[slots][::2].sum()))
    every = list(range(2 * FOLDS))
    folds = [fit_on([s for s in every if s // 2 != f]) for f in range(FOLDS)]
    judged = told.mapInArrow(_held_out(features, folds), "score double, toxic long").toArrow()
    mine = np.where(features[None] == listed[:, None], 1, 0) @ n.T
    with_t, with_c = mine[:, 1::2].sum(1) + 0.5, mine[:, ::2].sum(1) + 0.5
    stay = np.log(with_t / (t + 1)) - np.log(with_c / (c + 1)) + np.sqrt(1 / with_t + 1 / with_c) >= 0
    return features, fit_on(every), toxic_threshold(judged.column("score").to_numpy(), judged.column("toxic").to_numpy()), stay


def _train(rows: list, posterior: dict[str, np.ndarray], rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and biases of a scorer that gives rows their posteriors."""
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    y = np.stack([posterior.get(r.votes, np.full(len(CLASSES), 1 / len(CLASSES))) for r in rows]).astype(np.float32)
    x[:, :TRIGRAMS] *= 30
    w, b = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.log(y.mean(0) + 1e-3).astype(np.float32)
    m, v = np.zeros((len(w) + 1, len(CLASSES)), np.float32), np.zeros((len(w) + 1, len(CLASSES)), np.float32)
    for i in range(1, rounds + 1):
        p = _softmax(x @ w + b)
        g = np.concatenate((x.T @ (p - y) / len(y) + 1e-4 * w, (p - y).mean(0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    w[:TRIGRAMS] *= 30
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _picked(seed: int, share: float, *columns: str) -> tuple[Column, Column]:
    """(condition, order): about a share of the rows by hash, and their order by it."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.pmod(h, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)), F.pmod(h, F.lit(1 << 30))


def fit(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", sample: int = SAMPLE, labelled: int = LABELLED, insults: Sequence[str] = INSULTS) -> Model:
    """Learns from docs (doc_id, text_col) and, if there are any, labels (doc_id, toxic 0 or 1; nulls teach nothing, and a
    doc_id with both is toxic). Pattern counts cover all documents; the scorer sees at most `sample` of them, picked by a hash
    of doc_id and text, and toxic words come from at most `labelled` labelled ids, picked by a hash (of an id's texts the
    first in order counts). insults are words that one labeller of toxicity looks for, without those that labels show in clean
    documents. Null ids, repeated rows and other columns do no harm; texts of any length count as a whole. No documents give a
    model that keeps all that has words; empty labels are like none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = np.unique(np.array([_word(w) for w in insults], np.uint64))
    flat = np.zeros((TRIGRAMS + len(MEASURES) * _WIDE, len(CLASSES)), np.float32)
    model = Model(flat[:TRIGRAMS], flat[TRIGRAMS:], np.array([1.0, 0, 0], np.float32), {}, listed=listed)
    if labels is not None:
        known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        known = cut(known, "labels")
        some, order = _picked(11, 1.2 * labelled / max(1, known.count()), "doc_id")
        few = known.where(some).orderBy(order, "doc_id").limit(labelled)
        slot = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(FOLDS)).cast("int") * 2 + F.col("toxic")
        told = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # `labelled` bounds what is broadcast
        told = cut(told, "labelled")
        sketches = told.select("doc_id", "text").mapInArrow(_sketched, "doc_id long, sketch array<long>")
        leaders = sketches.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_leaders, "doc_id long")  # `labelled` rows of SKETCH numbers
        first = cut(told.join(leaders, "doc_id", "left_semi").select("text", slot.alias("slot")).repartition(shuffle_partitions(docs.sparkSession)), "labelled-first")
        model.toxic, model.weights, model.threshold, stay = _fit_toxic(first, (listed & np.uint64(TOXIC - 1)).astype(np.int64))
        model.listed = listed[stay]
        drop(told, first, known)
    counted = rows.select("text").mapInArrow(_count_patterns(model), "votes string, n long").groupBy("votes").agg(F.sum("n")).collect()  # 3^11 rows at most
    patterns = {k: n for k, n in counted}
    total = sum(patterns.values())
    if not total:
        return model
    model.posterior = posteriors(patterns)
    some, order = _picked(13, 1.2 * sample / total, "doc_id", "text")
    taught = rows.where(some).orderBy(order).limit(sample).select("text").mapInArrow(_training_rows(model), "votes string, x binary").collect()
    if taught:
        w, model.bias = _train(taught, model.posterior)
        model.trigrams, model.steps = w[:TRIGRAMS], w[TRIGRAMS:]
    return model


NEW = (("votes", T.StringType(), pa.string()), ("posterior", T.DoubleType(), pa.float64()), ("quality", T.DoubleType(), pa.float64()), ("toxicity", T.DoubleType(), pa.float64()), ("toxic_words", T.LongType(), pa.int64()), ("kept", T.BooleanType(), pa.bool_()))


def _score(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = _Measures(model)
        for b in batches:
            new: list[list] = [[] for _ in NEW]
            for group, values, n, found in measures.groups(b.column(text_at)):
                of, h = _trigrams(group)
                each = np.maximum(1, np.bincount(of, minlength=len(group)))
                z = np.stack([np.bincount(of, model.trigrams[h, c], len(group)) / each for c in range(len(CLASSES))], 1)
                p = _softmax(z + model.steps[_steps(values)].sum(1) + model.bias)
                p[n == 0] = 0
                letters = votes(values, n)
                posterior = [model.posterior[k][0] if k in model.posterior else None for k in letters]
                for column, x in zip(new, (letters, posterior, p[:, 0].tolist(), p[:, 2].tolist(), found.tolist(), (p[:, 0] >= GOOD).tolist())):
                    column.extend(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, kind) for x, (_, _, kind) in zip(new, NEW)]], [*b.schema.names, *[n for n, _, _ in NEW]])

    return run


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with votes, posterior (of being good by the votes; null for votes that fit() has not met), quality and toxicity (the
    scorer's probabilities that the document is good or toxic), toxic_words (different ones found) and kept: quality of GOOD
    or more.

    A text that is null or has no words has quality 0 and is not kept; a very long one is judged as a whole. Every row is
    judged by itself, so repeated rows agree, and an empty table gives no rows. Columns of docs with the names of new ones
    are replaced, all others stay.
    """
    rows = docs.drop(*[n for n, _, _ in NEW])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, kind) for n, kind, _ in NEW]])
    return rows.mapInArrow(_score(model, rows.columns.index(text_col)), schema)
