"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the subsequences of three characters that both hold, decay to the power of
the spans they cover, spans beyond seven characters left out; it is normalised to 1 for equal words and taken to
the fourth power. So a word with a gap or an inserted character stays near to the one without; marks within a word
don't count, and a run of single characters is read as one word. The kernel of two sentences is the sum over their
pairs of words, so that an insult of several words adds up.

The machine is trained on the sentences of labelled rows: all those of clean rows count as clean, and a toxic row
is shown by its witnesses, which no clean row may hold also. These are the sentences with a word that is typical of
toxic rows beyond chance and, for some rounds, the one that the machine of the round before finds most toxic. Rows
in which none shows are learnt from by the most toxic of all their sentences, with a tenth of a witness's weight, as
labels can be wrong. Sentences that copies of a text repeat count once. A witness is learnt from twice, the second
time with a character put into the middle of its most telling word. Training runs in one task, which gets the
labelled rows that ``most_rows`` bounds.

A string of more than LONG characters is read in overlapping pieces: in training it has the mean of their features,
when scored the largest of their weights. So memory is bounded whatever a string's length.

Sentences have Nyström features: those of their words against landmark words, added up. Landmarks are typical words
that aren't near to each other, common ones, and the words of clean sentences that a first machine finds most toxic.
A row's margin is the largest of its sentences, and a logistic curve, fitted on labelled rows that the machine
wasn't trained on with margins beyond 2 taken as 2, turns it into a score. As the features of words add up, a word
has a weight of its own and a sentence the sum of its words' weights, so that tasks score distinct words once.

Edge cases: null or empty texts have the margin of no words; a null label counts as no label, a null doc_id
as the text "" where rows are held out; of labelled rows that share a doc_id one text is learnt from; rows that
repeat are scored each; without labels of both classes every score is the share of toxic labels, or 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, bounded_sample, kept_in_worker, split_batches

SPAN, DECAY = 7, 0.8
#: (gap to the second, gap to the third character) of subsequences of three.
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_ODD = re.compile(r"[\W_]+")
_SINGLE = re.compile(r"(?:\b\w[\W_]+){2,}\w\b")
_END = re.compile(r"[.!?]+\s|[\n|]+")
BEGIN = "^"
#: Power of the kernel of two words, which tells near words from others.
POWER = 4
#: Characters of a word beyond which it is read in pieces that overlap by half.
LONG = 32
#: Words of a stretch that is read as one sentence where no end comes; stretches overlap by half.
STRETCH = 24
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def sentences(text: str) -> list[set[str]]:
    """The words of each sentence, each once, in lower case."""
    out = []
    for part in _END.split(text.lower()):
        words = _SINGLE.sub(lambda m: _ODD.sub("", m[0]), part).split()
        if len(words) <= STRETCH:
            if words:
                out.append({*words})
        else:
            out += [{*words[i : i + STRETCH]} for i in range(0, len(words) - STRETCH // 2, STRETCH // 2)]
    return out


def folded(word: str) -> str:
    """The word's letters and digits after a mark, so that what a word begins with counts."""
    return BEGIN + (word if word.isalnum() else _ODD.sub("", word))


def pieces(word: str) -> list[str]:
    """The overlapping pieces of a folded word; itself, if it isn't long."""
    return [word[a : a + LONG] for a in range(0, max(1, len(word) - LONG // 2), LONG // 2)]


def _narrow(chars: np.ndarray) -> np.ndarray:
    """Characters in 16 bits; those beyond are folded into them."""
    return ((chars >> np.uint32(16)) * np.uint32(40503) + chars & np.uint32(0xFFFF)).astype(np.uint64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of the words' subsequences, each once for a word; words of a length are taken together,
    and a subsequence's code has its gap's class in the lowest bits while they are sorted."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    rows, codes, weights = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0)]
    of_class = DECAY ** (np.arange(8) + 3.0)
    for n, which in by_length.items():
        spans = [(a, a + i, a + j, j) for i, j in _GAPS for a in range(n - j)]
        if not spans:
            continue
        first, second, third, gap = (np.array(x) for x in zip(*spans))
        chars = _narrow(np.frombuffer("".join([words[k] for k in which]).encode("utf-32-le"), np.uint32)).reshape(len(which), n)
        keys = chars[:, first] << np.uint64(35) | chars[:, second] << np.uint64(19) | chars[:, third] << np.uint64(3) | (gap - 2).astype(np.uint64)
        keys.sort(axis=1)
        code = (keys >> np.uint64(3)).ravel()
        new = np.empty(code.shape, bool)
        new[1:] = code[1:] != code[:-1]
        new[:: len(spans)] = True
        at = np.flatnonzero(new)
        rows.append(np.array(which)[at // len(spans)])
        codes.append(code[at])
        weights.append(np.add.reduceat(of_class[(keys & np.uint64(7)).ravel()], at))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


def normalised(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences with weights that make each word's vector one long."""
    r, c, w = subsequences(words)
    return r, c, w / np.sqrt(np.maximum(np.bincount(r, w * w, len(words)), 1e-24))[r] if len(r) else w


class Landmarks:
    """The landmarks' subsequences, found by the numbers of their characters."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        r, c, w = normalised(words)
        order = np.argsort(c, kind="stable")
        self.row, self.weight = r[order], w[order]
        names, self.first, self.length = np.unique(c[order], return_index=True, return_counts=True)
        letters = np.unique(np.concatenate([names >> np.uint64(s) & np.uint64(0xFFFF) for s in (32, 16, 0)]))
        self.size = len(letters) + 1
        self.letter = np.zeros(1 << 16, np.int64)
        self.letter[letters.astype(np.int64)] = np.arange(1, self.size)
        self.names = names
        self.place = None
        if self.size <= 128:
            self.place = np.full(self.size**3, -1, np.int32)
            self.place[self._spot(names)] = np.arange(len(names))

    def _spot(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = (self.letter[codes >> np.uint64(s) & np.uint64(0xFFFF)] for s in (32, 16, 0))
        return (a * self.size + b) * self.size + c

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes the landmarks have, and their places."""
        if self.place is not None:
            at = self.place[self._spot(codes)]
            hit = np.flatnonzero(at >= 0)
            return hit, at[hit]
        at = np.minimum(np.searchsorted(self.names, codes), max(len(self.names) - 1, 0))
        hit = np.flatnonzero(self.names[at] == codes) if len(self.names) else np.empty(0, np.int64)
        return hit, at[hit]

    def kernel(self, words: list[str], power: int = POWER, some: int = 2_000) -> np.ndarray:
        """Normalised kernel values to a power, words by landmarks; of a long word the mean of its pieces' values."""
        out = self._kernel([w for w in words if len(w) <= LONG], power, some)
        if len(out) == len(words):
            return out
        whole, at = np.zeros((len(words), self.n), np.float32), 0
        for k, w in enumerate(words):
            if len(w) <= LONG:
                whole[k], at = out[at], at + 1
            else:
                parts = pieces(w)
                for a in range(0, len(parts), some):
                    whole[k] += self._kernel(parts[a : a + some], power, some).sum(axis=0) / len(parts)
        return whole

    def _kernel(self, words: list[str], power: int, some: int) -> np.ndarray:
        out = np.zeros((len(words), self.n), np.float32)
        for a in range(0, len(words), some):
            r, c, w = normalised(words[a : a + some])
            hit, at = self.find(c)
            r, w, n, low = r[hit], w[hit], self.length[at], self.first[at]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
            size = len(words[a : a + some])
            flat = np.bincount(np.repeat(r * self.n, n) + self.row[at], np.repeat(w, n) * self.weight[at], size * self.n)
            out[a : a + size] = flat.reshape(size, -1)
        return np.power(out, power, out=out)


def kernel(words: list[str], landmarks: list[str], power: int = POWER) -> np.ndarray:
    return Landmarks(landmarks).kernel(words, power)


class Machine:
    """A weight for each landmark, and a bias."""

    def __init__(self, landmarks: list[str], alpha: np.ndarray, bias: float):
        self.landmarks, self.alpha, self.bias = Landmarks(landmarks), alpha, bias

    def weights_of(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's margin."""
        return self.landmarks.kernel(words) @ self.alpha


def least_squared_hinge(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, pull: float, some: int = 8192) -> np.ndarray:
    """The linear machine (last entry: bias) with the least sum of weighted squared hinge losses over blocks of
    (rows, +-1, weights) and pull / 2 times the squared weights, by Newton steps over the rows within the margin,
    halved while they don't help. Rows are taken some at a time."""
    ridge = np.append(np.full(len(start) - 1, pull), pull * 1e-3)

    def loss(w):
        gaps = [np.maximum(0, 1 - y * (x @ w[:-1].astype(x.dtype) + w[-1])) * (weigh > 0) for x, y, weigh in blocks]
        return 0.5 * float(ridge @ (w * w)) + sum(float(weigh @ (gap * gap)) for gap, (_, _, weigh) in zip(gaps, blocks)), gaps

    w = start.copy()
    now, gaps = loss(w)
    for _ in range(40):
        slope, square = ridge * w, np.diag(ridge)
        for gap, (x, y, weigh) in zip(gaps, blocks):
            on = np.flatnonzero(gap)
            for a in range(0, len(on), some):
                at = on[a : a + some]
                xs = np.hstack([x[at], np.ones((len(at), 1), x.dtype)]).astype(np.float64)
                slope = slope - 2 * xs.T @ (weigh[at] * y[at] * gap[at])
                square += 2 * xs.T @ (xs * weigh[at][:, None])
        move, step = np.linalg.solve(square, slope), 1.0
        while step > 1e-6:
            then, new_gaps = loss(w - step * move)
            if then <= now:
                break
            step /= 2
        else:
            break
        w, gain, now, gaps = w - step * move, now - then, then, new_gaps
        if gain <= 1e-9 * max(now, 1e-12):
            break
    return w


def typical_words(parts: list[np.ndarray], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """For each word how typical it is of toxic sentences: twice the log-likelihood ratio of its sentences' kinds,
    0 where chance among so many words would give as much."""
    tally = np.zeros((2, n_words))
    for y in (0, 1):
        some = [p for p, t in zip(parts, toxic.tolist(), strict=True) if t == y]
        if some:
            tally[y] = np.bincount(np.concatenate(some), minlength=n_words)
    seen, base = tally.sum(0), toxic.mean() if len(toxic) else 0.0
    rate = tally[1] / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(t > 0, t * np.log(t / np.maximum(seen * b, 1e-12)), 0.0) for t, b in ((tally[1], base), (tally[0], 1 - base)))
    return np.where((rate > base) & (ratio > 2 * np.log(n_words + 1)), ratio, 0.0)


def diverse(words: list[str], chosen: list[str], until: int) -> list[str]:
    """The chosen ones and, in their order, those of the words that aren't near to one before, until so many."""
    chosen = list(chosen)
    for a in range(0, len(words), 200):
        if len(chosen) >= until:
            break
        some = words[a : a + 200]
        near, taken = kernel(some, chosen + some, 1), [*range(len(chosen))]
        for k, word in enumerate(some):
            if len(chosen) < until and (not taken or near[k, taken].max() < 0.8):
                taken.append(near.shape[1] - len(some) + k)
                chosen.append(word)
    return chosen


def learn(texts: list[str], labels: list[int], most_landmarks: int = 160, rounds: int = 4, pull: float = 1e-4) -> dict:
    """A model from texts and their labels, 0 or 1. A quarter of the rows is for the curve alone."""
    label = (np.array(labels) > 0).astype(np.int64)
    if len({*label.tolist()}) < 2:
        return {"machine": None, "share": float(label.max(initial=0))}
    vocabulary: dict[str, int] = {}
    names: list[str] = []
    forms: dict[str, int] = {}

    def number(word: str) -> int:
        if word not in vocabulary:
            form = folded(word)
            if form not in forms:
                forms[form] = len(names)
                names.append(form)
            vocabulary[word] = forms[form]
        return vocabulary[word]

    # sentences are told apart, so that those which copies of a text repeat count once
    of_words: dict[bytes, int] = {}
    every: list[np.ndarray] = []
    split: list[list[int]] = []
    for t in texts:
        own = []
        for words in sentences(t):
            x = np.array(sorted({*map(number, words)}))
            if x.tobytes() not in of_words:
                of_words[x.tobytes()] = len(every)
                every.append(x)
            own.append(of_words[x.tobytes()])
        split.append(own)
    tuning = np.zeros(len(texts), bool)
    for y in (0, 1):  # every fourth of a class, by the order of the rows
        tuning[np.flatnonzero(label == y)[3::4]] = True
    shown_clean = np.zeros(len(every), bool)
    shown_toxic = np.zeros(len(every), bool)
    for i in np.flatnonzero(~tuning).tolist():
        (shown_toxic if label[i] else shown_clean)[split[i]] = True
    shown_toxic &= ~shown_clean
    known = np.flatnonzero(shown_clean | shown_toxic)
    typical = typical_words([every[i] for i in known.tolist()], shown_toxic[known], len(names))

    clean = np.flatnonzero(shown_clean)
    toxic = [own for i, row in enumerate(split) if label[i] and not tuning[i] and len(own := np.array([s for s in row if shown_toxic[s]], np.int64))]
    typically = np.flatnonzero([shown_toxic[k] and typical[s].max() > 0 for k, s in enumerate(every)])
    in_clean = np.zeros(len(names), bool)
    in_clean[np.concatenate([np.empty(0, np.int64), *(every[i] for i in clean.tolist())])] = True
    long = np.array([3 < len(n) <= LONG for n in names], bool)  # what can be a landmark
    unsure = [np.array(sorted({*row}), np.int64) for i, row in enumerate(split) if label[i] and not tuning[i] and row]

    def fitted(marks: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
        """The landmarks' weights, the bias and the sentences' margins. Only the sentences' features are held whole."""
        own = Landmarks(marks)
        values, vectors = np.linalg.eigh(own.kernel(marks).astype(np.float64))
        keep = values > 1e-6
        root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        x = np.empty((len(every), root.shape[1]), np.float32)
        for a in range(0, len(every), 1024):
            some = every[a : a + 1024]
            words, at = np.unique(np.concatenate(some), return_inverse=True)
            z = own.kernel([names[i] for i in words.tolist()]) @ root
            x[a : a + len(some)] = np.add.reduceat(z[at], np.cumsum([0] + [len(s) for s in some[:-1]]))
        w, margins = np.zeros(x.shape[1] + 1), None
        for _ in range(rounds + 1):
            witness = typically
            if margins is not None:
                most = np.array([own_[margins[own_].argmax()] for own_ in toxic], np.int64)
                witness = np.union1d(typically, most[margins[most] > 0])
            words = np.unique(np.concatenate([every[s] for s in witness.tolist()]))
            tells = np.where(typical[words] > 0, typical[words], own.kernel([names[i] for i in words.tolist()]) @ (root @ w[:-1].astype(np.float32)))
            telling = np.array([every[s][tells[np.searchsorted(words, every[s])].argmax()] for s in witness.tolist()])
            spelt, at = np.unique(telling, return_inverse=True)
            plain = [names[i] for i in spelt.tolist()]
            varied = x[witness] + ((own.kernel([f"{n[: len(n) // 2 + 1]}x{n[len(n) // 2 + 1 :]}" for n in plain]) - own.kernel(plain)) @ root)[at]
            y, weigh = np.full(len(every), -1.0), np.zeros(len(every))
            weigh[clean] = 0.5 / len(clean)
            y[witness], weigh[witness] = 1.0, 0.25 / len(witness)
            blocks = [(x, y, weigh), (varied, np.ones(len(varied)), np.full(len(varied), 0.25 / len(varied)))]
            if margins is not None:
                shown = np.zeros(len(every), bool)
                shown[witness] = True
                rest = np.array([row[margins[row].argmax()] for row in unsure if not shown[row].any()], np.int64)
                if len(rest):
                    blocks.append((x[rest], np.ones(len(rest)), np.full(len(rest), 0.1 * 0.25 / len(witness))))
            w = least_squared_hinge(blocks, w, pull)
            margins = x @ w[:-1].astype(np.float32) + w[-1]
        return root.astype(np.float64) @ w[:-1], float(w[-1]), margins

    if not len(typically) or not len(clean):
        return {"machine": None, "share": float(label.mean())}
    telling = diverse([names[i] for i in np.argsort(-typical, kind="stable").tolist() if typical[i] > 0 and long[i]], [], most_landmarks // 2)
    often = np.bincount(np.concatenate(every), minlength=len(names)) * (long & (typical == 0))
    common = [names[i] for i in np.argsort(-often, kind="stable")[: most_landmarks - len(telling)].tolist() if often[i]]
    first = Machine(telling + common, *fitted(telling + common)[:2])
    weights = np.concatenate([first.weights_of(names[a : a + 10_000]) for a in range(0, len(names), 10_000)])
    # the words of clean sentences that look most toxic take the place of half of the common ones
    hard = [names[i] for i in np.argsort(-weights, kind="stable").tolist() if in_clean[i] and typical[i] == 0 and long[i] and weights[i] > 0]
    hard = diverse(hard, telling, len(telling) + len(common) // 2)[len(telling) :]
    marks = [*dict.fromkeys(telling + hard + common[: most_landmarks - len(telling) - len(hard)])]
    alpha, bias, margins = fitted(marks)
    row_margin = np.array([margins[row].max() if row else bias for row in split])
    return {"machine": (marks, alpha, bias)} | logistic(np.clip(row_margin[tuning], -1, 2), label[tuning] > 0)


def logistic(x: np.ndarray, y: np.ndarray) -> dict:
    """A logistic curve of margins, by Newton steps with the smoothed targets that keep it finite."""
    n1, n0 = int(y.sum()), int((~y).sum())
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, design.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0])), -2, 2)
    return {"a": max(float(beta[0]), 0.0), "b": float(beta[1])}


class Scorer:
    """Largest margins of texts; holds the weights of up to ``most`` words."""

    def __init__(self, machine: Machine, most: int = 500_000):
        self.machine, self.most, self.known = machine, most, {}

    def margins(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        split = [sentences(t) for t in texts]
        new = [w for w in {w for row in split for s in row for w in s} if w not in self.known]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            found = np.full(len(some), -np.inf)
            parts = [(k, p) for k, f in enumerate(map(folded, some)) for p in pieces(f)]
            for a in range(0, len(parts), 20_000):
                np.maximum.at(found, [k for k, _ in parts[a : a + 20_000]], self.machine.weights_of([p for _, p in parts[a : a + 20_000]]))
            self.known.update(zip(some, found.tolist(), strict=True))
        get, bias = self.known.__getitem__, self.machine.bias
        return np.array([bias + max((sum(map(get, s)) for s in row), default=0.0) for row in split])


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3_000, most_landmarks: int = 160) -> dict:
    """A model from labelled rows that aren't held out. ``most_rows`` bounds the labelled rows that are learnt
    from, the first by a hash, and so what the task that learns gets: their texts. The driver gets the landmarks, of
    which there are ``most_landmarks`` at most, and their weights. Nothing else is left out."""
    rows = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("label")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = bounded_sample(rows, most_rows, "doc_id", "label")
    # most_rows bounds what is sent, and what the one task holds
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def learnt(batches):
        got = sorted((i, y, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = learn([t for _, _, t in got], [y for _, y, _ in got], most_landmarks)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select("doc_id", "label", "text").repartition(1).mapInArrow(learnt, "model binary").first()
    return pickle.loads(made["model"]) if made else learn([], [])


def scores_of(model: dict, texts: list[str]) -> np.ndarray:
    """Scores from 0 to 1."""
    if model["machine"] is None:
        return np.full(len(texts), model["share"])
    landmarks, alpha, bias = model["machine"]
    scorer = kept_in_worker(("toxicity", alpha.tobytes(), bias), lambda: Scorer(Machine(landmarks, alpha, bias)))
    return 1 / (1 + np.exp(-np.clip(model["a"] * scorer.margins(texts) + model["b"], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def scores(batches):
        for b in split_batches(batches, 2 << 20):
            s = scores_of(model, b.column("text").to_pylist())
            yield batch_of(_SCORES, b.column("doc_id"), b.column("held_out"), s, (s >= 0.5).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""

    def stay(batches):
        for b in split_batches(batches, 2 << 20):
            texts = [t or "" for t in b.column("text").cast(pa.string()).to_pylist()]
            yield b.filter(pa.array(scores_of(model, texts) < 0.5))

    return docs.mapInArrow(stay, docs.schema)
