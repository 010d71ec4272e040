"""The network that scores toxicity, its inputs and its training, in numpy alone: a process that trains needs
nothing of Spark. What it computes is told in toxicity.py."""

from __future__ import annotations

import pickle
import re
import sys
import zlib
from collections import Counter

import numpy as np

WINDOW, STRIDE = 64, 48
HIDDEN, ATTENTION = 8, 8
#: Numbers a word, width of a word's and of an n-gram's vector, and inputs in all.
NUMBERS, VECTOR = 7, 8
INPUTS = NUMBERS + 2 * VECTOR
#: Share of vectors left out in a step of training, and the rate at which the others move.
LEFT_OUT, VECTOR_RATE = 0.5, 0.005
#: Steps of gradient descent, whatever the sample's size.
STEPS, BATCH, RATE = 400, 64, 0.01
SHRINK = 8.0
THRESHOLD = 0.3
SEED = 11
#: Word hashes by which near copies among training rows are told.
SKETCH, COMMON = 24, 50
KEPT_WORDS = 200_000
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 1024, 20_000
words_in = re.compile(r"[^\W\d_]+").findall


def grams(word: str) -> list[str]:
    """Character n-grams of a word, its beginning marked."""
    marked = "<" + word
    n = len(marked)
    return [marked[i : i + 4] for i in range(n - 3)] + [marked[i : i + 5] for i in range(n - 4)]


def segment_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0)


def summed(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each owner."""
    return np.stack([np.bincount(owner, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1)


class Vectors:
    """Trained vectors of words and of n-grams, by number; number -1 has the last row, of zeros."""

    def __init__(self, words: int, grams: int, seed: int = SEED):
        r = np.random.default_rng(seed + 1)
        self.words, self.grams = ((0.1 * r.standard_normal((n + 1, VECTOR))).astype(np.float32) for n in (words, grams))
        self.words[-1] = self.grams[-1] = 0
        self.moved = [np.full(len(x), 1e-6) for x in (self.words, self.grams)]

    def of(self, word: np.ndarray, flat: np.ndarray, owner: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        """Both vectors of each word. flat: n-grams of all words, owner: whose they are."""
        n = len(word)
        count = np.maximum(1, np.bincount(owner[flat >= 0], minlength=n))
        out = np.concatenate((self.words[word], summed(self.grams[flat], owner, n) / count[:, None]), axis=1).astype(np.float32)
        if keep is not None:
            out *= np.repeat(np.stack(keep, axis=1), VECTOR, axis=1)
        return out

    def learn(self, word: np.ndarray, flat: np.ndarray, owner: np.ndarray, d: np.ndarray) -> None:
        """A step against the gradients d of what of() gave; each row by the size of its gradients so far."""
        known = flat >= 0
        count = np.maximum(1, np.bincount(owner[known], minlength=len(word)))
        for k, (table, at, g) in enumerate(((self.words, word, d[:, :VECTOR]), (self.grams, flat[known], (d[:, VECTOR:] / count[:, None])[owner[known]]))):
            rows, back = np.unique(at, return_inverse=True)
            g = summed(g, back, len(rows))
            self.moved[k][rows] += (g**2).sum(axis=1)
            table[rows] -= (VECTOR_RATE * g / np.sqrt(self.moved[k][rows])[:, None]).astype(np.float32)
            table[-1] = 0


class Inputs:
    """The inputs of any word: log-odds and vectors of words and n-grams, looked up by name."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], odds: tuple[np.ndarray, np.ndarray], vectors: Vectors):
        self.words, self.grams, self.odds = words, grams, odds
        self.tables = (vectors.words, vectors.grams)

    def of(self, words: list[str]) -> np.ndarray:
        get, n = self.grams.get, len(words)
        flat, owner = [], []
        begin = np.full((n, 2), -1)
        for i, word in enumerate(words):
            found = [get(g) for g in grams(word)]
            if found:
                begin[i, 0] = -1 if found[0] is None else found[0]
                at = len(word) - 2  # the first of five letters follows those of four
                five = found[at] if at < len(found) else found[0] if len(word) == 3 else None
                begin[i, 1] = -1 if five is None else five
            found = [g for g in found if g is not None]
            flat += found
            owner += [i] * len(found)
        flat, owner = np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)
        word = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=n)
        vectors = Vectors.__new__(Vectors)
        vectors.words, vectors.grams = self.tables
        numbers = numbers_of(word, flat, owner, begin, np.array([len(w) for w in words]), *self.odds)
        return np.concatenate((numbers, vectors.of(word, flat, owner)), axis=1)


def numbers_of(word: np.ndarray, flat: np.ndarray, owner: np.ndarray, begin: np.ndarray, length: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """The NUMBERS of each word. word, flat, begin: numbers of words and n-grams, -1 if unknown; odds end with a 0 for those."""
    n = len(word)
    out = np.zeros((n, NUMBERS), np.float32)
    out[:, 0] = word_odds[word]
    known = flat >= 0
    values, who = gram_odds[flat[known]], owner[known]
    if len(values):
        starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        some = who[starts]
        high = np.maximum(values, 0)
        out[some, 1] = largest = segment_max(high, starts)
        at = np.flatnonzero(high == np.repeat(largest, np.diff(np.append(starts, len(who)))))
        high[at[np.unique(who[at], return_index=True)[1]]] = 0  # one of each word's largest
        out[some, 2] = segment_max(high, starts)
        out[some, 3] = np.add.reduceat(values, starts) / np.diff(np.append(starts, len(who)))
    out[:, 4:6] = gram_odds[begin]
    out[:, 6] = np.minimum(length, 30) / 10
    return out


class Counts:
    """Words and n-grams of the training documents by number, and in how many documents of either label they are."""

    def __init__(self, texts: list[str], labels: list[int]):
        index: dict[str, int] = {}
        self.docs = [np.fromiter((index.setdefault(w, len(index)) for w in words_in(t.lower())), dtype=np.int32) for t in texts]
        self.words = list(index)
        parts: dict[str, int] = {}
        flat, sizes = [], []
        for w in self.words:
            ids = [parts.setdefault(g, len(parts)) for g in grams(w)]
            flat.append(np.array(ids, dtype=np.int32))
            sizes.append(len(ids))
        del index
        self.parts = list(parts)
        del parts
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.word_docs, self.part_docs = (np.zeros((2, n), np.int32) for n in (len(self.words), len(self.parts)))
        for ids, y in zip(self.docs, labels):
            mine = np.unique(ids)
            self.word_docs[y, mine] += 1
            if len(mine):
                self.part_docs[y, np.unique(np.concatenate([self.flat[self.ends[i] : self.ends[i + 1]] for i in mine]))] += 1
        self.share = sum(labels) / max(1, len(labels))

    def odds(self, counts: np.ndarray, own: int | None, least: int) -> np.ndarray:
        """Log-odds, shrunk towards 0; what is in fewer than `least` documents has none. own: the label of a
        document that is left out of the counts."""
        c, t = np.maximum(0, counts[0] - (own == 0)), np.maximum(0, counts[1] - (own == 1))
        out = np.log((t + SHRINK * self.share) / (c + SHRINK * (1 - self.share))) - np.log(self.share / (1 - self.share))
        return np.where(counts.sum(axis=0) >= least, out, np.nan)

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that words and n-grams have among those with log-odds, -1 for others."""
        out = []
        for counts, least in ((self.word_docs, 2), (self.part_docs, 3)):
            good = counts.sum(axis=0) >= least
            out.append(np.where(good, np.cumsum(good) - 1, -1).astype(np.int32))
        return out[0], out[1]

    def tables(self, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by those numbers, then a 0. own: for training documents of that label."""
        return tuple(np.append(o[~np.isnan(o)], 0.0) for o in (self.odds(self.word_docs, own, 2), self.odds(self.part_docs, own, 3)))

    def inputs(self, vectors: Vectors) -> Inputs:
        names = [{n: int(k) for n, k in zip(x, at.tolist()) if k >= 0} for x, at in zip((self.words, self.parts), self.known())]
        return Inputs(*names, self.tables(None), vectors)

    def matrix(self, own: int) -> np.ndarray:
        """The numbers of every word, as for a training document of that label."""
        n = len(self.words)
        word, gram = self.known()
        tables, length = self.tables(own), np.array([len(w) for w in self.words])
        out = np.empty((n, NUMBERS), np.float32)
        for at in range(0, n, WORDS_AT_ONCE):
            some = slice(at, min(n, at + WORDS_AT_ONCE))
            size, start, ends = length[some], self.ends[some], self.ends[at : some.stop + 1]
            begin = np.full((len(size), 2), -1)
            four, five, three = size >= 3, size >= 4, size == 3
            begin[four, 0] = gram[self.flat[start[four]]]
            begin[five, 1] = gram[self.flat[start[five] + size[five] - 2]]
            begin[three, 1] = begin[three, 0]  # the whole word is the beginning
            out[some] = numbers_of(word[some], gram[self.flat[ends[0] : ends[-1]]], np.repeat(np.arange(len(size)), np.diff(ends)), begin, size, *tables)
        return out


def windows(n: int) -> list[int]:
    """First words of the windows of a text of n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name; forward and backward over windows of one length."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        h = HIDDEN
        self.p = {
            "W": init(2, INPUTS, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "U": init(2, h, 3 * h), "bn": np.zeros((2, 1, h), np.float32),
            "A": init(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION, 1)[:, 0] * 0.5,
            "o": init(2 * h, 1)[:, 0], "c": np.zeros((), np.float32),
        }

    def project(self, x: np.ndarray) -> np.ndarray:
        """What inputs add to the gates, for both directions: [n, 2, 3 * HIDDEN]."""
        return np.einsum("nf,dfg->ndg", x, self.p["W"], optimize=True) + self.p["b"]

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: [steps, 2, windows, 3 * HIDDEN], the second direction reversed; mask: [steps, windows]."""
        steps, _, n, _ = gates.shape
        h, u, bn = HIDDEN, self.p["U"], self.p["bn"]
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((steps, 2, n, h), np.float32)
        memory = []
        both = np.stack((mask, mask[::-1]), axis=1)[..., None]
        for t in range(steps):
            x = gates[t]
            rec = np.matmul(state, u)
            zr = _sigmoid(x[..., : 2 * h] + rec[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            inner = rec[..., 2 * h :] + bn
            new = np.tanh(x[..., 2 * h :] + r * inner)
            m = both[t]
            if keep:
                memory.append((state, z, r, inner, new, m))
            state = state + m * (1 - z) * (new - state)
            states[t] = state
        seq = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)  # [steps, n, 2h]
        hidden = np.tanh(seq @ self.p["A"] + self.p["a"])
        e = hidden @ self.p["v"] + np.where(mask > 0, 0, -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = (e / e.sum(axis=0)).astype(np.float32)
        pooled = np.einsum("tn,tnh->nh", weight, seq)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (gates, memory, seq, hidden, weight, pooled)) if keep else logit

    def backward(self, kept, x: np.ndarray, dlogit: np.ndarray) -> dict:
        """Gradients of every parameter and, as "x", of the inputs x [steps, windows, INPUTS]."""
        gates, memory, seq, hidden, weight, pooled = kept
        steps, h, p = len(gates), HIDDEN, self.p
        g = {"o": pooled.T @ dlogit, "c": dlogit.sum()}
        dpooled = dlogit[:, None] * p["o"]
        dseq = weight[..., None] * dpooled
        dw = (seq * dpooled).sum(axis=-1)
        de = weight * (dw - (weight * dw).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", de, hidden)
        dhid = de[..., None] * p["v"] * (1 - hidden**2)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", seq, dhid, optimize=True), dhid.sum(axis=(0, 1))
        dseq += dhid @ p["A"].T
        dstates = np.stack((dseq[..., :h], dseq[::-1, :, h:]), axis=1)
        dU, dbn, dW, db = (np.zeros_like(p[k]) for k in ("U", "bn", "W", "b"))
        dstate, dx = np.zeros_like(dstates[0]), np.zeros(x.shape, dtype=x.dtype)
        for t in range(steps - 1, -1, -1):
            state, z, r, inner, new, m = memory[t]
            d = dstates[t] + dstate
            dnew = d * m * (1 - z) * (1 - new**2)
            dz = d * m * (state - new) * z * (1 - z)
            dr = dnew * inner * r * (1 - r)
            dinner = dnew * r
            dgate = np.concatenate((dz, dr, dnew), axis=-1)
            drec = np.concatenate((dz, dr, dinner), axis=-1)
            dstate = d * (1 - m * (1 - z)) + np.matmul(drec, p["U"].transpose(0, 2, 1))
            dU += np.matmul(state.transpose(0, 2, 1), drec)
            dbn += dinner.sum(axis=1, keepdims=True)
            two = np.stack((x[t], x[steps - 1 - t]))
            dW += np.matmul(two.transpose(0, 2, 1), dgate)
            db += dgate.sum(axis=1)
            dx[t] += dgate[0] @ p["W"][0].T
            dx[steps - 1 - t] += dgate[1] @ p["W"][1].T
        return g | {"U": dU, "bn": dbn, "W": dW, "b": db, "x": dx}

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: [steps, windows, INPUTS]."""
        steps, n, _ = x.shape
        gates = self.project(x.reshape(steps * n, -1)).reshape(steps, n, 2, -1).transpose(0, 2, 1, 3)
        gates = np.stack((gates[:, 0], gates[::-1, 1]), axis=1)
        return self.forward(gates, mask, keep)

    def fit(self, sample: "Sample", y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam for the network, and a step of the vectors with each of its steps."""
        r = np.random.default_rng(seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        k = 0
        while k < steps:
            order = r.permutation(len(y))
            for at in range(0, len(order), BATCH):
                i = order[at : at + BATCH]
                xs, ms, learn = sample.inputs(i, r)
                logit, kept = self.run(xs, ms, keep=True)
                grads = self.backward(kept, xs, ((_sigmoid(logit) - y[i]) / len(i)).astype(np.float32))
                learn(grads.pop("x")[..., NUMBERS:])
                norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
                k += 1
                for n, d in grads.items():
                    d = d * min(1.0, 5.0 / (norm + 1e-9))
                    first[n] = 0.9 * first[n] + 0.1 * d
                    second[n] = 0.999 * second[n] + 0.001 * d * d
                    step = RATE * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)
                    self.p[n] = (self.p[n] - step).astype(np.float32)


class Sample:
    """Training windows as word numbers, with what their words need for inputs."""

    def __init__(self, counts: Counts, numbers: np.ndarray, windows: np.ndarray, own: np.ndarray, vectors: Vectors):
        self.numbers, self.windows, self.own, self.vectors = numbers, windows, own, vectors
        self.word, gram = counts.known()
        self.flat, self.ends = gram[counts.flat], counts.ends

    def inputs(self, which: np.ndarray, r) -> tuple:
        """Inputs [steps, windows, INPUTS] and mask of some windows, and what to do with the gradients of their vectors."""
        ids = self.windows[which].T
        mask = (ids >= 0).astype(np.float32)
        words, back = np.unique(ids, return_inverse=True)
        back = back.reshape(ids.shape)
        sizes = np.diff(self.ends)[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        flat = self.flat[np.repeat(self.ends[:-1][words] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(owner))]
        keep = tuple((r.random(len(words)) >= LEFT_OUT) / (1 - LEFT_OUT) for _ in "wg")
        vectors = self.vectors.of(self.word[words], flat, owner, keep)
        x = np.concatenate((self.numbers[self.own[which][None, :], ids], vectors[back]), axis=2) * mask[..., None]

        def learn(d: np.ndarray) -> None:
            d = summed((d * mask[..., None]).reshape(-1, 2 * VECTOR), back.ravel(), len(words))
            self.vectors.learn(self.word[words], flat, owner, d * np.repeat(np.stack(keep, axis=1), VECTOR, axis=1))

        return x.astype(np.float32), mask, learn


class Scorer:
    """Inputs and network together; keeps the gates of the latest words."""

    def __init__(self, inputs: Inputs | None, network: Network, shift: float):
        self.inputs, self.network, self.shift = inputs, network, shift
        self.known: dict[str, int] = {}
        self.gates = None

    def __getstate__(self):
        return {"inputs": self.inputs, "network": self.network, "shift": self.shift, "known": {}, "gates": None}

    def _index(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.known)
        if self.gates is None or len(self.known) + len(new) > KEPT_WORDS:
            new = set().union(*texts)
            self.known = {}
            pad = self.network.project(np.zeros((1, INPUTS), np.float32))
            self.gates = np.empty((max(KEPT_WORDS, len(new)) + 1, *pad.shape[1:]), np.float32)
            self.gates[0] = pad[0]
        if new:
            new = list(new)
            x = self.inputs.of(new)
            at = len(self.known) + 1
            self.gates[at : at + len(new)] = self.network.project(x)
            self.known.update(zip(new, range(at, at + len(new))))

    def score(self, texts: list[str]) -> np.ndarray:
        """Score of each text."""
        if self.inputs is None:
            return np.full(len(texts), _sigmoid(self.shift))
        found = [words_in(x.lower()) for x in texts]
        self._index(found)
        rows, owner = [], []
        for i, words in enumerate(found):
            ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))
            starts = windows(len(ids))
            if len(ids) < WINDOW:
                ids = np.concatenate((ids, np.zeros(WINDOW - len(ids), np.int32)))
            rows.append(ids[np.array(starts)[:, None] + np.arange(WINDOW)])
            owner += [i] * len(starts)
        ids, owner = np.concatenate(rows), np.array(owner)
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(ids), WINDOWS_AT_ONCE):
            part = ids[at : at + WINDOWS_AT_ONCE].T
            mask = (part > 0).astype(np.float32)
            gates = np.stack((self.gates[part, 0], self.gates[part[::-1], 1]), axis=1)
            np.maximum.at(best, owner[at : at + WINDOWS_AT_ONCE], self.network.forward(gates, mask).astype(np.float64))
        return _sigmoid(best + self.shift)


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows less near copies of earlier rows: those that share half of their SKETCH least word hashes.
    Else the words of a text that was copied often would pass for marks of its label."""
    owners: dict[int, list[int]] = {}
    out = []
    for i, (text, y) in enumerate(rows):
        least = sorted({zlib.crc32(w.encode()) for w in words_in(text.lower())})[:SKETCH]
        telling = [owners.get(h, ()) for h in least]
        telling = [o for o in telling if len(o) <= COMMON]  # a common word's owners say nothing
        met = Counter(o for some in telling for o in some)
        if not met or max(met.values()) < max(2, len(telling) / 2):
            out.append((text, y))
            for h in least:
                owners.setdefault(h, []).append(i)
    return out


def train(rows: list[tuple[str, int]], share: float | None = None, seed: int = SEED) -> Scorer:
    """A scorer from (text, label) rows. share: of toxic rows where the scorer will be used."""
    rows = without_copies(sorted({(t or "", int(y)) for t, y in rows}))
    toxic = sum(y for _, y in rows)
    share = min(0.99, max(0.01, (toxic + 1) / (len(rows) + 2) if share is None else share))
    if toxic == 0 or toxic == len(rows):
        return Scorer(None, Network(seed), float(np.log(share / (1 - share))))
    counts = Counts([t for t, _ in rows], [y for _, y in rows])
    vectors = Vectors(*(int(x.max(initial=-1)) + 1 for x in counts.known()), seed)
    r = np.random.default_rng(seed)
    ids, ys = [], []
    numbers = np.stack([counts.matrix(own) for own in (0, 1)])
    for own in (0, 1):
        for words, (_, y) in zip(counts.docs, rows):
            if y != own:
                continue
            starts = windows(len(words))
            suspicion = [float(np.sort(numbers[own][words[s : s + WINDOW], :3].max(axis=1, initial=0))[-4:].sum()) for s in starts]
            chosen = {starts[int(np.argmax(suspicion))]} | ({starts[int(r.integers(len(starts)))]} if not y else set())
            for s in sorted(chosen):
                part = words[s : s + WINDOW].astype(np.int64)
                ids.append(np.pad(part, (0, WINDOW - len(part)), constant_values=-1))
                ys.append(y)
    y = np.array(ys)
    inputs, sample = counts.inputs(vectors), Sample(counts, numbers, np.stack(ids), y, vectors)
    del counts  # the names of all n-grams, which nothing needs from here on
    network = Network(seed)
    network.fit(sample, y.astype(np.float32), seed=seed)
    seen = y.mean()
    return Scorer(inputs, network, float(np.log(share / (1 - share)) - np.log(seen / (1 - seen))))


def answer() -> None:
    """Trains on what standard input brings, arguments of train(), and writes the scorer to standard output."""
    rows, share = pickle.load(sys.stdin.buffer)
    pickle.dump(train(rows, share), sys.stdout.buffer)
