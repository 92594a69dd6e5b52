"""Language-model scoring with a gated recurrent network in numpy.

Words are counted over the whole corpus. The most frequent words are split into classes of like
frequency and the output softmax is factored: P(word) = P(class | state) P(word | class, state).
Words beyond them are in classes whose inner distribution is that of the counts; the last class
holds all words that are not broadcast, and one slot for unknown ones, so the model is a probability
over the same events as the count model that it is compared with. Training is truncated
backpropagation through time, with the state carried from window to window: a bounded sample starts
the network (and parts the rarer words into topics), then it learns from every training document, in
ROUNDS parts by a hash of the text; in each, every task trains a copy on its rows, and the copies are
averaged by their words. Scoring carries the state through the complete document.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

END = b""
#: Factors of the inputs of the gates z and r and of the new state n: 1 / (1 + exp(x)) and 2 / (1 + exp(x)) - 1 of the products are the gates.
SIGNS = np.array([-1, -1, -2], "float32")
#: What the gradients that training carries of n, of z, of r and of the states' share in n are to be multiplied by.
HALVES = np.array([0.5, 1, 0.5, 0.5], "float32")
SMOOTH = 0.1
#: Words that are broadcast with their counts; a bound. All others are joined.
HEAD = 200_000
NEURAL, PER_CLASS = 4096, 64
BINS = (16_384, 65_536, HEAD)
TOPICS = 6
HIDDEN = 24
LANES, ROUND_LANES, WINDOW = 64, 512, 24
SCORE_LANES, SCORE_WINDOW = 256, 64
#: Words that a task scores together, about.
SCORE_WORDS = 2_000_000
#: Rows whose logits are made at once; they fit in a core's cache.
BLOCK = 1024
#: Parts that all training documents are learned in, the rate there, words that a task holds at once,
#: and words of a text that the state is carried through in training.
ROUNDS, ROUND_RATE, CHUNK_WORDS, PIECE_WORDS = 2, 0.004, 800_000, 500
#: Places of a row whose gradients are summed beside those of other rows.
FEW = 32
#: Bytes of a piece of the parameters that are averaged together.
SLICE = 1 << 16
#: Copies of a slice that are averaged together.
FAN = 256
#: Documents and words of the sample that starts the network; longer texts than MAX_CHARS are not picked for it.
TRAIN_DOCS, TRAIN_WORDS, MAX_CHARS = 3000, 1_000_000, 30_000
#: Share of the count model that is mixed in.
BACKOFF = 0.02
#: Words that a task counts together.
FLUSH = 3_000_000


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts (bytes; null: none), one after another, and each text's number of words.

    Arrow's kernels cut at the characters of ``bytes.split`` and take any bytes for text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty piece
    if not some.all():
        words, offsets = words.filter(pa.array(some)), np.append(0, np.cumsum(some))[offsets]
    return words.view(pa.binary()), np.diff(offsets).astype("int64")


def split_batches(batches: Iterator[pa.RecordBatch], column: int, most: int, kept: list | None = None) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """``split_words`` of batches, as many together as have ``most`` words; their other columns go to ``kept``."""
    words, sizes, held = [], [], 0
    for b in batches:
        found, size = split_words(b.column(column))
        words.append(found)
        sizes.append(size)
        held += len(found) + len(size)
        if kept is not None:
            kept.append(b.columns[:column])
        if held >= most:
            yield words, sizes
            words, sizes, held = [], [], 0
    if sizes:
        yield words, sizes


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs`` (column ``b``: bytes): counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes in split_batches(batches, 0, FLUSH):
            words, n = pa.chunked_array(held, pa.binary()).value_counts().flatten()
            ends = pa.array([sum(map(len, sizes))], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, ends])], names=["word", "n"])

    return docs.select("b").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head words: number, count, class and, in a class, place or inner probability."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, topic: dict[bytes, int]):
        self.words, self.counts, self.total, self.distinct = words, counts.astype("float64"), total, distinct
        n = len(words)
        self.neural = min(NEURAL, n)
        self.n_neural_classes = -(-self.neural // PER_CLASS)
        cls = np.minimum(np.arange(n) // PER_CLASS, max(self.n_neural_classes - 1, 0))
        last, at = self.n_neural_classes, self.neural
        for edge in BINS:
            edge = min(edge, n)
            if edge > at:
                of = np.array([topic.get(w, TOPICS) for w in words[at:edge]])
                for value in np.unique(of):
                    cls[at:edge][of == value] = last
                    last += 1
                at = edge
        self.tail_class = last
        self.n_classes = last + 1
        self.cls = cls.astype("int32")
        self.base_z = total + SMOOTH * (distinct + 1)
        self.tail_z = max(self.base_z - (self.counts.sum() + SMOOTH * n), SMOOTH)
        mass = np.bincount(cls, weights=self.counts + SMOOTH, minlength=self.n_classes).astype("float64")  # without words it counts in integers
        self.inner = np.log((self.counts + SMOOTH) / np.maximum(mass[cls], 1e-300)) if n else np.zeros(0)
        self.class_mass = mass
        self.class_mass[self.tail_class] = self.tail_z
        #: input row of each word, the tail's at the end: its own for neural words, its class's for others
        self.inputs = np.where(np.arange(n) < self.neural, np.arange(n), self.neural + cls - self.n_neural_classes)
        self.inputs = np.append(self.inputs, self.neural + self.tail_class - self.n_neural_classes).astype("int32")
        self.n_inputs = self.neural + self.n_classes - self.n_neural_classes
        self.number = {w: i for i, w in enumerate(words)}
        self.cls = np.append(self.cls, self.tail_class).astype("int32")


class Network:
    """Gated recurrent network with a class-factored softmax; parameters are float32 arrays."""

    def __init__(self, v: Vocabulary, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        wc, ww = v.n_neural_classes, np.full((v.n_neural_classes, PER_CLASS), -30.0)
        for c in range(wc):
            rows = np.arange(c * PER_CLASS, min((c + 1) * PER_CLASS, v.neural))
            ww[c, : len(rows)] = v.inner[rows]
        f = lambda x: np.ascontiguousarray(x, "float32")
        self.p = {
            "x": f(rng.normal(0, 0.1, (v.n_inputs, 3 * h))), "u": f(rng.normal(0, 1 / math.sqrt(h), (h, 3 * h))), "bu": np.zeros(3 * h, "float32"),
            "c": f(rng.normal(0, 0.05, (h, v.n_classes))), "bc": f(np.log(v.class_mass / v.class_mass.sum())),
            "w": f(rng.normal(0, 0.05, (wc, h, PER_CLASS))), "bw": f(ww),
        }
        self.wide = np.zeros((wc, PER_CLASS), bool)
        for c in range(wc):
            self.wide[c, : min(PER_CLASS, v.neural - c * PER_CLASS)] = True

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of states (with their bias) and of inputs, by gate (z, r, n), times SIGNS."""
        u = np.vstack([self.p["u"], self.p["bu"]])
        return tuple(np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1)) * SIGNS[:, None, None] for x in (u, self.p["x"]))

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """States (HIDDEN x lanes) after words of the gathered input rows ``x`` (lanes x 3 HIDDEN), with the gates z, r and n."""
        after, made = np.array(h.T, "float32", order="C"), x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1) * SIGNS[:, None, None]
        with np.errstate(over="ignore"):
            advance(np.hstack([after, np.ones((len(x), 1), "float32")]), after, made, self.gates()[0])
        return after.T, *(gate.T for gate in made)

    def loss(self, hs: np.ndarray, words: np.ndarray, v: Vocabulary, grad: dict | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """log P(class), log P(word | class) of each word under its state (a row of ``hs``, with a last
        column of ones for the biases); with ``grad`` also the states' gradient. Words below zero are none
        and have zeros. Rows are taken in ``order``, that of ``by_class``, BLOCK at a time, so that their
        logits stay in the cache."""
        p, k = self.p, HIDDEN
        order = by_class(words, v) if order is None else order
        own, states = words[order], hs.take(order, axis=0)
        cls, n = v.cls[own], len(order)
        dh = None if grad is None else np.zeros((n + 1, k), "float32")  # the last row is that of no word
        outer, within = np.vstack([p["c"], p["bc"]]), np.concatenate([p["w"], p["bw"][:, None]], 1)
        if grad is not None:
            g_outer, g_within, outer_t, within_t = np.zeros_like(outer), np.zeros_like(within), np.ascontiguousarray(p["c"].T), np.ascontiguousarray(p["w"].swapaxes(1, 2))
        # states are within -1 and 1, so the parameters tell whether a logit can be too large for exp
        clip = max(float((np.abs(x[..., :k, :]).sum(-2) + x[..., k, :]).max(initial=0)) for x in (outer, within)) > 60
        widest = max(outer.shape[1], PER_CLASS)
        ones, upto, held = np.ones(widest, "float32"), np.arange(BLOCK), np.empty(BLOCK * widest, "float32")

        def softmax(at: int, end: int, weights: np.ndarray, spots: np.ndarray, logit: np.ndarray, total: np.ndarray) -> tuple:
            """Logits and sums of some rows; with ``grad`` the rows' softmax less one at the word, times the sum."""
            part, width, sums = states[at:end], weights.shape[1], total[at:end]
            flat = held[: len(part) * width]
            e = flat.reshape(len(part), width)
            np.matmul(part, weights, out=e)
            if clip:
                np.minimum(e, np.float32(60), out=e)
            spots = spots[at:end] + upto[: len(part)] * width
            flat.take(spots, out=logit[at:end], mode="clip")
            np.exp(e, out=e)
            np.matmul(e, ones[:width], out=sums)
            if grad is None:
                return ()
            flat[spots] -= sums
            sums = sums[:, None]
            return e, part / sums, sums

        logit_c, total_c = np.empty(n, "float32"), np.empty(n, "float32")
        for at in range(0, n, BLOCK):
            end = min(at + BLOCK, n)
            made = softmax(at, end, outer, cls, logit_c, total_c)
            if made:
                e, scaled, sums = made
                g_outer += (e.T @ scaled).T  # faster than scaled.T @ e
                np.divide(e @ outer_t, sums, out=dh[at:end])
        logit, total, places = np.zeros(n, "float32"), np.ones(n, "float32"), own - cls * PER_CLASS
        bounds = np.searchsorted(cls, np.arange(v.n_neural_classes + 1)).tolist()
        for c in range(v.n_neural_classes):
            for at in range(bounds[c], bounds[c + 1], BLOCK):
                end = min(at + BLOCK, bounds[c + 1])
                made = softmax(at, end, within[c], places, logit, total)
                if made:
                    e, scaled, sums = made
                    g_within[c] += (e.T @ scaled).T
                    back = e @ within_t[c]
                    back /= sums
                    dh[at:end] += back
        static = slice(bounds[-1], int(np.searchsorted(cls, v.tail_class)))
        logit[static] = v.inner[own[static]]
        log_c, inner = np.zeros(len(words), "float32"), np.zeros(len(words), "float32")
        log_c[order], inner[order] = logit_c - np.log(total_c), logit - np.log(total)
        if grad is not None:
            grad |= {"c": g_outer[:k], "bc": g_outer[k], "w": g_within[:, :k], "bw": g_within[:, k] * self.wide}
            place = np.full(len(words), n)
            place[order] = np.arange(n)
            dh = dh.take(place, axis=0)
        return log_c, inner, dh

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in sorted(self.p)])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for n in sorted(self.p):
            x = self.p[n]
            self.p[n] = np.array(values[at : at + x.size], "float32").reshape(x.shape)
            at += x.size

    def train(self, docs: list[np.ndarray], v: Vocabulary, rate: float = 0.006, moments: dict | None = None) -> None:
        """Truncated backpropagation: lanes of whole documents, windows of WINDOW words, carried states.

        With ``moments``, a dict that is kept from call to call, training goes on at an even rate."""
        if not docs or not v.neural:
            return
        ids, reset, _ = lanes(docs, LANES if moments is None else ROUND_LANES)
        k, h = HIDDEN, np.zeros((ids.shape[1], HIDDEN), "float32")
        held = {} if moments is None else moments
        if not held:
            held |= {"steps": 0, "mean": {n: np.zeros_like(x) for n, x in self.p.items()}, "square": {n: np.zeros_like(x) for n, x in self.p.items()}}
        begun, n_steps = held["steps"], -(-len(ids) // WINDOW)
        for step in range(n_steps):
            words, new = ids[step * WINDOW : (step + 1) * WINDOW], reset[step * WINDOW : (step + 1) * WINDOW]
            on_lanes = int((words[0] >= 0).sum())  # lanes are sorted by length, longest first
            words, new, h = words[:, :on_lanes], new[:, :on_lanes], h[:on_lanes]
            steps, lanes_n = words.shape
            fresh, inputs, (u, x) = new.any(1), v.inputs[words], self.gates()
            hs, made, less = np.ones((steps, lanes_n, k + 1), "float32"), np.empty((steps, 3, lanes_n, k), "float32"), np.empty((steps, lanes_n, k), "float32")
            shares = []
            with np.errstate(over="ignore"):  # an infinite exp gives the right limit, 0
                for t in range(steps):  # a lane goes on beyond its end, where it has no loss
                    if fresh[t]:
                        h[new[t]] = 0
                    hs[t, :, :k] = h
                    x.take(inputs[t], axis=1, out=made[t], mode="clip")
                    shares.append(advance(hs[t], h, made[t], u, less[t]))
            flat, order = hs.reshape(-1, k + 1), by_class(words.ravel(), v)
            count = max(1, len(order))
            grad: dict = {}
            dh_all = self.loss(flat, words.ravel(), v, grad, order)[2].reshape(steps, lanes_n, k)
            carried, d, u_back = np.zeros_like(h), np.empty((4, steps, lanes_n, k), "float32"), np.ascontiguousarray(u[:, :k].swapaxes(1, 2)) * HALVES[1:, None, None]
            for t in range(steps - 1, -1, -1):
                zr, n, (dn, dz, dr, dhn) = made[t, :2], made[t, 2], d[:, t]
                rest = zr[0] * carried
                np.multiply(n, n, out=dn)
                dn -= np.float32(1)
                carried -= rest
                dn *= carried
                slope = zr - np.float32(1)
                np.multiply(less[t], rest, out=dz)
                dz *= slope[0]
                slope[1] *= zr[1]
                np.multiply(dn, shares[t], out=dr)
                dr *= slope[1]
                np.multiply(dn, zr[1], out=dhn)
                back = d[1:, t] @ u_back
                np.add(rest, dh_all[t], out=carried)
                for part in back:
                    carried += part
                if fresh[t]:
                    carried[new[t]] = 0
            d = d.reshape(4, -1, k)
            scale = HALVES * SIGNS[[2, 0, 1, 2]]
            du = np.concatenate([flat.T @ x * s for x, s in zip(d[1:], scale[1:], strict=True)], 1)
            grad["u"], grad["bu"] = du[:k], du[k]
            touched, sums = sums_by_row(inputs.ravel().take(order), order, d[:3])
            grad["x"] = np.concatenate([sums[i] * scale[i] for i in (1, 2, 0)], 1)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) / count
            shrink = np.float32(min(1.0, 2.0 / max(norm, 1e-9)) / count)
            slower = 1 - 0.9 * step / n_steps if moments is None else 1.0
            done = begun + step + 1
            now = rate * slower * math.sqrt(1 - 0.998**done) / (1 - 0.9**done)
            held["steps"] = done
            for name, g in grad.items():
                g = g.astype("float32")
                g *= shrink
                at = touched if name == "x" else slice(None)  # rows without a gradient keep their moments
                mean, square = held["mean"][name][at], held["square"][name][at]
                change = g - mean
                change *= np.float32(0.1)
                mean += change
                g *= g
                g -= square
                g *= np.float32(0.002)
                square += g
                if name == "x":
                    held["mean"][name][at], held["square"][name][at] = mean, square
                np.sqrt(square, out=g)
                g += np.float32(1e-6)
                np.multiply(mean, np.float32(now), out=change)
                change /= g
                self.p[name][at] -= change

    def score(self, docs: list[np.ndarray], v: Vocabulary) -> np.ndarray:
        """Of each document the sum of log10 probabilities, for tail words without their own count."""
        out = np.zeros(len(docs))
        ids, reset, of = lanes(docs, SCORE_LANES)
        h, (u, x) = np.zeros((ids.shape[1], HIDDEN), "float32"), self.gates()
        base = np.append((v.counts + SMOOTH) / v.base_z, 1 / v.base_z) * BACKOFF
        scale = np.append(np.full(len(v.words), 1 - BACKOFF), (1 - BACKOFF) / v.tail_z)
        for start in range(0, len(ids), SCORE_WINDOW):
            words, new = ids[start : start + SCORE_WINDOW], reset[start : start + SCORE_WINDOW]
            on_lanes = int((words[0] >= 0).sum())  # lanes are sorted by length, longest first
            words, new, h = words[:, :on_lanes], new[:, :on_lanes], h[:on_lanes]
            fresh, inputs, made = new.any(1), v.inputs[words], np.empty((3, on_lanes, HIDDEN), "float32")
            hs = np.ones((*words.shape, HIDDEN + 1), "float32")
            with np.errstate(over="ignore"):  # an infinite exp gives the right limit, 0
                for t in range(len(words)):
                    if fresh[t]:
                        h[new[t]] = 0
                    hs[t, :, :HIDDEN] = h
                    x.take(inputs[t], axis=1, out=made, mode="clip")
                    advance(hs[t], h, made, u)
            live = words.ravel() >= 0
            flat = words.ravel()[live]
            log_c, inner = (found[live] for found in self.loss(hs.reshape(-1, HIDDEN + 1), words.ravel(), v)[:2])
            total = np.log(np.exp(log_c.astype("float64") + inner) * scale[flat] + base[flat])
            out += np.bincount(of[start : start + SCORE_WINDOW, :on_lanes].ravel()[live], weights=total, minlength=len(docs))
        return out / math.log(10)


def advance(states: np.ndarray, h: np.ndarray, made: np.ndarray, u: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
    """Takes ``h`` (lanes x HIDDEN) a word further, in place. ``states`` is ``h`` with a column of ones; ``made``
    has the words' input weights by gate, from ``Network.gates`` as ``u``, and gets z, r and n; ``less`` gets
    h - n. Returns the states' share in n, before r is applied. Overflows of exp are the caller's to ignore."""
    less, share, zr, n = h if less is None else less, states @ u, made[:2], made[2]
    zr += share[:2]
    np.exp(zr, out=zr)
    zr += np.float32(1)
    np.divide(np.float32(1), zr, out=zr)
    n += zr[1] * share[2]
    np.exp(n, out=n)
    n += np.float32(1)
    np.divide(np.float32(2), n, out=n)
    n -= np.float32(1)
    np.subtract(h, n, out=less)
    np.multiply(less, zr[0], out=h)
    h += n
    return share[2]


def by_class(words: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The places of all words of 0 and more, by class and, where words have inputs of their own, by word."""
    inputs = v.inputs[words].astype("uint16")  # few enough for numpy to sort by digits
    none = words < 0
    if not none.any():
        return np.argsort(inputs, kind="stable")
    inputs[none] = 65535
    return np.argsort(inputs, kind="stable")[: len(words) - int(none.sum())]


def sums_by_row(rows: np.ndarray, order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``rows`` (ascending; those of the places ``order``) and their sums of ``values`` (gates x places
    x HIDDEN). Rows of few places are summed together, first their first places, then their second ones."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    by = np.argsort(-sizes, kind="stable")  # so that those with another place come first
    starts, sizes = starts[by], sizes[by]
    found = rows[starts].astype("int64")
    many = int((sizes > FEW).sum())
    out, ones = np.empty((len(values), len(starts), values.shape[2]), "float32"), np.ones(sizes[0], "float32")
    for i, (at, size) in enumerate(zip(starts[:many].tolist(), sizes[:many].tolist(), strict=True)):
        np.matmul(ones[:size], values.take(order[at : at + size], axis=1), out=out[:, i])
    starts, sizes = starts[many:], sizes[many:]
    few = values.take(order[starts], axis=1)
    for i in range(1, FEW):
        if not (n := int((sizes > i).sum())):
            break
        few[:, :n] += values.take(order[starts[:n] + i], axis=1)
    out[:, many:] = few
    return found, out


def lanes(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid out in lanes, one after another, longest first to the shortest lane: word
    numbers (-1 beyond a lane's end), starts of documents, and document numbers; longest lane first."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    n = max(1, min(most, len(docs)))
    heap, held = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in order:
        size, lane = heap[0]
        held[lane].append(i)
        heapq.heapreplace(heap, (size + len(docs[i]), lane))
    held.sort(key=lambda own: -sum(len(docs[i]) for i in own))
    length = sum(len(docs[i]) for i in held[0])
    ids, of = np.full((n, length), -1, "int32"), np.zeros((n, length), "int32")
    reset = np.zeros((n, length), bool)
    for lane, own in enumerate(held):
        at = 0
        for i in own:
            ids[lane, at : at + len(docs[i])] = docs[i]
            of[lane, at : at + len(docs[i])] = i
            reset[lane, at] = len(docs[i]) > 0 if at < length else False
            at += len(docs[i])
    return np.ascontiguousarray(ids.T), np.ascontiguousarray(reset.T), np.ascontiguousarray(of.T)


def _topics(sample: list[list[bytes]], words: list[bytes]) -> dict[bytes, int]:
    """Word -> topic, from a k-means of the sample's documents over their most frequent words."""
    top = {w: i for i, w in enumerate(words[:256])}
    docs = [s for s in sample if len(s) >= 20]
    if len(docs) < 50:
        return {}
    x = np.zeros((len(docs), max(1, len(top))))
    for i, s in enumerate(docs):
        for w, n in Counter(s).items():
            if (j := top.get(w)) is not None:
                x[i, j] = math.sqrt(n)
    x /= np.sqrt((x**2).sum(1, keepdims=True)) + 1e-9
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(TOPICS, len(x)), replace=False)]
    for _ in range(15):
        of = (x @ centres.T).argmax(1)
        centres = np.array([x[of == j].mean(0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.sqrt((centres**2).sum(1, keepdims=True)) + 1e-9
    votes: dict[bytes, Counter] = {}
    share = np.bincount(of, minlength=len(centres)) + 1.0
    for s, topic in zip(docs, of.tolist(), strict=True):
        for w in set(s):
            votes.setdefault(w, Counter())[topic] += 1 / share[topic]
    return {w: c.most_common(1)[0][0] for w, c in votes.items()}


def learn(counts: DataFrame, train: DataFrame) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of counts (word, n) and training documents (b)."""
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("docs")).first()
    # The least count whose words fit in HEAD, from a histogram of the counts' logarithms.
    bins = counts.groupBy(F.floor(F.log2("n") * 32).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for r in bins:
        held += r["m"]
        if held > HEAD:
            break
        least = r["n"]
    head = [] if least is None else counts.where(F.col("n") >= least).collect()
    head.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in head]
    # A hash picks distinct texts at a rate that gives TRAIN_DOCS of them.
    rate = min(1.0, TRAIN_DOCS / max(totals["docs"] or 1, 1))
    picked = train.where(F.octet_length("b") <= MAX_CHARS).where(F.pmod(F.xxhash64("b"), F.lit(1 << 30)) < int(rate * (1 << 30))).distinct().collect()
    picked.sort(key=lambda r: zlib.crc32(r["b"]))
    sample = [words_of(bytes(r["b"])) for r in picked]
    vocabulary = Vocabulary(words, np.array([r["n"] for r in head], "float64"), totals["n"] or 0, totals["v"] or 0, _topics(sample, words))
    network = Network(vocabulary)
    docs, total = [], 0
    for s in sample:
        docs.append(numbers(vocabulary, s))
        total += len(docs[-1])
        if total > TRAIN_WORDS:
            break
    network.train(docs, vocabulary)
    return vocabulary, network


def learn_all(train: DataFrame, v: Vocabulary, net: Network, scratch: Scratch) -> int:
    """Trains ``net`` on every document of ``train`` (b) and returns the number of words learned from.

    The parameters of the tasks are averaged in slices and in a tree of FAN copies a node, so that no task or
    driver holds all copies. The tasks are those of the input, so its partitions have a say in the result."""
    if not v.neural:
        return 0
    spark, learned = train.sparkSession, 0
    for part in range(ROUNDS):
        held = spark.sparkContext.broadcast((v, net))  # at most HEAD words and the network

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            v, start = held.value
            from pyspark import TaskContext

            head, own = pa.array(v.words, pa.binary()), Network.__new__(Network)
            own.wide, own.p = start.wide, {n: x.copy() for n, x in start.p.items()}
            moments: dict = {}
            pieces, size, total = [], 0, 0
            for words, sizes in split_batches(batches, 0, CHUNK_WORDS):
                ids, starts = numbers_of_texts(v, head, words, sizes)
                for begin, end in itertools.pairwise(starts.tolist()):
                    for at in range(begin, end, PIECE_WORDS):
                        pieces.append(ids[at : min(at + PIECE_WORDS, end)])
                        size += len(pieces[-1])
                        if size >= CHUNK_WORDS:
                            own.train(pieces, v, ROUND_RATE, moments)
                            pieces, size, total = [], 0, total + size
            own.train(pieces, v, ROUND_RATE, moments)
            total += size
            if total:
                flat = own.flat()
                parts = [flat[i : i + SLICE // 4].astype("float32").tobytes() for i in range(0, len(flat), SLICE // 4)]
                task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), task, pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["at", "task", "n", "w"])

        def average(key: tuple, rows: pa.Table) -> pa.Table:
            total, out = 0, 0.0
            for n, w in zip(rows.column("n").to_pylist(), rows.column("w"), strict=True):
                out = out + n * np.frombuffer(w.as_py(), "float32").astype("float64")
                total += n
            return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([total], pa.int64()), "w": pa.array([(out / total).astype("float32").tobytes()], pa.binary())})

        own = train.where(F.pmod(F.xxhash64(F.coalesce("b", F.lit(b""))), F.lit(ROUNDS)) == part)
        kind = "at int, task int, n long, w binary"
        made = scratch.write(own.mapInArrow(run, kind), f"round{part}")
        last = made.agg(F.max("task")).first()[0]
        while last is not None:
            last //= FAN
            made = made.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("at", "task").applyInArrow(average, kind)
            if not last:
                break
        slices = made.orderBy("at").collect()  # one copy of the parameters
        held.unpersist()
        scratch.drop(f"round{part}")
        if slices:
            net.set_flat(np.concatenate([np.frombuffer(r["w"], "float32") for r in slices]))
            learned += slices[0]["n"]
    return learned


def numbers(v: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The words' numbers in the vocabulary and the end's; the number behind the last for all others."""
    return np.fromiter(map(v.number.get, [*words, END], repeat(len(v.words))), "int32", len(words) + 1)


def numbers_of_texts(v: Vocabulary, head: pa.Array, words: list[pa.Array], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``numbers`` of many texts, from their ``split_words`` and the vocabulary's words as ``head``: all numbers
    with the ends, one text after another, and where each text begins (and the last one ends)."""
    size = np.concatenate(sizes) if sizes else np.zeros(0, "int64")
    tail, starts = len(v.words), np.append(0, np.cumsum(size + 1))
    flat = np.full(starts[-1], v.number.get(END, tail), "int32")
    is_word = np.ones(len(flat), bool)
    is_word[starts[1:] - 1] = False
    flat[is_word] = pc.fill_null(pc.index_in(pa.chunked_array(words, pa.binary()), value_set=head), tail).to_numpy()
    return flat, starts


def lost_words(flat: np.ndarray, starts: np.ndarray, words: list[pa.Array], tail: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words without a number of their own: text, word and how often it occurs there."""
    at = np.flatnonzero(flat == tail)
    of = np.searchsorted(starts, at, "right") - 1
    end = at == starts[of + 1] - 1  # each text has one end, and either all of them are lost or none
    of_ends, at, of = of[end], at[~end], of[~end]
    coded = pa.concat_arrays([*words, pa.array([], pa.binary())]).take(pa.array(at - of)).dictionary_encode()
    keys, n = np.unique(of * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
    of, code = np.divmod(keys, max(len(coded.dictionary), 1))
    ends = pa.array([END] * len(of_ends), pa.binary())
    return np.concatenate([of, of_ends]), pa.concat_arrays([coded.dictionary.take(pa.array(code)), ends]), np.concatenate([n, np.ones(len(of_ends), "int64")])


_live: dict = {}


def score(docs: DataFrame, is_train, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score.

    ``is_train`` (a boolean column; null counts as true) marks the documents that are learned from;
    all are scored. Null and empty texts are the end token alone. Equal texts get scores that agree
    but for rounding. Very long texts are learned from and scored whole, with states carried along; an empty
    table stays empty. Without training documents every word is unknown. Columns with the names of
    added ones are replaced; names that start with two underscores are reserved.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c not in added and c != text_col]
    rows = docs.select(*kept, F.col(text_col).cast("binary").alias("b"), F.coalesce(is_train, F.lit(True)).alias("__train"))
    train = rows.where("__train").select("b")
    counts = scratch.write(count_words(train), "counts")
    scratch.free_shuffles()
    vocabulary, network = learn(counts, train)
    learn_all(train, vocabulary, network, scratch)
    held = spark.sparkContext.broadcast((vocabulary, network))  # at most HEAD words and the network
    key = scratch.root
    base_fields = rows.select(*kept).schema.fields
    extra = [("__uid", T.LongType()), ("n_tokens", T.LongType()), ("__known", T.LongType()), ("__base", T.DoubleType()), ("__score", T.DoubleType()), ("__word", T.BinaryType()), ("__n", T.LongType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in base_fields], *[T.StructField(n, t) for n, t in extra]])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if key not in _live:
            _live.clear()
            _live[key] = held.value
        v, net = _live[key]
        uid, head = TaskContext.get().partitionId() << 36, pa.array(v.words, pa.binary())
        tail = len(v.words)
        logs = np.append(np.log10(v.counts + SMOOTH), 0.0)
        columns: list[list[pa.Array]] = []
        # the documents of a group of batches share the lanes, so long ones leave few idle
        for words, sizes in split_batches(batches, n_kept, SCORE_WORDS, columns):
            flat, starts = numbers_of_texts(v, head, words, sizes)
            size, n = np.diff(starts), len(starts) - 1
            found = net.score([flat[a:b] for a, b in itertools.pairwise(starts.tolist())], v)
            of = np.repeat(np.arange(n), size)
            known = np.bincount(of, weights=flat < tail, minlength=n).astype("int64")
            base = np.bincount(of, weights=logs[flat], minlength=n)
            rest_of, rest_words, rest_n = lost_words(flat, starts, words, tail)
            m = len(rest_of)
            left = lambda x, t, m=m: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)])
            arrays = [pa.concat_arrays([*(c[i] for c in columns), pa.nulls(m, columns[0][i].type)]) for i in range(n_kept)]
            arrays += [
                pa.array(uid + np.concatenate([np.arange(n), rest_of]), pa.int64()), left(size, pa.int64()), left(known, pa.int64()), left(base, pa.float64()), left(found, pa.float64()),
                pa.concat_arrays([pa.nulls(n, pa.binary()), rest_words]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rest_n, pa.int64())]),
            ]
            uid += n
            columns.clear()
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    made = scratch.write(rows.select(*kept, "b").mapInArrow(run, schema), "made")
    rest = made.where("__word is not null").select("__uid", F.col("__word").alias("word"), F.col("__n").alias("m"))
    log_c = F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)
    rest = rest.join(counts, "word", "left").groupBy("__uid").agg(F.sum(F.col("m") * log_c).alias("__tail"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("__more"))
    whole = made.where("__word is null").drop("__word", "__n").join(rest, "__uid", "left")
    tail = F.coalesce("__tail", F.lit(0.0))
    return whole.select(
        *kept, "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("__base") + tail - F.col("n_tokens") * math.log10(vocabulary.base_z)).alias("base_score"), (F.col("__score") + tail).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return score(docs, ~held)
