"""Log-likelihood of whole documents under a gated recurrent language model in numpy.

Tokens are words between ASCII white space, A-Z lower-cased, and one end. The
`frequent` words with most tokens (and the end) have an output each; all others
share `tails` outputs by their last bytes. Outputs make classes of `width` by rank,
and the model is P(class | state) P(output | class, state): both are softmax layers
over the state of a gated recurrent unit. A tail's outputs depend on the state like
any other; among the words that share one, a word has its smoothed share of their
counts, and one share is kept for unknown words, so probabilities sum to one.

Counts cover all training rows and stay distributed; the `table` words with most
tokens (at least the frequent ones) are broadcast, counts of the others are joined
to the rare words of each document. `frequent` bounds the network, which every task
holds and sends back once, so that tasks follow the input's splits. The network is started by truncated backpropagation on a bounded
sample of training documents (`sample` rows of up to `max_bytes`) and then trained
for an epoch over all training rows as whole texts: each task trains a copy, and the
changes are averaged, weighted by how often a task saw the word or class they belong
to. State is carried from window to window and reset at document starts, in training
and in scoring. Which rows share a task follows the input's partitions, and with it
the last digits of `score`.

Defined results: a NULL, empty or blank text is one end token; a NULL id is not
held out and not learned from; without training rows N = V = 0 and base scores
are 0; ties in counts go by word; repeated rows are scored and counted each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, id_text, pieces, settle, utf8
from .runs import split

END = b"\n"
LONGEST = 64
_loaded: dict = {}


def tail_of(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


class Lookup:
    """Places of words among `words`; of a word that is not there, its tail after them."""

    def __init__(self, words: list[bytes], tails: int):
        self.words, self.tails = pa.array(words, pa.large_binary()), tails

    def __call__(self, names: pa.Array) -> np.ndarray:
        found = pc.index_in(names, value_set=self.words)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            gone = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            last = pc.binary_slice(names.take(pa.array(gone)), -3).dictionary_encode()
            of = np.array([tail_of(w, self.tails) for w in last.dictionary.to_pylist()], np.int64)
            at[gone] = len(self.words) + of[last.indices.to_numpy()]
        return at


def laid(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of a text column (the end last), the index of every token among them, and the row bounds in tokens."""
    data, offsets = utf8(column)
    words, index, bounds = split(LOWER[data], offsets)
    names = pa.concat_arrays([words, pa.array([END], words.type)])
    return names, np.insert(index, bounds[1:], len(names) - 1), bounds + np.arange(len(bounds))


def word_counts(rows: DataFrame, most: int = 12 << 20) -> DataFrame:
    """(word, c) over all `rows` (text); counted in pieces of `most` bytes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most=most):
                names, index, _ = laid(piece.column(0))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(index, minlength=len(names)))], ["word", "c"])

    return rows.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def starting(fresh: np.ndarray, sizes: np.ndarray) -> list[bool]:
    """Which steps of a window start a lane anew."""
    return (np.add.reduceat(fresh.astype(np.int32), np.cumsum([0, *sizes[:-1]])) > 0).tolist()


def window_of(starts: np.ndarray, lengths: np.ndarray, at: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes in each step of a window over lanes that lie one after the other, longest first; lane and place of each of their tokens."""
    steps = np.arange(at, upto)
    sizes = np.searchsorted(-lengths, -steps, "left")  # lanes longer than the step
    lane = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sizes, lane, starts[lane] + np.repeat(steps, sizes)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place, of values up to 60, and their sums by row."""
    if z.max(initial=0) > 60:
        np.minimum(z, np.float32(60), out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z, total = _exp(z)
    z *= (1 / total)[:, None]
    return z


def grouped(rows: np.ndarray, times: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of `times` rows each, one group after the other: groups of a few rows side by side, larger ones by themselves."""
    first = np.cumsum(times) - times
    sums = rows.take(first, 0)
    for i in range(1, few):
        more = np.flatnonzero(times > i)
        sums[more] += rows.take(first[more] + i, 0)
    ones = np.ones(times.max(), rows.dtype)
    for k in np.flatnonzero(times > few).tolist():
        sums[k] += ones[few:times[k]] @ rows[first[k] + few:first[k] + times[k]]
    return sums


def with_one(h: np.ndarray, by: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows `by` of `h`, and a column of ones, in `out`."""
    out[:, :-1] = h.take(by, 0)
    out[:, -1] = 1
    return out


def together(cuts: np.ndarray, most: int = 2048) -> Iterator[list[int]]:
    """Groups that are not empty, in order, in lists of about `most` rows: what is done with a list stays in the cache."""
    some: list[int] = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        if some and cuts[k + 1] - cuts[some[0]] > most:
            yield some
            some = []
        some.append(k)
    if some:
        yield some


class Room(dict):
    """Arrays by name that are used again, so that a window does not ask for its memory anew."""

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size or self[name].dtype != dtype:
            self[name] = np.empty(size, dtype)
        return self[name][:size].reshape(shape)


@dataclass
class Network:
    """Parameters by name; codes are frequent words, then tails, then the start; `width` codes in a row are a class."""

    p: dict[str, np.ndarray]
    frequent: int
    width: int
    tails: int

    @property
    def heads(self) -> int:
        return -(-(self.frequent + self.tails) // self.width)

    def run(self, x: np.ndarray, fresh: np.ndarray, sizes: np.ndarray, h: np.ndarray, room: Room, keep: bool = True) -> tuple[np.ndarray, ...]:
        """Steps of `sizes` lanes each, one after the other, on inputs `x` from states `h`; a lane starts anew where `fresh`.

        States, and with `keep` states before, gates, candidates, and the recurrent part (its first two blocks halved), a row
        for each input in each of their blocks. They are arrays of `room`: the next call overwrites them.
        """
        n, kind, held = h.shape[1], h.dtype, len(x) if keep else int(sizes.max(initial=0))
        halves = np.array([0.5, 0.5, 1], kind)[:, None, None]  # the logistic function is a tanh of half its argument
        rec = self.blocks() * halves
        a = room("a", kind, 3, len(x), n)
        if keep:
            rows = room("rows", kind, len(x), 3, n)
            np.take(self.p["in"], x, 0, rows.reshape(len(x), 3 * n), "clip")
            np.multiply(rows.transpose(1, 0, 2), halves, out=a)
        else:  # longer windows, for which the whole table is halved sooner than its rows
            table = np.multiply(self.p["in"].reshape(-1, 3, n).transpose(1, 0, 2), halves, out=room("table", kind, 3, len(self.p["in"]), n))
            for block, given in zip(table, a):
                np.take(block, x, 0, given, "clip")
        u, gate = room("u", kind, 3, held, n), room("gate", kind, 2, held, n)
        m, before, out = room("m", kind, held, n), room("before", kind, held, n), room("out", kind, len(x), n)
        bounds = np.cumsum([0, *sizes]).tolist()
        for at, upto, anew in zip(bounds, bounds[1:], starting(fresh, sizes)):
            own = slice(at, upto) if keep else slice(0, upto - at)
            given, old, w, g, c = a[:, at:upto], before[own], u[:, own], gate[:, own], m[own]
            old[:] = h[:upto - at]
            if anew:
                old[fresh[at:upto]] = 0
            np.matmul(old, rec, out=w)
            np.add(w[:2], given[:2], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[0], w[2], out=c)
            c += given[2]
            np.tanh(c, out=c)
            h = np.subtract(old, c, out=out[at:upto])
            h *= g[1]
            h += c
        return out, before, gate, m, u

    def blocks(self) -> np.ndarray:
        """The recurrent weights of each gate and of the candidate."""
        n = self.p["rec"].shape[0]
        return np.ascontiguousarray(self.p["rec"].reshape(n, 3, n).transpose(1, 0, 2))

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return y // self.width

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the codes in which each class lies together, and the bounds of the classes in it."""
        c = self.class_of(y).astype(np.min_scalar_type(self.heads))  # few bits sort fast
        return np.argsort(c, kind="stable"), np.cumsum([0, *np.bincount(c, minlength=self.heads)])

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of outputs, the bias as a further row: `with_one` states times these."""
        return np.concatenate([self.p["cls"], self.p["cls_b"][None]]), np.concatenate([self.p["out"], self.p["out_b"][:, None]], 1)

    def outputs(self, h: np.ndarray, cuts: np.ndarray, layer: np.ndarray) -> np.ndarray:
        """Scores of the codes of the class of each state, `with_one`; `cuts` bound the classes' states."""
        z = np.empty((len(h), self.width), h.dtype)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            np.matmul(h[own], layer[k], out=z[own])
        return z

    def score(self, h: np.ndarray, y: np.ndarray, most: int = 1 << 13) -> np.ndarray:
        """Natural log probability of codes `y` at states `h`. At most `most` rows at once."""
        if len(y) > most:
            return np.concatenate([self.score(h[at:at + most], y[at:at + most], most) for at in range(0, len(y), most)])
        by, cuts = self.by_class(y)
        h, y, every = with_one(h, by, np.empty((len(y), h.shape[1] + 1), h.dtype)), y[by], np.arange(len(y))
        out = np.empty(len(y), h.dtype)
        cls, own = self.layers()
        own = self.outputs(h, cuts, own)
        found = own[every, y % self.width]
        found -= np.log(_exp(own)[1])
        c, room = self.class_of(y), np.empty((512, self.heads), h.dtype)
        for at in range(0, len(y), 512):  # parts that stay in the cache
            part = slice(at, at + 512)
            z = np.matmul(h[part], cls, out=room[:len(c[part])])
            found[part] += z[every[:len(z)], c[part]]
            found[part] -= np.log(_exp(z)[1])
        out[by] = found
        return out


def start(counts: np.ndarray, frequent: int, width: int, tails: int, hidden: int) -> Network:
    """A network whose output biases are the logarithms of the counts (frequent words, then tails)."""
    rng = np.random.default_rng(5)
    heads = -(-(frequent + tails) // width)
    words = np.zeros(heads * width)
    words[:frequent + tails] = counts + 1
    words = words.reshape(heads, width)
    mass = words.sum(1)
    f = np.float32
    small = lambda *s: rng.normal(0, 0.1, s).astype(f)
    return Network({
        "in": small(frequent + tails + 1, 3 * hidden), "rec": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(f),
        "cls": small(hidden, heads), "cls_b": np.log(mass / mass.sum()).astype(f),
        "out": small(heads, hidden, width), "out_b": np.where(words > 0, np.log(np.maximum(words, 1e-9) / words.sum(1, keepdims=True)), -40).astype(f),
    }, frequent, width, tails)


def lay(docs: list[np.ndarray], lanes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole documents dealt to lanes of about equal length: codes lane after lane, where a document starts, and starts and lengths of the lanes, longest first."""
    heap = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + len(docs[i]), k))
    held = sorted(([own[j] for j in rng.permutation(len(own))] for own in held if own), key=lambda own: -sum(len(docs[i]) for i in own))
    order = [i for own in held for i in own]
    fresh = np.zeros(sum(len(docs[i]) for i in order), bool)
    fresh[np.cumsum([0, *(len(docs[i]) for i in order)])[:-1]] = True
    lengths = np.array([sum(len(docs[i]) for i in own) for own in held])
    return np.concatenate([docs[i] for i in order]), fresh, np.cumsum([0, *lengths[:-1]]), lengths


@dataclass
class Learner:
    """A network in training: sums of squared gradients (Adagrad), and how often each input row and each class was seen."""

    net: Network
    squares: dict[str, np.ndarray]
    inputs: np.ndarray
    classes: np.ndarray
    room: Room = field(default_factory=Room)

    @classmethod
    def of(cls, net: Network, squares: dict[str, np.ndarray] | None = None) -> Learner:
        """A learner on copies of what is given, which has seen nothing."""
        own = Network({k: v.copy() for k, v in net.p.items()}, net.frequent, net.width, net.tails)
        made = {k: squares[k].copy() if squares else np.zeros_like(v) for k, v in net.p.items()}
        return cls(own, made, np.zeros(len(net.p["in"])), np.zeros(net.heads))

    def move(self, name: str, at, g: np.ndarray, rate: float) -> None:
        root = np.multiply(g, g, out=self.room("root", g.dtype, *g.shape))
        root += self.squares[name][at]
        self.squares[name][at] = root
        np.sqrt(root, out=root)
        root += 1e-8
        np.divide(g, root, out=root)
        root *= rate
        self.net.p[name][at] -= root

    def learn(self, docs: list[np.ndarray], lanes: int = 512, window: int = 16, epochs: int = 1, rate: float = 0.1, most: int = 8192) -> None:
        """Truncated backpropagation over whole documents on lanes, state kept between windows, reset at starts.

        A window is `window` steps long, and longer where fewer lanes are left, so that an update sees about `most` tokens
        and the longest documents do not take an update for every few tokens.
        """
        net, hidden = self.net, self.net.p["rec"].shape[0]
        total = sum(len(d) for d in docs)
        if not total:
            return
        lanes = min(lanes, max(1, total // (16 * window)))
        rng = np.random.default_rng(9)
        for _ in range(epochs):
            flat, fresh, starts, lengths = lay(docs, lanes, rng)
            given = np.where(fresh, flat.dtype.type(net.frequent + net.tails), np.roll(flat, 1))
            h = np.zeros((len(lengths), hidden), net.p["rec"].dtype)
            at = 0
            while at < lengths[0]:
                left = int(np.searchsorted(-lengths, -at, "left"))
                upto = min(at + max(window, min(most // left, 512)), int(lengths[0]))
                sizes, _, place = window_of(starts, lengths, at, upto)
                x, anew = given[place], fresh[place]
                held = net.run(x, anew, sizes, h, self.room)
                h = held[0][len(x) - sizes[-1]:].copy()
                self._update(x, anew, sizes, held, flat[place], rate)
                at = upto

    def _update(self, x: np.ndarray, fresh: np.ndarray, sizes: np.ndarray, held: tuple[np.ndarray, ...], target: np.ndarray, rate: float) -> None:
        net, p, n = self.net, self.net.p, self.net.p["rec"].shape[0]
        states, before, gate, m, u = held
        by, cuts = net.by_class(target)
        s, target, scale = with_one(states, by, self.room("s", states.dtype, len(by), n + 1)), target[by], np.float32(1 / len(target))
        c, spot = net.class_of(target), target % net.width
        self.classes += np.diff(cuts)
        room, kind, every = self.room, states.dtype, np.arange(len(s))
        dh, more = room("dh", kind, *states.shape), room("more", kind, *states.shape)
        cls, out = net.layers()
        g, turned, z = np.zeros_like(cls), np.ascontiguousarray(cls[:-1].T), room("z", kind, 512, cls.shape[1])
        for at in range(0, len(s), 512):  # parts that stay in the cache
            part = slice(at, at + 512)
            d = _softmax(np.matmul(s[part], cls, out=z[:len(s[part])]))
            d[every[:len(d)], c[part]] -= 1
            np.matmul(d, turned, out=dh[part])
            g += s[part].T @ d
        g *= scale
        self.move("cls", slice(None), g[:-1], rate)
        self.move("cls_b", slice(None), g[-1], rate)
        g, turned, z = room("g", kind, *out.shape), np.ascontiguousarray(p["out"].transpose(0, 2, 1)), room("own", kind, len(s), net.width)
        g.fill(0)
        for some in together(cuts):
            part = slice(cuts[some[0]], cuts[some[-1] + 1])
            d = z[part]
            for k in some:
                own = slice(cuts[k], cuts[k + 1])
                np.matmul(s[own], out[k], out=z[own])
            _softmax(d)
            d[every[:len(d)], spot[part]] -= 1
            for k in some:
                own = slice(cuts[k], cuts[k + 1])
                np.matmul(z[own], turned[k], out=more[own])
                np.matmul(s[own].T, z[own], out=g[k])
        dh += more
        g *= scale
        # classes without a target have no gradient and stay
        self.move("out", slice(None), g[:, :-1], rate)
        self.move("out_b", slice(None), g[:, -1], rate)
        dh *= scale
        ds = more
        ds[by] = dh
        # what a state's gradient becomes at each gate and at the candidate, for the whole window at once
        r, z, gu = gate[0], gate[1], room("gu", kind, 3, len(x), n)
        shut, cand = np.subtract(1, z, out=room("shut", kind, len(x), n)), np.multiply(m, m, out=room("cand", kind, len(x), n))
        np.subtract(1, cand, out=cand)
        cand *= shut
        np.multiply(cand, r, out=gu[2])
        np.subtract(1, r, out=gu[0])
        gu[0] *= gu[2]
        gu[0] *= u[2]
        np.subtract(before, m, out=gu[1])
        gu[1] *= z
        gu[1] *= shut
        back, turned = np.zeros((0, n), kind), np.ascontiguousarray(net.blocks().transpose(0, 2, 1))
        bounds = np.cumsum([0, *sizes]).tolist()
        for at, upto, anew in zip(bounds[-2::-1], bounds[:0:-1], reversed(starting(fresh, sizes))):
            g, own = ds[at:upto], gu[:, at:upto]
            g[:len(back)] += back
            own *= g
            back, *rest = np.matmul(own, turned, out=room("back", kind, *own.shape))
            for other in rest:
                back += other
            back += np.multiply(g, z[at:upto], out=rest[0])
            if anew:
                back[fresh[at:upto]] = 0
        self.move("rec", slice(None), np.matmul(before.T, gu).transpose(1, 0, 2).reshape(n, 3 * n), rate)
        cand *= ds
        times = np.bincount(x, minlength=len(self.inputs))
        rows = np.flatnonzero(times)
        self.inputs += times
        order, wide, block = np.argsort(x.astype(np.min_scalar_type(len(times))), kind="stable"), room("rows", kind, len(x), 3, n), room("s", kind, len(x), n)
        for k, part in enumerate((gu[0], gu[1], cand)):  # the input's part of the candidate, which the gate does not weigh
            wide[:, k] = np.take(part, order, 0, block, "clip")
        self.move("in", rows, grouped(wide.reshape(len(x), -1), times[rows]), rate)

    def weights(self) -> dict[str, np.ndarray]:
        """How much was seen by what each parameter belongs to, in the parameters' shapes or ones that broadcast to them."""
        every, heads = np.array(self.classes.sum()), self.classes[:self.net.heads]
        return {"in": self.inputs[:, None], "rec": every, "cls": every, "cls_b": every, "out": heads[:, None, None], "out_b": heads[:, None]}

    def told(self, base: Network) -> np.ndarray:
        """Changes since `base` times their weights, then the weights: sums over learners give averages."""
        changes = [((v - base.p[k]) * self.weights()[k]).ravel() for k, v in self.net.p.items()]
        return np.concatenate([*changes, self.inputs, self.classes]).astype(np.float32)


def averaged(base: Network, told: np.ndarray) -> Network:
    """`base` plus the weighted mean of the learners' changes, from the sum of what they `told`."""
    sums = Learner.of(base)
    sums.classes = told[len(told) - len(sums.classes):]
    sums.inputs = told[len(told) - len(sums.classes) - len(sums.inputs):len(told) - len(sums.classes)]
    at, weights = 0, sums.weights()
    for k, v in sums.net.p.items():
        v += (told[at:at + v.size].reshape(v.shape) / np.maximum(weights[k], 1)).astype(np.float32)
        at += v.size
    return sums.net


def train_all(rows: DataFrame, net: Network, squares: dict[str, np.ndarray], words: list[bytes], codes: np.ndarray, n_tokens: int, block: int = 1 << 14, most: int = 1 << 22) -> Network:
    """One epoch over all `rows` (text), whole texts: a learner in each task, then the mean of the learners.

    A task reads at least four tokens for each parameter, so that what is shuffled stays a share of the input. Texts are
    learned together once they have `most` tokens, which keeps the lanes beside long texts filled.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((net, squares, words, codes))
    size = sum(v.size for v in net.p.values()) + len(net.p["in"]) + net.heads

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, squares, words, codes = shared.value
        table, own = Lookup(words, base.tails), None
        codes, docs, held = codes.astype(np.min_scalar_type(len(base.p["in"]))), [], 0
        for batch in batches:
            for piece in pieces(batch, most=12 << 20):
                own = own or Learner.of(base, squares)
                names, index, bounds = laid(piece.column(0))
                coded = codes[table(names)][index]
                docs += [coded[a:b] for a, b in zip(bounds, bounds[1:])]
                held += len(coded)
                if held >= most:
                    own.learn(docs)
                    docs, held = [], 0
        if docs:
            own.learn(docs)
        told = own.told(base) if own else np.zeros(0, np.float32)
        for at in range(0, len(told), block):
            yield pa.RecordBatch.from_arrays([pa.array([at // block], pa.int32()), pa.array([told[at:at + block].tobytes()], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["block", "part"])

    kind = "block int, part binary"
    tasks = max(sc.defaultParallelism, n_tokens // (4 * size))
    found = rows.select("text").coalesce(tasks).mapInArrow(learn, kind).repartition("block").mapInArrow(add, kind).toArrow()
    shared.unpersist()
    if not found.num_rows:
        return net
    told = np.zeros(size)
    for k, part in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        told[k * block:k * block + len(part) // 4] = np.frombuffer(part, np.float32)
    return averaged(net, told)


def document_scores(net: Network, docs: list[np.ndarray], window: int = 32) -> np.ndarray:
    """Natural log-likelihood of each code sequence; longest first, so that ended ones leave the batch."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    order = np.argsort([-len(d) for d in docs], kind="stable")
    lengths = np.array([len(docs[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([docs[i] for i in order])
    given = np.roll(flat, 1)
    given[starts] = net.frequent + net.tails
    h = np.zeros((len(docs), net.p["rec"].shape[0]), net.p["rec"].dtype)
    total, room = np.zeros(len(docs)), Room()
    at = 0
    while at < lengths[0]:
        # longer windows where fewer sequences are left
        left = int(np.searchsorted(-lengths, -at, "left"))
        upto = min(at + max(min(window, 1 + 16384 // left), min(8192 // left, 512)), int(lengths[0]))
        sizes, lane, place = window_of(starts, lengths, at, upto)
        states = net.run(given[place], np.zeros(len(place), bool), sizes, h, room, keep=False)[0]
        h = states[len(place) - sizes[-1]:].copy()
        total[:left] += np.bincount(lane, net.score(states, flat[place]), left)
        at = upto
    out[order] = total
    return out


@dataclass
class Model:
    """The broadcast part: table words with codes and logarithms, totals, tails and the network."""

    words: list[bytes]
    log_c: np.ndarray
    codes: np.ndarray
    tail_log: np.ndarray
    n: int
    v: int
    net: Network


def _lookup(shared) -> tuple[Model, Lookup]:
    if shared.id not in _loaded if hasattr(shared, "id") else True:
        model: Model = shared.value
        table = Lookup(model.words, model.net.tails)
        _loaded.clear()
        _loaded[getattr(shared, "id", 0)] = (model, table)
    return _loaded[getattr(shared, "id", 0)]


def fit(docs: DataFrame, learn: Column, frequent: int = 4096, width: int | None = None, tails: int = 2048, table: int = 131072, hidden: int = 16, sample: int = 1500, max_bytes: int = 16384) -> tuple[Model, DataFrame]:
    """The model, and the settled counts (word, c) of the training words that are not in its table."""
    rows = id_text(docs).where(F.coalesce(learn, F.lit(False)))
    counts = settle(word_counts(rows))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(whole["n"] or 0), int(whole["v"])
    table = max(table, frequent)
    short = F.octet_length("word") <= LONGEST
    top = counts.where(short & (F.col("word") != END.decode())).orderBy(F.desc("c"), "word").limit(table - 1).toArrow()
    ends = counts.where(F.col("word") == END.decode()).first()
    words = [END, *(w.encode() for w in top.column("word").to_pylist())]
    c = np.concatenate([[ends["c"] if ends else 0], top.column("c").to_numpy()]).astype(np.int64)
    frequent = min(frequent, len(words))
    width = width or max(64, math.isqrt(frequent))
    by_tail = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)), F.lit(tails))
    classes = {r["t"]: (r["c"], r["v"]) for r in counts.groupBy(by_tail.alias("t")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    tail_c = np.array([classes.get(j, (0, 0))[0] for j in range(tails)], np.int64)
    tail_v = np.array([classes.get(j, (0, 0))[1] for j in range(tails)], np.int64)
    for w, k in zip(words[:frequent], c[:frequent]):  # frequent words leave the tails
        if k:
            j = tail_of(w, tails)
            tail_c[j] -= k
            tail_v[j] -= 1
    codes = np.array([i if i < frequent else frequent + tail_of(w, tails) for i, w in enumerate(words)] + list(range(frequent, frequent + tails)), np.int64)
    net = start(np.concatenate([c[:frequent], tail_c]), frequent, width, tails, hidden)
    near = rows.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    texts = near.orderBy(F.xxhash64(F.lit("lm"), "doc_id"), "doc_id", F.xxhash64("text")).limit(sample).select("text").toArrow().column("text").combine_chunks()
    names, index, bounds = laid(texts)
    coded = codes[Lookup(words, tails)(names)][index]
    first = Learner.of(net)
    first.learn([coded[a:b] for a, b in zip(bounds, bounds[1:])], lanes=128, epochs=3)
    net = train_all(rows, first.net, first.squares, words, codes, n)
    # the least in the table: words after it by (count, word), and long ones, are found by a join
    in_table = F.lit(False)
    if top.num_rows:
        in_table = short & ((F.col("c") > int(c[-1])) | ((F.col("c") == int(c[-1])) & (F.col("word") <= words[-1].decode())))
    others = counts.where(~in_table & (F.col("word") != END.decode()))
    return Model(words, np.log10(c + 1.0), codes, np.log10(tail_c + tail_v + 1.0), n, v, net), others


def score(docs: DataFrame, model: Model, others: DataFrame, most: int = 1 << 22) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) for every row of `docs`.

    Texts are scored together once they have `most` tokens, so that a long one does not take its steps almost alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _lookup(shared)
        known, frequent = len(model.words), model.net.frequent
        log_c = np.concatenate([model.log_c, np.zeros(model.net.tails)])
        # log10 of a tail word's share of its class, without log10(c + 1) for words outside the table
        share = np.where(model.codes >= frequent, log_c - model.tail_log[np.maximum(model.codes - frequent, 0)], 0.0)
        seen = np.concatenate([model.log_c > 0, np.zeros(model.net.tails, bool)])
        unit = np.log10(model.n + model.v + 1)
        small, docs, held = np.min_scalar_type(len(model.net.p["in"])), [], []

        def scored() -> Iterator[pa.RecordBatch]:
            parts, at = document_scores(model.net, docs) / np.log(10), 0
            for columns, shares in held:
                part = shares + parts[at:at + len(shares)]
                at += len(shares)
                yield pa.RecordBatch.from_arrays([*columns[:4], pa.array(part), *columns[4:]], ["doc_id", "n_tokens", "n_known", "base", "part", "words", "times"])
            docs.clear()
            held.clear()

        for batch in batches:
            for piece in pieces(batch, most=12 << 20):
                names, index, bounds = laid(piece.column(1))
                of = table(names)
                at, first, n_tokens = of[index], bounds[:-1], np.diff(bounds)
                # every row has its end, so no sum is over nothing
                sums = lambda x: np.add.reduceat(x, first)
                codes = model.codes[at].astype(small)
                docs += [codes[a:b] for a, b in zip(bounds, bounds[1:])]
                # words that the table lacks, with their counts in each row
                rare = np.flatnonzero(at >= known)
                row = np.searchsorted(bounds, rare, "right") - 1
                pair, times = np.unique(row * np.int64(len(names)) + index[rare], return_counts=True)
                cuts = pa.array(np.searchsorted(pair, np.arange(piece.num_rows + 1) * np.int64(len(names))), pa.int32())
                words = names.take(pa.array(pair % len(names))).cast(pa.string())
                held.append(([
                    piece.column(0).cast(pa.int64()), pa.array(n_tokens), pa.array(sums(seen[at].astype(np.int64))), pa.array(sums(log_c[at]) - n_tokens * unit),
                    pa.ListArray.from_arrays(cuts, words), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ], sums(share[at])))
                if sum(map(len, docs)) >= most:
                    yield from scored()
        yield from scored()

    kind = "doc_id bigint, n_tokens bigint, n_known bigint, base double, part double, words array<string>, times array<int>"
    rows = settle(id_text(docs).mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    more = rare.join(others, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    plus = F.coalesce("more", F.lit(0.0))
    return rows.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + plus).alias("base_score"), (F.col("part") + plus).alias("score"),
    )
