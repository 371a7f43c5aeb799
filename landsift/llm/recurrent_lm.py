"""Recurrent language model: a GRU with a class-factored output softmax, trained by truncated backpropagation in numpy,
and whole-document log-likelihoods with the state carried across windows.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end for each document. Counts of all training
tokens are exact and grow with the corpus: they are aggregated over the cluster and never collected. The model's words:

* head: the 1,024 most frequent tokens, with input rows and output vectors of their own, in 32 classes of 32;
* all other tokens, in 18 surface classes (ASCII or not, ending, length): the class comes from the network, the word
  within it by its training count + 0.5, with one share of 0.5 for all unknown words. So p(word) = p(class | state) *
  p(word | class[, state]) sums to 1 over known words and one unknown word a surface class.

A dictionary of up to 200,000 most frequent words (a word of over 64 bytes goes by its digest) is broadcast; counts of
rarer words are joined by the word. Texts are cut into words once, before the dictionary is made, and held as places in a
list of words for each million; these lists are counted and looked up, and all rounds and the scoring read the codes
that come of it. Training is data-parallel: in each of `rounds` rounds every task trains a copy of
the shared weights on its own documents, and weights are averaged in a tree. Round i takes the documents of slice
i % `slices` by hash, and there are no fewer rounds than slices, so every training document is learnt from, with the
defaults exactly once, whatever the size of the corpus; a task has about `task_tokens` tokens or more. Output biases
start from the counts of all training tokens.

Defined cases: a null text counts as empty (one end); a null id is a training id; repeated rows count and are scored
each; an empty table gives an empty result; other columns are not read. Texts are scored whole, of any length.
"""

from __future__ import annotations

import math
import uuid
import zlib
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_size, cut, partition_sum, remove, ship

END = b""
HEAD, CLASSES, SURFACE, HIDDEN = 1024, 32, 18, 16
DICTIONARY, WORD_BYTES, PART, OUTSIDE = 200_000, 64, 1_000_000, -1 - SURFACE
WINDOW, LONGEST = 24, 480  # steps of a window of backpropagation, and of one that few lanes are left in
#: Lanes, tokens gathered before they are dealt to lanes, and rate's factor, until a task has learnt WARM tokens and then
WARM, BEGIN, THEN = 200_000, (64, 50_000, 1.0), (192, 250_000, 1.75)
LN10 = math.log(10)
HALF = np.float32(0.5)
TOP, ONES = np.float32(80), np.ones(4096, np.float32)  # logits stay below what float32 can exponentiate


def tokens(text: str | bytes | None) -> list[bytes]:
    """Of a text, or of its UTF-8."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    words.append(END)
    return words


def named(word: bytes) -> bytes:
    """The word, or of one beyond WORD_BYTES a name of bounded size: a byte that UTF-8 lacks, a 128-bit digest, and what
    `surface` looks at."""
    return word if len(word) <= WORD_BYTES else b"\xff" + blake2b(word, digest_size=16).digest() + (b"a" if word.isascii() else b"u") + word[-1:]


def surface(word: bytes) -> int:
    """Class of a word (or its name) outside the head, by its looks."""
    last, ascii_ = word[-1:], word[17:18] == b"a" if word[:1] == b"\xff" else word.isascii()
    end = 1 if last in (b".", b"!", b"?") else 2 if last in (b",", b";", b":", b")", b'"', b"-") else 0
    return (0 if ascii_ else 9) + 3 * end + (0 if len(word) <= 5 else 1 if len(word) <= 9 else 2)


def surfaces(words: pa.Array) -> np.ndarray:
    """`surface` of each of an array of words or names."""
    held = words.buffers()
    data = np.append(np.frombuffer(held[2] or b"", np.uint8), np.uint8(0))
    at = np.frombuffer(held[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    start, size = at[:-1], np.diff(at)
    high = np.append(0, np.cumsum(data >= 128))
    ascii_ = np.where((data[start] == 255) & (size > 17), data[np.minimum(start + 17, len(data) - 1)] == ord("a"), high[at[1:]] == high[start])
    ends = np.zeros(256, np.int64)
    ends[list(b".!?")], ends[list(b",;:)\"-")] = 1, 2
    return np.where(ascii_, 0, 9) + 3 * np.where(size > 0, ends[data[at[1:] - 1]], 0) + (size > 5) + (size > 9)


def is_held_out(id_) -> bool:
    return id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 1


def held_out(id_: str = "id"):
    """is_held_out as a condition."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Words(dict):
    """word -> code: its place in the dictionary, or -1 - surface class."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.full = len(self) + 100_000

    def __missing__(self, word: bytes) -> int:
        code = self.get(named(word)) if len(word) > WORD_BYTES else None
        if code is None:
            code = -1 - surface(word)
        if len(self) < self.full:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


class Lexicon:
    """Dictionary with counts, head classes and class totals; what workers need besides the weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, totals: np.ndarray, n: float, v: float):
        self.words, self.counts, self.n, self.v, self.key = words, counts, n, v, uuid.uuid4().hex
        self.head = min(HEAD, len(words))
        size = max(1, math.ceil(self.head / CLASSES))
        self.edges = [(a, min(a + size, self.head)) for a in range(0, self.head, size)]
        self.surface_of = np.array([surface(w) for w in words], dtype=np.int64)
        outside = totals + 0.5
        np.subtract.at(outside, self.surface_of[: self.head], counts[: self.head] + 0.5)
        self.totals = np.maximum(outside, 0.5)
        heads = np.array([counts[a:b].sum() for a, b in self.edges])
        self.class_of = np.concatenate([np.repeat(np.arange(len(self.edges)), [b - a for a, b in self.edges]), len(self.edges) + self.surface_of[self.head :]]).astype(np.int64)
        self.mass = np.concatenate([heads, self.totals])
        # class and input row by code, the surface classes' codes first
        code = np.arange(-SURFACE, len(words))
        cls = np.where(code < 0, len(self.edges) - 1 - code, self.class_of[np.maximum(code, 0)])
        self.split = cls.astype(np.int16), np.where((code >= 0) & (code < self.head), code, self.head + cls - len(self.edges)).astype(np.int16)
        self.near = np.where((code < 0) | (code < self.head), code, -1 - self.surface_of[np.maximum(code, 0)]).astype(np.int32)

    def seen(self, codes: np.ndarray) -> np.ndarray:
        """codes as the network tells them apart: of a word outside the head only its surface class."""
        return self.near[codes + SURFACE]


def start_weights(lex: Lexicon, seed: int = 11) -> dict[str, np.ndarray]:
    rng, c = np.random.default_rng(seed), len(lex.mass)
    word_bias = np.zeros(lex.head)
    for a, b in lex.edges:
        word_bias[a:b] = np.log(np.maximum(lex.counts[a:b], 0.5)) - math.log(max(lex.counts[a:b].sum(), 0.5))
    return {
        "x": rng.normal(0, 0.1, (lex.head + SURFACE, 3 * HIDDEN)).astype(np.float32),
        "u": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
        "b": np.repeat(np.array([1.0, 0.0, 0.0], dtype=np.float32), HIDDEN),
        "wc": np.zeros((HIDDEN, c), np.float32),
        "bc": np.log(np.maximum(lex.mass, 0.5)).astype(np.float32) - np.float32(math.log(max(lex.mass.sum(), 1.0))),
        "wo": np.zeros((lex.head, HIDDEN), np.float32),
        "bo": word_bias.astype(np.float32),
    }


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Stream:
    """Texts, or parts of them, dealt to lanes, the longest first to the shortest lane; a lane reads its parts one after
    another and begins each with the state that `states` has for it (none: the empty state) and the token that `before`
    has for it (none: the end's, which also closes each document)."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int, before: list[int] | None = None, states: np.ndarray | None = None):
        import heapq

        heap = [(0, i, []) for i in range(max(1, min(lanes, len(docs))))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, i, own = heap[0]
            own.append(d)
            heapq.heapreplace(heap, (n + len(docs[d]), i, own))
        heap = sorted(heap, key=lambda x: -x[0])
        self.states = states
        self.lengths = np.array([n for n, _, _ in heap])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        order = np.array([d for _, _, own in heap for d in own], dtype=np.int64)
        sizes = np.array([len(docs[d]) for d in order], dtype=np.int64)
        order, sizes = order[sizes > 0], sizes[sizes > 0]
        first = np.cumsum(sizes) - sizes
        self.target = np.concatenate([docs[d] for d in order]) if len(order) else np.zeros(0, np.int32)
        self.doc = np.repeat(order, sizes).astype(np.int32)
        self.input = np.roll(self.target, 1)
        self.input[first] = end if before is None else np.array(before, dtype=np.int32)[order]
        self.begin = np.zeros(len(self.target), bool)
        self.begin[first] = True

    def windows(self, size: int, tokens: int):
        """(input, target, doc, begin) of the lanes that have tokens left, `size` steps or, of few lanes, about as many as
        make `tokens`; doc is -1 past a lane's end. Only a window is ever laid out, so a long text among short ones costs
        no more than its tokens."""
        t = 0
        while live := int((self.lengths > t).sum()):
            to = min(t + max(size, min(LONGEST, tokens // live)), int(self.lengths[0]))
            step = np.arange(t, to)[:, None]
            inside = step < self.lengths[:live]
            at = np.where(inside, self.offsets[:live] + step, 0)
            yield self.input[at], self.target[at], np.where(inside, self.doc[at], -1), self.begin[at] & inside
            t = to

    def entered(self, begin: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """h with the first state of those lanes that begin a part."""
        if self.states is None:
            return np.where(begin[:, None], np.float32(0), h)
        h = h.copy()
        h[begin] = self.states[doc[begin]]
        return h


def _across(x: np.ndarray) -> np.ndarray:
    """Last two axes exchanged, laid out anew: steps work on (units, lanes), whose slices by unit are contiguous."""
    return np.ascontiguousarray(np.swapaxes(x, -1, -2))


def forward(w: dict[str, np.ndarray], rows: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool = False, enter=None):
    """States of a window; rows: input rows. keep: also what the way back needs. enter(t, h): h where parts begin.
    Gates are sigmoids by tanh, which can't overflow; their halving is done on the weights."""
    k = HIDDEN
    steps, lanes = rows.shape
    half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), k)
    table = w["x"] + w["b"]
    table *= half
    x, u, h = _across(table[rows]), _across(w["u"] * half), _across(h)
    hs = np.empty((steps, k, lanes), np.float32)
    kept = steps if keep else 1  # without keep, steps write over each other
    gates, news, sums = np.empty((kept, 2 * k, lanes), np.float32), np.empty((kept, k, lanes), np.float32), np.empty((kept, 3 * k, lanes), np.float32)
    entry = np.empty((steps, k, lanes), np.float32) if keep else None
    starts = begin.any(axis=1).tolist()
    for t in range(steps):
        if starts[t]:
            h = np.where(begin[t], np.float32(0), h) if enter is None else _across(enter(t, h.T))
        if keep:
            entry[t] = h
        i = t if keep else 0
        a, g, n, new, xt = sums[i], gates[i], news[i], hs[t], x[t]
        np.matmul(u, h, out=a)
        np.add(xt[: 2 * k], a[: 2 * k], out=g)
        np.tanh(g, out=g)
        g *= HALF
        g += HALF
        np.multiply(g[k:], a[2 * k :], out=n)
        n += xt[2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= g[:k]
        new += n
        h = new
    return np.swapaxes(hs, 1, 2), h.T, (entry, gates, news, sums) if keep else None


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state (of components up to 1) can bring a logit of `weights` (one row an output) to TOP."""
    return float((np.abs(weights).sum(axis=1) + np.abs(bias)).max(initial=0)) < TOP


def log_probs(w: dict[str, np.ndarray], lex: Lexicon, hs: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None):
    """ln p(class) (+ ln p(word | class) in the head) of each state's target. With grads, they and d loss / d state.
    States go by class, so that each class is one slice."""
    order = np.argsort(cls.astype(np.int16, copy=False), kind="stable")
    cls, word = cls[order], word[order]
    at, safe = np.arange(len(cls)), _bounded(w["wc"].T, w["bc"]) and _bounded(w["wo"], w["bo"])
    states = np.ones((len(cls), HIDDEN + 1), np.float32)  # the last column carries the biases
    states[:, :-1] = hs[order]
    of_class, of_word = np.vstack([w["wc"], w["bc"]]), np.column_stack([w["wo"], w["bo"]])
    logits = states @ of_class
    if not safe:
        np.minimum(logits, TOP, out=logits)
    chosen = logits[at, cls].astype(np.float64)
    e = np.exp(logits, out=logits)
    s = e @ ONES[: e.shape[1]]
    total = s.astype(np.float64)
    if grads is not None:
        e *= (1 / s)[:, None]
        e[at, cls] -= 1
        down = states.T @ e
        grads["wc"] += down[:-1]
        grads["bc"] += down[-1]
        back = e @ w["wc"].T
        down = np.zeros_like(of_word)
    ends = np.searchsorted(cls, np.arange(len(lex.edges) + 1)).tolist()
    heads, width = ends[-1], max((b - a for a, b in lex.edges), default=0)
    if heads:  # one row of logits a state in the head, of the words of its class; a class short of words leaves the rest out
        logits = np.empty((heads, width), np.float32)
        classes = [(ends[c], ends[c + 1], a, b) for c, (a, b) in enumerate(lex.edges) if ends[c] < ends[c + 1]]
        for lo, hi, a, b in classes:
            np.matmul(states[lo:hi], of_word[a:b].T, out=logits[lo:hi, : b - a])
            if b - a < width:
                logits[lo:hi, b - a :] = -np.inf
        if not safe:
            np.minimum(logits, TOP, out=logits)
        i, j = at[:heads], word[:heads] - np.array([a for a, _ in lex.edges])[cls[:heads]]
        chosen[:heads] += logits[i, j]
        e = np.exp(logits, out=logits)
        s = e @ ONES[:width]
        total[:heads] *= s
        if grads is not None:
            e *= (1 / s)[:, None]
            e[i, j] -= 1
            inner = np.empty((heads, HIDDEN), np.float32)
            for lo, hi, a, b in classes:
                own = e[lo:hi, : b - a]
                np.matmul(own.T, states[lo:hi], out=down[a:b])
                np.matmul(own, w["wo"][a:b], out=inner[lo:hi])
            back[:heads] += inner
    if grads is not None:
        grads["wo"] += down[:, :-1]
        grads["bo"] += down[:, -1]
    out = np.empty(len(chosen))
    out[order] = chosen - np.log(total)
    if grads is None:
        return out, None
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return out, unsorted


def split_codes(lex: Lexicon, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, input row) of codes: rarer words share the row of their surface class."""
    at = codes + SURFACE
    return lex.split[0][at], lex.split[1][at]


class Trainer:
    """Adagrad over windows of truncated backpropagation. `mean` is the weights' average over the tokens learnt, the
    later ones counting more in proportion, which what a few long texts do last can't pull away."""

    def __init__(self, lex: Lexicon, w: dict[str, np.ndarray], rate: float):
        self.lex, self.w, self.rate = lex, w, rate
        self.square = {k: np.full(v.shape, 1e-2, np.float32) for k, v in w.items()}
        self.mean, self.seen, self.weight, self.fresh = {k: v.copy() for k, v in w.items()}, 0, 0.0, 0

    def window(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, begin: np.ndarray, h: np.ndarray, enter=None) -> np.ndarray:
        """One step of descent; returns the states of all tokens. Gradients end at the window's and the parts' edges."""
        w, k = self.w, HIDDEN
        rows = split_codes(self.lex, inputs)[1]
        hs, _, (h0, g, n, a) = forward(w, rows, begin, h, keep=True, enter=enter)
        whole = bool(valid.all())
        flat, targets = (hs.reshape(-1, k), targets.ravel()) if whole else (hs[valid], targets[valid])
        cls, _ = split_codes(self.lex, targets)
        grads = {name: np.zeros_like(v) for name, v in w.items() if name != "x"}
        _, back = log_probs(w, self.lex, flat, cls, targets, grads)
        if whole:
            dh_out = back.reshape(hs.shape)
        else:
            dh_out = np.zeros(hs.shape, np.float32)
            dh_out[valid] = back
        dh_out = _across(dh_out)
        z, r = g[:, :k], g[:, k:]
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (h0 - n) * z * (1 - z), a[:, 2 * k :] * r * (1 - r)
        da, dn_all = np.empty_like(a), np.empty_like(n)
        dh, u, starts = np.zeros_like(n[0]), w["u"], begin.any(axis=1).tolist()
        for t in range(len(rows) - 1, -1, -1):
            dh += dh_out[t]
            d, dn = da[t], dn_all[t]
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dh, to_z[t], out=d[:k])
            np.multiply(dn, to_r[t], out=d[k : 2 * k])
            np.multiply(dn, r[t], out=d[2 * k :])
            dh *= z[t]
            dh += u @ d
            if starts[t]:
                dh[:, begin[t]] = 0
        grads["u"] = np.matmul(h0, np.swapaxes(da, 1, 2)).sum(axis=0)
        da[:, 2 * k :] = dn_all
        dx = _across(da).reshape(-1, 3 * k)
        grads["b"] = dx.sum(axis=0)
        scale = np.float32(1 / self.nominal)  # a window that few lanes are left in counts less
        for name, grad in grads.items():
            self._step(name, slice(None), grad * scale)
        order = np.argsort(rows, axis=None, kind="stable")
        sorted_rows = rows.ravel()[order]
        first = np.flatnonzero(np.diff(sorted_rows, prepend=np.int16(-1)))
        self._step("x", sorted_rows[first], np.add.reduceat(dx[order], first, axis=0) * scale)
        self.fresh += len(flat)
        if self.fresh >= 8 * self.nominal:
            self.average()
        return hs

    def average(self) -> None:
        """Take the present weights into the mean, for the tokens learnt since the last time."""
        if self.fresh:
            self.seen += self.fresh
            self.weight += float(self.seen) * self.fresh
            share = np.float32(self.seen * self.fresh / self.weight)
            for name, v in self.mean.items():
                v += share * (self.w[name] - v)
            self.fresh = 0

    def _step(self, name: str, at, g: np.ndarray) -> None:
        np.clip(g, -0.5, 0.5, out=g)
        self.square[name][at] += g * g
        self.w[name][at] -= np.float32(self.rate) * g / np.sqrt(self.square[name][at])

    def learn(self, texts: list[tuple[np.ndarray, int, np.ndarray]], end: int, lanes: int = 64, size: int = WINDOW, part: int = 1000) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """texts: (codes, those learnt already, state after these). Up to `part` tokens of each are learnt, so that lanes
        end together; returns the texts that have more, with the state that the next part goes on from."""
        self.nominal = lanes * size
        docs = [self.lex.seen(codes[at : at + part]) for codes, at, _ in texts]
        states = np.array([h for *_, h in texts], dtype=np.float32)
        s = Stream(docs, lanes, end, [codes[at - 1] if at else end for codes, at, _ in texts], states)
        left = {i for i, (codes, at, _) in enumerate(texts) if at + part < len(codes)}
        last = {}
        h = np.zeros((len(s.lengths), HIDDEN), np.float32)
        for inputs, targets, doc, begin in s.windows(size, self.nominal):
            hs = self.window(inputs, targets, doc >= 0, begin, h[: inputs.shape[1]], lambda t, h, begin=begin, doc=doc: s.entered(begin[t], doc[t], h))
            h = hs[-1]
            if left:
                final = doc.copy()  # places where a part ends
                final[:-1][doc[:-1] == doc[1:]] = -1
                for t, lane in zip(*np.nonzero(np.isin(final, list(left))), strict=True):
                    last[int(doc[t, lane])] = hs[t, lane].copy()
        return [(texts[i][0], texts[i][1] + part, last[i]) for i in sorted(left)]


def score_codes(lex: Lexicon, w: dict[str, np.ndarray], docs: list[np.ndarray], end: int, lanes: int = 256, size: int = 32) -> np.ndarray:
    """Sum of ln p(class) and, in the head, ln p(word | class) of each document."""
    out = np.zeros(len(docs))
    s = Stream([lex.seen(d) for d in docs], lanes, end)
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    for inputs, targets, doc, begin in s.windows(size, lanes * size):
        hs, h, _ = forward(w, split_codes(lex, inputs)[1], begin, h[: inputs.shape[1]])
        valid = doc >= 0
        t = targets[valid]
        out += np.bincount(doc[valid], log_probs(w, lex, hs[valid], split_codes(lex, t)[0], t)[0], len(docs))
    return out


class Places(dict):
    """word -> how many others came before it."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def split(docs: DataFrame) -> DataFrame:
    """docs (id, text) cut into words once, a row for about PART tokens (the last texts', up to 4 MB or
    one, may be beyond): ids, tokens of each, their places in
    `words` as the bytes of int32, these words, and how often each occurs in training documents. So a word is looked up by
    its bytes once here and, for the counts and in the dictionary, only once for all that a row has of it."""

    def part(ids, learnt, codes, places):
        sizes, codes = np.array([len(c) for c in codes], np.int32), np.concatenate(codes)
        c = np.bincount(codes[np.repeat(np.concatenate(learnt), sizes)], minlength=len(places))
        words = pa.array([w if len(w) <= WORD_BYTES else named(w) for w in places], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(sizes), words, pa.array(c, pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([codes.tobytes()], pa.binary())], names=["ids", "sizes", "words", "counts", "codes"])

    def run(batches):
        ids, learnt, codes, places, n = [], [], [], Places(), 0
        for b in by_size(batches, 1, 4096, 4 << 20):
            ids.append(b.column(0))
            learnt.append(~b.column(2).to_numpy(zero_copy_only=False))
            for text in b.column(1).cast(pa.binary()):
                words = tokens(text.as_py())
                codes.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                n += len(words)
            if n >= PART:
                yield part(ids, learnt, codes, places)
                ids, learnt, codes, places, n = [], [], [], Places(), 0
        if ids:
            yield part(ids, learnt, codes, places)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", held_out().alias("held")).mapInArrow(run, f"ids array<{kind}>, sizes array<int>, words array<binary>, counts array<long>, codes binary")


def counted(parts: DataFrame) -> DataFrame:
    """(token, c) over the training documents of what `split` made; one row a token."""
    pairs = parts.select(F.inline(F.arrays_zip("words", "counts"))).filter(F.col("counts") > 0)
    return pairs.groupBy(F.col("words").alias("token")).agg(F.sum("counts").alias("c"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over the training documents of docs (id, text)."""
    return counted(split(docs))


def build_lexicon(counts: DataFrame) -> Lexicon:
    """From cut counts: totals over all tokens, and the dictionary: all words from the least count on from which they are
    DICTIONARY at most, so the driver gets a histogram and then no more words than that, of bounded size."""

    def sums(batches):
        t = np.zeros(SURFACE + 2)
        for b in batches:
            c = b.column(1).to_numpy()
            t[:SURFACE] += np.bincount(surfaces(b.column(0)), c + 0.5, SURFACE)
            t[SURFACE:] += c.sum(), len(c)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], names=["sum"])

    totals = partition_sum(counts.mapInArrow(sums, "sum binary"), SURFACE + 2)
    size = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")  # a histogram of at most 512 bins
    words_ = counts.filter(F.length("token") > 0)
    least, most = None, 0
    for r in sorted(words_.groupBy(size.alias("size")).count().collect(), reverse=True):
        most += r["count"]
        if most > DICTIONARY:
            break
        least = r["size"]
    best = [] if least is None else sorted((-r["c"], bytes(r["token"])) for r in words_.filter(size >= least).collect())
    ends = counts.filter(F.length("token") == 0).first()
    words, c = [w for _, w in best], np.array([-n for n, _ in best], dtype=np.float64)
    place = min(HEAD - 1, len(words))
    return Lexicon([*words[:place], END, *words[place:]], np.insert(c, place, ends[1] if ends else 0), totals[:SURFACE], totals[SURFACE], totals[SURFACE + 1])


_word_codes: dict = {}


def _codes_of(shared) -> Words:
    """Of this worker process; it lives on between tasks."""
    lex = shared.value
    if lex.key not in _word_codes:
        _word_codes.clear()
        _word_codes[lex.key] = Words(lex.words)
    return _word_codes[lex.key]


def train(docs: DataFrame, lex: Lexicon, shared, rounds: int, slices: int, task_tokens: int, rate: float) -> dict[str, np.ndarray]:
    """Weights, averaged after each round over the tasks. docs: (id, text), or (id, codes) of `coded`. A task learns its documents once, in the order they come, a
    part of each at a time; of a long one the state goes on from part to part."""
    if rounds < slices:
        raise ValueError("fewer rounds than slices leave training documents out")
    w = start_weights(lex)
    end = lex.words.index(END)
    tasks = max(1, math.ceil(lex.n / slices / task_tokens))
    for i in range(rounds):
        crc = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(0))
        own = docs.filter(~held_out() & (F.floor(crc / 5) % slices == i % slices)).coalesce(tasks)
        held = docs.sparkSession.sparkContext.broadcast(w)

        def run(batches, held=held):
            lexicon, known = shared.value, _codes_of(shared)
            trainer = Trainer(lexicon, {k: v.copy() for k, v in held.value.items()}, rate)
            waiting, fresh, seen, pace = [], 0, 0, BEGIN
            empty = np.zeros(HIDDEN, np.float32)

            def learnt():
                trainer.rate = rate * pace[2]
                return trainer.learn(waiting, end, pace[0])

            for b in batches:
                for value in b.column(1):
                    value = value.as_py()
                    codes = np.frombuffer(value, np.int32) if isinstance(value, bytes) else known.of(tokens(value))
                    waiting.append((codes, 0, empty))
                    fresh += len(codes)
                    if fresh >= pace[1]:
                        waiting, seen, fresh = learnt(), seen + fresh, 0
                        pace = BEGIN if seen < WARM else THEN
            seen += fresh
            while waiting:
                waiting = learnt()
            trainer.average()
            flat = pack(trainer.mean)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(flat * seen, seen).tobytes()], pa.binary())], names=["sum"])

        flat = partition_sum(own.mapInArrow(run, "sum binary"), sum(v.size for v in w.values()) + 1)
        if flat[-1]:
            w = unpack(flat[:-1] / flat[-1], w)
    return w


def recoded(parts: DataFrame, shared) -> DataFrame:
    """(id, codes, row, tail) of the documents in what `split` made: the codes of the tokens, as the bytes of int32, a
    number that no other row has, and the words outside the dictionary."""

    def run(batches):
        known = _codes_of(shared)
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes, words = (b.column(c)[i].values for c in range(3))
                places = np.frombuffer(b.column(3)[i].as_buffer(), np.int32)
                codes = np.fromiter(map(known.get, words.to_pylist(), repeat(OUTSIDE)), np.int32, len(words))
                codes = np.where(codes == OUTSIDE, -1 - surfaces(words), codes).astype(np.int32)[places]
                ends, unknown = np.append(0, np.cumsum(sizes.to_numpy())), codes < 0
                cells = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(codes)])
                tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(unknown))[ends], pa.int32()), words.take(pa.array(places[unknown])))
                rows = (part << 40) + row + np.arange(len(ids))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([ids, cells, pa.array(rows, pa.int64()), tails], names=["id", "codes", "row", "tail"])

    kind = parts.schema["ids"].dataType.elementType.simpleString()
    return parts.select("ids", "sizes", "words", "codes").mapInArrow(run, f"id {kind}, codes binary, row long, tail array<binary>")


def coded(docs: DataFrame, shared) -> DataFrame:
    """`recoded` of docs (id, text)."""
    return recoded(split(docs), shared)


def score_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = 3, slices: int = 3, task_tokens: int = 120_000, rate: float = 0.3) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; scores are log10 probabilities."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    parts = cut(split(docs))
    counts = cut(counted(parts))
    lex = build_lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)
    words_ = cut(recoded(parts, shared))
    remove(parts)
    held = spark.sparkContext.broadcast(train(words_.select("id", "codes"), lex, shared, rounds, slices, task_tokens, rate))
    end = lex.words.index(END)

    def run(batches):
        lexicon, w = shared.value, held.value
        log_c = np.log10(lexicon.counts + 0.5)
        log_class = np.log10(lexicon.totals)
        ids, rows, docs_, n = [], [], [], 0

        def out():
            n, sizes = len(docs_), np.array([len(d) for d in docs_])
            codes, doc = np.concatenate(docs_), np.repeat(np.arange(n), sizes)
            tail, mid, inside = codes < 0, codes >= lexicon.head, codes >= 0
            base = np.bincount(doc[inside], log_c[codes[inside]], n)
            known_ = np.bincount(doc[inside][lexicon.counts[codes[inside]] > 0], minlength=n)
            model = score_codes(lexicon, w, docs_, end) / LN10
            model += np.bincount(doc[mid], log_c[codes[mid]] - log_class[lexicon.surface_of[codes[mid]]], n)
            model -= np.bincount(doc[tail], log_class[-1 - codes[tail]], n)
            cols = [ids, rows, [is_held_out(i) for i in ids], sizes, known_, base, model]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "row", "held_out", "n_tokens", "n_known", "base", "model"])

        for b in batches:
            for id_, row, codes in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(id_)
                rows.append(row)
                docs_.append(np.frombuffer(codes, np.int32))
                n += len(docs_[-1])
                if n >= 1_000_000:
                    yield out()
                    ids, rows, docs_, n = [], [], [], 0
        if ids:
            yield out()

    scored = cut(words_.select(F.col("id").cast("long").alias("id"), "row", "codes").mapInArrow(run, "id long, row long, held_out boolean, n_tokens long, n_known long, base double, model double"))
    rare = (
        words_.select("row", F.explode("tail").alias("token"))
        .join(counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_c"), F.count("c").alias("known"))
    )
    z = math.log10(lex.n + 0.5 * (lex.v + 1))
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(lex.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_c", zero) - F.col("n_tokens") * F.lit(z)).alias("base_score"),
        (F.col("model") + F.coalesce("log_c", zero)).alias("score"),
    )
