"""LM scoring: a gated recurrent network over words, with an output softmax factored by classes.

Counts of words come from all training documents. The most frequent ones are the network's tokens; all others share one token
of it and are told apart by their counts, so that every text has a probability. Documents stand side by side in lanes and
advance together, a window at a time; the state goes on from window to window until a document ends, while gradients
stop at the window's edge. Every training document is learned from once: partitions learn by themselves in rounds, and
their weights, averaged by tokens in a tree, start the next round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bound_batches, drop_stored, scratch, stored, table
from .langid import held_out
from .token_store import _slices


@dataclass(frozen=True)
class Settings:
    """words: tokens that the network knows, the end among them; classes: of its softmax; hidden: size of state and embeddings;
    window: steps of a truncated backpropagation; lanes: documents side by side in training; segment: tokens after which
    training (not scoring) starts a long document's state anew; rounds: averagings; rate: of Adam, falling to a tenth;
    listed: most frequent words whose counts tasks hold, at most; group: tokens that a task lays out at once, about."""

    words: int = 1_024
    classes: int = 32
    hidden: int = 16
    window: int = 32
    lanes: int = 192
    segment: int = 4_096
    rounds: int = 4
    rate: float = 0.01
    listed: int = 100_000
    group: int = 3_000_000


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
_HELD = 300_000
#: The end of a document; no word is empty.
END = b""


def words(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.translate(_LOWER).split()


def _flat_words(texts):
    """Words of an Arrow array of texts, one after the other, and where each text's begin, with the end of the last. Where a text
    begins or ends with white space, or is empty or null, an empty word stands among them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # bytes as they are, UTF-8 or not; what separates words here is what bytes.split() takes for white space
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")))
    offsets = found.offsets.to_numpy()
    return found.flatten(), offsets - offsets[0]


def _digests(distinct) -> list[bytes]:
    """Of an Arrow array of words; that of the empty one is empty."""
    import pyarrow as pa

    return [xxhash.xxh3_128_digest(w) if w else END for w in distinct.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (128-bit digest; empty for the end), n of all tokens of whole texts. Null texts count as empty."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)

    def rows(held: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in held.to_batches(50_000):
            keys, n = _digests(b.column(0)), b.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), n], names=["word", "n"]).filter(pa.array([k != END for k in keys], pa.bool_()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        for b in batches:
            ends += b.num_rows
            for part in _slices(b.column(0)):
                held.append(pa.Table.from_arrays(_flat_words(part)[0].value_counts().flatten(), names=["word", "n"]))
                if sum(map(len, held)) > 2 * _HELD:
                    held = [_added(held)]
                    if len(held[0]) > _HELD:
                        yield from rows(held[0])
                        held = []
        if held:
            yield from rows(_added(held))
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(held: list):
    """Tables of words and their numbers as one, each word once."""
    import pyarrow as pa

    return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


@dataclass(frozen=True)
class Vocabulary:
    """counts: of the listed words by digest, most frequent first, the end before all; n, v: tokens and different tokens of all
    training documents; known: how many of the listed are the network's."""

    counts: dict[bytes, tuple[int, int]]  # place, count
    n: int
    v: int
    known: int

    @property
    def rare(self) -> tuple[int, int]:
        """Tokens, and different ones, that are not the network's."""
        own = [c for place, c in self.counts.values() if place < self.known]
        return self.n - sum(own), self.v - sum(c > 0 for c in own)


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """Of a stored table word_counts(). What comes to the driver is a histogram of powers of two's sixteenths, then at most
    settings.listed words: all from that count on from which they are no more."""
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    power = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r.p, r.c) for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = None, 0
    for p, c in steps:
        total += c
        if total > settings.listed:
            break
        least = p
    wanted = (F.col("word") == F.lit(END)) if least is None else (power >= least) | (F.col("word") == F.lit(END))
    found = sorted(((r.word != END, -r.n, bytes(r.word)) for r in counts.where(wanted).collect()))
    if not found or found[0][0]:
        found.insert(0, (False, 0, END))
    return Vocabulary({w: (i, -c) for i, (_, c, w) in enumerate(found)}, n or 0, v or 0, min(len(found), settings.words))


_ENCODED = [T.StructField("n_tokens", T.LongType(), False), T.StructField("n_known", T.LongType(), False), T.StructField("n_rare", T.LongType(), False), T.StructField("log_all", T.DoubleType(), False), T.StructField("log_rare", T.DoubleType(), False), T.StructField("ids", T.BinaryType(), False), T.StructField("others", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType(), False), T.StructField("k", T.LongType(), False)]), False), False)]


def encoded(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """docs less the text, with n_tokens, and of the listed words: n_known (in training), n_rare (those that are not the network's),
    log_all and log_rare (sums of log10(count + 1)); ids: the network's tokens as 16-bit numbers, the last one for all others;
    others: words that are not listed, with their numbers."""
    import pyarrow as pa

    # by place, and last what is not listed
    counts = np.array([*(c for _, c in vocab.counts.values()), 0])
    shared = docs.sparkSession.sparkContext.broadcast(({w: place for w, (place, _) in vocab.counts.items()}, counts, vocab.known))

    def work():
        def run(column):
            parts = [_encoded_texts(x, *shared.value) for x in _slices(column)]
            return [pa.concat_arrays(x) for x in zip(*parts, strict=True)] if parts else [[] for _ in _ENCODED]

        return run

    return add_by_batch(docs, [text], _ENCODED, work)


def _encoded_texts(texts, places: dict[bytes, int], counts: np.ndarray, known: int) -> list:
    """Arrow arrays of the columns that encoded() adds. A word is hashed and looked up once for all texts."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in _ENCODED]
    listed, logs = len(counts) - 1, np.log10(counts + 1)
    found, starts = _flat_words(texts)
    coded = found.dictionary_encode()
    keys, words = _digests(coded.dictionary), coded.indices.to_numpy()
    place = np.array([places.get(k, listed) for k in keys], np.int32)
    if END in keys:  # no word: ends follow below
        real = words != keys.index(END)
        words, starts = words[real], np.append(0, np.cumsum(real))[starts]
    at = np.insert(place[words], starts[1:], 0)
    first = starts[:-1] + np.arange(len(texts))
    log, rare = logs[at], at >= known
    sums = [np.add.reduceat(x, first) for x in ((counts[at] > 0).astype(np.int64), rare.astype(np.int64), log, log * rare)]
    ids = np.minimum(at, known).astype(np.uint16)
    packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.append(2 * first, ids.nbytes).astype(np.int32)), pa.py_buffer(ids)])
    # words that are not listed, each once a text
    where = np.flatnonzero(place[words] == listed)
    text = np.searchsorted(starts, where, "right") - 1
    pairs, k = np.unique(text * np.int64(len(keys) + 1) + words[where], return_counts=True)
    text, own = np.divmod(pairs, len(keys) + 1)
    others = pa.StructArray.from_arrays([pa.array(keys, pa.binary()).take(pa.array(own)), pa.array(k, pa.int64())], fields=list(types[-1].value_type))
    ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(texts)))).astype(np.int32)
    return [*(pa.array(x, t) for x, t in zip([np.diff(starts) + 1, *sums], types, strict=False)), packed, pa.ListArray.from_arrays(pa.array(ends), others, type=types[-1])]


def classes_of(n: int, classes: int) -> np.ndarray:
    """First token of each class, and the end: known tokens by frequency in classes of about equal size; then the one for all
    others, in a class of its own."""
    edges = np.linspace(0, n, min(max(1, n), classes) + 1).round().astype(int)
    return np.append(edges, n + 1)


class Network:
    """Weights as views of one vector: embeddings e, input and state weights w, u and bias b of the gates (update, reset,
    candidate), class weights c and their bias, word weights o and their bias."""

    def __init__(self, n: int, settings: Settings, flat: np.ndarray | None = None, counts: np.ndarray | None = None, seed: int = 7):
        """n: known tokens; counts: of them and of all others together, for the first biases. flat: weights to start from."""
        h = settings.hidden
        self.n, self.h, self.settings = n, h, settings
        self.edges = classes_of(n, settings.classes)
        g = len(self.edges) - 1
        self.class_of = np.repeat(np.arange(g, dtype=np.uint8 if g < 256 else np.uint16), np.diff(self.edges))
        shapes = {"e": (n + 1, h), "w": (h, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "c": (h, g), "cb": (g,), "o": (n + 1, h), "ob": (n + 1,)}
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes.values())])
        self.shapes, self.ends = shapes, ends
        dtype = np.float32 if flat is None else flat.dtype
        self.flat = np.zeros(ends[-1], dtype) if flat is None else flat.copy()
        self.p = self.views(self.flat)
        if flat is None:
            rng = np.random.default_rng(seed)
            for k, scale in (("e", 0.3), ("w", h**-0.5), ("u", h**-0.5), ("c", 0.1), ("o", 0.1)):
                self.p[k][:] = rng.normal(0, scale, shapes[k])
            self.p["b"][:h] = 1.0  # states last at first
            if counts is not None:
                seen = counts.astype(float) + 0.5
                own = np.add.reduceat(seen, self.edges[:-1])
                self.p["cb"][:] = np.log(own / own.sum())
                self.p["ob"][:] = np.log(seen / own[self.class_of])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[a:b].reshape(s) for (k, s), a, b in zip(self.shapes.items(), self.ends[:-1], self.ends[1:], strict=True)}

    def states(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States (hidden, steps, lanes) after each step, given the token before each step (steps, lanes) and the states
        (hidden, lanes) before the first; an end resets."""
        return self.run(before, h).transpose(1, 0, 2)

    def run(self, before: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """states() with steps first, so that a step's numbers lie together. keep: gets what the way back needs."""
        p, n = self.p, self.h
        steps, lanes = before.shape
        # a gate is tanh(v / 2) / 2 + 1 / 2: one call in place of four
        half = np.repeat([0.5, 1.0], [2 * n, n]).astype(h.dtype)
        inputs = (p["e"] @ p["w"] + p["b"]) * half
        a = inputs.take(before.ravel(), axis=0).reshape(steps, lanes, 3 * n).transpose(0, 2, 1).copy()
        ut = (p["u"] * half).T.copy()
        goes_on = (before != 0).astype(h.dtype)
        resets = (before == 0).any(axis=1).tolist()
        out = np.empty((steps, n, lanes), h.dtype)
        # with keep, each step has its own
        s, m, first = (np.empty((steps if keep is not None else 1, k * n, lanes), h.dtype) for k in (3, 1, 1))
        for t in range(steps):
            i = t if keep is not None else 0
            if resets[t]:
                h = h * goes_on[t]
            if keep is not None:
                first[t] = h
            np.matmul(ut, h, out=s[i])
            gates, c = a[t, : 2 * n], m[i]
            gates += s[i, : 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[n:], s[i, 2 * n :], out=c)
            c += a[t, 2 * n :]
            np.tanh(c, out=c)
            h = np.subtract(h, c, out=out[t])
            h *= gates[:n]
            h += c
        if keep is not None:
            keep += [goes_on, resets, first, a, m, s]
        return out

    def log_probs(self, states: np.ndarray, targets: np.ndarray, back: tuple[np.ndarray, dict] | None = None) -> np.ndarray:
        """Natural log probability of each target by its state (a row). back: (weight of each target, gradients to add to): then
        also puts the gradient by states into back[1]["states"]."""
        p = self.p
        # equal targets stand together, so that classes do too, the one for all others at the end
        order = np.argsort(targets.astype(np.uint16), kind="stable")
        own, target = states.take(order, axis=0), targets.take(order)
        cls, at = self.class_of.take(target), np.arange(len(target))
        until = np.searchsorted(cls, np.arange(len(self.edges))).tolist()
        known = until[-2]  # targets that a class of several words may have
        # biases are factors of the exponentials, relative to the largest of their class
        cb, ob = p["cb"] - p["cb"].max(), p["ob"] - np.maximum.reduceat(p["ob"], self.edges[:-1])[self.class_of]
        ecb, eob = np.exp(cb), np.exp(ob)
        reach = max(float(states.max(initial=0)), -float(states.min(initial=0))) * max(float(np.abs(p["c"]).sum(axis=0).max()), float(np.abs(p["o"]).sum(axis=1).max()))
        if wide := not reach <= 40:  # exponentials could run over: biases are added, each row's largest logit is taken off
            ecb[:] = eob[:] = 1
        words = p["o"].take(target[:known], axis=0)
        logits = own @ p["c"]
        found = logits.reshape(-1).take(at * logits.shape[1] + cls)
        found[:known] += np.einsum("ij,ij->i", own[:known], words)
        if wide:
            found -= self.level(logits, cb)
        np.exp(logits, out=logits)
        total, sums = logits @ ecb, np.ones_like(found)
        if back is not None:
            weight, grads = back
            weight = weight.take(order)[:, None]
            scale = weight / total[:, None]
            scaled, weighted = own * scale, own * weight
            grads["c"] += (scaled.T @ logits) * ecb
            grads["cb"] += (scale[:, 0] @ logits) * ecb
            d = logits @ (p["c"] * ecb).T
            d *= scale
            d -= p["c"].T.take(cls, axis=0) * weight
            factored, by_word, by_bias, d_word = p["o"] * eob[:, None], np.zeros_like(p["o"]), np.zeros_like(ob), np.empty_like(words)
        for k, (i, j) in enumerate(zip(until[:-2], until[1:-1], strict=True)):
            if i == j:
                continue
            lo, hi = int(self.edges[k]), int(self.edges[k + 1])
            part = own[i:j]
            logits = part @ p["o"][lo:hi].T
            if wide:
                found[i:j] -= self.level(logits, ob[lo:hi])
            np.exp(logits, out=logits)
            sums[i:j] = logits @ eob[lo:hi]
            if back is not None:
                share = weight[i:j, 0] / sums[i:j]
                by_bias[lo:hi] = share @ logits
                d_word[i:j] = logits @ factored[lo:hi]
                logits *= share[:, None]
                by_word[lo:hi] = logits.T @ part
        found += cb.take(cls) + ob.take(target)
        found -= np.log(total)
        found -= np.log(sums)
        if back is not None and len(target):
            d_word *= weight[:known] / sums[:known, None]
            d_word -= words * weight[:known]
            d[:known] += d_word
            grads["o"] += by_word * eob[:, None]
            grads["ob"] += by_bias * eob
            # what the targets themselves take off: sums of equal ones, then of classes
            starts = np.flatnonzero(np.diff(target, prepend=-1))
            there, of = target[starts], cls[starts]
            by_target, n = np.add.reduceat(weighted, starts), np.add.reduceat(weight[:, 0], starts)
            firsts = np.flatnonzero(np.diff(of.astype(int), prepend=-1))
            grads["c"][:, of[firsts]] -= np.add.reduceat(by_target, firsts).T
            grads["cb"][of[firsts]] -= np.add.reduceat(n, firsts)
            own_class = there < self.n
            grads["o"][there[own_class]] -= by_target[own_class]
            grads["ob"][there[own_class]] -= n[own_class]
        if back is not None:
            grads["states"] = np.empty_like(d)
            grads["states"][order] = d
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def level(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Adds the bias and takes off each row's largest logit, in place; what was taken off."""
        logits += bias
        top = logits.max(axis=1)
        logits -= top[:, None]
        return top

    def gradients(self, before: np.ndarray, targets: np.ndarray, weight: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the weighted sum of -log probabilities of a window (steps, lanes): a vector like flat; the last states; the sum."""
        p, n = self.p, self.h
        steps, lanes = before.shape
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        keep: list = []
        states = self.run(before, h, keep)
        goes_on, resets, first, a, m, s = keep
        back = dict(g)
        found = self.log_probs(states.transpose(0, 2, 1).reshape(-1, n), targets.ravel(), (weight.ravel(), back))
        d_out = back["states"].reshape(steps, lanes, n).transpose(0, 2, 1).copy()
        # what a step's gradient by its state is multiplied with, for all steps: by the candidate's input and both gates'
        gates, slope = a[:, : 2 * n], s[:, : 2 * n]
        z, r, by_z, by_r = gates[:, :n], gates[:, n:], slope[:, :n], slope[:, n:]
        np.subtract(1, gates, out=slope)
        by_m = m * m
        np.subtract(1, by_m, out=by_m)
        by_m *= by_z
        slope *= gates
        by_z *= np.subtract(first, m, out=m)
        by_r *= s[:, 2 * n :]
        # candidate, update, reset: by inputs; update, reset, candidate's state: by what comes from the state
        d = np.empty((steps, 4 * n, lanes), h.dtype)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh += d_out[t]
            own = d[t]
            dm = np.multiply(dh, by_m[t], out=own[:n])
            np.multiply(dh, by_z[t], out=own[n : 2 * n])
            np.multiply(dm, by_r[t], out=own[2 * n : 3 * n])
            np.multiply(dm, r[t], out=own[3 * n :])
            dh *= z[t]
            dh += p["u"] @ own[n:]
            if resets[t]:
                dh *= goes_on[t]
        by_input, by_state = d[:, : 3 * n], d[:, n:]
        turned = np.r_[n : 3 * n, :n]  # update, reset, candidate, as in the weights
        g["u"] += np.matmul(first, by_state.transpose(0, 2, 1)).sum(axis=0)
        g["b"] += by_input.sum(axis=2).sum(axis=0)[turned]
        x = p["e"].take(before.ravel(), axis=0).reshape(steps, lanes, n)
        g["w"] += np.matmul(by_input, x).sum(axis=0)[turned].T
        order = np.argsort(before.ravel().astype(np.uint16), kind="stable")
        tokens = before.ravel().take(order)
        starts = np.flatnonzero(np.diff(tokens, prepend=-1))
        w = np.concatenate([p["w"][:, 2 * n :], p["w"][:, : 2 * n]], axis=1)
        by_x = np.matmul(by_input.transpose(0, 2, 1), w.T).reshape(-1, n)
        g["e"][tokens[starts]] += np.add.reduceat(by_x.take(order, axis=0), starts, axis=0)
        return flat, states[-1], -float(found @ weight.ravel())


@dataclass
class Lanes:
    """Sequences laid out end to end in lanes, the longest lane first."""

    tokens: np.ndarray
    starts: np.ndarray  # of each lane
    lengths: np.ndarray
    order: np.ndarray  # sequences as they lie in tokens


def laid_out(sequences: list[np.ndarray], lanes: int) -> Lanes:
    """Longest sequences first, each on the shortest lane."""
    sizes = np.array([len(s) for s in sequences])
    heap = [(0, i) for i in range(min(lanes, len(sequences)))]
    own: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, lane = heapq.heappop(heap)
        own[lane].append(i)
        heapq.heappush(heap, (n + int(sizes[i]), lane))
    own.sort(key=lambda lane: -int(sizes[lane].sum()))
    order = [i for lane in own for i in lane]
    lengths = np.array([int(sizes[lane].sum()) for lane in own])
    return Lanes(np.concatenate([sequences[i] for i in order]).astype(np.int32), np.cumsum(lengths) - lengths, lengths, np.array(order))


def windows(lanes: Lanes, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in tokens, the token before each of them, and which are there, all (steps, lanes that are not at their end)."""
    for t in range(0, int(lanes.lengths.max(initial=0)), steps):
        n = int((lanes.lengths > t).sum())
        steps_now = min(steps, int(lanes.lengths[0]) - t)
        ahead = t + np.arange(steps_now)[:, None]
        valid = ahead < lanes.lengths[:n]
        at = lanes.starts[:n] + np.minimum(ahead, lanes.lengths[:n] - 1)
        before = lanes.tokens.take(np.maximum(at - 1, 0))
        before[ahead[:, 0] == 0] = 0
        yield at, before, valid


def log10_scores(net: Network, sequences: list[np.ndarray], lanes: int = 256) -> np.ndarray:
    """log10 probability of each whole sequence of tokens (each ends with the end), state carried from its first token to its
    last."""
    if not sequences:
        return np.zeros(0)
    own = laid_out(sequences, lanes)
    found = np.zeros(len(own.tokens))
    h = np.zeros((net.h, len(own.lengths)), net.flat.dtype)
    for at, before, valid in windows(own, net.settings.window):
        states = net.run(before, h[:, : at.shape[1]])
        h = states[-1]
        at = at[valid]
        found[at] = net.log_probs(states.transpose(0, 2, 1).reshape(-1, net.h).take(np.flatnonzero(valid), axis=0), own.tokens.take(at))
    sizes = np.array([len(sequences[i]) for i in own.order])
    out = np.zeros(len(sequences))
    out[own.order] = np.add.reduceat(found, np.cumsum(sizes) - sizes) / np.log(10)
    return out


class Adam:
    def __init__(self, net: Network):
        self.net, self.m, self.v, self.step = net, np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def __call__(self, grad: np.ndarray, rate: float) -> None:
        self.step += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.net.flat -= (rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)) * self.m / (np.sqrt(self.v) + 1e-7)


def learn(net: Network, adam: Adam, sequences: list[np.ndarray], rate: float) -> None:
    """Once through all sequences; long ones start anew after settings.segment tokens."""
    s = net.settings
    parts = [x[i : i + s.segment] for x in sequences for i in range(0, len(x), s.segment)]
    own = laid_out(parts, s.lanes)
    h = np.zeros((net.h, len(own.lengths)), net.flat.dtype)
    for at, before, valid in windows(own, s.window):
        weight = valid.astype(net.flat.dtype) / max(1, int(valid.sum()))
        grad, h, _ = net.gradients(before, own.tokens.take(at), weight, h[:, : at.shape[1]])
        size = float(np.sqrt(grad @ grad))
        adam(grad * min(1.0, 1.0 / (size + 1e-9)), rate)


def _groups(batches, column: int, most: int) -> Iterator[list[np.ndarray]]:
    own: list[np.ndarray] = []
    total = 0
    for b in batches:
        for x in b.column(column):
            own.append(np.frombuffer(x.as_buffer(), np.uint16))
            total += len(own[-1])
            if total >= most:
                yield own
                own, total = [], 0
    if own:
        yield own


def _averaged(rows: DataFrame) -> DataFrame:
    """One row (n, weights) a partition: the mean of its rows, weighted by n."""
    import pyarrow as pa

    def mean(batches):
        total, n = None, 0
        for b in batches:
            for k, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * k
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    return rows.mapInArrow(mean, "n long, weights binary")


def fitted(rows: DataFrame, vocab: Vocabulary, settings: Settings, row: str = "row") -> Network:
    """A network that has learned once from every row of a stored table (row, ids). Each round takes its share of the rows, by
    a hash; each partition starts from the last round's mean and returns one vector of fixed size."""
    import pyarrow as pa

    s, spark = settings, rows.sparkSession
    bound_batches(spark)
    known = np.zeros(vocab.known + 1)
    for place, c in vocab.counts.values():
        if place < vocab.known:
            known[place] = c
    known[-1] = vocab.rare[0]
    net = Network(vocab.known, s, counts=known)
    for turn in range(s.rounds):
        shared = spark.sparkContext.broadcast(net.flat)
        rate = s.rate * 0.1 ** (turn / max(1, s.rounds - 1))

        def work(batches, shared=shared, rate=rate):
            own = Network(vocab.known, s, shared.value)
            adam, n = Adam(own), 0
            for sequences in _groups(batches, 0, s.group):
                learn(own, adam, sequences, rate)
                n += sum(map(len, sequences))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], names=["n", "weights"])

        mine = rows.where(F.pmod(F.xxhash64(row), F.lit(s.rounds)) == turn).select("ids")
        path = scratch(spark, "weights")
        mine.mapInArrow(work, "n long, weights binary").write.parquet(path)
        parts = spark.read.schema("n long, weights binary").parquet(path)
        left = parts.count()
        while left > 32:  # up a tree, so that no place gets all vectors
            left = -(-left // 32)
            further = scratch(spark, "weights")
            _averaged(parts.repartition(left)).write.parquet(further)
            drop_stored(spark, path)
            path, parts = further, spark.read.schema("n long, weights binary").parquet(further)
        got = parts.collect()
        drop_stored(spark, path)
        if got:
            total = sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.n for r in got) / sum(r.n for r in got)
            net = Network(vocab.known, s, total.astype(np.float32))
    return net


def scored(docs: DataFrame, learns: Column, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """docs less the text, with n_tokens, n_known, train_tokens, base_score, score.

    learns: which rows are training documents (null: not). Tokens: words, A-Z in lower case, then one end. base_score: sum of
    log10((c + 1) / (N + V + 1)) by counts c, N tokens and V different ones of training documents; score: log10 probability of the
    whole text by the network, where words that are not its own also have their share (c + 1) / (N' + V' + 1) of those. Null and
    empty texts are an end alone. Repeated rows count again and get equal scores. Without training documents the base
    is 1 / (N + V + 1) = 1 for every token (score 0), and the network that has learned nothing scores. Other columns
    stay as they are; columns of the names added are replaced.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    results = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    columns = [c for c in docs.columns if c != text and c.lower() not in results]
    # other columns under names of their own; the text gives its place to the ids on the way
    trains = F.coalesce(learns, F.lit(False))
    sent = docs.select(*[F.col(f"`{c}`").alias(f"carried{i}_") for i, c in enumerate(columns)], trains.alias("trains"), F.col(f"`{text}`").alias("ids"))
    counts = stored(word_counts(sent.where("trains"), "ids"), "lm-counts")
    vocab, row = vocabulary(counts, s), "row"
    rows = encoded(sent, vocab, "ids").withColumn(row, F.monotonically_increasing_id())
    rows = stored(rows, "lm-rows", compression="zstd")
    net = fitted(rows.where("trains"), vocab, s)
    found = rows.select(row, F.explode("others").alias("o")).select(row, "o.word", "o.k").join(counts, "word")
    others = found.groupBy(row).agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_log"))
    shared = spark.sparkContext.broadcast(net)

    def work():
        own = shared.value

        def run(column):
            out: list[float] = []
            for sequences in _groups([_One(column)], 0, s.group):
                out += log10_scores(own, sequences).tolist()
            return [out]

        return run

    by_net = add_by_batch(rows.drop("others"), ["ids"], [T.StructField("score", T.DoubleType(), False)], work).drop("ids")
    n, v = vocab.n, vocab.v
    rare_n, rare_v = vocab.rare
    joined = by_net.join(others, row, "left")
    more_log, more_known = F.coalesce("more_log", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    base = F.col("log_all") + more_log - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    score = F.col("score") + F.col("log_rare") + more_log - F.col("n_rare") * F.lit(float(np.log10(rare_n + rare_v + 1)))
    return joined.select(*[F.col(f"carried{i}_").alias(c) for i, c in enumerate(columns)], "n_tokens", (F.col("n_known") + more_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


class _One:
    """A column in the place of a batch."""

    def __init__(self, column):
        self.own = column

    def column(self, _: int):
        return self.own


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Every document's probability by a network that has learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, ~held_out("doc_id", 7, 2))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
