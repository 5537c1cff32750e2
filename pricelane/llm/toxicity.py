"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words (runs of letters, lower-cased) in overlapping windows that cover all of it. A
word enters as its own vector, if training has seen it often enough, and as the mean of the vectors of
its character trigrams, which every word has. A forward and a backward gated recurrent layer read a
window, attention pools their states, and a logistic unit gives the window's log-odds; the text's score
is that of its most toxic window.

The network is trained in numpy on a bounded sample of labelled documents, whose windows are cut on the
executors. As labels are given for documents, each pass trains on the window of a document that the
network finds most toxic so far, and on a random one of the clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelane.llm import words

WINDOW, STRIDE = 64, 48
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
CHAR_SLOTS = 1 << 12
#: By byte: what ends a word (0), letters in lower case, and the bytes of other letters as they are.
LETTER = np.array([i if 0x61 <= i <= 0x7A or i >= 0x80 else 0 for i in range(256)], np.uint8)
_random = np.random.default_rng(4)
TRIGRAM = _random.integers(0, 2 ** 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Vocabulary(NamedTuple):
    """The distinct words of some texts: hashes, and the slots of their character trigrams in a row
    with the bounds by word."""
    hashes: np.ndarray
    slots: np.ndarray
    bounds: np.ndarray


def vocabulary(texts: list[bytes]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, the number in it of each word, and the bounds of the texts."""
    found = words.split(texts, LETTER)
    hashes, first, number = np.unique(found.hashes(), return_index=True, return_inverse=True)
    start, length = found.first[first], found.length[first]
    # letters with a zero around each word
    bounds = np.r_[0, np.cumsum(length)]
    place = np.repeat(start - bounds[:-1], length) + np.arange(bounds[-1])
    padded = np.zeros(bounds[-1] + 2 * len(length), np.uint64)
    shift = np.repeat(2 * np.arange(len(length)) + 1, length)
    padded[np.arange(bounds[-1]) + shift] = found.letters[place]
    gram = padded[:-2] * TRIGRAM[0] + padded[1:-1] * TRIGRAM[1] + padded[2:] * TRIGRAM[2] \
        if len(length) else np.zeros(0, np.uint64)
    # a word of n letters has n trigrams; two positions a word reach into the next one
    centre = np.arange(bounds[-1]) + shift - 1
    slots = (words.mixed(gram[centre]) >> np.uint64(52)).astype(np.int64)
    return Vocabulary(hashes, slots, bounds), number, found.bounds


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of the overlapping windows of all texts; an empty text has one."""
    size = np.diff(bounds)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = number * STRIDE
    return text, bounds[text] + start, np.clip(size[text] - start, 0, WINDOW)


class Network:
    """Weights, and the forward and backward passes over batches of windows."""

    def __init__(self, known: np.ndarray, seed: int = 1):
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        inputs = WORD_DIM + CHAR_DIM
        self.known = np.sort(known)
        self.w = {"word": draw(len(known) + 1, WORD_DIM, scale=0.1),
                  "char": draw(CHAR_SLOTS, CHAR_DIM, scale=0.3),
                  "attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3),
                  "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"{side}_in": draw(inputs, 3 * HIDDEN, scale=inputs ** -0.5),
                       f"{side}_bias": np.zeros(3 * HIDDEN, np.float32),
                       f"{side}_rec": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5)}
        self.w["word"][-1] = 0  # words that training has not seen

    def rows_of(self, vocab: Vocabulary) -> np.ndarray:
        """The row of each word's own vector."""
        if not len(self.known):
            return np.zeros(len(vocab.hashes), np.int64)
        place = np.minimum(np.searchsorted(self.known, vocab.hashes), len(self.known) - 1)
        return np.where(self.known[place] == vocab.hashes, place, len(self.known))

    def inputs(self, vocab: Vocabulary, rows: np.ndarray) -> np.ndarray:
        n = np.diff(vocab.bounds)
        chars = np.add.reduceat(self.w["char"][vocab.slots], vocab.bounds[:-1], axis=0) if len(n) else \
            np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.w["word"][rows], chars / np.maximum(n, 1)[:, None].astype(np.float32)], 1)

    def layer(self, side: str, given: np.ndarray, index: np.ndarray, active: np.ndarray, keep: bool):
        """States [step, window, HIDDEN] of one direction. given: gate inputs by word. index: words by
        step and window, windows by falling length. active: windows that reach each step."""
        u = self.w[f"{side}_rec"]
        states = np.zeros((len(index), index.shape[1], HIDDEN), np.float32)
        h, tape = np.zeros((index.shape[1], HIDDEN), np.float32), []
        for t, n in enumerate(active):
            x, before = given[index[t, :n]], h[:n]
            g = before @ u
            gates = np.tanh((x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN]) * np.float32(0.5))
            gates += 1
            gates *= np.float32(0.5)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            after = new + z * (before - new)
            if keep:
                tape.append((before.copy(), z, r, new, g[:, 2 * HIDDEN:].copy()))
            h[:n] = after
            states[t, :n] = after
        return states, tape

    def forward(self, x: np.ndarray, token: np.ndarray, start: np.ndarray, length: np.ndarray, keep=False):
        """Log-odds of windows, which come by falling length."""
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        t = np.arange(steps)[:, None]
        inside = t < length[None, :]
        ahead = np.where(inside, start[None, :] + t, 0)
        back = np.where(inside, start[None, :] + length[None, :] - 1 - t, 0)
        index = {"f": token[ahead], "b": token[back]} if len(token) else {s: ahead for s in "fb"}
        sides, tapes = {}, {}
        for side in "fb":
            given = x @ self.w[f"{side}_in"] + self.w[f"{side}_bias"]
            sides[side], tapes[side] = self.layer(side, given, index[side], active, keep)
        # the backward states in reading order
        turn = np.where(inside, length[None, :] - 1 - t, 0)
        states = np.concatenate([sides["f"], np.take_along_axis(sides["b"], turn[:, :, None], 0)], 2)
        if steps:
            mark = np.where(inside, states @ self.w["attend"], -np.inf)
            weight = np.exp(mark - np.where(length > 0, mark.max(0), 0))
            weight = weight / np.maximum(weight.sum(0), 1e-30)
            pooled = np.einsum("tn,tnh->nh", weight, states)
        else:
            weight, pooled = np.zeros((0, len(length)), np.float32), np.zeros((len(length), 2 * HIDDEN), np.float32)
        odds = pooled @ self.w["out"] + self.w["bias"][0]
        return (odds, (index, active, inside, turn, states, weight, pooled, tapes)) if keep else odds

    def gradient(self, vocab: Vocabulary, rows: np.ndarray, token, start, length, target) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows, by weight."""
        x = self.inputs(vocab, rows)
        odds, (index, active, inside, turn, states, weight, pooled, tapes) = \
            self.forward(x, token, start, length, keep=True)
        error = (1 / (1 + np.exp(-odds)) - target) / len(target)
        out = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.w["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_mark = weight * (d_weight - (weight * d_weight).sum(0))
        out["attend"] = np.einsum("tn,tnh->h", d_mark, states)
        d_states = weight[:, :, None] * d_pooled + d_mark[:, :, None] * self.w["attend"]
        d_x = np.zeros_like(x)
        d_side = {"f": d_states[:, :, :HIDDEN], "b": np.zeros_like(d_states[:, :, HIDDEN:])}
        back = np.where(inside[:, :, None], d_states[:, :, HIDDEN:], 0)
        d_side["b"] = np.where(inside[:, :, None], np.take_along_axis(back, turn[:, :, None], 0), 0)
        for side in "fb":
            u = self.w[f"{side}_rec"]
            d_u, d_given = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(length), HIDDEN), np.float32)
            for t in range(len(active) - 1, -1, -1):
                n = active[t]
                before, z, r, new, g = tapes[side][t]
                d = d_h[:n] + d_side[side][t, :n]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * g * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_new * r], 1)
                d_u += before.T @ d_g
                np.add.at(d_given, index[side][t, :n], np.concatenate([d_z, d_r, d_new], 1))
                d_h[:n] = d * z + d_g @ u.T
            out |= {f"{side}_rec": d_u, f"{side}_bias": d_given.sum(0), f"{side}_in": x.T @ d_given}
            d_x += d_given @ self.w[f"{side}_in"].T
        out["word"] = np.zeros_like(self.w["word"])
        np.add.at(out["word"], rows, d_x[:, :WORD_DIM])
        out["word"][-1] = 0
        out["char"] = np.zeros_like(self.w["char"])
        n = np.diff(vocab.bounds)
        each = np.repeat(d_x[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0)
        np.add.at(out["char"], vocab.slots, each)
        return out

    def odds_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, log-odds) of all windows of the texts."""
        vocab, token, bounds = vocabulary(texts)
        text, start, length = windows(bounds)
        x = self.inputs(vocab, self.rows_of(vocab))
        odds = np.empty(len(text), np.float32)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), 2048):
            part = order[at:at + 2048]
            odds[part] = self.forward(x, token, start[part], length[part])
        return text, odds

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """By text: the probability that its most toxic window gives."""
        text, odds = self.odds_of(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, odds)
        return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def fit(texts: list[bytes], owner: np.ndarray, label: np.ndarray, passes: int = 12, batch: int = 64,
        rate: float = 0.02, min_docs: int = 3, seed: int = 1) -> Network:
    """A network from windows (texts), the document of each (owner, falling together) and the
    documents' labels. Without both labels only the constant is fitted."""
    random = np.random.default_rng(seed)
    vocab, token, bounds = vocabulary(texts)
    start, length = bounds[:-1], np.minimum(np.diff(bounds), WINDOW)
    docs = np.unique(np.stack([token, np.repeat(owner, np.diff(bounds))]), axis=1)[0] if len(token) else token
    network = Network(vocab.hashes[np.bincount(docs, minlength=len(vocab.hashes)) >= min_docs], seed)
    positive = label[owner] > 0 if len(owner) else np.zeros(0, bool)
    share = (label.sum() + 1) / (len(label) + 2)
    network.w["bias"][0] = np.log(share / (1 - share))
    if len(np.unique(label)) < 2:
        network.w["out"][:] = 0
        return network
    rows = network.rows_of(vocab)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.w.items()}
    step = 0
    order = np.argsort(-length, kind="stable")
    for number in range(passes):
        if number < 2:
            odds = random.random(len(texts))
        else:
            odds = np.empty(len(texts), np.float32)
            x = network.inputs(vocab, rows)
            for at in range(0, len(order), 2048):
                part = order[at:at + 2048]
                odds[part] = network.forward(x, token, start[part], length[part])
        top = np.lexsort((-odds, owner))
        hardest = top[np.r_[True, owner[top][1:] != owner[top][:-1]]]
        any_ = np.lexsort((random.random(len(texts)), owner))
        other = any_[np.r_[True, owner[any_][1:] != owner[any_][:-1]]]
        chosen = np.unique(np.r_[hardest, other[~positive[other]]])
        random.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            part = chosen[at:at + batch]
            part = part[np.argsort(-length[part], kind="stable")]
            # the batch's own words alone
            spots = [np.arange(a, a + n) for a, n in zip(start[part], length[part])]
            used, own = np.unique(token[np.concatenate(spots)], return_inverse=True) if len(token) else (token, token)
            size = np.diff(vocab.bounds)[used]
            grams = np.concatenate([vocab.slots[vocab.bounds[w]:vocab.bounds[w + 1]] for w in used]) \
                if len(used) else vocab.slots[:0]
            small = Vocabulary(vocab.hashes[used], grams, np.r_[0, np.cumsum(size)])
            found = network.gradient(small, rows[used], own, np.cumsum(length[part]) - length[part], length[part],
                                     positive[part].astype(np.float32))
            step += 1
            pace = rate * min(1, 2 * (1 - number / passes))
            for k, g in found.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                network.w[k] -= (pace * (first / (1 - 0.9 ** step))
                                 / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
            network.w["word"][-1] = 0
    return network


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_label: int = 1000,
          windows_per_row: int = 12, passes: int = 12) -> Network:
    """A network from `docs` (doc_id, text) and `labels` (doc_id, toxic), of rows for which `learn`
    (on doc_id) holds and toxic is not null.

    rows_per_label: at most so many documents of each label, chosen by a hash of their ids, are used,
    and of each at most `windows_per_row` windows, evenly spread: the bound of the training sample.
    """
    spark = docs.sparkSession
    rows = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = [r for value in (0, 1) for r in rows.filter(F.col("toxic") == value)
              .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows_per_label).collect()]
    sample = F.broadcast(spark.createDataFrame(chosen, rows.schema).toDF("sample_id", "toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .join(sample, F.col("doc_id") == F.col("sample_id")).select("sample_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, part in words.slices(batch.column(2)):
                found = words.split(part, LETTER)
                text, start, length = windows(found.bounds)
                offset = np.r_[found.first, len(found.letters)]
                keep = []
                for i in range(len(part)):
                    own = np.flatnonzero(text == i)
                    keep.extend(own[np.unique(np.linspace(0, len(own) - 1, min(len(own), windows_per_row)).astype(int))])
                shown = [b" ".join(found.letters[offset[w]:offset[w + 1]].tobytes()
                                   for w in range(start[k], start[k] + length[k])) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text[keep] + at]), pa.array(toxic[text[keep] + at]), pa.array(shown, pa.binary())],
                    names=["doc_id", "toxic", "words"])

    table = texts.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, toxic int, words binary") \
        .orderBy("doc_id", "words").toArrow()  # at most 2 * rows_per_label * windows_per_row windows
    ids, toxic = np.asarray(table["doc_id"]), np.asarray(table["toxic"])
    found, first, owner = np.unique(ids, return_index=True, return_inverse=True)
    return fit(table["words"].to_pylist(), owner, toxic[first], passes)


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score (0 to 1) of each row of `docs` (doc_id, text; other columns are ignored). A
    null, empty or wordless text is scored as an empty window; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)),
                                                  pa.array(network.scores(texts))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(every: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
