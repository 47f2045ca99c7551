"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a vector: learned word and character n-gram embeddings, and
how much more often the word and its n-grams stand in toxic training texts. Two
recurrent passes read a window of words, attention pools their states, and a
text scores as its highest window; windows overlap and cover the whole text.
The network is trained in numpy on a bounded sample: each epoch takes the
windows that score highest at present. In training a text's evidence comes from
the other texts' folds alone, so the network learns how far to trust it.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, hold, table

#: Labelled rows of each class that a fit takes, on average (a hash of the id chooses them).
TRAIN_ROWS = 1000
#: UTF-8 bytes of text that a fit takes of both classes, on average.
TRAIN_BYTES = 256 << 20
#: Words to a window, and from one window to the next.
WINDOW, STRIDE = 32, 24
HIDDEN, EMBEDDING, ATTENTION = 8, 4, 8
#: Words of the vocabulary at most (the most frequent ones), and slots for hashed n-grams of 3 to 7 bytes.
WORDS, GRAMS = 20_000, 1 << 16
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Texts of a class that a word or n-gram must be in to count for the evidence.
SUPPORT = 4
#: Parts of the sample; equal texts are in one.
FOLDS = 5
#: Words whose inputs a worker remembers; beyond that it starts anew.
REMEMBERED = 150_000
#: Words whose n-grams are looked up at a time.
CALL = 8192
#: Windows that are scored in step.
LANES = 4096


def split_words(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " "))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams (3 to 7 bytes, the ends marked) of all words, and the word of each; a word has at least one."""
    found = [_grams(words[i : i + CALL], i) for i in range(0, len(words), CALL)]
    return np.concatenate([np.zeros(0, np.uint16), *(s for s, _ in found)]), np.concatenate([np.zeros(0, np.int32), *(o for _, o in found)])


def _grams(words: list[str], base: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [f"^{w}$".encode() for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in parts])
    word = np.repeat(np.arange(len(parts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the word's end
    code, slots, of = np.zeros(len(data), np.uint32), [], []
    for n in range(1, 8):
        code = code * np.uint32(257) + np.concatenate([data[n - 1 :], np.zeros(min(n - 1, len(data)), np.uint32)])
        if n >= 3:
            at = np.flatnonzero(left >= n)
            mixed = (code[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            slots.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(GRAMS))
            of.append(word[at])
    slot, of = np.concatenate(slots).astype(np.uint16), np.concatenate(of).astype(np.int32)
    order = np.argsort(of, kind="stable")
    return slot[order], of[order] + np.int32(base)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def windows(size: int) -> range | list[int]:
    """The starts of a text's windows: every STRIDE words, and one that ends with the text."""
    if size <= WINDOW:
        return [0]
    starts = list(range(0, size - WINDOW, STRIDE))
    return [*starts, size - WINDOW]


class Network:
    """Parameters p by name, the vocabulary, and the evidence of words and n-grams."""

    def __init__(self, vocabulary: dict[str, int], word_evidence: np.ndarray, gram_evidence: np.ndarray) -> None:
        rng = np.random.default_rng(9)
        self.vocabulary, self.word_evidence, self.gram_evidence = vocabulary, word_evidence.astype(np.float32), gram_evidence.astype(np.float32)
        size = 3 + 2 * EMBEDDING
        normal = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"words": normal(len(vocabulary) + 1, EMBEDDING, scale=0.05), "grams": normal(GRAMS, EMBEDDING, scale=0.05), "u": normal(2 * HIDDEN, ATTENTION), "v": normal(ATTENTION), "w": normal(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": normal(size, 3 * HIDDEN), f"h{way}": normal(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}

    def trusting(self, word_evidence: np.ndarray, gram_evidence: np.ndarray) -> Network:
        """The same parameters with other evidence."""
        other = copy.copy(self)
        other.word_evidence, other.gram_evidence = word_evidence.astype(np.float32), gram_evidence.astype(np.float32)
        return other

    # Inputs

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words; also their vocabulary rows, the slots of their n-grams and the slots' words."""
        row = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        slot, of = grams(words)
        n = np.bincount(of, minlength=len(words)).astype(np.float32)
        x = np.empty((len(words), 3 + 2 * EMBEDDING), np.float32)
        for i in range(0, len(words), CALL):
            some = slice(i, min(len(words), i + CALL))
            a, b = np.searchsorted(of, [some.start, some.stop])
            edges, part = np.searchsorted(of[a:b], np.arange(some.start, some.stop)), slot[a:b]
            evidence = self.gram_evidence[part]
            x[some, 0], x[some, 1], x[some, 2] = self.word_evidence[row[some]], np.maximum.reduceat(evidence, edges), np.add.reduceat(evidence, edges) / n[some]
            x[some, 3 : 3 + EMBEDDING] = self.p["words"][row[some]]
            x[some, 3 + EMBEDDING :] = np.add.reduceat(self.p["grams"][part], edges, axis=0) / n[some, None]
        return x, row, slot, of

    # The network over windows: inputs (lane, time, 3 HIDDEN) of each way, and a mask (lane, time)

    def run(self, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        lanes, times = mask.shape
        full = bool(mask.all())
        states, kept = np.zeros((lanes, times, 2 * HIDDEN), np.float32), {}
        for at, way in enumerate("fb"):
            h, weights, cache = np.zeros((lanes, HIDDEN), np.float32), self.p[f"h{way}"], []
            for t in range(times) if way == "f" else range(times - 1, -1, -1):
                x, a = inputs[way][:, t], h @ weights
                gates = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if not full:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    cache.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
                h = new
                states[:, t, at * HIDDEN : (at + 1) * HIDDEN] = h
            kept[way] = cache
        q = np.tanh(states @ self.p["u"])
        energy = np.where(mask, q @ self.p["v"], -1e9)
        energy = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
        alpha = energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("lt,lth->lh", alpha, states)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, (states, q, alpha, pooled, kept)) if keep else logit

    def gradients(self, inputs: dict[str, np.ndarray], mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Of the weighted logistic loss: by parameter, and by input of each way."""
        logit, (states, q, alpha, pooled, kept) = self.run(inputs, mask, keep=True)
        d = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        pooled_d = d[:, None] * self.p["w"]
        alpha_d = np.einsum("lth,lh->lt", states, pooled_d)
        states_d = alpha[:, :, None] * pooled_d[:, None]
        energy_d = alpha * (alpha_d - (alpha * alpha_d).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("lt,lta->a", energy_d, q)
        q_d = energy_d[:, :, None] * self.p["v"] * (1 - q * q)
        g["u"] = np.einsum("lth,lta->ha", states, q_d)
        states_d += q_d @ self.p["u"].T
        inputs_d = {}
        for at, way in enumerate("fb"):
            weights = self.p[f"h{way}"]
            g[f"h{way}"], x_d, carry = np.zeros_like(weights), np.zeros_like(inputs[way]), 0
            for t, h, z, r, n, a in reversed(kept[way]):
                m = mask[:, t, None]
                total = states_d[:, t, at * HIDDEN : (at + 1) * HIDDEN] + carry
                new_d = total * m
                n_d = new_d * (1 - z) * (1 - n * n)
                z_d = new_d * (h - n) * z * (1 - z)
                r_d = n_d * a * r * (1 - r)
                x_d[:, t] = np.concatenate([z_d, r_d, n_d], axis=1)
                a_d = np.concatenate([z_d, r_d, n_d * r], axis=1)
                g[f"h{way}"] += h.T @ a_d
                carry = total * ~m + new_d * z + a_d @ weights.T
            inputs_d[way] = x_d
        return g, inputs_d


class Scorer:
    """A network and the inputs of the words a worker has met so far."""

    def __init__(self, network: Network, remembered: int = REMEMBERED) -> None:
        self.network, self.remembered = network, remembered
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.inputs = {way: np.zeros((0, 3 * HIDDEN), np.float32) for way in "fb"}

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.remembered:
            self.clear()
        if new := [w for w in words if w not in self.row]:
            x = self.network.features(new)[0]
            self.row.update((w, i) for i, w in enumerate(new, len(self.row)))
            self.inputs = {way: np.concatenate([held, x @ self.network.p[f"x{way}"] + self.network.p[f"c{way}"]]) for way, held in self.inputs.items()}
        return np.array([self.row[w] for w in words], np.int64)

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word, and each window's text, first word and size."""
        split = split_words(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        held, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        real = np.array([bool(w) for w in held] + [False])[code]
        edges = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
        index = np.zeros(len(held) + 1, np.int64)
        index[[i for i, w in enumerate(held) if w]] = self.rows([w for w in held if w])
        sizes = np.diff(edges)
        starts = [windows(int(n)) for n in sizes]
        text = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
        return index[code[real]], text, edges[text] + np.array([x for s in starts for x in s], np.int64), np.minimum(sizes, WINDOW)[text]

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The windows' texts and logits."""
        rows, text, first, size = self.windows(texts)
        rows = np.concatenate([rows, [0]])
        out = np.empty(len(text), np.float32)
        inputs = {way: held if len(held) else np.zeros((1, 3 * HIDDEN), np.float32) for way, held in self.inputs.items()}
        time = np.arange(WINDOW)
        for short in (False, True):
            lanes = np.flatnonzero((size < WINDOW) == short)
            for i in range(0, len(lanes), LANES):
                some = lanes[i : i + LANES]
                mask = time < size[some, None]
                at = rows[np.where(mask, first[some, None] + time, len(rows) - 1)]
                out[some] = self.network.run({way: held[at] for way, held in inputs.items()}, mask)
        return text, out

    def score(self, texts: pa.Array) -> np.ndarray:
        text, logit = self.logits(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit)
        return sigmoid(best)


def counts(docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, keys: int) -> np.ndarray:
    """The texts that hold a key, by fold and label."""
    found = np.zeros((FOLDS, 2, keys + 1), np.int32)
    for doc, label, fold in zip(docs, labels, folds, strict=True):
        found[fold, label, doc] += 1
    return found


def evidence(held: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log odds of a key's share of toxic and other texts, shrunk; 0 for rare keys. held: texts with the key by label; texts: all by label."""
    odds = np.log((held[1] + 1) / (texts[1] + 2)) - np.log((held[0] + 1) / (texts[0] + 2))
    return np.where(held.sum(axis=0) >= SUPPORT, odds, 0.0)


def train(texts: list[str], labels: list[int], prior: float | None = None) -> Network:
    """The network for labelled texts; one class alone, or none, gives a constant score. prior: the share of label 1 where the sample's differs."""
    y = np.array(labels, np.int64)
    array = pa.array([t or "" for t in texts], pa.string())
    split = split_words(array)
    coded = split.flatten().dictionary_encode()
    seen, edges = coded.dictionary.to_pylist(), split.offsets.to_numpy()
    distinct = [np.unique(coded.indices.to_numpy()[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    present = np.bincount(np.concatenate([np.zeros(0, np.int64), *distinct]), minlength=len(seen))
    usual = sorted((i for i, w in enumerate(seen) if w and present[i] >= SUPPORT), key=lambda i: (-present[i], seen[i]))[:WORDS]
    vocabulary = {seen[i]: k for k, i in enumerate(usual)}
    number = np.full(len(seen), -1)
    number[usual] = np.arange(len(usual))
    slot, of = grams(seen)
    starts = np.searchsorted(of, np.arange(len(seen) + 1))
    slot_docs = [np.unique(np.concatenate([np.zeros(0, np.uint16), *(slot[starts[w] : starts[w + 1]] for w in words)])).astype(np.int64) for words in distinct]
    fold = np.array([zlib.crc32((t or "").encode(errors="surrogatepass")) % FOLDS for t in texts], np.int64)
    by_word, by_slot = counts([k[k >= 0] for k in (number[words] for words in distinct)], y, fold, len(vocabulary)), counts(slot_docs, y, fold, GRAMS)
    size = np.stack([np.bincount(y[fold == f], minlength=2) for f in range(FOLDS)])
    of_words, of_slots = [np.stack([evidence(c.sum(axis=0) - part, size.sum(axis=0) - n) for part, n in zip([*c, 0], [*size, 0], strict=True)]) for c in (by_word, by_slot)]  # the last one: all folds
    of_words[:, -1] = 0
    network = Network(vocabulary, of_words[-1], of_slots[-1][:GRAMS])
    views = [network.trusting(of_words[f], of_slots[f][:GRAMS]) for f in range(FOLDS)]
    del slot, of, slot_docs, distinct, coded, by_word, by_slot
    if len(set(labels)) < 2:
        network.p["w"][:], network.p["b"][0] = 0, (4.0 if labels and labels[0] else -4.0)
        return network
    rng, moments, step = np.random.default_rng(3), {}, 0
    rate = {1: 0.5 / max(1, (y == 1).sum()), 0: 0.5 / max(1, (y == 0).sum())}
    scorer = Scorer(network, len(seen))
    rows, text, first, size = scorer.windows(array)
    names = list(scorer.row)
    _, vocabulary_row, slot, of = network.features(names)
    n_grams = np.bincount(of, minlength=len(names)).astype(np.float32)
    trusted = [view.features(names)[0][:, :3] for view in views]

    def values() -> np.ndarray:
        """The windows' logits, each text's by the evidence of the other folds."""
        out = np.empty(len(text), np.float32)
        for f in range(FOLDS):
            if len(some := np.flatnonzero(fold == f)):
                out[fold[text] == f] = Scorer(views[f], len(seen)).logits(array.take(pa.array(some)))[1]
        return out

    for epoch in range(EPOCHS):
        if epoch:
            value = values()
        else:  # the window with most evidence
            value = np.empty(len(text), np.float32)
            for f in range(FOLDS):
                sums = np.concatenate([[0], np.cumsum(np.maximum(trusted[f], 0).sum(axis=1)[rows])])
                value[fold[text] == f] = (sums[first + size] - sums[first])[fold[text] == f]
        order = np.lexsort((-value, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[(rank == 0) | ((y[text[order]] == 0) & ((rank == 1) | (rng.random(len(order)) < 0.05)))]
        rng.shuffle(chosen)
        batches = [part[i : i + BATCH] for f in range(FOLDS) for part in [chosen[fold[text[chosen]] == f]] for i in range(0, len(part), BATCH)]
        for k in rng.permutation(len(batches)):
            some = batches[k]
            x = trusted[fold[text[some[0]]]]
            mask = np.arange(WINDOW) < size[some, None]
            at = np.concatenate([rows, [0]])[np.where(mask, first[some, None] + np.arange(WINDOW), len(rows))]
            used, inverse = np.unique(at, return_inverse=True)
            of_used = np.isin(of, used)
            back = np.searchsorted(used, of[of_used])
            edges = np.searchsorted(back, np.arange(len(used)))
            now = np.concatenate([x[used], network.p["words"][vocabulary_row[used]], np.add.reduceat(network.p["grams"][slot[of_used]], edges, axis=0) / n_grams[used, None]], axis=1)
            inputs = {way: (now @ network.p[f"x{way}"] + network.p[f"c{way}"])[inverse.reshape(at.shape)] for way in "fb"}
            g, inputs_d = network.gradients(inputs, mask, y[text[some]].astype(np.float32), np.array([rate[k] for k in y[text[some]]], np.float32))
            now_d = np.zeros_like(now)
            for way in "fb":
                flat = np.zeros((len(used), 3 * HIDDEN), np.float32)
                np.add.at(flat, inverse.ravel(), inputs_d[way].reshape(-1, 3 * HIDDEN))
                g[f"x{way}"], g[f"c{way}"] = now.T @ flat, flat.sum(axis=0)
                now_d += flat @ network.p[f"x{way}"].T
            g["words"], g["grams"] = np.zeros_like(network.p["words"]), np.zeros_like(network.p["grams"])
            np.add.at(g["words"], vocabulary_row[used], now_d[:, 3 : 3 + EMBEDDING])
            np.add.at(g["grams"], slot[of_used], (now_d[:, 3 + EMBEDDING :] / n_grams[used, None])[back])
            step += 1
            for name, d in g.items():  # Adam
                m, v = moments.setdefault(name, (np.zeros_like(d), np.zeros_like(d)))
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                network.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    # The bias by which most of the sample, at the classes' true shares, falls on its side of 0.5.
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, text, values())
    share = y.mean() if prior is None else prior
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    order = np.argsort(best)
    right = weight[y == 1].sum() + np.concatenate([[0], np.cumsum(np.where(y[order] == 0, weight[order], -weight[order]))])
    cut = np.flatnonzero(right >= right.max() - 1e-12)
    cut = int(cut[len(cut) // 2])
    low, high = best[order[max(0, cut - 1)]], best[order[min(len(y) - 1, cut)]]
    network.p["b"] -= np.float32((low + high) / 2)
    return network


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Network:
    """A network from about `rows` labelled texts of each class, fewer where their texts would take more than half of `most` bytes; rows without a label or a text don't count, of repeated labels the highest does."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("bytes")).join(known, "doc_id").groupBy("toxic").agg(F.sum("bytes").alias("bytes"))
    held_bytes = {r["toxic"]: r["bytes"] for r in sizes.collect()}  # two rows
    if not held:
        return train([], [])
    unit = 1 << 30
    share = F.create_map(*[x for k, n in held.items() for x in (F.lit(k), F.lit(int(unit * min(1.0, rows / n, most / 2 / max(1, held_bytes.get(k, 0))))))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(unit)) < share[F.col("toxic")])
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])  # `rows` ids of each class
    return train(sample.column("text").to_pylist(), sample.column("toxic").to_pylist(), held.get(1, 0) / sum(held.values()))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row and whole text.

    A null text counts as empty; a text without words is one empty window. Rows
    stay as they are, repeated ones too; only doc_id and text are read.
    """
    key = ("toxicity", hash(network.p["w"].tobytes() + network.p["b"].tobytes()))
    shared = docs.sparkSession.sparkContext.broadcast(network)  # bounded by WORDS and GRAMS

    def make():
        scorer = hold(key, lambda: Scorer(shared.value))
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(batch.column("text")).astype(np.float64))], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out() -> Column:
    """Whether a row is kept from training; rows without an id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
