"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words (an embedding of each word known from training) and their characters (the mean of
the embeddings of the byte n-grams at its start and end known from training). The network reads windows of
words; a document's score is that of its most toxic window, over all overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.arrays import PLAIN_WORDS, find_words, lower, slice_hashes, text_chunks
from gleanery.llm.language import fold

#: Steps in which scores (log odds) are counted for the threshold, which all labelled documents that
#: training does not read set: one in four by a hash, of any length.
THRESHOLD_STEP = 0.001
#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 16
#: The bounded sample: labelled documents of each label that training reads whole, and the most
#: bytes of such a document (of a longer one it would have to guess where the label comes from).
SAMPLE_DOCS, SAMPLE_BYTES = 1200, 4096
#: Sizes of word and character inputs and of a direction's state; lengths of the
#: character n-grams at a word's start and end.
WORD_SIZE, GRAM_SIZE, HIDDEN = 8, 8, 8
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8), (3, 4)
#: Training steps on all windows with their document's label, then on each document's top window.
FIRST_STEPS, STEPS, BATCH, RATE = 60, 180, 192, 0.02
#: Against learning documents by heart: a word or n-gram must be in so many of the sample's
#: documents, inputs of so many distinct words are left out of a step, and embeddings decay.
IN_DOCS, DROPPED, DECAY = 4, 0.3, 0.03


def word_windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (from a text's first word) and texts of all windows: every STRIDE words, and one that
    ends with the text. A shorter text is one window, a text without words none."""
    n = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0)), text


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hashes of the distinct words, for every word its number, and where each is first."""
    return np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hashes of each word's prefixes and suffixes of the lengths in PREFIXES and SUFFIXES (bytes;
    the whole word is both), and the word of each."""
    sizes, hashes, owner = ends - starts, [], []
    for lengths, is_suffix in ((PREFIXES, 0), (SUFFIXES, 1)):
        for n in lengths:
            word = np.flatnonzero(sizes >= n)
            first = ends[word] - n if is_suffix else starts[word]
            hashes.append(slice_hashes(data, first, first + n) ^ np.uint64(is_suffix))
            owner.append(word)
    return np.concatenate(hashes), np.concatenate(owner)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ToxicityNetwork:
    """Embeddings, two gated recurrent units, attention pooling and a logistic output."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, self.grams = words, grams
        size, h = WORD_SIZE + GRAM_SIZE, HIDDEN
        self.p = {
            "word": rng.normal(0, 0.01, (len(words) + 1, WORD_SIZE)), "gram": rng.normal(0, 0.01, (len(grams) + 1, GRAM_SIZE)),
            "attend": rng.normal(0, 0.3, (2 * h, h)), "query": rng.normal(0, 0.3, h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1),
        }
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (size, 3 * h)), f"h{d}": rng.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
        self.p["gram"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, hashes: np.ndarray, gram_hashes: np.ndarray, gram_word: np.ndarray):
        """Places of words and grams among the known ones (0: unknown) and the grams' weights."""

        def place(known, h):
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            return np.where(known[at] == h, at + 1, 0) if len(known) else np.zeros(len(h), np.int64)

        grams = place(self.grams, gram_hashes)
        some = grams > 0
        weight = 1 / np.maximum(np.bincount(gram_word[some], minlength=len(hashes)), 1)
        return place(self.words, hashes), grams[some], gram_word[some], weight.astype(np.float32)

    def embed(self, word, gram, gram_word, weight):
        x = np.empty((len(word), WORD_SIZE + GRAM_SIZE), np.float32)
        x[:, :WORD_SIZE] = self.p["word"][word]
        for k in range(GRAM_SIZE):
            x[:, WORD_SIZE + k] = np.bincount(gram_word, self.p["gram"][gram, k], len(word)) * weight
        return x

    def _run(self, d: str, z: np.ndarray, index: np.ndarray, mask, keep: bool):
        """States of a direction at every step; z: projected inputs of distinct words."""
        n, steps = index.shape
        w, h = self.p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
        states, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = z[index[:, t]], h @ w
            gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            u, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            new = c + u * (h - c)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep:
                kept.append((t, h, u, r, c, b[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, kept

    def forward(self, x: np.ndarray, index: np.ndarray, mask=None, keep: bool = False):
        """Logits of windows; index: the distinct word at each place, mask: places that count."""
        sides = {d: self._run(d, x @ self.p[f"x{d}"] + self.p[f"c{d}"], index, mask, keep) for d in "fb"}
        states = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        look = np.tanh(states @ self.p["attend"])
        energy = look @ self.p["query"]
        if mask is not None:
            energy = np.where(mask.T, energy, -1e9)
        share = np.exp(energy - energy.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return logit, (sides, states, look, share, pooled)

    def gradients(self, x, index, mask, made, d_logit, used, kept=1):
        """Of all parameters, by back-propagation through time."""
        sides, states, look, share, pooled = made
        word, gram, gram_word, weight = used
        g = {"bias": np.array([d_logit.sum()]), "out": pooled.T @ d_logit}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_share = (states * d_pooled).sum(axis=2)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["query"] = np.einsum("tn,tnh->h", d_energy, look)
        d_look = d_energy[:, :, None] * self.p["query"] * (1 - look * look)
        g["attend"] = np.einsum("tnk,tnh->kh", states, d_look)
        d_states = share[:, :, None] * d_pooled + d_look @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            w = self.p[f"h{d}"]
            g[f"h{d}"], d_z, d_h = np.zeros_like(w), np.zeros((len(x), 3 * HIDDEN), np.float32), 0
            for t, h, u, r, c, bc in reversed(sides[d][1]):
                d_new = d_states[t][:, part] + d_h
                stay = 0
                if mask is not None:
                    stay = np.where(mask[:, t, None], 0, d_new)
                    d_new = np.where(mask[:, t, None], d_new, 0)
                d_c = d_new * (1 - u) * (1 - c * c)
                d_u, d_r = d_new * (h - c) * u * (1 - u), d_c * bc * r * (1 - r)
                d_b = np.concatenate([d_u, d_r, d_c * r], axis=1)
                g[f"h{d}"] += h.T @ d_b
                np.add.at(d_z, index[:, t], np.concatenate([d_u, d_r, d_c], axis=1))
                d_h = d_new * u + d_b @ w.T + stay
            g[f"x{d}"], g[f"c{d}"] = x.T @ d_z, d_z.sum(axis=0)
            d_x += d_z @ self.p[f"x{d}"].T
        d_x = d_x * kept
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], word, d_x[:, :WORD_SIZE])
        np.add.at(g["gram"], gram, (d_x[:, WORD_SIZE:] * weight[:, None])[gram_word])
        g["gram"][0] = 0
        return g


def training_windows(docs: DataFrame, labelled: DataFrame) -> list[tuple[int, list[str]]]:
    """(label, windows) of the bounded sample: of each label the SAMPLE_DOCS documents of at most
    SAMPLE_BYTES bytes that come first by a hash of doc_id, with all their windows."""
    labels = usable_labels(labelled).where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0)
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id")
    labels = sampled_labels(labels.join(short, "doc_id"), SAMPLE_DOCS)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    texts = texts.join(F.broadcast(labels), "doc_id").select("doc_id", "toxic", "text")

    def cut(batches):
        for batch, data, offsets in text_chunks(batches):
            low = lower(data)
            starts, ends, first = find_words(low, offsets, PLAIN_WORDS)
            start, text = word_windows(np.diff(first))
            raw, out = low.tobytes(), []
            for row in range(batch.num_rows):
                mine = start[text == row]
                out.append([
                    b" ".join(raw[s:e] for s, e in zip(starts[a:z].tolist(), ends[a:z].tolist())).decode()
                    for a, z in ((first[row] + k, min(first[row] + k + WINDOW, first[row + 1])) for k in mine.tolist())
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "toxic", "windows"]
            )

    rows = texts.mapInArrow(cut, "doc_id long, toxic int, windows array<string>").collect()
    return [(r["toxic"], r["windows"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["windows"])) if r["windows"]]


def _common_grams(gram_hashes, gram_word, pairs, n_words) -> np.ndarray:
    """The n-grams that at least IN_DOCS documents have; pairs: distinct (word, document)."""
    grams, number = np.unique(gram_hashes, return_inverse=True)
    order = np.argsort(gram_word, kind="stable")
    first = np.searchsorted(gram_word[order], np.arange(n_words + 1))
    n = (first[1:] - first[:-1])[pairs[0]]
    at = order[np.repeat(first[pairs[0]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    both = np.unique(number[at].astype(np.int64) << 32 | np.repeat(pairs[1], n))
    return grams[np.bincount(both >> 32, minlength=len(grams)) >= IN_DOCS]


def sampled_labels(labelled: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, toxic) of each label's first rows by a hash of doc_id; a document with both labels
    is toxic. Each label is cut in parts first, then whole, so no task reads all of a label."""
    labels = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    for key in (["toxic", F.pmod("h", F.lit(64))], ["toxic"]):
        labels = labels.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id")))
        labels = labels.where(F.col("rank") <= per_label)
    return labels.select("doc_id", "toxic")


def usable_labels(labelled: DataFrame) -> DataFrame:
    return labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")


def set_threshold(net: ToxicityNetwork, docs: DataFrame, labelled: DataFrame) -> ToxicityNetwork:
    """Shift the output so that 0.5 separates the labels of whole documents best: the middle of
    the cuts with the most right decisions, both labels weighing the same."""
    labels = usable_labels(labelled).where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = score_texts(docs.select("doc_id", "text").join(labels, "doc_id"), net)
    score = F.least(F.greatest("toxicity", F.lit(1e-7)), F.lit(1 - 1e-7))
    place = F.round(F.log(score / (1 - score)) / THRESHOLD_STEP).cast("long").alias("place")
    rows = sorted(scored.groupBy(place).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect())
    toxic, n = (np.array([r[c] for r in rows], float) for c in ("toxic", "n"))
    clean = n - toxic
    if len(rows) > 1 and toxic.sum() and clean.sum():
        logit = np.array([r["place"] for r in rows]) * THRESHOLD_STEP
        cuts = (logit[1:] + logit[:-1]) / 2
        right = 1 - np.cumsum(toxic)[:-1] / toxic.sum() + np.cumsum(clean)[:-1] / clean.sum()
        best = cuts[np.flatnonzero(right >= right.max() - 1e-9)]
        net.p["bias"] -= np.float32((best[0] + best[-1]) / 2)
    return net


def train(sample: list[tuple[int, list[str]]], seed: int = 5) -> ToxicityNetwork:
    """The network fitted to the sample, by multiple-instance learning: a document's label is first
    given to all its windows, then to its top window. Batches hold both labels equally. Without
    both labels it stays as drawn."""
    windows = [w for _, ws in sample for w in ws]
    raw = "\n".join(windows).encode()
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(w.encode()) + 1 for w in windows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]) if len(sizes) else np.zeros(1, np.int64)
    offsets[-1] = len(data)
    starts, ends, first = find_words(data, offsets, PLAIN_WORDS)
    hashes, at, which = distinct_words(data, starts, ends)
    gram_hashes, gram_word = word_grams(data, starts[at], ends[at])
    label = np.array([t for t, _ in sample], np.float32)
    bag = np.repeat(np.arange(len(sample)), [len(ws) for _, ws in sample])
    in_docs = np.unique(which * len(sample) + np.repeat(bag, np.diff(first))) if len(which) else which
    pairs = np.stack([in_docs // max(len(sample), 1), in_docs % max(len(sample), 1)])
    counts = np.bincount(pairs[0], minlength=len(hashes))
    net = ToxicityNetwork(hashes[counts >= IN_DOCS], _common_grams(gram_hashes, gram_word, pairs, len(hashes)), seed)
    positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(positive) or not len(negative):
        return net
    n_words = np.diff(first)
    place = np.minimum(np.arange(WINDOW), np.maximum(n_words[:, None] - 1, 0))
    index = which[first[:-1][:, None] + place]
    mask = np.arange(WINDOW) < n_words[:, None]
    word, gram, gram_word, weight = net.inputs(hashes, gram_hashes, gram_word)
    by_word = np.argsort(gram_word, kind="stable")
    gram, gram_word = gram[by_word], gram_word[by_word]
    gram_first = np.searchsorted(gram_word, np.arange(len(hashes) + 1))
    rng = np.random.default_rng(seed)
    windows_of = np.searchsorted(bag, np.arange(len(sample) + 1))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    top = None
    for step in range(FIRST_STEPS + STEPS):
        if step >= FIRST_STEPS and (step - FIRST_STEPS) % 30 == 0:
            x = net.embed(word, gram, gram_word, weight)
            logits = np.concatenate([net.forward(x, index[k : k + 4096], mask[k : k + 4096])[0] for k in range(0, len(index), 4096)])
            best = np.lexsort((-logits, bag))
            top = best[windows_of[:-1]]
        docs = np.concatenate([rng.choice(positive, BATCH // 2), rng.choice(negative, BATCH // 2)])
        some = windows_of[docs] + (rng.random(len(docs)) * (windows_of[docs + 1] - windows_of[docs])).astype(np.int64)
        if top is not None:
            hard = (label[docs] == 1) | (rng.random(len(docs)) < 0.7)
            some = np.where(hard, top[docs], some)
        used, local = np.unique(index[some], return_inverse=True)
        local, m = local.reshape(len(some), WINDOW), mask[some]
        n = gram_first[used + 1] - gram_first[used]
        g_at = np.repeat(gram_first[used] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        inputs = (word[used], gram[g_at], np.repeat(np.arange(len(used)), n), weight[used])
        kept = (rng.random((len(used), 1)) >= DROPPED).astype(np.float32)
        x = net.embed(*inputs) * kept
        logit, made = net.forward(x, local, m, keep=True)
        d_logit = ((_sigmoid(logit) - label[docs]) / len(docs)).astype(np.float32)
        for k, g in net.gradients(x, local, m, made, d_logit, inputs, kept).items():
            mean, square = moments[k]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            rate = RATE * np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            net.p[k] -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
            if k in ("word", "gram"):
                net.p[k] *= 1 - RATE * DECAY
    return net


def score_texts(docs: DataFrame, net: ToxicityNetwork) -> DataFrame:
    """The rows with `toxicity` from 0 to 1 (replaced if there): the score of the most toxic of all
    overlapping windows; 0 for texts that are null, empty or without words. One pass, no shuffle."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop("toxicity")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.schema), T.StructField("toxicity", T.DoubleType())])
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]):
        net = shared.value
        for batch, data, offsets in text_chunks(batches, max_bytes=4 << 20):
            data = lower(data)
            starts, ends, first = find_words(data, offsets, PLAIN_WORDS)
            counts = np.diff(first)
            hashes, at, which = distinct_words(data, starts, ends)
            x = net.embed(*net.inputs(hashes, *word_grams(data, starts[at], ends[at]))) if len(hashes) else None
            start, text = word_windows(counts)
            best = np.full(batch.num_rows, -np.inf)
            for whole in (True, False):
                rows = np.flatnonzero((counts[text] >= WINDOW) == whole)
                for some in np.array_split(rows, len(rows) // 4096 + 1):
                    if not len(some):
                        continue
                    n = counts[text[some]]
                    place = np.minimum(np.arange(WINDOW), n[:, None] - 1)
                    index = which[(first[text[some]] + start[some])[:, None] + (np.arange(WINDOW) if whole else place)]
                    logit, _ = net.forward(x, index, None if whole else np.arange(WINDOW) < n[:, None])
                    np.maximum.at(best, text[some], logit)
            cols = [batch.column(f.name) for f in list(arrow)[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(np.isfinite(best), _sigmoid(best), 0.0))], schema=arrow)

    return kept.mapInArrow(score, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold(5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    net = set_threshold(train(training_windows(docs, labels)), docs, labels)
    scored = score_texts(docs, net)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
