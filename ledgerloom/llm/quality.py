"""Quality classifier of supervised subword embeddings.

Words, character n-grams and word pairs (reduced to whether a word repeats the
one before) are hashed to rows of an embedding table. A document's vector is the
mean of its features' rows; a softmax layer on top
gives the probability of each label. Table and layer are learned together by
stochastic gradient descent in numpy, in one task, on a bounded sample of
labelled documents. For two classes the trained model is linear in the mean, so
that scoring needs one number a feature, which is what the tasks get.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NON_SPACE, Words, chunks, pack, unpack

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4)
#: Labelled documents of each label that are learned from, at most: those with the smallest hashes of their doc_id.
SAMPLE = 3000
#: Bytes of text of each label's sample, at most; documents beyond them, in the same order, are not learned from.
SAMPLE_BYTES = 64 << 20
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.4, 7
#: Small samples are gone through more often, until there are so many steps.
STEPS = 1100


def features(texts: list, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, character n-grams and repeats (rows 0: no, 1: yes) of all texts, text by text, and the first of each text (one entry more)."""
    words = Words(texts, NON_SPACE, lower=False)
    w = (words.hashes & np.uint64(buckets - 1)).astype(np.int32)
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    again = np.zeros(len(w), np.int32)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[:-1][words.counts() > 0]] = 0
    parts, counts = [w, again], [words.counts(), words.counts()]
    for n in NGRAMS:
        if len(points) < n:
            continue
        last = len(points) - n + 1
        h = np.zeros(last, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + points[j : j + last] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside = np.ones(last, bool)
        for j in range(1, n):  # not across texts
            edge = begin[1:-1] - j
            inside[edge[(edge >= 0) & (edge < last)]] = False
        parts.append((h[inside] & np.uint32(buckets - 1)).astype(np.int32))
        counts.append(np.maximum(sizes - n + 1, 0))
    total = np.sum(counts, axis=0)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(total, out=first[1:])
    out, at = np.empty(first[-1], np.int32), first[:-1].copy()
    for part, count in zip(parts, counts, strict=True):
        start = np.cumsum(count) - count
        out[np.arange(len(part)) + np.repeat(at - start, count)] = part
        at += count
    return out, first


def vector(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct features and the share of each."""
    u, n = np.unique(features([text], buckets)[0], return_counts=True)
    return u, (n / max(n.sum(), 1)).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED, steps_at_least: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding table (dim, buckets), output layer (dim, 2) and its bias, by stochastic gradient descent on the softmax loss over documents' vectors. The rate falls evenly to 0; small samples are gone through more often than ``epochs`` times, until ``steps_at_least`` batches were seen."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (dim, buckets)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    each = -(-len(docs) // batch)
    epochs = max(epochs, -(-steps_at_least // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(docs)), each):
            lr = rate * (1 - steps / total)
            steps += 1
            own = [docs[i] for i in chosen if len(docs[i][0])]
            y = np.array([labels[i] for i in chosen if len(docs[i][0])])
            if not own:
                continue
            at, weight = np.concatenate([d[0] for d in own]), np.concatenate([d[1] for d in own])
            sizes = np.array([len(d[0]) for d in own])
            mean = np.add.reduceat(table[:, at] * weight, np.cumsum(sizes) - sizes, axis=1).T
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            back = (p @ layer.T).T  # (dim, documents)
            layer -= lr * (mean.T @ p)
            bias -= lr * p.sum(axis=0) / len(y)
            pull = np.repeat(back, sizes, axis=1) * weight
            for k in range(dim):
                np.add.at(table[k], at, -lr * pull[k])
    return table, layer, bias


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, buckets: int = BUCKETS, **how) -> tuple[np.ndarray, float]:
    """A number for each bucket and a constant, whose sum with a document's mean is the log odds of label 1.

    Labels are sampled, balanced, before texts are looked at: at most ``sample``
    documents of each label, with at most ``sample_bytes`` of text together
    (the first one always). Their vectors are made where the texts are read, and
    only vectors reach the task that learns; the constant is moved by the odds of
    all labels. Several labels of a document count as the largest; null labels, other
    values than 0 and 1, and labels without doc_id as none. With one label only,
    or none, all numbers are 0 and the constant has that label's share.
    """
    own = labels.select(F.col(label_id).cast("long").alias("__label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and __label_id is not null").groupBy("__label_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    none = np.zeros(buckets, np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n0 or not n1:
        return none
    chosen = None
    for label in (0, 1):
        part = own.where(F.col("label") == label).orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id")).groupBy("doc_id", "label").agg(F.sum("size").alias("size"))
    # At most 2 * sample rows.
    before = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("size")
    chosen = sized.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= sample_bytes)).select(F.col("doc_id").alias("__label_id"), "label")

    def look(it):
        for pdf in it:
            own = [vector(t, buckets) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": [pack(u) for u, _ in own], "share": [pack(w) for _, w in own]})

    vectors = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id")).select("doc_id", "text", "label").mapInPandas(look, "doc_id long, label int, at binary, share binary")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "at"])
        y = pdf["label"].to_numpy(np.int64)
        own = [(unpack(u, np.int32), unpack(w, np.float32)) for u, w in zip(pdf["at"], pdf["share"], strict=True)]
        table, layer, bias = train(own, y, buckets, **how)
        step = layer[:, 1] - layer[:, 0]
        prior = np.log(n1 / n0) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return pd.DataFrame({"weights": [pack((step @ table).astype(np.float32))], "constant": [float(bias[1] - bias[0] + prior)]})

    model = vectors.groupBy().applyInPandas(fit, "weights binary, constant double").first()
    return none if model is None else (unpack(bytes(model["weights"]), np.float32), model["constant"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with one column more, ``quality_score``: the probability of label 1 for the whole text.

    Null and empty texts have no features and get the constant's probability.
    Rows are looked at one by one; other columns pass through. An empty table
    gives an empty result. Any column of the name ``quality_score`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def look(text: pd.Series) -> pd.Series:
        texts, out = text.to_list(), []
        weights, constant = sent.value
        for lo, hi in chunks(texts):
            f, first = features(texts[lo:hi], len(weights))
            total = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
            mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
            out.append(1 / (1 + np.exp(-np.clip(mean + constant, -60, 60))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.drop("quality_score").withColumn("quality_score", F.pandas_udf(look, "double")(F.col(text_col).cast("string")))
