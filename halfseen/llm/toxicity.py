"""Toxicity by multiple instances: sentences are scored, a noisy-or over them is fitted to document labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import query, small_batches, table
from halfseen.llm.shingles import texts

SENTENCE = re.compile(rb"[^.!?\n]+")
STRIP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ASCII punctuation and white space part words; everything else, letters of any script included, is part of one.
BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
TABLE = bytes(32 if c in BREAKS else STRIP[c] for c in range(256))

MAX_ROWS, MAX_CHARS = 6_000, 24_000_000    # bound of the labelled sample that the model is fitted on
MIN_DOCS, MIN_Z = 5, 4.0                   # a feature is in so many sample texts, and so unevenly between labels
STEMS = (4, 5, 6, 7)                       # bytes of a word's beginning that are features besides the word itself


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) in bytes, of sentences that have words."""
    return [(m.start(), m.end(), words) for m in SENTENCE.finditer(text) if (words := m[0].translate(TABLE).split())]


def features(word: bytes) -> list[bytes]:
    """The word and, marked by a blank, its stems; insults are inflected more often than repeated."""
    return [word, *(word[:k] + b" " for k in STEMS if len(word) > k)]


class WordWeights(dict):
    """word -> summed weight of its features; forgotten when it holds 200,000 words."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 200_000:
            self.clear()
        get = self.weights.get
        total = self[word] = sum(get(f, 0.0) for f in features(word))
        return total


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> list[tuple[bytes, int]]:
    """Up to max_rows labelled texts of up to max_chars characters together, in the order of a hash of the id; one (the longest) of an id, without those that do not fit.

    Labels: rows with an id and a 0/1 label; of several labels of a document the largest.
    """
    want = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    rank = F.xxhash64("id", F.lit(11))
    sized = docs.where("body is not null").groupBy("id").agg(F.max(F.length("body")).alias("chars")).where(F.col("chars") <= max_chars)
    chosen = sized.join(want, "id").orderBy(rank, "id").limit(max_rows).select("id", "label", "chars").collect()
    room, ids = max_chars, {}
    for r in chosen:
        if r["chars"] <= room:
            room -= r["chars"]
            ids[r["id"]] = int(r["label"])
    if not ids:
        return []
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(i,) for i in ids], "id long"))    # at most max_rows ids
    longest = F.max(F.struct(F.length("body").alias("chars"), "body"))["body"].alias("body")
    rows = docs.where("body is not null").join(few, "id", "left_semi").groupBy("id").agg(longest).collect()
    return [(r["body"].encode(), ids[r["id"]]) for r in sorted(rows, key=lambda r: (r["id"], r["body"]))]


def telling(sample, y: np.ndarray, min_docs: int, min_z: float) -> dict[bytes, int]:
    """Features whose share of texts differs between the labels by min_z standard errors."""
    seen, toxic = Counter(), Counter()
    for text, label in zip(sample, y):
        found = {f for w in {w for _, _, words in sentences(text) for w in words} for f in features(w)}
        seen.update(found)
        if label:
            toxic.update(found)
    n1 = y.sum()
    n0 = len(y) - n1

    def z(w: bytes) -> float:
        rate = seen[w] / len(y)
        return (toxic[w] / n1 - (seen[w] - toxic[w]) / n0) / math.sqrt(max(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))

    return {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= min_docs and abs(z(w)) >= min_z))}


def fit(sample: list[tuple[bytes, int]], min_docs: int = MIN_DOCS, min_z: float = MIN_Z, steps: int = 500,
        l2: float = 1e-5) -> tuple[dict[bytes, float], float]:
    """Feature weights and bias of a sentence's log-odds so that the noisy-or of its sentences explains a document's label.

    P(doc) = 1 - prod(1 - p_s), p_s = sigmoid(bias + sum of the feature weights of distinct words in s).
    Equal texts count once (with the larger label), so a text copied often adds no weight.
    Adam on the mean log-loss with an L2 penalty; without both labels in the sample the
    weights are empty and the bias says the only label there is (clean if none).
    """
    once: dict[bytes, int] = {}
    for text, label in sample:
        once[text] = max(label, once.get(text, 0))
    y = np.array(list(once.values()), float)
    if not len(y) or y.min() == y.max():
        return {}, (30.0 if len(y) and y[0] else -30.0)
    vocab = telling(once, y, min_docs, min_z)
    word, sent, doc_of = [], [], []
    for d, text in enumerate(once):
        for _, _, words in sentences(text):
            found = [vocab[f] for w in set(words) for f in features(w) if f in vocab]
            word += found
            sent += [len(doc_of)] * len(found)
            doc_of.append(d)
    word, sent, doc_of = np.array(word, np.int64), np.array(sent, np.int64), np.array(doc_of, np.int64)
    theta = np.zeros(len(vocab) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.clip(theta[-1] + np.bincount(sent, theta[:-1][word], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.bincount(doc_of, -np.logaddexp(0, z), len(y))      # log prod (1 - p_s)
        none = np.exp(log_none)
        some = np.maximum(1 - none, 1e-12)
        # d loss / d z_s: p_s for a clean document, -p_s * none / some for a toxic one
        g = np.where(y[doc_of] == 1, -p * (none / some)[doc_of], p) / len(y)
        grad = np.append(np.bincount(word, g[sent], len(vocab)) + l2 * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return {w: float(theta[i]) for w, i in vocab.items() if abs(theta[i]) > 1e-3}, float(theta[-1])


def score(docs: DataFrame, model: tuple[dict[bytes, float], float], threshold: float = 0.5) -> DataFrame:
    """id, score, predicted and the sentence that is likeliest to offend: its place in code points and its probability."""
    names = ["id", "score", "predicted", "worst_start", "worst_end", "worst_score"]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]

    def one(text: bytes, weight, bias: float):
        log_none, top, where = 0.0, None, None
        flat = text.translate(TABLE)
        for m in SENTENCE.finditer(text):
            a, b = m.span()
            words = set(flat[a:b].split())
            if not words:
                continue
            z = bias + sum(map(weight, words))
            log_none -= z if z > 30 else math.log1p(math.exp(z))
            if top is None or z > top:
                top, where = z, (a, b)
        if where is None:
            return 0.0, 0, None, None, None
        total = -math.expm1(log_none)
        start = len(text[:where[0]].decode("utf-8", "replace"))
        return (total, int(total >= threshold), start, start + len(text[where[0]:where[1]].decode("utf-8", "replace")),
                1 / (1 + math.exp(-max(top, -700))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = WordWeights(model[0]).__getitem__, model[1]
        for batch in batches:
            out = list(zip(*[one(t, weight, bias) for t in texts(batch, "body")])) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, k) for c, k in zip(out, kinds[1:])], names)

    return docs.mapInArrow(run, "id long, score double, predicted int, worst_start long, worst_end long, worst_score double")


def held_out(ident):
    """Every fifth document by crc32 of its id as text."""
    return F.crc32(ident.cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             train=None, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, threshold: float = 0.5,
             row_col: str | None = None) -> DataFrame:
    """One row per document: id, score in 0..1, predicted, and place and score of its likeliest offending sentence.

    Only labels enter the fit for which `train` (a function of the id column) holds; the
    model sees words alone. The sample it is fitted on is bounded by max_rows and
    max_chars; scoring is one pass over whole texts.

    Empty, blank and null texts have no sentence and score 0. Without usable labels of
    both kinds every sentence gets the same extreme score (clean, or toxic if all labels
    are). Rows without id are scored, never learnt from; repeated rows are scored alike.
    With `row_col`, a long that names a row, results carry it in place of the id, which
    then only finds the labels. Other columns are not read; an empty table gives no rows.
    """
    docs, name = small_batches(docs), row_col or id_col
    rows, named = (docs.select(F.col(c).cast("long").alias("id"), F.col(text_col).alias("body")) for c in (id_col, name))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    if train is not None:
        known = known.where(train(F.col("id")))
    model = fit(labelled_sample(rows, known, max_rows, max_chars))
    return score(named, model, threshold).withColumnRenamed("id", name)


@query("op7_toxicity")
def op7_toxicity(spark, d):
    scored = toxicity(table(spark, d, "documents"), table(spark, d, "labels"), train=lambda i: ~held_out(i))
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
