"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import handover, query, small_batches, table
from halfseen.llm.near_dedup import multipliers
from halfseen.llm.shingles import WORDS, WordHashes, shingle_sequence, texts

SAMPLES = 96               # a shared share of 0.75 goes unseen with probability below (1 - 0.15)**96 = 2e-7
SMALL = 8                  # items of so few shingles are looked up by every shingle
BLOCK_SHINGLES = 2_000_000  # items are searched in blocks of about so many shingles
SEGMENT = 1 << 15          # shingles of a document worked on at a time


class ItemIndex:
    """Items of one block by size class: the smallest hash of each under every sample, or each shingle of small ones.

    An item of class s has more than s / 2 and at most s shingles. Documents are seen in
    windows of 2 s shingles, one every s, so an item lies whole in a window and shares at
    least about 0.15 of the window's and its own shingles together; each sample then has
    that chance to agree.
    """

    def __init__(self, items: list[tuple[int, bytes]], samples: int):
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(g, np.uint64) for _, g in items]
        self.a = self.fold(multipliers(samples)) | np.uint32(1)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        per_class: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, x in enumerate(self.sets):
            if len(x):
                s = 1 if len(x) <= SMALL else 1 << int(len(x) - 1).bit_length()
                keys = self.fold(x) if s == 1 else (self.a[:, None] * self.fold(x)[None, :]).min(axis=1)
                per_class.setdefault(s, []).append((keys, k))
        for s, found in sorted(per_class.items()):
            key = np.concatenate([k for k, _ in found])
            item = np.repeat([k for _, k in found], [len(k) for k, _ in found])
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << min(25, max(16, int(64 * len(key)).bit_length())), bool)
            sieve[self.spot(key, sieve)] = True
            self.classes[s] = key[order], item[order], sieve

    @staticmethod
    def fold(x: np.ndarray) -> np.ndarray:
        """Leading 32 bits: sampling in 32-bit words is twice as fast, and candidates are decided on all 64."""
        return (x >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def spot(values: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        """Place in the sieve; minima are small numbers, multiplied they spread over it."""
        return values * np.uint32(0x9E3779B1) >> np.uint32(32 - len(sieve).bit_length() + 1)

    def look_up(self, s: int, values: np.ndarray) -> set[int]:
        key, item, sieve = self.classes[s]
        values = values[sieve[self.spot(values, sieve)]]
        lo, hi = np.searchsorted(key, values, "left"), np.searchsorted(key, values, "right")
        return {int(item[k]) for a, b in zip(lo[hi > lo], hi[hi > lo]) for k in range(a, b)}

    def candidates(self, x: np.ndarray) -> set[int]:
        """Items that may be contained in the document with the shingles x, in their order."""
        x = self.fold(x)
        found = self.look_up(1, x) if 1 in self.classes else set()
        sizes = [s for s in self.classes if s > 1]
        if not sizes:
            return found
        reach = max(SEGMENT, sizes[-1])
        for lo in range(0, max(len(x) - 1, 0) + 1, reach):
            part = x[lo:lo + reach + 2 * sizes[-1]]
            found |= self.segment(part, sizes)
        return found

    def segment(self, x: np.ndarray, sizes: list[int]) -> set[int]:
        if not len(x):
            return set()
        base = sizes[0]
        x = np.pad(x, (0, -len(x) % base), "edge").reshape(-1, base)
        a = self.a[:, None]
        low = a * x[None, :, 0]
        for j in range(1, base):
            np.minimum(low, a * x[None, :, j], out=low)
        found, at = set(), base
        while True:
            if at in self.classes:
                window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                found |= self.look_up(at, window.ravel())
            if at >= sizes[-1]:
                return found
            if low.shape[1] % 2:
                low = np.concatenate([low, low[:, -1:]], axis=1)
            low, at = np.minimum(low[:, ::2], low[:, 1::2]), 2 * at


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", percent: int = 75, words: int = WORDS, samples: int = SAMPLES,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, item, item_shingles, shared_shingles) of every item of which a document holds at least `percent` of the shingles.

    Documents are not reduced to one signature: an item is looked for in windows of its own
    size class, so its length against the document's does not matter. Candidates are decided
    by counting the item's distinct shingles in the document's whole set. The items are
    broadcast in blocks of bounded size, each searched in one pass over the documents,
    without a shuffle.

    An item of fewer than `words` words is one shingle of all its words; it is found only in
    a document of just these words. Empty and null items are in nothing, empty and null
    documents hold nothing. Repeated rows and rows without id are reported as they come,
    repeated item ids each. Other columns are not read; empty tables give no rows.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("body"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(shingle_sequence(t, hashes, words)) for t in texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()),
                                              pa.array([len(s) for s in sets], pa.int64())], ["id", "grams", "n"])

    held = handover(items.mapInArrow(grams, "id long, grams binary, n long").where("n > 0"))
    total = held.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_shingles))
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "grams"), F.lit(blocks)))
    sc, found = docs.sparkSession.sparkContext, None
    for block in range(blocks):
        index = sc.broadcast([(r["id"], bytes(r["grams"])) for r in held.where(F.col("block") == block).select("id", "grams").collect()])
        hits = docs.mapInArrow(searcher(index, percent, words, samples), "id long, item long, n long, shared long")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("item_shingles"),
                        F.col("shared").alias("shared_shingles"))


def searcher(block, percent: int, words: int, samples: int):
    names = ["id", "item", "n", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = ItemIndex(block.value, samples), WordHashes()
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column("id").to_pylist(), texts(batch, "body")):
                x = shingle_sequence(text, hashes, words)
                near = index.candidates(x) if len(x) else ()
                if near:
                    own = np.unique(x)
                    for k in sorted(near):
                        item = index.sets[k]
                        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                        shared = int((own[at] == item).sum())
                        if 100 * shared >= percent * len(item):
                            rows.append((ident, index.ids[k], len(item), shared))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names)

    return run


@query("op3_benchmark_leaks", r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
t AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS t FROM w),
s AS (SELECT DISTINCT kind, id, array_to_string(t[i : i + 4], ' ') AS g
      FROM (SELECT kind, id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM t WHERE len(t) > 0)),
n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, shared AS shared_shingles FROM hit JOIN n USING (item_id) WHERE 100 * shared >= 75 * n""")
def op3_benchmark_leaks(spark, d):
    return contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))
