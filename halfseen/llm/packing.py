"""Best-fit packing: tokens once, then bounded-space online best-fit over piece lengths."""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import handover, query, small_batches, table

TOKENIZER = "word_bpe_49k.json"
LENGTH, END = 4096, 1
#: The tokenizer lower-cases and always parts letters (here: of the Latin-1 range) from ASCII marks other than the apostrophe,
#: so texts may be lower-cased and such places opened by a blank without another result, and far fewer chunks differ.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")      # lower-case letters of that range in UTF-8
BEHIND, BEFORE = (f"({LETTER})({MARK})", r"\1 \2"), (f"({MARK})({LETTER})", r"\1 \2")
OPEN_BINS = 1024                # bins a task holds open
TOKENS_PER_TASK = 64_000_000    # at least 15 bins are filled for each that may stay open at the end


@functools.cache
def tokenizer_of(path: str):
    """(tokenizer, whether an id ends a word) once per worker process; one thread, as Spark gives a task one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer, ends = Tokenizer.from_file(path), None
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if suffix:
        vocab = tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
    return tokenizer, ends


class Chunks:
    """Token ids of white-space separated chunks, encoded once while remembered.

    The tokenizer drops white space before it forms words, so ids of a text are the ids of
    its chunks in order. Chunks keep their place in growing arrays; the memory is given up
    when it holds `most` chunks.
    """

    def __init__(self, path: str, most: int = 250_000):
        (self.tokenizer, self.ends), self.most = tokenizer_of(path), most
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.start = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.count = self.used = 0

    def add(self, new: list[bytes]) -> None:
        """Chunks of letters are one word each to the tokenizer, so many go in one call and the tokens that end a word part them again."""
        letters: list[bytes] = []
        rest: list[bytes] = []
        for c in new:
            (letters if self.ends is not None and WORD.fullmatch(c) else rest).append(c)
        texts = [b" ".join(letters[lo:lo + 128]).decode() for lo in range(0, len(letters), 128)]
        for lo, e in zip(range(0, len(letters), 128), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            part, ids = letters[lo:lo + 128], np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                self.keep(part, ids, np.diff(last, prepend=-1))
            else:
                rest += part
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.keep(rest, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def keep(self, chunks: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        used, count = self.used + len(ids), self.count + len(chunks)
        while used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while count + 1 > len(self.start):
            self.start = np.resize(self.start, 2 * len(self.start))
        self.ids[self.used:used] = ids
        self.start[self.count + 1:count + 1] = self.used + np.cumsum(size)
        self.place.update(zip(chunks, range(self.count, count)))
        self.used, self.count = used, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each text."""
        if self.count > self.most:
            self.clear()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():     # else special tokens may be written out
            texts = pc.replace_substring_regex(pc.replace_substring_regex(pc.ascii_lower(texts), *BEHIND), *BEFORE)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = parts.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.add([c for c in distinct if c not in self.place])
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        size = self.start[at + 1] - self.start[at]
        offset = np.r_[0, np.cumsum(size)]
        own = self.ids[np.repeat(self.start[at] - offset[:-1], size) + np.arange(offset[-1])]
        ids = pa.LargeListArray.from_arrays(pa.array(offset), pa.array(own)).take(words.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(size[words.indices.to_numpy()])]
        return ids, np.diff(ends[np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]])


def pieces(docs: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(path)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                bodies = pc.fill_null(batch.column("body").take(pa.array(range(batch.num_rows))), "")    # a copy: slices upset some kernels
                ids, counts = chunks.encode(bodies.cast(pa.large_string()))
                rows, at = [], 0
                for ident, count in zip(batch.column("id").to_pylist(), counts.tolist()):
                    own = np.append(ids[at:at + count], np.uint32(end)).astype("<u4")
                    at += count
                    rows += [(ident, k, s, min(length, len(own) - s), zlib.crc32(own[s:s + length].tobytes()))
                             for k, s in enumerate(range(0, len(own), length))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64())
                                                  for c, n in zip(zip(*rows), names)], names)

    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins in stacks by free space, with one bit for each free space that occurs."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]    # free -> (bin, used)
        self.bits = self.open = self.made = 0

    def take(self, free: int) -> int:
        stack = self.at[free]
        name = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return name

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the open bin it leaves least space in, else a new one."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self.take(free)
        else:
            if self.open == self.most:           # the fullest closes
                self.take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, name = self.length, self.made
            self.made += 1
            self.open += 1
        left = free - size
        if left:
            self.at[left].append(name)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return name, self.length - free


def best_fit(parts: DataFrame, length: int, open_bins: int, tokens_per_task: int) -> DataFrame:
    """Adds sequence_id and offset to rows with id, piece and length.

    Lengths are dealt by a hash into as many tasks as the tokens ask for, so at most
    `open_bins` bins per `tokens_per_task` tokens stay unfinished; each task walks its rows
    in hash order with `open_bins` bins in memory.
    """
    total = parts.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // tokens_per_task))
    mixed = F.xxhash64("id", "piece")
    dealt = parts.withColumn("h", mixed).repartition(tasks, "h").sortWithinPartitions("h", "id", "piece")

    def run(batches):
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                batch.schema.names + ["sequence_id", "offset"])

    kept = dealt.drop("h")
    return kept.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH,
         end: int = END, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids followed by `end`; only longer ones than `length` are cut.
    Null and empty texts are the single id `end`. A row without id is packed like others.
    Repeated rows are packed each. Pieces share a sequence without gaps; the order in it is
    that of arrival. Other columns are not read; an empty table gives no rows.
    `tokenizer`: path of the vocabulary (default: the installed word_bpe_49k).
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    parts = handover(pieces(rows, tokenizer or public_tokenizers.path(TOKENIZER), length, end))
    return best_fit(parts, length, open_bins, tokens_per_task).withColumnRenamed("id", id_col)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, d):
    return pack(table(spark, d, "documents"))
