"""SentencePiece encoding that keeps byte offsets: own normaliser with source alignment, pieces projected to original spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from halfseen.llm.common import query, small_batches, table
from halfseen.llm.shingles import texts

MODEL = "piece_bpe_32k.model"
SPACE, MARK = b" ", "▁".encode()      # a space, and the character that stands for it in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6     # kinds of pieces in a model file
WORDS, CHARACTERS = 200_000, 4_000_000     # words a worker remembers, and their characters
LONG = 1 << 16                             # characters from which a word without a space is cut at further safe places


class CharMap:
    """The compiled character map of a model: a double-array trie of byte strings and a block of replacements.

    A unit of the array holds a byte label, a flag for "a string ends here" and the offset to
    its children; the value of a string is the place of its replacement, ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size:]
        self.starts: dict[str, bool] = {}

    @staticmethod
    def child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int = 0) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest string of the map that starts at `at`."""
        if not self.units:
            return None
        node, found = self.child(self.units[0]), None
        for end in range(at, len(text)):
            node ^= text[end]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != text[end]:
                break
            node ^= self.child(unit)
            if unit & 0x100:
                found = self.units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        start, taken = found
        return self.replacements[start:self.replacements.index(b"\0", start)], taken

    def opens(self, char: str) -> bool:
        """Whether some string of the map starts with this character."""
        known = self.starts.get(char)
        if known is None:
            known, node = bool(self.units), self.child(self.units[0]) if self.units else 0
            for byte in char.encode():
                node ^= byte
                unit = self.units[node] if node < len(self.units) else 0
                if unit & 0x800000FF != byte:
                    known = False
                    break
                node ^= self.child(unit)
            self.starts[char] = known
        return known


class Normaliser:
    """Text to normalised bytes, with the source span of every byte."""

    def __init__(self, spec: pb.NormalizerSpec, suffix: bool = False, user: list[str] = ()):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.user = re.compile("|".join(re.escape(u) for u in sorted(user, key=len, reverse=True))) if user else None

    def changes(self, text: str) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, end, replacement) in bytes, in order, of all that the map replaces; user symbols stay as they are."""
        if self.map is None:
            return
        openers = [c for c in set(text) if self.map.opens(c)]
        if not openers and self.user is None:
            return
        heads = re.compile("|".join(filter(None, [self.user and self.user.pattern, "[" + "".join(map(re.escape, openers)) + "]" if openers else ""])))
        body, at, done = text.encode(), 0, 0
        for m in heads.finditer(text):
            done += len(text[at:m.start()].encode())
            at = m.start()
            if m.end() - m.start() > 1 or (self.user and self.user.match(text, at)):
                continue
            hit = self.map.longest(body, done)
            if hit is not None:
                yield done, done + hit[1], hit[0]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised bytes, begin, end): byte j comes from text bytes begin[j] to end[j].

        A byte that stays is its own source; all bytes of a replacement come from the whole
        string replaced; a space put in before or behind the text has an empty source.
        """
        body = text.encode()
        out, begins, ends, last = [], [], [], 0

        def keep(to: int) -> None:
            out.append(body[last:to])
            begins.append(np.arange(last, to, dtype=np.int32))
            ends.append(np.arange(last + 1, to + 1, dtype=np.int32))
        for start, end, new in self.changes(text):
            if start < last:                 # inside the string replaced before
                continue
            keep(start)
            out.append(new)
            begins.append(np.full(len(new), start, np.int32))
            ends.append(np.full(len(new), end, np.int32))
            last = end
        keep(len(body))
        norm, begin, end = np.frombuffer(b"".join(out), np.uint8), np.concatenate(begins), np.concatenate(ends)
        blank = norm == 0x20
        if self.squeeze and len(norm):
            stay = ~(blank & np.r_[True, blank[:-1]])
            norm, begin, end = norm[stay], begin[stay], end[stay]
        if not len(norm):
            return b"", begin, end
        space, own = (MARK, norm.tobytes().replace(SPACE, MARK)) if self.escape else (SPACE, norm.tobytes())
        times = np.where(norm == 0x20, len(space), 1)
        begin, end = np.repeat(begin, times), np.repeat(end, times)
        empty = np.zeros(len(space), np.int32)
        if self.dummy and not self.suffix:
            own, begin, end = space + own, np.concatenate([empty, begin]), np.concatenate([empty, end])
        if self.squeeze:                         # behind the text a mark of its own goes like a space
            n = len(own)
            while own.endswith(space, 0, n):
                n -= len(space)
            own, begin, end = own[:n], begin[:n], end[:n]
        if self.dummy and self.suffix:
            own, begin, end = own + space, np.concatenate([begin, empty + len(body)]), np.concatenate([end, empty + len(body)])
        return own, begin, end


class PieceEncoder:
    """A model's normaliser and its pieces. The library merges characters into pieces on text that is normalised here.

    Where no piece holds a space mark behind another character, no merge crosses the place
    before a mark that follows one; texts are cut there into words, and a worker remembers the
    pieces of the words it has seen. This holds for merges (BPE) only; other models get whole texts.
    """

    def __init__(self, model: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [p.type for p in proto.pieces]
        names = [p.piece for p in proto.pieces]
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix,
                                    [n for n, t in zip(names, kinds) if t == USER])
        for field in ("normalization_rule_tsv", "precompiled_charsmap"):
            proto.normalizer_spec.ClearField(field)
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unknown, self.end = self.merger.unk_id(), self.merger.eos_id()
        self.bytes_of = np.array([1 if t == BYTE else len(n.encode()) for n, t in zip(names, kinds)], np.int32)
        mark = MARK.decode()
        self.by_word = proto.trainer_spec.model_type == pb.TrainerSpec.BPE and USER not in kinds and mark in names and not any(
            a != mark and b == mark for n, t in zip(names, kinds) if t in (NORMAL, UNUSED) for a, b in zip(n, n[1:]))
        self.pairs = {p for n in names for p in zip(n, n[1:])} if self.by_word else set()
        self.word = re.compile(f"{mark}*[^{mark}]+|{mark}+")
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.pieces = np.empty((2, 1 << 16), np.int32)      # ids above their byte lengths, word by word
        self.start = np.zeros(1 << 14, np.int64)            # where the pieces of a code start; the next one's start ends them
        self.held = 0

    def words(self, norm: str) -> list[str]:
        """Strings that no merge crosses, in order."""
        if not self.by_word:
            return [norm] if norm else []
        found = self.word.findall(norm)
        if len(norm) > LONG and any(len(w) > LONG for w in found):
            return [part for w in found for part in (self.cut(w) if len(w) > LONG else [w])]
        return found

    def cut(self, word: str) -> Iterator[str]:
        """A very long word, cut between characters that stand side by side in no piece."""
        start = 0
        for i in range(1, len(word)):
            if i - start >= 1024 and (word[i - 1], word[i]) not in self.pairs:
                yield word[start:i]
                start = i
        yield word[start:]

    def remember(self, words: list[str], counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, at = len(self.code), int(self.start[len(self.code)])
        while at + len(ids) > self.pieces.shape[1]:
            self.pieces = np.hstack([self.pieces, np.empty_like(self.pieces)])
        while first + len(words) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.pieces[0, at:at + len(ids)], self.pieces[1, at:at + len(ids)] = ids, sizes
        self.start[first + 1:first + 1 + len(words)] = at + np.cumsum(counts)
        self.code.update(zip(words, range(first, first + len(words))))
        self.held += sum(map(len, words))

    def learn(self, words: list[str]) -> None:
        """Remember the pieces of the words not seen so far.

        Words that open with a mark and do not end with one are merged in one string: no merge
        crosses from one to the next, and byte lengths tell them apart again.
        """
        mark, alone, together = MARK.decode(), [], []
        for w in dict.fromkeys(words):
            if w not in self.code:
                (together if self.by_word and w[0] == mark != w[-1] else alone).append(w)
        if together:
            ids = np.array(self.merger.encode("".join(together), num_threads=1), np.int32)
            if (ids == self.unknown).any():
                alone += together
            else:
                sizes = self.bytes_of[ids]
                ends = np.searchsorted(np.cumsum(sizes), np.cumsum([len(w.encode()) for w in together]))
                self.remember(together, np.diff(ends + 1, prepend=0), ids, sizes)
        for w in alone:
            ids = np.array(self.merger.encode(w), np.int32)
            sizes = self.bytes_of[ids]
            if (ids == self.unknown).any():       # the length of an unknown piece is that of its surface
                sizes = np.array([len(p.surface.encode()) for p in self.merger.encode(w, return_type="proto").pieces], np.int32)
            self.remember([w], np.array([len(ids)]), ids, sizes)

    def encode(self, batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text: its pieces and the spans of UTF-8 bytes of the text that they stand for."""
        for text in batch:
            norm, begin, end = self.normalise(text)
            words = self.words(norm.decode())
            if len(self.code) > WORDS or self.held > CHARACTERS:
                self.forget()
            self.learn(words)
            if not words:
                yield np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
                continue
            codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
            counts = self.start[codes + 1] - self.start[codes]
            place = np.repeat(self.start[codes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            ids, size = self.pieces[:, place]
            upto = np.cumsum(size)
            if upto[-1] != len(norm):
                raise ArithmeticError("pieces do not cover the normalised text")
            yield ids, begin[upto - size], end[upto - 1]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model: str) -> PieceEncoder:
    """One encoder per worker and model. `model` names a file of the public tokenizers, or is a path on every executor."""
    if model not in _ENCODERS:
        import public_tokenizers
        path = model if "/" in model else public_tokenizers.path(model)
        with open(path, "rb") as f:
            _ENCODERS[model] = PieceEncoder(f.read())
    return _ENCODERS[model]


def ragged(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def kind_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end_id: bool = True) -> DataFrame:
    """One row per document: id, ids, begin, end. Piece k stands for bytes begin[k] to end[k] of the text's UTF-8.

    The normaliser follows the longest prefixes of the model's compiled character map and
    notes the source of every byte; pieces of the normalised text are projected back through
    it. Spans follow each other without overlap except where one source string became several
    pieces, which then all have its span; a byte piece has its byte. The space before the
    text and the end id have empty spans. A null text counts as empty: the end id alone.
    Null and repeated ids, repeated rows and any length are rows as any; a text is encoded
    whole. Other columns are not read; an empty table gives no rows.
    """
    def run(batches):
        own = encoder(model)
        tail = (np.array([own.end], np.int32),) if end_id else ()
        for batch in batches:
            bodies = texts(batch, "body")
            found = [(np.concatenate([i, *tail]), np.concatenate([b, *[[len(t)] for _ in tail]]).astype(np.int32),
                      np.concatenate([e, *[[len(t)] for _ in tail]]).astype(np.int32))
                     for t, (i, b, e) in zip(bodies, own.encode([t.decode() for t in bodies]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(ragged([f[k] for f in found]) for k in range(3))], [id_col, "ids", "begin", "end"])

    rows = small_batches(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as body"))
    return rows.mapInArrow(run, f"{id_col} {kind_of(docs, id_col)}, ids array<int>, begin array<int>, end array<int>")


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: id and the text that the library decodes from the ids; null ids count as none."""
    def run(batches):
        own = encoder(model)
        for batch in batches:
            ids = [i or [] for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([own.library.decode(i) for i in ids], pa.string())], [id_col, "text"])

    rows = small_batches(encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids"))
    return rows.mapInArrow(run, f"{id_col} {kind_of(encoded, id_col)}, text string")


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Digests of what encode_pieces and decode_pieces give, in one pass that keeps one text's pieces at a time.

    id, n_tokens, ids_sha256 (decimal ids, one space between), decoded_sha256, and uncovered:
    bytes of the text that no piece stands for (the spaces that a model drops; else 0).
    """
    def run(batches):
        own = encoder(model)
        names = [str(k) for k in range(own.merger.get_piece_size())]
        for batch in batches:
            rows = []
            bodies = texts(batch, "body")
            for body, (ids, begin, end) in zip(bodies, own.encode([b.decode() for b in bodies])):
                ids = [*ids.tolist(), own.end]
                left = len(body) - int((end - np.maximum(begin, np.r_[0, np.maximum.accumulate(end)[:-1]])).clip(0).sum()) if len(end) else len(body)
                rows.append((len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(own.library.decode(ids).encode()).hexdigest(), left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "uncovered"])

    rows = small_batches(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as body"))
    return rows.mapInArrow(run, f"{id_col} {kind_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string, uncovered long")


@query("op12_sentencepiece")
def op12_sentencepiece(spark, d):
    return piece_digests(table(spark, d, "documents"))
