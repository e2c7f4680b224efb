"""Piece encoding against the library itself: ids, decoded texts, normalised texts and source alignment."""

import hashlib
import random

import pytest
import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2 as pb

import public_tokenizers
from halfseen.llm import pieces

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, body int, ids string, begin int"
ODD = ["", " ", "   ", "a", " a", "a ", "  a  b   c ", "▁", "a▁b ▁ ▁▁c", "\x00 \x01\t\n\r\n", "<s>", "</s> <unk> <0x0A>", "�", "ﬁ ① ｱﾞ ㌔ Å é", "é ö̈",
       "漢字かな交じり文です。" * 30, "🙂👩‍👩‍👧 🏳️‍🌈", "x" * 5000, "  　 　wide　space", "¨ ´ ½", "ŉ ǆ ﷺ", " no­break​", "word " * 400, "ÄÖÜ" * 300, "0123456789" * 50]


def model_bytes():
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        return f.read()


def remade(rule="nmt_nfkc", squeeze=True, suffix=False, dummy=True, bytes_=True, user=()):
    """The public model under another normaliser; no training, only its stated settings differ."""
    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes())
    if rule:
        other = pb.ModelProto()
        other.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
        proto.normalizer_spec.name = rule
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, dummy
    proto.trainer_spec.treat_whitespace_as_suffix = suffix
    if not bytes_:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pieces.BYTE:
                p.type = pieces.UNUSED
    for k, u in enumerate(user):
        proto.pieces[20_000 + k].piece, proto.pieces[20_000 + k].type = u, pieces.USER
    return proto.SerializeToString()


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    alphabet = "aaabcdeehtins   ﬁ①ｱﾞ㌔Ǻ̈éß漢字▁　 ​½🙂\t.,-'\"ﷺ¨㍿"
    return ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("settings", [dict(), dict(rule=None, squeeze=False), dict(rule=None), dict(squeeze=False), dict(suffix=True), dict(dummy=False),
                                      dict(rule="nfkc_cf"), dict(bytes_=False), dict(rule=None, squeeze=False, bytes_=False), dict(user=("zzth", "¨e", "①"))])
def test_same_ids_as_the_library(settings):
    model = remade(**settings)
    library, own = spm.SentencePieceProcessor(model_proto=model), pieces.PieceEncoder(model)
    assert own.by_word == ("user" not in settings)
    rows = ODD + random_texts(300)
    for text, (ids, begin, end) in zip(rows, own.encode(rows)):
        assert ids.tolist() == library.encode(text), text
        assert (begin <= end).all() and (not len(end) or end.max() <= len(text.encode()))


def test_alignment_is_the_library_s():
    """Begin of every normalised character, from the library's own table of offsets."""
    library = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normaliser(proto.normalizer_spec)
    for text in ODD + random_texts(300, 9):
        want, offsets = library.Normalize(text, with_offsets=True)
        norm, begin, end = own(text)
        assert norm.decode() == want
        at = [len(text[:o].encode()) for o in offsets]
        j = 0
        for c, o in zip(want, at):
            assert begin[j] == o or c == "▁" and begin[j] == 0, text
            j += len(c.encode())
        assert len(begin) == len(end) == len(norm)


def test_longest_prefix_of_the_map():
    other = pb.ModelProto()
    other.ParseFromString(spm.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    found = pieces.CharMap(other.normalizer_spec.precompiled_charsmap)
    assert found.longest("ﬁx".encode()) == (b"fi", 3) and found.longest(b"plain") is None
    assert found.longest("ｶﾞ".encode()) == ("ガ".encode(), 6) and found.longest("ｶ".encode()) == ("カ".encode(), 3)
    assert found.opens("ﬁ") and not found.opens("日") and pieces.CharMap(b"").longest(b"a") is None


def test_spans_give_the_text_back():
    own = pieces.PieceEncoder(model_bytes())
    for text, (ids, begin, end) in zip(ODD, own.encode(ODD)):
        body = text.encode()
        assert b"".join(body[a:b] for a, b in zip(begin, end)) == body
        for i, a, b in zip(ids.tolist(), begin, end):
            piece = own.library.id_to_piece(i)
            assert body[a:b] == (bytes([int(piece[3:5], 16)]) if own.library.is_byte(i) else piece.replace("▁", " ").encode() if a or b else b"") \
                or piece.startswith("▁") and (not a or "▁" in text)


def test_words_forgotten_and_long_words_cut(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "LONG", 2000)
    own = pieces.PieceEncoder(model_bytes())
    rows = ["漢字かな交じり文です。" * 900, "x" * 6000, "abc漢x9-" * 1500, *ODD]
    assert len(own.words(rows[2])) > 2 and max(map(len, own.words(rows[2]))) < 1100
    for text, (ids, _, _) in zip(rows, own.encode(rows)):
        assert ids.tolist() == own.library.encode(text)


def test_encode_and_decode_frames(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (700, None), (1, " "), (1, " ")]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(4)
    library = spm.SentencePieceProcessor(model_proto=model_bytes())
    encoded = pieces.encode_pieces(df)
    got = encoded.collect()
    assert sorted((tuple(r["ids"]) for r in got)) == sorted(tuple(library.encode(t or "", add_eos=True)) for _, t in rows)
    assert all(len(r["ids"]) == len(r["begin"]) == len(r["end"]) for r in got)
    decoded = sorted(((r["doc_id"], r["text"]) for r in pieces.decode_pieces(encoded).collect()), key=str)
    assert decoded == sorted(((i, library.decode(library.encode(t or "", add_eos=True))) for i, t in rows), key=str)
    assert [r["ids"] for r in pieces.encode_pieces(df.where("doc_id = 0"), end_id=False).collect()] == [[]]
    for f in (pieces.encode_pieces, pieces.piece_digests):
        assert f(df.limit(0)).count() == 0
    assert {r["uncovered"] for r in pieces.piece_digests(df).collect()} == {0}


def test_digests_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    library = spm.SentencePieceProcessor(model_proto=model_bytes())

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want[r["doc_id"]] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    assert {r["doc_id"]: tuple(r)[1:4] for r in pieces.piece_digests(df).collect()} == want
