"""Operators of the training-data package against plain statements of what they compute, on awkward rows."""

import collections
import hashlib
import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from halfseen.llm import common, decontaminate, exact_dedup, near_dedup, packing, repeats, secrets, sharding, toxicity, url_filter, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, body int, key string, n int, label int"


def extra(rows):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return [(i, t, "x", 1, "k", 2, 1) for i, t in rows]


PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up every jar of liquid zinc and then "
         "walked home along the river under a pale moon without saying a single word to anyone they met on the long way back")
AWKWARD = [
    (1, PROSE), (2, PROSE), (3, PROSE.replace("seven", "eight")), (4, PROSE.upper()), (5, None), (6, ""), (7, "one two"), (8, "one  TWO"),
    (9, " \t\n"), (10, "äöü ß ÄÖÜ ż 漢字 " * 12), (11, "äöü ß ÄÖÜ ż 漢字 " * 12), (12, "word " * 60_000), (13, "password: hunter2hunter2"), (None, PROSE),
    (None, "lonely text of a row without id"), (14, PROSE + " " + PROSE), (1, PROSE), (15, "x" * 99), (16, "x" * 100), (17, "x" * 101), (18, "x" * 300),
]
UNIQUE = [r for k, r in enumerate(AWKWARD) if r[0] is not None and k != 16]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(extra(AWKWARD), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_copies(spark, awkward, nothing):
    for bits in (128, 4):       # with 4 bits different texts share hashes
        got = exact_dedup.exact_dedup(awkward, hash_bits=bits).collect()
        assert len(got) == len(AWKWARD)
        groups = collections.defaultdict(list)
        for i, t in AWKWARD:
            groups[t or ""].append(i)
        for r in got:
            text = next(t or "" for i, t in AWKWARD if i == r["doc_id"] and hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])
            ids = [i for i in groups[text] if i is not None]
            assert r["group_size"] == len(groups[text]) and r["keep_id"] == (min(ids) if ids else None)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(awkward, keep="largest").where("doc_id = 1").collect()} == {2}
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_near_copies_awkward(awkward, nothing):
    got = near_dedup.near_dedup(awkward).collect()
    want, sizes = brute.near_groups(UNIQUE)
    assert len(got) == len(AWKWARD)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [1, None]
    assert near_dedup.near_dedup(nothing).count() == 0


def test_near_copies_brute(spark, documents):
    """A family of edited copies whose links need the second phase, among the given documents; small cells force blocks."""
    import random
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    family = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        family.append((10_000 + k, " ".join(w)))
    rows = pairs(documents) + family
    want, sizes = brute.near_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (1024, 16):
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dedup.near_dedup(df, cell=cell).collect()}
        assert got == {i: (want[i], sizes[i]) for i in want}


def test_odd_sketch_estimates_high_similarity():
    import numpy as np
    rng = np.random.default_rng(3)
    for n, share in ((400, 0.9), (5000, 0.8), (60, 0.95)):
        common_part = rng.integers(0, 2**63, int(n * share), dtype=np.uint64) * np.uint64(2)
        own = [np.unique(np.r_[common_part, rng.integers(0, 2**63, n - len(common_part), dtype=np.uint64) * np.uint64(2)]) for _ in range(2)]
        j = len(common_part) / (len(own[0]) + len(own[1]) - len(common_part))
        (a, s1), (b, s2) = map(near_dedup.odd_sketch, own)
        z = near_dedup.sketch_bits(np.frombuffer(a, np.uint64)[None], np.frombuffer(b, np.uint64)[None])
        ok = near_dedup.margin(z, np.array([s1]), np.array([s2]), np.array([len(own[0])]), np.array([len(own[1])]), 75)[0] >= 0
        assert ok == (j >= 0.6)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark, awkward, nothing, documents):
    items = [(1, " ".join(PROSE.split()[3:20])), (2, "one two"), (3, None), (4, ""), (5, "word " * 40), (6, "never seen words in any text at all"),
             (7, PROSE + " and a tail"), (8, "quick brown fox jumps over the")]
    table = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, id string, n int")
    want = brute.contained(AWKWARD, items)
    for block in (2_000_000, 20):
        got = decontaminate.contained_items(awkward, table, block_shingles=block)
        assert {tuple(r) for r in got.collect()} == want
    assert decontaminate.contained_items(nothing, table).count() == 0
    assert decontaminate.contained_items(awkward, table.limit(0)).count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate.contained_items(documents, bench).collect()
    assert {tuple(r) for r in got} == brute.contained(pairs(documents), [(r["item_id"], r["text"]) for r in bench.collect()])


def test_archives_round_trip(spark, nothing):
    big = "<p>" + "payload " * 50_000
    rows = [(1, "http://a/x", big), (2, "http://a/y", big), (3, None, None), (4, "http://b\r\nX: 1", "short"), (5, "u", "short"), (None, "n", big),
            (None, "m", "only without id " * 20), (None, "k", "only without id " * 20), (6, "ü", "ä" * 60), (7, "z", "ä" * 60), (1, "http://a/x", big)]
    rows += [(100 + k, f"http://site/{k}", f"<html><body><h1>title {k}</h1>" + "menu item " * 200 + str(k)) for k in range(60)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(2)
    folder = common.shared_path(spark, "warc-test")
    archives = warc.write_archives(pages, folder)
    got = warc.read_archives(spark, archives).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): h or "" for _, _, h in rows}
    for r in got:
        text = by_digest[r["payload_digest"]]
        shared = len(text.encode()) >= 100 and text in first and r["page_id"] != first[text]
        assert r["record_type"] == ("revisit" if shared else "response") and r["refers_to"] == (first[text] if shared else None)
        assert r["payload_bytes"] == len(text.encode()) and (r["payload"] is None if shared else bytes(r["payload"]) == text.encode())
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(i for i, _, _ in rows)
    import struct
    with_dictionary = 0
    for a in archives.collect():
        fs, path = warc.filesystem(a["archive"])
        data = fs.open_input_stream(path, compression=None).read()
        with_dictionary += struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
    assert with_dictionary
    empty = pages.limit(0)
    assert warc.round_trip(empty).count() == 0


def test_url_verdicts(spark):
    urls = ["http://www.example.com/en/1", "http://x.example.com/en/1?q#f", "HTTP://A.Example.COM/de/2", "http://shop.net/es/1", "http://shop.net/fr",
            "http://com", "http://com/", "http://xcom/", None, "", "no scheme", "http://best-casino-bets.example.org/win", "https://museum.example.org/en/5",
            "a://b://c/d", "http://Ä.com/x", "http://h.net/fr/?a", "x" * 100_000, "http://\n.com/\n/"]
    df = spark.createDataFrame([(k if k != 3 else None, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rules = [(v, h, p) for v, h, p in url_filter.RULES]
    got = url_filter.url_verdicts(df).collect()
    assert len(got) == len(urls)
    for r in got:
        k = 3 if r["page_id"] is None else r["page_id"]
        host, path = brute.url_parts(urls[k])
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == (max(fit)[2] if fit else "block" if r["p_block"] >= 0.5 else "allow")
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[11] == "block" and verdict[12] == "allow"
    assert url_filter.url_verdicts(df.limit(0)).count() == 0
    unlabelled = url_filter.default_table(spark).limit(0)
    assert {r["verdict"] for r in url_filter.url_verdicts(df, unlabelled, rules=[]).collect()} == {"allow"}
    one_kind = url_filter.default_table(spark).where("label = 0")
    assert {r["verdict"] for r in url_filter.url_verdicts(df, one_kind, rules=[]).collect()} == {"allow"}


def test_packing(spark, awkward, nothing, documents):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    odd = ["It's 'sNice\t\tX y", "a'b.c", "<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>", "Σας ΣΣ. á.b̸≮=", "don't!!'re ('s '(s", "12ab3.4,5É.Ñ", "\x1c a\x1fb\x0bc"]
    df = awkward.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")).unionByName(
        spark.createDataFrame([(5000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = packing.pack(df).collect()
    want = collections.Counter()
    for i, t in pairs(df):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = b"".join(x.to_bytes(4, "little") for x in ids[s:s + 4096])
            want[(i, k, s, len(own) // 4, zlib.crc32(own))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) + 3
    assert packing.pack(nothing).count() == 0


def test_open_bins_stay_bounded_and_close_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 5, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0), (2, 5)]
    bins = packing.OpenBins(10, 2)
    placed = [bins.place(n) for n in (8, 7, 6, 3)]      # the bin filled to 8 closes for the third
    assert placed == [(0, 0), (1, 0), (2, 0), (1, 7)] and bins.open == 1


def test_shards(spark, awkward, nothing, documents):
    rows = [(k, "copied text") for k in range(90)] + [(200 + k, f"pair {k // 2}") for k in range(60)] + [(400 + k, f"own {k}") for k in range(57)]
    big = spark.createDataFrame(rows, "doc_id long, text string")
    for df, shards in ((awkward, 4), (documents, 40), (big, 10), (big, 40)):
        got = sharding.balanced_shards(df, shards=shards).collect()
        n = df.count()
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
            (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs(df))
        count = collections.Counter(r["shard"] for r in got)
        assert set(count) <= set(range(shards)) and max(count.values()) - (min(count.values()) if len(count) == shards else 0) <= 1 and sum(count.values()) == n
        for s in count:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
        assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    at = {r["doc_id"]: r["shard"] for r in sharding.balanced_shards(big, shards=10).collect()}
    assert len({at[k] for k in range(90)}) <= 7                                          # 90 copies need five shards of 21; they start in ten
    assert sum(at[200 + k] != at[201 + k] for k in range(0, 60, 2)) == 0                 # pairs stay together
    assert sharding.balanced_shards(nothing).count() == 0


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (4, None, "x"), (None, 1, "x"), (6, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (5, 6, 9)} == {0.0}
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(awkward, labels.limit(0)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(awkward.where("length(trim(text)) > 5"), labels.where("doc_id = 1")).collect()} == {1}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = lambda i: ~toxicity.held_out(i)
    got = toxicity.toxicity(docs, labels, train=train).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    toxic = [r for r in got if r["toxic"] == 1]
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    held = {r["doc_id"] for r in got}
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)


def test_toxicity_finds_the_sentence():
    clean = [(f"a calm sentence number {k}. another one about trees.".encode(), 0) for k in range(60)]
    bad = [(f"a calm sentence number {k}. what a dreadful {w} you are. more about trees.".encode(), 1) for k in range(30) for w in ("blork", "blorks")]
    weights, bias = toxicity.fit(clean + bad)
    assert bias < -2 and any(f.startswith(b"blor") and w > 1 for f, w in weights.items())


def test_secrets(spark, awkward, nothing, documents):
    odd = ['API_KEY = "abcdefgh12345" tOken:x1y2z3w4v5 paſſword=nothing1 secret=short', "AKIA" + "B" * 12 + " AKIA AKIA123", "deadbeef" * 4 + "g" + "deadbeef" * 3,
           "é password='ünot' ß passwd==aaaaaaaa=", "token=a password=bbbbbbbbbb",
           "user=anna\nkey aB3" + "dE4" * 12 + "f\nhttps://db.example.org/x\n\nuser=berta alone", "lonely aB3" + "dE4" * 12 + "f"]
    df = awkward.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(9000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = collections.Counter(((r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) for r in secrets.secret_scan(df).collect())
    assert got == collections.Counter(brute.base_secrets(t)[:2] for _, t in pairs(df))
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(df).where("doc_id >= 9000").collect()}
    for k, t in enumerate(odd[:5]):
        assert set(filter(None, brute.base_secrets(t)[2].split(","))) <= set(spans[9000 + k].split(","))
    assert [s.split(":")[0] for s in spans[9005].split(",")] == ["ident", "secret", "endpoint"] and spans[9006] == ""
    assert secrets.secret_scan(nothing).count() == 0


def test_repeated_strings(spark, awkward, nothing, documents):
    for rows in (UNIQUE, pairs(documents)):
        df = spark.createDataFrame(extra(rows), SCHEMA)
        want = brute.repeated_strings(rows)
        for hot in (repeats.HOT, 1):
            got = repeats.repeated_strings(df, hot=hot).collect()
            assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    got = repeats.repeated_strings(awkward).collect()
    assert len(got) == len(AWKWARD) and {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == [0, len(PROSE)]
    assert repeats.repeated_strings(nothing).count() == 0


def test_long_documents_in_segments(monkeypatch):
    import random
    rnd = random.Random(1)
    body = bytes(rnd.randrange(97, 123) for _ in range(3000))
    body += body[500:1500]
    whole = {(int(p), int(n), int(t)) for _, pos, near, far, name, triple in repeats.sampled([body]) for p, n, t in zip(pos, name, triple)}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = {(int(p), int(n), int(t)) for _, pos, near, far, name, triple in repeats.sampled([b"x" * 10, body]) for p, n, t in zip(pos, name, triple)}
    assert parts == whole


def test_pipeline(spark, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = pairs(docs), common.handover(stage(spark, docs, SF))
        after, left = pairs(docs), dict(pairs(docs))
        assert docs.columns == documents.columns and len(after) == len(left)
        if name == "toxicity":
            gone = {i for i, _ in before} - set(left)
            assert all(labels.get(i) != 0 for i in gone) and gone
        if name == "exact_dedup":
            keep = {}
            for i, t in sorted(before):
                keep.setdefault(t, i)
            assert set(left) == set(keep.values())
        if name == "near_dedup":
            comp, _ = brute.near_groups(before)
            assert set(left) == {i for i in comp if comp[i] == i}
        if name == "decontamination":
            assert set(left) == {i for i, _ in before} - {h[0] for h in brute.contained(before, items)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} == set(left)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(left)
