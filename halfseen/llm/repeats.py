"""Repeated byte strings across documents: sampled suffixes are named by triples of blocks, what names leave open is merged and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halfseen.llm.common import gathered, handover, query, small_batches, table, tidy
from halfseen.llm.shingles import mix, texts

LENGTH = 100                   # a string of so many bytes that also starts earlier is removed
BLOCK = 50                     # bytes of a block; a triple is the block before a sampled position, at it and behind it
REACH = LENGTH - BLOCK         # a string's sample lies 0..REACH bytes behind its start
BATCH = 1 << 16                # bytes worked on at a time, unless one document is longer
LOW = np.uint64((1 << 24) - 1)
SEGMENT = (1 << 24) - 4 * LENGTH
SIEVE = 1 << 26                # bits of the map of repeated block names
DOC_SIEVE = 1 << 24            # bits of a map of documents
HOT = 20_000                   # names with more contexts than this are merged by aggregation instead of in a task

BASE = 0x9E3779B97F4A7C15
POWER = {n: np.uint64(pow(BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 18)}


def block_names(x: np.ndarray) -> np.ndarray:
    """64-bit name of every BLOCK-byte string of x, by doubling."""
    n = len(x) - BLOCK + 1
    c = {1: x.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8, 16):
        c[2 * k] = c[k][:-k] * POWER[k] + c[k][k:]
    return mix(c[32][:n] * POWER[18] + (c[16][32:32 + n] * POWER[2] + c[2][48:48 + n]))


def samples(x: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(document, position, near, far, name, triple) of the sampled positions of the documents x[start:end].

    Every string of LENGTH bytes has one sample: of the blocks inside it the one with the
    smallest name, the leftmost of equal ones. So equal strings have their samples at
    equal distances, which is what a difference cover is for, and neighbours share theirs:
    a sample at p serves the strings that start at p - far .. p - near. triple names the
    three blocks around p, as far as the document goes.
    """
    h = block_names(x)
    v = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16):
        v = np.minimum(v[:-k], v[k:])
    own = (np.minimum(v[:-(REACH - 31)], v[REACH - 31:]) & LOW).astype(np.int64)
    edge = np.zeros(len(x) + 1, np.int64)
    long = end - start >= LENGTH
    np.add.at(edge, start[long], 1)
    np.add.at(edge, end[long] - LENGTH + 1, -1)
    p = np.flatnonzero(np.cumsum(edge)[:len(own)] > 0)
    if not len(p):
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    own = own[p]
    doc = np.searchsorted(start, p, "right") - 1
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    a, doc = own[first], doc[first]
    name = mix(h[a])           # the smallest of many are small numbers: mixed again they spread over ranges and maps
    inside = (a - start[doc] >= BLOCK) & (a + LENGTH <= end[doc])
    left, right = h[np.maximum(a - BLOCK, 0)], h[np.minimum(a + BLOCK, len(h) - 1)]
    triple = mix(mix(left + h[a]) + right)
    raw = x.tobytes()
    for k in np.flatnonzero(~inside).tolist():
        lo, hi = max(int(start[doc[k]]), int(a[k]) - BLOCK), min(int(end[doc[k]]), int(a[k]) + LENGTH)
        triple[k] = xxhash.xxh64_intdigest(raw[lo:hi], seed=int(a[k]) - lo + 1)
    return doc, a - start[doc], a - p[last], a - p[first], name, triple


def sampled(bodies: list[bytes]) -> Iterator[tuple]:
    """samples() over batches of documents, with document numbers in `bodies`; documents beyond SEGMENT bytes in overlapping segments."""
    held, size, base = [], 0, 0

    def emit(parts):
        x = np.frombuffer(b"".join(parts), np.uint8)
        end = np.cumsum([len(b) for b in parts])
        return samples(x, end - [len(b) for b in parts], end)

    for i, body in enumerate(bodies):
        if len(body) > SEGMENT:
            if held:
                doc, *rest = emit(held)
                yield doc + base, *rest
            for lo in range(0, len(body) - LENGTH + 1, SEGMENT - LENGTH + 1):
                doc, pos, near, far, name, triple = emit([body[lo:lo + SEGMENT]])
                pos = pos + lo
                cut = (pos < lo + BLOCK) & (lo > 0) | (pos + LENGTH > lo + SEGMENT) & (lo + SEGMENT < len(body))
                for k in np.flatnonzero(cut).tolist():      # a triple that a segment cuts is named from the whole text
                    q = int(pos[k])
                    x = np.frombuffer(body[max(0, q - BLOCK):q + LENGTH], np.uint8)
                    h = block_names(x)
                    if q >= BLOCK and len(x) == BLOCK + LENGTH:
                        triple[k] = mix(mix(h[:1] + h[BLOCK:BLOCK + 1]) + h[2 * BLOCK:2 * BLOCK + 1])[0]
                yield doc + i, pos, near, far, name, triple
            held, size, base = [], 0, i + 1
            continue
        if held and size + len(body) > SEGMENT:     # positions in a batch stay below 2^24
            doc, *rest = emit(held)
            yield doc + base, *rest
            held, size, base = [], 0, i
        held.append(body)
        size += len(body)
        if size >= BATCH:
            doc, *rest = emit(held)
            yield doc + base, *rest
            held, size, base = [], 0, i + 1
    if held:
        doc, *rest = emit(held)
        yield doc + base, *rest


def repeated_names(docs: DataFrame, total_bytes: int) -> bytes:
    """Bitmap (by the leading bits) of block names that occur at two samples or more.

    Names are dealt out by range in packed arrays of the 32 bits behind their range's, at
    most two of a kind from a batch; each range is sorted once and reports its slice of the
    map, so the driver gets SIEVE bits. Names that agree in these bits count as repeated,
    which only leaves more to decide later.
    """
    ranges = min(1 << max(4, (total_bytes // 26 // 2_000_000).bit_length()), SIEVE // 8)
    bits = ranges.bit_length() - 1
    shift, rest, spot = np.uint64(64 - bits), np.uint64(32 - bits), np.uint64(SIEVE.bit_length() - 1 - bits)

    def names(batches):
        for batch in batches:
            found = [f[4] for f in sampled(texts(batch, "body"))]
            x = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
            x = x[np.r_[True, True, x[2:] != x[:-2]][:len(x)]]
            k = (x >> shift).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            tail = (x >> rest).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array([g.tobytes() for g in np.split(tail, cut[1:])] if len(k) else [], pa.binary())],
                                             ["k", "names"])

    def slices(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, b in zip(batch.column("k").to_pylist(), batch.column("names").to_pylist()):
                held.setdefault(k, []).append(b)
        for k in list(held):
            x = np.sort(np.frombuffer(b"".join(held.pop(k)), np.uint32))
            on = np.zeros(SIEVE // ranges, np.uint8)
            on[(x[1:][x[1:] == x[:-1]] >> np.uint32(32 - int(spot))).astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(on).tobytes()], pa.binary())], ["k", "bits"])

    dealt = docs.select("body").mapInArrow(names, "k long, names binary").repartition(ranges, "k")
    full = bytearray(SIEVE // 8)
    step = SIEVE // ranges // 8
    with tidy(docs.sparkSession):
        for r in dealt.mapInArrow(slices, "k long, bits binary").collect():
            full[r["k"] * step:(r["k"] + 1) * step] = r["bits"]
    return bytes(full)


def named(docs: DataFrame, sieve) -> DataFrame:
    """Samples whose name may be repeated: doc, spot (packed place), name (32 bits), triple, later.

    later: the batch holds the triple in an earlier document, or earlier in the same one. That
    settles the sample, so it gets a triple of its own and a triple of very many documents
    leaves a batch once.
    """
    bit = np.uint64(64 - SIEVE.bit_length() + 1)

    def run(batches):
        on = np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            ids, parts = batch.column("doc").to_numpy(), []
            for doc, pos, near, far, name, triple in sampled(texts(batch, "body")):
                at = (name >> bit).astype(np.int64)
                ok = (on[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                parts.append((ids[doc[ok]], pos[ok] << 12 | near[ok] << 6 | far[ok], name[ok], triple[ok]))
            if not parts:
                continue
            doc, spot, name, triple = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((spot, doc, triple))
            d, s, t = doc[order], spot[order], triple[order]
            again = np.r_[False, t[1:] == t[:-1]][:len(t)]
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(t)))) if len(t) else np.empty(0, np.int64)
            later = np.empty(len(t), bool)
            later[order] = again & ~((d == d[lead]) & (s >> 12 == s[lead] >> 12))
            triple = np.where(later, mix(doc.astype(np.uint64) * np.uint64(BASE) + spot.astype(np.uint64)), triple)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(spot), pa.array((name >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                              pa.array(triple.view(np.int64)), pa.array(later)], ["doc", "spot", "name", "triple", "later"])

    return docs.select("doc", "body").mapInArrow(run, "doc long, spot long, name int, triple long, later boolean")


def ruled(found: DataFrame, hot: int) -> DataFrame:
    """(doc, at) with at = structs of spot, state and name.

    State 2: the sample's triple also occurs in an earlier document (or earlier in its own),
    so all its strings do. 0, or 3 for a name with many contexts: it is the first of its
    triple, but its name has other triples. Samples whose strings are certainly first are
    left out.
    """
    front = F.min("doc").over(Window.partitionBy("triple"))
    told = handover(found.withColumn("front", front).select("doc", "spot", F.when(~F.col("later") & (F.col("doc") == F.col("front")), F.col("name")).alias("name")))
    firsts = told.where("name is not null")
    kinds = firsts.groupBy(F.col("name").alias("k")).agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    undecided = firsts.join(kinds, F.col("name") == F.col("k")).select(
        "doc", "spot", F.when(F.col("contexts") > hot, 3).otherwise(0).alias("state"), "name")
    settled = told.where("name is null").select("doc", "spot", F.lit(2).alias("state"), "name")
    each = settled.unionByName(undecided)
    return handover(each.groupBy("doc").agg(F.collect_list(F.struct("spot", "state", "name")).alias("at")))     # bounded by the document's length


def only_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc, body) of docs that may be in ids (doc): a broadcast bitmap of fixed size spares most others the shuffle of a join."""
    spot = F.pmod(F.xxhash64("doc"), F.lit(DOC_SIEVE))
    bits = np.zeros((DOC_SIEVE // 32768, 4096), np.uint8)
    with tidy(docs.sparkSession):
        for r in (ids.select(spot.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("k"))
                  .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()):
            bits[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    sieve = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        on = np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little")
        for batch in batches:
            yield batch.select(["doc", "body"]).filter(pa.array(on[batch.column("spot").to_numpy()] > 0))

    return docs.select("doc", "body", spot.alias("spot")).mapInArrow(run, "doc long, body string")


def open_suffixes(docs: DataFrame, at: DataFrame) -> DataFrame:
    """The contexts of samples in state 0 or 3: the bytes BLOCK before to LENGTH behind, padded with zeros where the document ends."""
    names = ["name", "doc", "spot", "state", "context"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    todo = at.select("doc", F.filter("at", lambda s: s["state"] != 2).alias("at")).where("size(at) > 0")

    def run(batches):
        for batch in batches:
            out = []
            for doc, found, body in zip(batch.column("doc").to_pylist(), batch.column("at").to_pylist(), texts(batch, "body")):
                for s in found:
                    p = s["spot"] >> 12
                    out.append((s["name"], doc, s["spot"], s["state"],
                                body[max(0, p - BLOCK):p].rjust(BLOCK, b"\0") + body[p:p + LENGTH].ljust(LENGTH, b"\0")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    rows = only_in(docs, todo.select("doc")).join(todo, "doc")
    return rows.select("doc", "at", "body").mapInArrow(run, "name int, doc long, spot long, state int, context binary")


def words_of(b: np.ndarray) -> list[np.ndarray]:
    """Big-endian 64-bit words of byte rows, most significant first."""
    b = np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))
    return list(np.ascontiguousarray(b).view(">u8").astype(np.uint64).T)


def adjacent(name: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows within their name and the length of the prefix each shares with the row before (-1: another name)."""
    order = np.lexsort((*reversed(words_of(b)), name))
    n, s = name[order], b[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), b.shape[1])
    return order, np.r_[-1, np.where(n[1:] == n[:-1], common, -1)] if len(n) else np.empty(0, np.int64)


def merged(t: pa.Table) -> pa.RecordBatch:
    """(doc, spot, mask): for samples of whole names, a bit for every distance whose string also starts earlier.

    Suffixes from the samples are sorted, and so are the reversed bytes before them. A
    string that starts d bytes before a sample is the d bytes before it and the LENGTH - d
    bytes from it: equal strings are runs of shared prefixes in both orders.
    """
    name, doc, spot = (t.column(c).to_numpy() for c in ("name", "doc", "spot"))
    pos, near, far = spot >> 12, spot >> 6 & 63, spot & 63
    context = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(-1, BLOCK + LENGTH)
    right, rprefix = adjacent(name, context[:, BLOCK:])
    left, lprefix = adjacent(name, context[:, BLOCK - 1::-1])
    age = np.empty(len(name), np.int64)
    age[np.lexsort((pos, doc))] = np.arange(len(name))
    mask = np.zeros(len(name), np.int64)
    r, q = np.empty(len(name), np.int64), np.empty(len(name), np.int64)
    for d in range(REACH + 1):
        take = np.flatnonzero((near <= d) & (d <= far))
        if len(take) < 2:
            continue
        r[right], q[left] = np.cumsum(rprefix < LENGTH - d), np.cumsum(lprefix < d)
        key = r[take] * (len(name) + 1) + q[take]
        order = np.lexsort((age[take], key))
        again = np.r_[False, key[order][1:] == key[order][:-1]]
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        at, front = take[order], take[order][lead]
        later = again & ~((doc[at] == doc[front]) & (pos[at] == pos[front]))
        mask[at[later]] |= np.int64(1) << np.int64(d)
    hit = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(spot[hit]), pa.array(mask[hit])], ["doc", "spot", "mask"])


def merge_names(rows: DataFrame) -> DataFrame:
    """merged() over whole names, each in one task; names have at most HOT contexts."""
    def run(batches):
        held = None
        for t in gathered(batches):
            t = t if held is None else pa.concat_tables([held, t])
            name = t.column("name").to_numpy()
            cut = int(np.argmax(name == name[-1]))
            held = t.slice(cut)
            if cut:
                yield merged(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield merged(held)

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, "doc long, spot long, mask long")


def merge_hot(rows: DataFrame) -> DataFrame:
    """The same for names with many contexts: one row per string, the first found by an aggregation with map-side combining."""
    pos, near, far = F.shiftright("spot", 12), F.shiftright("spot", 6).bitwiseAND(63), F.col("spot").bitwiseAND(63)
    each = rows.select("doc", "spot", pos.alias("pos"), F.explode(F.sequence(near.cast("int"), far.cast("int"))).alias("d"), "context")
    each = each.withColumn("string", F.unhex(F.sha2(F.expr(f"substring(context, {BLOCK} - d + 1, {LENGTH})"), 256))).drop("context")
    front = each.groupBy("d", "string").agg(F.min(F.struct("doc", "pos")).alias("front"))
    later = each.join(front, ["d", "string"]).where("not (doc = front.doc and pos = front.pos)")
    return later.groupBy("doc", "spot").agg(F.expr("bit_or(shiftleft(1L, d))").alias("mask"))


def cut_out(docs: DataFrame) -> DataFrame:
    """(doc, n_removed, n_spans, kept_sha256) of documents with ruled samples (at) and masks."""
    names = ["doc", "n_removed", "n_spans", "kept_sha256"]

    def one(body: bytes, at, masks):
        edge = np.zeros(len(body) + 1, np.int32)
        for s in at:
            if s["state"] == 2:
                p = s["spot"] >> 12
                edge[p - (s["spot"] & 63)] += 1
                edge[p - (s["spot"] >> 6 & 63) + LENGTH] -= 1
        for m in masks or ():
            p = m["spot"] >> 12
            for d in range(REACH + 1):
                if m["mask"] >> d & 1:
                    edge[p - d] += 1
                    edge[p - d + LENGTH] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(body, np.uint8)[~gone]
        return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept.tobytes()).hexdigest()

    def run(batches):
        for batch in batches:
            out = [one(b, at, m) for b, at, m in zip(texts(batch, "body"), batch.column("at").to_pylist(), batch.column("masks").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(
                pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string())))], names)

    return docs.select("doc", "body", "at", "masks").mapInArrow(run, "doc long, n_removed long, n_spans long, kept_sha256 string")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body and doc: a number of its own for every text of an id, in the order that counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    behind = F.shiftright(F.xxhash64("body"), 2) + F.lit((1 << 62) + (1 << 61))
    tie = rows.where("id is not null").select("id", F.xxhash64("body").alias("tie"))
    clash = handover(tie.groupBy(F.col("id").alias("c")).agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b").select("c"))
    if clash.isEmpty():
        return rows.withColumn("doc", F.coalesce("id", behind))
    return rows.join(clash, F.col("id") == F.col("c"), "left").withColumn("doc", F.when(F.col("c").isNull(), F.col("id"))).withColumn(
        "doc", F.coalesce("doc", behind)).drop("c")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 after removing every byte that is covered by a string of LENGTH bytes
    which also starts earlier (in a document with a smaller id, or before in the same one).

    1. Sampled positions are named by the block at them and by the triple of blocks around
       them. Names that occur once decide their strings at once.
    2. The names recur in an aggregation: of equal triples only the first is kept in play,
       the strings of the others are repeats; a name with one triple is decided too.
    3. For the rest the suffixes from the samples and the reversed bytes before them are
       sorted, the strings between samples are merged in by their distance, and adjacent
       prefixes say which are equal. Bytes are compared here; names are 64-bit hashes.

    Rows of one id and text are one document. Rows without id, and rows that share an id
    but not a text, count as behind all others, in the order of a hash of their text. Null
    and empty texts have no bytes. Other columns are not read; an empty table gives no rows.
    """
    rows = keyed(small_batches(docs), id_col, text_col)
    long = rows.where(F.octet_length("body") >= LENGTH).select("doc", "body")
    total = long.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    sieve = docs.sparkSession.sparkContext.broadcast(repeated_names(long, total))
    at = ruled(named(long, sieve), hot)
    suffixes = handover(open_suffixes(long, at))
    masks = merge_names(suffixes.where("state = 0")).unionByName(merge_hot(suffixes.where("state = 3")))
    masks = handover(masks.distinct().groupBy("doc").agg(F.collect_list(F.struct("spot", "mask")).alias("masks")))
    touched = only_in(long, at.select("doc")).join(at, "doc").join(masks, "doc", "left")
    cut = handover(cut_out(touched)).dropDuplicates(["doc"])
    out = rows.select("id", "doc", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return out.join(cut, "doc", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


@query("op10_repeated_strings")
def op10_repeated_strings(spark, d):
    return repeated_strings(table(spark, d, "documents"))
