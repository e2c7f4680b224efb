"""Near duplicates: MinHash bands propose, odd sketches sift, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import components, gathered, handover, join_back, numbered, query, small_batches, table
from halfseen.llm.shingles import S32, WORDS, WordHashes, mix, shingle_set, texts

BANDS, ROWS = 40, 4        # a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**40 = 3e-7
BINS, BITS = 1024, 2048    # MinHash samples of the odd sketch, and its width
SIGMAS = 5.0               # a pair is sifted out when its estimate lies so far below the threshold
SIEVE = 1 << 24            # bits of the map of documents whose sets are asked for
CELL = 1024                # rows of one side that a task compares at a time


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(x: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from bands * rows minimum hashes of the set x."""
    a = (multipliers(bands * rows) >> S32).astype(np.uint32)[:, None] | np.uint32(1)
    x = (x >> S32).astype(np.uint32)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (a * x[None, i:i + 1024]).min(axis=1), out=low)
    low = low.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key + low[:, i])
    return key.view(np.int64)


def odd_sketch(x: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the MinHash samples (the smallest hash in each of BINS ranges) and their number.

    x is sorted, so the first hash in a range is its minimum. Each sample flips one bit.
    """
    bins = (x >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    at = (mix(x[first]) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes(), len(first)


def margin(z, s1, s2, n1, n2, percent: int) -> np.ndarray:
    """How far above the lowest credible value the matches of two sketches that differ in z bits lie; below 0: not at the threshold.

    From z follows the number of samples the sets do not share, from it the matches M. At
    the threshold J the union fills U bins, of which J * U match; M may lie SIGMAS standard
    deviations below (sampling and folding noise together). Sets too different in size
    cannot reach the threshold.
    """
    j = percent / 100
    full = 1 - 2 * np.minimum(z, BITS / 2 - 1) / BITS
    m = (s1 + s2 + BITS / 2 * np.log(full)) / 2
    u = BINS * -np.expm1(-(n1 + n2) / (1 + j) / BINS)
    d = np.maximum(s1 + s2 - 2 * j * u, 1.0)
    fold = np.sqrt(BITS / 4 * -np.expm1(-4 * d / BITS)) * np.exp(2 * d / BITS) / 2
    over = m - (j * u - SIGMAS * np.sqrt(j * (1 - j) * u + fold ** 2) - 1)
    return np.where(100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2), over, -1.0)


def sketch_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def as_words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), BITS // 64)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """id, n (set size), fp (of the set), keys (one per band), sketch, s (its samples); no keys for an empty set."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64())),
                        ("sketch", pa.binary()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in texts(batch, "body"):
                x = shingle_set(text, hashes, words)
                if len(x):
                    sketch, s = odd_sketch(x)
                    out.append((len(x), xxhash.xxh3_128_digest(x.tobytes()), band_keys(x, bands, rows), sketch, s))
                else:
                    out.append((0, None, None, None, 0))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])],
                                             schema=schema)

    return docs.select("id", "body").mapInArrow(run, "id long, n long, fp binary, keys array<long>, sketch binary, s long")


def sift(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose odd sketches allow the threshold."""
    for side in "ab":
        pairs = pairs.join(sketches.select(*[F.col(c).alias(f"{c}_{side}") for c in sketches.columns]), F.col(side) == F.col(f"id_{side}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = sketch_bits(as_words(batch.column("sketch_a")), as_words(batch.column("sketch_b")))
                ok = margin(z, *numbers(batch, "s_a", "s_b", "n_a", "n_b"), percent) >= 0
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "sketch_a", "sketch_b", "s_a", "s_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def cells(entries: DataFrame, labels: DataFrame, cell: int) -> DataFrame:
    """Rows (key, i, j, role, id, comp): who is compared with whom.

    Buckets with the same members are compared once, buckets inside one component not at
    all. Within a bucket only documents outside its largest component ask (role 0); askers
    and members (role 1) are cut into blocks of about `cell` rows, and (i, j) is a pair of
    blocks.
    """
    e = entries.select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("comp"))
    by_comp = e.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h"))
    stats = (by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.sum("h").alias("h"))
             .where("main.c < m").groupBy("m", "h").agg(F.min(F.struct("key", "main")).alias("k"))
             .select("k.key", F.col("k.main.comp").alias("main"), F.ceil((F.col("m") - F.col("k.main.c")) / cell).alias("g"),
                     F.ceil(F.col("m") / cell).alias("h")))
    slot = F.xxhash64("id", F.lit(7))
    at = F.explode(F.concat(
        F.when(F.col("comp") != F.col("main"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), lambda j: F.struct(
            F.lit(0).alias("role"), F.pmod(slot, F.col("g")).alias("i"), j.alias("j")))).otherwise(F.array()),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda i: F.struct(
            F.lit(1).alias("role"), i.alias("i"), F.pmod(slot, F.col("h")).alias("j")))))
    return e.join(stats, "key").select("key", "id", "comp", at.alias("at")).select("key", "at.i", "at.j", "at.role", "id", "comp")


def by_cell(rows: DataFrame, compare, schema: str) -> DataFrame:
    """Apply compare(table of whole cells, sorted) -> batch."""
    rows = rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "role")

    def run(batches):
        held = None
        for t in gathered(batches):
            t = t if held is None else pa.concat_tables([held, t])
            last = [t.column(c)[t.num_rows - 1].as_py() for c in ("key", "i", "j")]
            open_ = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(open_))
            held = t.slice(cut)          # the last cell waits for its remaining rows
            if cut:
                yield compare(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield compare(held)

    return rows.mapInArrow(run, schema)


def cross_pairs(t: pa.Table, sk: np.ndarray, n: np.ndarray, s: np.ndarray, percent: int):
    """Per cell and chunk of pairs: indices (x, y) of asker and member in different components, and their margin, where not below 0."""
    key, i, j, role, comp = (t.column(c).to_numpy() for c in ("key", "i", "j", "role", "comp"))
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    size = np.diff(np.r_[start, len(key)])
    asks = size - np.add.reduceat(role, start)
    work = asks * (size - asks)
    chunk = np.cumsum(work) // 100_000
    for c in np.unique(chunk):
        at = np.flatnonzero((chunk == c) & (work > 0))
        if not len(at):
            continue
        group = np.repeat(at, work[at])
        k = np.arange(len(group)) - np.repeat(np.cumsum(work[at]) - work[at], work[at])
        members = (size - asks)[group]
        x, y = start[group] + k // members, start[group] + asks[group] + k % members
        ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        for lo in range(0, len(x), 50_000):
            p, q = x[lo:lo + 50_000], y[lo:lo + 50_000]
            over = margin(sketch_bits(sk[p], sk[q]), s[p], s[q], n[p], n[q], percent)
            keep = over >= 0
            yield p[keep], q[keep], over[keep]


def undecided(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of cells that have, across components, a partner their sketches allow."""
    names = ["key", "i", "j", "role", "id", "comp"]

    def compare(t: pa.Table) -> pa.RecordBatch:
        hit = np.zeros(t.num_rows, bool)
        sk = as_words(t.column("sketch").combine_chunks())
        for x, y, _ in cross_pairs(t, sk, t.column("n").to_numpy(), t.column("s").to_numpy(), percent):
            hit[x] = hit[y] = True
        return t.select(names).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else pa.RecordBatch.from_pylist(
            [], schema=t.select(names).schema)

    with_sketch = rows.join(sketches.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).drop("sid")
    return by_cell(with_sketch, compare, "key long, i long, j long, role int, id long, comp long")


def same_share(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def decide(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components inside each cell, decided on full sets.

    The likeliest pairs come first; a pair whose ends a cell has joined already needs no
    decision, every other pair the sketches allow gets one.
    """
    def compare(t: pa.Table) -> pa.RecordBatch:
        grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        drawn = [odd_sketch(x) for x in grams]
        sk = np.frombuffer(b"".join(b for b, _ in drawn), np.uint64).reshape(-1, BITS // 64)
        n, s = np.array([len(x) for x in grams]), np.array([k for _, k in drawn])
        ident, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        cell = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        found = list(cross_pairs(t, sk, n, s, percent))
        x, y, over = (np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3))
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def root(v):
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        links = []
        for p in np.argsort(-over, kind="stable").tolist():
            q, r = int(x[p]), int(y[p])
            u, v = root((cell[q], comp[q])), root((cell[r], comp[r]))
            if u != v and same_share(grams[q], grams[r], percent):
                up[u] = v
                links.append((int(ident[q]), int(ident[r])))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))], ["a", "b"])

    with_sets = rows.join(sets.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).drop("sid")
    return by_cell(with_sets, compare, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Full shingle sets of the named documents.

    A bitmap of fixed size, broadcast, spares the other documents the shuffle; what it lets
    through by chance is taken out by the exact join.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    bits = np.zeros((SIEVE // 32768, 4096), np.uint8)
    for r in (ids.select(spot.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("k"))
              .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()):      # SIEVE / 8 bytes at most
        bits[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    sieve = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        bit, hashes = np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little"), WordHashes()
        for batch in batches:
            batch = batch.filter(pa.array(bit[batch.column("spot").to_numpy()] > 0))
            sets = [shingle_set(t, hashes, words).tobytes() for t in texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "grams"])

    found = docs.where("id is not null").select("id", "body", spot.alias("spot")).mapInArrow(run, "id long, grams binary")
    return found.join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): the threshold on full sets."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(f"id_{side}"), F.col("grams").alias(f"grams_{side}")), F.col(side) == F.col(f"id_{side}"))

    def run(batches):
        for batch in batches:
            ok = [same_share(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent)
                  for p, q in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long, linked boolean")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS,
               rows: int = ROWS, words: int = WORDS, cell: int = CELL) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept.

    Documents with the same shingle set are one node, named by their smallest id. Nodes
    that share the key of a band fall in a bucket. First every node is tried against the
    bucket leader it meets most often; links that hold on the full sets join components.
    Then documents of different components that share a bucket are compared by odd
    sketch, and pairs that pass are decided on the full sets. So every pair that shares a
    band is in one component already, refuted by its sketches at SIGMAS deviations, or
    decided exactly; no group of copies is expanded into its pairs.

    Empty or null texts have an empty set, are linked with nothing and kept. Texts under
    `words` words are one shingle. Where rows share an id or have none, the whole table is
    handed over with a number per row and solved by it, so repeated rows cost no more than
    others, an id may stand for several texts, and each row takes the smallest id of its own
    component (null where no row of it has one). Other columns are not read; an empty table
    gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    solve = lambda d: by_unique_id(small_batches(d), percent, bands, rows, words, cell)
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1").isEmpty():
        found = solve(docs)
    else:
        own = numbered(docs)
        by_row = handover(solve(own.select(F.col("row_no").alias("id"), "body")))
        of_row = own.select(F.col("row_no").alias("id"), F.col("id").alias("doc")).join(by_row, "id")
        names = of_row.groupBy("component").agg(F.min("doc").alias("name"), F.count(F.lit(1)).alias("c"))
        found = join_back(of_row, names, "component", "c").select(F.col("doc").alias("id"), "n", F.col("name").alias("component"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def by_unique_id(docs: DataFrame, percent: int, bands: int, rows: int, words: int, cell: int) -> DataFrame:
    """(id, n, component) of documents (id, body) whose ids are there and unique."""
    sig = handover(signatures(docs, bands, rows, words))
    classes = handover(sig.where("n > 0").groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("c")))
    nodes = classes.select(F.col("node").alias("id"))
    sketches = sig.select("id", "n", "s", "sketch").where("n > 0")
    entries = sig.where("n > 0").select("id", "n", "keys").join(nodes, "id", "left_semi").select("id", "n", F.explode("keys").alias("key"))
    heads = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("head")).where("m > 1")
    entries = handover(entries.join(heads, "key").select("key", "id", "n", F.col("head.id").alias("lead"), F.col("head.n").alias("lead_n")))
    star = (entries.where(f"id <> lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
            .groupBy("id", "lead").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("id").agg(F.max(F.struct("c", -F.col("lead"))).alias("best"))
            .select((-F.col("best.col2")).alias("a"), F.col("id").alias("b")))
    tried = handover(sift(star, sketches, percent).distinct())
    sets = handover(shingle_sets(docs, tried.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words))
    links = handover(confirm(tried, sets, percent).where("linked").select("a", "b"))
    rest = handover(undecided(cells(entries, components(links), cell), sketches, percent))
    more = rest.select("id").distinct().join(sets.select("id"), "id", "left_anti")
    sets = sets.unionByName(handover(shingle_sets(docs, more, words)))
    labels = components(links.unionByName(decide(rest, sets, percent)))
    node_comp = classes.join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select(
        "fp", "c", F.coalesce("component", "node").alias("component"))
    full = join_back(sig.where("n > 0").select("id", "n", "fp"), handover(node_comp), "fp", "c").select("id", "n", "component")
    empty = sig.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(empty)


@query("op2_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, v.b FROM reach r JOIN both_ways v ON r.c = v.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.c) AS component_id, w.doc_id = min(reach.c) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id, n.n""")
def op2_near_dedup(spark, d):
    return near_dedup(table(spark, d, "documents"))
