"""Rows without id, with a shared id and repeated ones: each is decided on for itself."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as cp  # noqa: E402

SCHEMA, SF = "doc_id long, text string, source string", "/root/testdata/sf0.001"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def test_pipeline_decides_by_row(spark, tmp_path):
    near = {k: prose(k) for k in range(4)}
    copy = near[1].rsplit(" ", 1)[0] + " other"
    bad = [(k, f"{prose(100 + k, 8)} vileword {prose(200 + k, 8)}") for k in range(100, 130)]
    good = [(k, prose(k, 30)) for k in range(200, 230)]
    item = prose("item", 30)
    docs = spark.createDataFrame([(i, t, "s") for i, t in [
        *bad, *good, (None, "vileword " + prose(7)), (None, near[0]), (None, near[1]), (None, copy), (None, near[0]), (5, near[0]), (5, near[0]),
        (6, near[2]), (6, near[3]), (6, "a vileword here"), (7, near[2]), (None, item), (8, item), (8, prose(9)), (None, None), (9, "")]], SCHEMA)
    d = str(tmp_path)
    spark.createDataFrame([(k, int(k < 200)) for k, _ in bad + good], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    step = lambda f, x: cp.handover(f(spark, x, d))
    rows = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str)
    before = rows(docs)

    kept = step(cp.drop_toxic, docs)
    assert rows(kept) == [r for r in before if "vileword" not in (r[1] or "")]
    once = step(cp.drop_copies, kept)
    goods = [(k, t) for k, t in good]
    assert rows(once) == sorted([*goods, (None, near[1]), (None, copy), (5, near[0]), (6, near[2]), (6, near[3]), (8, item), (8, prose(9)), (9, "")], key=str)
    apart = step(cp.drop_near_copies, once)
    assert len([t for _, t in rows(apart) if t in (near[1], copy)]) == 1 and apart.count() == once.count() - 1
    twice = step(cp.drop_near_copies, kept)
    assert sum(t == near[0] for _, t in rows(twice)) == 1 and (5, near[0]) in rows(twice) and (6, near[3]) in rows(twice)
    clean = step(cp.drop_leaks, apart)
    assert rows(clean) == [r for r in rows(apart) if r[1] != item] and clean.columns == docs.columns
