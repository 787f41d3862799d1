"""The audit, the vector codes and the packing against brute force and the library, with nulls, ties, repeated rows, long texts and clashing columns."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import difference
from tidemark.llm import audit, bpe, codes, packing, registry, sharding
from tidemark.llm.shared import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_audit", "op12_codes"])
def test_queries_equal_their_sql(spark, name):
    assert difference(spark, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def documents(n=150, seed=2):
    draw = random.Random(seed)
    pool = ["Word", "next", "a#b", "é", "LOUD", *(f"w{i}" for i in range(300))]
    rows = [(i, draw.choice(["en", "de", None, ""]), " ".join(draw.choice(pool[: draw.choice([3, 40, 305])]) for _ in range(draw.choice([0, 3, 120, 260])))) for i in range(n)]
    rows += [(n + i, draw.choice(["en", "fr"]), rows[7][2]) for i in range(60)]  # copies of one text
    rows += [(3, "en", rows[3][2]), (3, "en", rows[3][2]), (None, "de", rows[3][2]), (None, None, None), (900, "de", None), (901, "en", ""), (902, "en", " \x0b\x1f "), (903, "fr", "X" * 5000 + " y" * 4000)]
    return rows


def test_audit(spark):
    rows = documents()
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (99999, 1, 1)]
    first = {}
    for doc, _, text in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    judged = []
    for doc, lang, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and doc > first[text]), strict=True) if f}
        good, toxic = (any(d == doc and doc is not None and (q, t)[k] == 1 for d, q, t in labels) for k in (0, 1))
        judged.append((lang or "", fails, good, toxic))
    want, share = {}, {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [j for j in own if f in j[1] and not j[1] & before]
                want[part, order, k + 1] = [sum(not j[1] & (before | {f}) for j in own), len(gone), sum(f in j[1] and bool(j[1] & before) for j in own), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
                share[part, f] = share.get((part, f), 0) + len(gone)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").select("*", F.lit(1).alias("mask"), F.lit(2).alias("words"), F.lit("x").alias("part")).repartition(4)
    masked = audit.with_copies(audit.text_failures(docs), 16)
    got = audit.audit(audit.mask_counts(masked, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    assert len(got) == len(want)
    assert all(r.shapley == share[r.part, r.filter_order[r.step - 1]] for r in got)


def test_audit_of_other_filters_and_of_nothing(spark):
    counts = spark.createDataFrame([("p", m, m + 1, 1, 0) for m in range(8)], "part string, mask int, rows long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in audit.audit(counts, "XYZ").collect()}
    assert len(got) == 18
    assert got["ZYX", 1] == (1 + 2 + 3 + 4, 5 + 6 + 7 + 8)
    assert got["ZYX", 3] == (1, 2)
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert audit.audit(audit.mask_counts(audit.with_copies(audit.text_failures(empty), 16), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def lloyd(points, k, rounds):
    """By brute force: entries and squared distances of the last assignment, and the codebook."""
    book = points[:k].copy()
    for r in range(rounds + 1):
        d = ((points[:, None] - book) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            for e in set(at.tolist()):
                book[e] = points[at == e].sum(0) // (at == e).sum()
    return at, d.min(1), book


@pytest.mark.parametrize("kind", ["clustered", "spread", "ties"])
def test_walks_equal_all_comparisons(kind):
    draw = np.random.default_rng(5)
    points = draw.integers(-3, 3, (700, 4)) if kind == "ties" else draw.integers(-900, 900, (700, 4)) if kind == "spread" else draw.integers(-900, 900, (9, 4))[draw.integers(0, 9, 700)] + draw.integers(-5, 5, (700, 4))
    tree = codes.Tree(points)
    tree = codes.Tree.read(tree.written(), 4)
    for k in (1, 2, 30, 256):
        at, d, _ = lloyd(points, k, 0)
        entries, errors = tree.assigned(points[:k])
        assert (entries == at).all() and (errors == d).all()
        sums, counts = np.zeros((k, 4), np.int64), np.zeros(k, np.int64)
        tree.gathered(points[:k], sums, counts)
        assert (counts == np.bincount(at, minlength=k)).all()
        assert (sums == np.stack([points[at == e].sum(0) for e in range(k)])).all()
    if kind == "clustered":
        assert sum(isinstance(e, int) for _, e in tree.walk(points[:9])) >= 1  # whole subtrees


@pytest.mark.parametrize("block", [50, codes.BLOCK])
def test_codes(spark, block):
    draw = random.Random(8)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(8)], draw.choice([0, 1, 2, None])) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1], 9) for i in range(150)] + [(20, vectors[20][1], 1), (None, [0.5] * 8, 0)]
    odd = [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0] * 7 + [float("-inf")], 1)]
    other = [(2004, [1.0] * 4, 5), (2005, [], None)]
    frame = spark.createDataFrame(vectors + odd + other, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("error"), F.lit(2).alias("vector"), F.lit(3).alias("_label")).repartition(7)
    frame = frame.where("vec_id is null or vec_id not in (500, 501)")
    got, books = codes.compressed(frame, block=block)
    rows = got.collect()
    kept = sorted(((v, np.float32(x).astype(float), lab) for v, x, lab in vectors), key=lambda r: (r[0] is None, r[0], r[1].tolist()))
    whole = np.floor(1024 * np.stack([x for _, x, _ in kept])).astype(np.int64)
    parts = [lloyd(p, 256, 4) for p in np.split(whole, 4, axis=1)]
    assert all((books[p] == parts[p][2]).all() for p in range(4))
    error = sum(p[1] for p in parts)
    by_label = {}
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    want = [(v, "".join(f"{p[0][i]:02x}" for p in parts), int(error[i]), by_label[lab]) for i, (v, _, lab) in enumerate(kept)]
    want += [(2004, None, None, None), (2005, None, None, by_label[None])]
    key = lambda r: str(tuple(r))
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in rows], key=key) == sorted(want, key=key)
    near = codes.decoded(got, books).where("vec_id = 5").first().vector
    assert np.abs(np.array(near) * 1024 - whole[5]).max() <= 3000 and len(near) == 8


def test_codes_of_rare_labels_and_of_nothing(spark):
    rows = materialise(spark.createDataFrame([(i, i, 1) for i in range(3000)] + [(5000 + i, None, 2) for i in range(50)], "vec_id long, label int, error long"))
    got = {r.vec_id: r.label_error for r in codes.with_label_errors(rows).collect()}
    assert len(got) == 3050 and got[5001] == 100 and got[7] == 1
    for data in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        out, books = codes.compressed(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
        assert out.count() == (1 if data and data[0][1] else 0)
        assert books.size == 0


def test_packing(spark):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    every = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["It's", "Übung", "x<|endoftext|>y", "á", "日本", "1234", "end.", "ΑΣ"]) for _ in range(draw.choice([1, 5, 30, 200])))) for i in range(80)]
    rows += [(100 + i, "same text again " * 9) for i in range(70)] + [(5, rows[5][1]), (None, None), (None, "nameless"), (300, ""), (301, "   \x1f "), (302, every), (303, "word " * 3001), (304, "q" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("length"), F.lit(1).alias("ids")).repartition(5)
    cut = packing.pieces(docs, path, 64)
    places = packing.packed(cut, 64)
    assert places.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = places.collect()
    whole = [(d, np.array([*bpe.library(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]
    want = [(d, k // 64, k, len(x[k : k + 64]), x[k : k + 64].tobytes()) for d, x in whole for k in range(0, len(x), 64)]
    key = lambda r: str(tuple(r))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got], key=key) == sorted(want, key=key)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for bin_ in filled.values():
        at = 0
        for offset, length, _ in sorted(bin_):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= -(-sum(r.length for r in got) // 64) * 1.02 + 1
    keyed = [r for r in got if r.doc_id is not None and r.doc_id != 5]
    unique = cut.where("doc_id is not null and doc_id != 5")
    out = {r.sequence_id: r.ids for r in packing.sequences(unique, places.where("doc_id is not null and doc_id != 5")).collect()}
    for s in {r.sequence_id for r in keyed}:
        raw = b"".join(bytes(r.ids) for r in sorted((r for r in keyed if r.sequence_id == s), key=lambda r: r.offset))
        assert out[s] == np.frombuffer(raw, "<u4").tolist()
    assert packing.packed(packing.pieces(docs.where("false"), path)).count() == 0


def test_two_replace_the_smallest():
    left = np.zeros(101, np.int64)
    left[[60, 30, 21, 19]] = 1
    assert packing.best_two(left, 100) == {60: 1, 21: 1, 19: 1}  # 60 + 30 leaves 10; 21 and 19 fill 40
    left[[21, 19]] = 0, 2
    assert packing.best_two(left, 100) == {60: 1, 19: 2}
    left[19] = 1
    assert packing.best_two(left, 100) == {60: 1, 30: 1}


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 50): draw.choice([1, 2, 7, 1000]) for _ in range(30)}
    plan = packing.Plan(counts, 50)
    used = {}
    for length, n in counts.items():
        for s, o in zip(*(x.tolist() for x in plan.places(np.full(n, length), np.arange(n))), strict=True):
            used.setdefault(s, []).append((o, length))
    assert len(used) == plan.sequences
    for bin_ in used.values():
        ends = [o + n for o, n in sorted(bin_)]
        assert [o for o, _ in sorted(bin_)] == [0, *ends[:-1]] and ends[-1] <= 50
    # never worse than best fit decreasing
    gaps = []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= length
        else:
            gaps.append(50 - length)
    assert plan.sequences <= len(gaps) + 1


def test_op13_crc32(spark):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()["op13_packing"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for doc, text in texts.items():
        ids = np.array([*bpe.library(path).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]


def shard(key, n):
    """The descent in plain Python: at each level the child with the least draw."""

    def draw(name, weight):
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        u = ((xxhash.xxh64_intdigest(name.encode(), h) >> 11) + 0.5) / 2**53
        return -math.log(u) / weight

    region = min(sharding.tree(n), key=lambda r: draw(f"region {r[0][0]}", sum(map(len, r))) if len(sharding.tree(n)) > 1 else 0)
    rack = min(region, key=lambda r: draw(f"rack {r[0]}", len(r))) if len(region) > 1 else region[0]
    return min(rack, key=lambda s: draw(f"shard {s}", 1)) if len(rack) > 1 else rack[0]


@pytest.mark.parametrize("cell_rows", [3, sharding.CELL_ROWS])
def test_sharding(spark, cell_rows):
    rows = [(i, f"text {i % 50}") for i in range(-40, 400)] + [(None, f"nameless {i}") for i in range(200)] + [(7, f"again {i}") for i in range(100)] + [(8, "same")] * 20 + [(None, None), (500, None), (501, ""), (502, "é" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("shard"), F.lit(2).alias("cell")).repartition(5)
    got = sharding.sharded(docs, 16, cell_rows).collect()
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", shard(d, 16), shard(d, 17)) for d, t in rows]
    key = lambda r: str(tuple(r))
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], key=key) == sorted(want, key=key)
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
