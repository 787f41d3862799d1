"""The corpus operators against brute force on small hand-made and hot inputs, with nulls, ties and repeated rows."""

import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, language, neighbours, quality, registry, sharding, suffixes, tokenfile, urls
from tidemark.llm.shared import components, materialise

SF = "/root/testdata/sf0.001"
WORDS = ["".join(random.Random(i).choice("abcdefgé") for _ in range(1 + i % 7)) for i in range(300)]


def corpus(n=60, seed=1):
    """Texts with exact and near copies, a passage of many, a very long one, nulls, empties and a short one."""
    draw = random.Random(seed)
    passage = " ".join(draw.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(1, 120))]
        if i % 3 == 0:
            words[len(words) // 2 : 0] = passage.split()
        rows.append((i, " ".join(words)))
    base = rows[5][1].split()
    for i in range(n, n + 20):
        near = list(base)
        near[draw.randrange(len(near))] = "XyZ"
        rows.append((i, " ".join(near) if i % 4 else rows[5][1]))
    return [*rows, (900, None), (901, ""), (902, "One"), (903, "one"), (904, " ".join(draw.choice(WORDS) for _ in range(9000)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(7)).withColumn("token", F.lit("clash")).repartition(5)


def roots(links, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(1000, i) for i in range(1001, 1050)] + [(i, i + 1) for i in range(2000, 2040)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3), (5, 5)], "u long, v long"), one_task).collect()}
    want = roots(links, {x for p in links if p[0] != p[1] for x in p})
    assert got == want


def removed(rows):
    """By brute force: of each doc_id its (bytes, removed bytes, removed runs, sha256 of the rest), a tuple a row."""
    seen, want = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        raw = (text or "").encode()
        hit = [False] * len(raw)
        for i in range(len(raw) - 99):
            part = raw[i : i + 100]
            if part in seen:
                hit[i : i + 100] = [True] * 100
            seen.add(part)
        rest = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        runs = len([x for x in "".join("x" if h else " " for h in hit).split() if x])
        want.setdefault(doc, []).append((len(raw), sum(hit), runs, hashlib.sha256(rest).hexdigest()))
    return want


@pytest.mark.parametrize(("alphabet", "depth"), [(1, 5), (2, 3), (2, 40), (3, 100)])
def test_suffix_ranks(alphabet, depth):
    draw = random.Random(alphabet * depth)
    for n in (0, 1, 2, 3, 4, 50, 301):
        s = [draw.randrange(alphabet) for _ in range(n)]
        rank = suffixes.suffix_ranks(np.array(s, np.int64), depth)
        order = sorted(range(n), key=lambda i: rank[i])
        assert sorted(rank.tolist()) == list(range(n))
        assert [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(n))


def test_suffixes(spark):
    rows = corpus() + [(5, corpus()[5][1] + "!"), (None, corpus()[7][1])]  # two rows of one id, one without
    want = removed([(-(2**63) if d is None else d, t) for d, t in rows])
    want[None] = want.pop(-(2**63))
    for chunk, hot in ((2000, 4 << 20), (2000, 300), (1 << 24, 4 << 20)):
        got = {}
        for r in suffixes.deduplicated(frame(spark, rows), False, chunk, hot).collect():
            got.setdefault(r[0], []).append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    whole = suffixes.deduplicated(frame(spark, rows))
    assert whole.columns == ["doc_id", "text", "n", "token", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert whole.where("doc_id = 900").first().text is None


def test_runs_of_one_byte_leave_one_string_a_task(spark):
    """300 runs of spaces of different lengths, and of two bytes in turn: grams can't split them, whole strings do."""
    draw = random.Random(8)
    rows = [(i, f"{i} {draw.choice(WORDS)}" + " " * (100 + i) + draw.choice(WORDS) + "-=" * (40 + i % 70) + str(i)) for i in range(300)]
    for chunk in (1 << 24, 6000):
        got = {r[0]: [tuple(r)[1:]] for r in suffixes.deduplicated(frame(spark, rows), False, chunk, 500).collect()}
        assert got == removed(rows)
    texts = [b" " * n for n in range(100, 400)] + [b"-=" * n for n in range(60, 200)]
    data = suffixes._bucketed(3, np.zeros(len(texts), np.int64), np.arange(len(texts)), np.full(len(texts), 9), texts)
    (out,) = [pa.Table.from_batches(suffixes._by_string(8)(iter(suffixes._rows(data).to_batches())))]
    left = out.filter(pc.greater_equal(out.column("bucket"), 0))
    strings = [p for c, d in zip(left.column("chunk").to_pylist(), left.column("data").to_pylist(), strict=True) for p in suffixes._opened(c, d)]
    assert sorted(strings) == [(3, 0, 9, b" " * 100), (3, 300, 9, b"-=" * 50), (3, 300, 10, b"=-" * 50)]
    rest = [suffixes.parted(x.as_py(), 3)[0][2].sum() for x in out.filter(pc.equal(out.column("bucket"), -1)).column("data")]
    assert sum(rest) + 3 == sum(len(t) - 99 for t in texts)


def test_long_pieces_by_string_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 150)
    monkeypatch.setattr(suffixes, "HELD", 20)
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab") for _ in range(30)) * 20, b"x" * 700, bytes(draw.choice(b"ab") for _ in range(450)), b"x" * 120]
    data = suffixes._bucketed(0, np.zeros(4, np.int64), np.arange(4), np.zeros(4, np.int64), texts)
    out = pa.Table.from_batches(suffixes._by_string(6)(iter(suffixes._rows(data).to_batches())))
    gone = set()
    for rows in (out.filter(pc.equal(out.column("bucket"), -1)), *(suffixes._decided(out.filter(pc.equal(out.column("bucket"), b))) for b in set(out.column("bucket").to_pylist()) - {-1})):
        for x in rows.column("data"):
            gone |= {(d, s + k) for d, s, n in zip(*(c.tolist() for c in suffixes.parted(x.as_py(), 3)[0]), strict=True) for k in range(n)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                want.add((d, s))
            seen.add(t[s : s + 100])
    assert gone == want


def test_where_all_text_repeats_no_bucket_is_cut_anew(spark, monkeypatch):
    """Three versions of each text, none a copy: buckets are large by many minimizers, which are no cause to cut their pieces."""
    draw = random.Random(4)
    texts = ["".join(draw.choice(string.ascii_letters) for _ in range(3000)) for _ in range(40)]
    rows = [(100 * v + i, t[: 900 + 50 * v] + str(v) + t[900 + 50 * v :]) for v in range(3) for i, t in enumerate(texts)]

    def never(*_):
        raise AssertionError("cut anew")

    for name in ("_cut_anew", "_by_string"):
        monkeypatch.setattr(suffixes, name, never)
    got = {r[0]: [tuple(r)[1:]] for r in suffixes.deduplicated(frame(spark, rows), False, 60_000, 20_000).collect()}
    assert got == removed(rows)


def test_lines_of_one_pattern_are_cut_by_what_differs(spark, monkeypatch):
    """All grams of the pattern are common, more than three rounds could find one by one; those of the numbers in it aren't."""
    draw = random.Random(12)
    pattern = "worker {:06d} has accepted a connection from a client and opened a new session for user number {:06d}, whose last visit was to the storage node in another region; "
    rows = [(i, "".join(pattern.format(draw.randrange(10**6), draw.randrange(10**6)) for _ in range(8))) for i in range(60)]

    def never(*_):
        raise AssertionError("cut into strings")

    monkeypatch.setattr(suffixes, "_by_string", never)
    got = {r[0]: [tuple(r)[1:]] for r in suffixes.deduplicated(frame(spark, rows), False, 8000, 8000).collect()}
    assert got == removed(rows)


def test_parts_of_a_bucket_are_sorted_in_turns(monkeypatch):
    draw = random.Random(9)
    strings = [bytes(draw.choice(b"abc") for _ in range(draw.randint(100, 140))) for _ in range(60)]
    texts = [t for t in strings for _ in range(draw.randint(1, 3))]
    part = np.array([zlib.crc32(t) % 16 for t in texts])
    rows = pa.concat_tables([suffixes._rows(suffixes._bucketed(c, part[c::2], np.arange(len(texts))[c::2], np.zeros(len(texts), np.int64)[c::2], texts[c::2])) for c in range(2)])
    assert sum(len(t) for t in texts[::2]) > rows.column("size")[0].as_py() == np.bincount(part[::2], [len(t) for t in texts[::2]]).max()
    seen = []
    later = suffixes._later
    monkeypatch.setattr(suffixes, "_later", lambda found: seen.append(sum(len(p[3]) for p in found)) or later(found))
    want = suffixes._decided(rows).to_pylist()
    assert len(seen) == 1
    monkeypatch.setattr(suffixes, "HOT_BYTES", 1500)
    got = suffixes._decided(rows).to_pylist()
    assert len(seen) > 5 and sum(seen[1:]) == seen[0] and max(seen[1:]) <= max(1500, np.bincount(part, [len(t) for t in texts]).max())
    starts = lambda found: {(r["chunk"], d, s + k) for r in found for d, s, n in zip(*(c.tolist() for c in suffixes.parted(r["data"], 3)[0]), strict=True) for k in range(n)}
    assert starts(got) == starts(want) != set()


def test_copies_of_whole_texts_send_no_pieces(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice(string.ascii_letters) for _ in range(n)) for n in (99, 100, 700, 2000, 2000, 2000)]
    rows = [(10 * k + i, t) for k in range(6) for i, t in enumerate(texts)] + [(99, None)] * 2
    for chunk in (1 << 24, 3000):
        got = {}
        for r in suffixes.deduplicated(frame(spark, rows), False, chunk).collect():
            got.setdefault(r[0], []).append(tuple(r)[1:])
        assert got == removed(rows)
    bounds = type("B", (), {"value": np.array([9], np.int64)})
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in [*rows[12:18], *rows[:6], *rows[6:12]]])  # a later chunk's rows may be read first
    sets = pa.Table.from_batches(suffixes._sample_sets(bounds, 0)(iter([batch])))
    kept = pa.concat_tables([suffixes._kept_samples(sets.filter(pc.equal(sets.column("bucket"), b))) for b in (0, -1)])
    bundles = pa.Table.from_batches(suffixes._bundled(bounds)(iter([batch])))
    split = [suffixes._split(0, 2)(*(t.filter(pc.equal(t.column("chunk"), c)) for t in (bundles, kept))) for c in (0, 1)]
    assert len(set(split[0].column("bucket").to_pylist()) - {-1}) > 1
    ((bucket, data),) = zip(split[1].column("bucket").to_pylist(), split[1].column("data").to_pylist(), strict=True)
    assert bucket == -1
    assert sorted(zip(*(c.tolist() for c in suffixes.parted(data, 3)[0]), strict=True)) == [(i, 0, len(texts[i % 6]) - 99) for i in range(12) if i % 6]


def test_many_pieces_by_string_are_looked_up_together(monkeypatch):
    """A part's starts are looked up at once, not the whole part for each of its pieces."""
    draw = random.Random(7)
    texts = [bytes([draw.choice(b"xy")]) + b" " * draw.randint(110, 300) for _ in range(400)]
    data = suffixes._bucketed(0, np.zeros(400, np.int64), np.arange(400), np.zeros(400, np.int64), texts)
    calls, plain = [], np.isin
    monkeypatch.setattr(np, "isin", lambda *a, **k: calls.append(a) or plain(*a, **k))
    out = pa.Table.from_batches(suffixes._by_string(6)(iter(suffixes._rows(data).to_batches())))
    assert len(calls) == 1
    kept = out.filter(pc.greater_equal(out.column("bucket"), 0))
    strings = sorted(p for c, d in zip(kept.column("chunk").to_pylist(), kept.column("data").to_pylist(), strict=True) for p in suffixes._opened(c, d))
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 99):
            first.setdefault(t[k : k + 100], (0, i, k))
    assert strings == sorted((*place, string) for string, place in first.items())


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_of_one_id_are_cut_into_chunks(spark, hot):
    texts = [t for _, t in corpus() if t is not None]
    rows = [(hot, t) for t in texts[:-1]] + [(i, t[::-1]) for i, t in enumerate(texts[:20])]
    docs = frame(spark, rows)
    bounds, cuts = suffixes.chunk_bounds(docs, 20, 2000)
    chunks = suffixes._chunk_of(pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows]), bounds, cuts)
    copies = sum(len(t) for t in texts if t == texts[5])
    assert np.bincount(chunks, [len(t) for _, t in rows]).max() < 8000 + copies
    place = sorted(range(len(rows)), key=lambda i: (-(2**63) if rows[i][0] is None else rows[i][0], rows[i][1]))
    assert (np.diff(chunks[place]) >= 0).all()
    want = removed([(-(2**63) if d is None else d, t) for d, t in rows])
    got = {}
    for r in suffixes.deduplicated(docs, False, 2000, 300).collect():
        got.setdefault(-(2**63) if r[0] is None else r[0], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suffixes_compare_bytes_not_fingerprints(spark, monkeypatch):
    """With fingerprints of a few bits nearly everything collides, and nothing is removed wrongly."""
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("ab ") for _ in range(300))) for i in range(30)]
    rows[7] = (7, rows[2][1][50:200] + rows[7][1])
    plain = suffixes.Prefixes.slices
    monkeypatch.setattr(suffixes.Prefixes, "slices", lambda self, a, z: (plain(self, a, z) & np.uint64(7)) << np.uint64(30))
    data, cut = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.arange(31) * 300
    hashes = suffixes.Prefixes.of_bytes(data)
    at, _ = suffixes.sampled(cut)
    names = hashes.slices(at, at + suffixes.WINDOW)
    assert len(np.unique(names)) <= 8
    bundle = next(suffixes._bundled(type("B", (), {"value": np.zeros(0, np.int64)}))(iter([pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in rows])])))
    kept = pa.table({"chunk": [0], "bucket": pa.array([0], pa.int64()), "names": [suffixes.squeezed(np.unique(names.astype(np.uint32)))]})
    split = suffixes._split(0, 2)(pa.Table.from_batches([bundle]), kept)
    rest = split.filter(pc.greater_equal(split.column("bucket"), 0))
    found = [suffixes._decided(rest.filter(pc.equal(rest.column("bucket"), b))) for b in sorted(set(rest.column("bucket").to_pylist()))]
    starts = [s for f in found for x in f.column("data") for s in zip(*(c.tolist() for c in suffixes.parted(x.as_py(), 3)[0]), strict=True)]
    assert {(d, s + k) for d, s, n in starts for k in range(n)} == {(7, s) for s in range(51)}


def test_jaccard(spark):
    rows = corpus()
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    for cell, listed in ((3, jaccard.LISTED), (jaccard.CELL, jaccard.LISTED), (3, 0), (jaccard.CELL, 12)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, rows), cell, 0 if cell == 3 else 1000, listed).collect()}
        assert got == {d: (len(sets[d]), want[d]) for d in sets}
    assert want[902] == want[903] == 902


def versions(words: int, seed: int = 9) -> list[tuple[int, str]]:
    """Six versions of one text that link with nothing (1.4 to 3 % of the words changed in each), and near copies of two of them."""
    draw = random.Random(seed)
    text = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    change = lambda t, share: [f"v{draw.randrange(10**9)}" if draw.random() < share else w for w in t]
    own = [change(text, 0.03 if i < 2 else 0.014 + 0.004 * i) for i in range(6)]
    return [(i, " ".join(t)) for i, t in enumerate([*own, change(own[0], 0.004), change(own[5], 0.004)])]


def test_jaccard_of_long_versions(spark):
    rows = versions(4000)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    assert 1 < len(links) < 10 and len(set(want.values())) > 3
    for listed in (jaccard.LISTED, 10**6):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, rows), listed=listed).collect()} == {d: (len(sets[d]), want[d]) for d in sets}


def thue_morse():
    """Two different words that meet under every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_do_not_meet(spark):
    a, b = thue_morse()
    assert not set(jaccard.shingles(np.frombuffer(a.encode(), np.uint8))) & set(jaccard.shingles(np.frombuffer(b.encode(), np.uint8)))
    got = jaccard.linked(frame(spark, [(1, a), (2, b), (3, a.upper())])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = bpe.tokenizer_path(name)
        got = {r.doc_id: r.ids for r in bpe.encoded(frame(spark, [(1, a), (2, b)]), path).collect()}
        assert got == {1: bpe.library(path).encode(a, add_special_tokens=False).ids, 2: bpe.library(path).encode(b, add_special_tokens=False).ids}


def test_common_shingles_in_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 3)
    draw = random.Random(2)
    sets = [sorted(draw.sample(range(-20, 20), draw.randint(0, 15))) for _ in range(12)]
    lists = pa.array(sets, pa.list_(pa.int64()))
    some, others = np.array([1, 4, 7]), np.array([0, 2, 3, 11])
    both, before = jaccard._common(jaccard._flat(lists, some), jaccard._flat(lists, others), (3, 4), 2)
    assert both.tolist() == [[len({*sets[i]} & {*sets[j]}) for j in others] for i in some]
    assert before.tolist() == [[len({x for x in {*sets[i]} & {*sets[j]} if x < 2}) for j in others] for i in some]


def test_decontaminate(spark):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[:12])), (2, "One"), (3, None), (4, ""), (5, " ".join(rows[7][1].upper().split()[:25])), (5, "zzz qqq"), (None, rows[1][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    windows = {(i, tuple(w[k : k + 10])) for i, t in items if i is not None and (w := words(t)) for k in range(max(1, len(w) - 9))}
    want = {}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        want[doc] = (len(w), len(hit), sorted(found), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (3, 1000):
        got = {r[0]: tuple(r)[1:] for r in decontaminate.report(frame(spark, rows), bench, most).collect()}
        assert got == want
    assert decontaminate.report(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(30, 16))
    v = np.concatenate([base, base[0] + 0.05 * draw.normal(size=(40, 16)), base[1:2] * 3, base[2:5] + 0.12 * draw.normal(size=(3, 16))])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, [1e-200, 2e-200], 1), (505, [2e200, 4e200], 2), (506, [], 1)]
    cos = v @ v.T / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))
    links = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= 0.95] + [(504, 505)]
    want = roots(links, [r[0] for r in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").repartition(4)
    same = [(i, rows[3][1], 0) for i in range(900, 925)] + [(7, rows[9][1], 0), (None, rows[0][1], 0)]  # copies of one vector, a second row of 7, no id
    again = spark.createDataFrame(rows + same, "vec_id long, embedding array<double>, n_links int").repartition(4)
    valid = [(r[0], np.array(r[1])) for r in rows + same if r[0] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    near = [[a @ b >= 0.95 * np.sqrt((a @ a) * (b @ b)) for _, b in valid] for _, a in valid]
    n_links = {}
    for k, (i, _) in enumerate(valid):
        n_links[i] = n_links.get(i, 0) + sum(near[k]) - 1
    both = roots([(valid[k][0], valid[m][0]) for k in range(len(valid)) for m in range(k) if near[k][m]] + [(504, 505)], [r[0] for r in rows + same if r[0] is not None])
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(again, block=9).collect()}
    assert got == {x: (n_links.get(x, 1 if x in (504, 505) else 0), both[x]) for x in both} | {None: (0, None)}
    for block in (7, 2500):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df, block=block).collect()}
        assert got == {x: (sum(x in p for p in links), want[x], want[x] == x) for x in want}


def test_urls(spark):
    to = lambda u, k="canonical": f'<link rel="{k}" href="{u}">'
    rows = [
        (1, "http://A.net/x?q#f", ""), (2, "http://b.test/1", to("http://A.net/x?q")), (3, "http://c.test/", '<META http-equiv="refresh" content="0; url=http://b.test/1#z">'), (4, "http://d.test/", to("https://x.example.net/en/1")),
        (5, "http://e.test/", to("http://d.test/") + to("http://A.net/x?q")), (6, None, None), (7, "nonsense", to("http://A.net/x?q")), (8, "http://sub.org/fr/1", None), (9, "http://www.example.com/de/", ""), (10, "http://anet/", ""), (11, "http://f.test/g", to("/h")),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("org/fr/", "allow") and got[9][2:] == ("example.com/de/", "block") and got[10][3] == "allow"
    # 2 and 3 hang on a blocked url, but 5 joins that class to an explicit allow, which comes first
    assert {got[i][3] for i in (2, 3, 4, 5, 11)} == {"allow"}
    two = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame([r for r in rows if r[0] not in (4, 5)], "page_id long, url string, html string")).collect()}
    assert two[2] == two[3] == "block"


def test_urls_equal_their_sql_with_links(spark, tmp_path):
    """Chains, a class with an explicit allow, ends that are no pages, repeated pages and an extra column, in Spark and in SQL."""
    to = lambda u, k=0: f'<meta http-equiv="refresh" content="0; url={u}">' if k else f'<link rel="canonical" href="{u}">'
    rows = [(i, f"http://h{i}.test/p?x={i}", to(f"https://H{i + 1}.test/p?x={i + 1}#f", i % 2)) for i in range(12)] + [(12, "http://h12.test/p?x=12", to("http://gone.net/x"))]
    rows += [(20, "http://k.test/", to("http://s.example.net/en/a") + to("http://b.net/x", 1)), (21, "http://b.net/x", None), (22, "http://l.test/", to("http://k.test/")), (23, "http://m.test/", to("http://www.example.com/de/")), (24, None, to("http://b.net/x")), (25, "http://b.net/x", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[3]]], "page_id long, url string, html string, verdict string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in urls.verdicts(pages).select("page_id", "host", "path", "rule", "verdict").collect())))
    assert got == sorted(map(str, con.execute(urls.SQL).fetchall()))
    verdict = {r.page_id: r.verdict for r in urls.verdicts(pages).collect()}
    assert all(verdict[i] == "block" for i in (0, 5, 12, 21, 23)) and verdict[20] == verdict[22] == "allow"


def test_links_are_resolved_like_a_browser(spark):
    from urllib.parse import urljoin

    to = "b.html ../x ../../../x ./ .. . ?p=2 ?u=http://q.test/ /h /g/../h?a#b d/./e/../f/ //o.test/1 http://o.test/a/../b?x=1&amp;y=2 ?a=1&amp;b=2 c?d=../e #top c#d /?x".split()
    bases = ["http://A.net/d/e/page?q=1#f", "https://b.test", "http://c.test/", "http://d.test/x/"]
    plain = lambda u: re.sub(r"^[^/?#]*", lambda m: m[0].lower(), u.split("://", 1)[1].split("#")[0])
    rows, want = [], set()
    for base in bases:
        for k, x in enumerate(to):
            tag = f'<link rel="canonical" href="{x}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={x}">'
            rows.append((len(rows), base, tag))
            absolute = x.replace("&amp;", "&")
            # urls in full keep their path here
            end = absolute if "://" in absolute.split("?")[0] else urljoin(base, absolute)
            if plain(end) != plain(base):
                want.add((plain(base), plain(end)))
    based = '<base href="../z/"><link rel=canonical href=b>'
    rows += [(900, "http://e.test/a/b/c", based), (901, "http://f.test/", '<link rel="canonical" href="mailto:x@y.test">')]
    want.add(("e.test/a/b/c", "e.test/a/z/b"))
    got = {tuple(r) for r in urls.links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_a_block_reaches_aliases_by_relative_links(spark):
    rows = [(1, "http://g.test/d/a", '<link rel="canonical" href="b.html">'), (2, "http://g.test/d/b.html", '<meta http-equiv="refresh" content="0; url=../x?p=1&amp;q=2">'), (3, "http://g.test/x?p=1&q=2", '<link rel="canonical" href="http://A.net/y">'), (4, "http://g.test/d/c", "")]
    got = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("word_bpe_49k.json")
    t, rows, at = Tokenizer.from_file(path), corpus(), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.index(tokenfile.write(frame(spark, rows), path)).collect()}
    for doc, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[doc] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_nulls_repeated_rows_and_clashing_columns(spark):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    rows = [(3, "x y z", 0), (None, "a b", 1), (3, "x y z", 2), (1, None, 3), (2, "", 4), (None, None, 5)]
    docs = spark.createDataFrame([(d, t, i, i, "q") for d, t, i in rows], "doc_id long, text string, part int, ids int, word string").repartition(3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.index(tokenfile.write(docs, path)).collect()), key=lambda r: r[1:3])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 3]
    ids = lambda t: np.array([*bpe.library(path).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in got) == sorted((d is None, d or 0, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, _ in rows)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]


def test_token_files_are_encoded_by_runs_where_the_tokenizer_allows(spark, monkeypatch):
    from tidemark.llm import packing

    word, byte = bpe.tokenizer_path("word_bpe_49k.json"), bpe.tokenizer_path("byte_bpe_50k.json")
    assert packing.by_runs(word) and not packing.by_runs(byte)
    docs = frame(spark, corpus())
    ids = lambda: {r.doc_id: bytes(r.ids) for r in tokenfile.encoded(docs, word, bpe.text_bytes(docs)).collect()}
    want = ids()
    monkeypatch.setattr(packing, "by_runs", lambda path: False)
    assert ids() == want
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "word_table", None)  # no table of words is made
    assert ids() == want


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 9000])
def test_segments_come_back_and_damage_shows(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 70000
    data = tokenfile.pack([4, None], [n, 0], ids)
    docs, counts, back = tokenfile.unpack(data)
    assert docs == [4, None] and counts.tolist() == [n, 0] and (back == ids).all()
    if n:
        bad = bytearray(data)
        bad[-9 if n > 1 else -1] ^= 1
        with pytest.raises((ValueError, IndexError)):
            if (tokenfile.unpack(bytes(bad))[2] == ids).all():
                raise ValueError("the last words of a block may hold no information")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [0, 4000, bpe.HEAD_BYTES])
def test_bpe_equals_the_library(spark, name, most):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path(name)
    t, draw = Tokenizer.from_file(path), random.Random(5)
    parts = [*" '\t\n s re've llTd12½Ⅷ éÉßΣς漢🎉.,!?\x85", "<|endoftext|>", "<|startoftext|>", "'s", " '", "don't", "  "]
    rows = corpus() + [(2000 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for i in range(200)]
    docs = materialise(frame(spark, rows).repartition(6))
    least, met = bpe.head(bpe.word_table(docs, path), most)[1], bpe.MOST_MET
    assert (least == 1, 1 < least <= met, least > met) == (most > 4000, most == 4000, most == 0)
    got = {r.doc_id: list(r.ids) for r in bpe.encoded(docs, path, most).collect()}
    assert got == {d: t.encode(x or "", add_special_tokens=False).ids for d, x in rows}
    if name.startswith("byte"):
        trip = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(docs, path, most).collect()}
        assert trip == {d: hashlib.sha256(t.decode(got[d], skip_special_tokens=False).encode()).hexdigest() for d in got}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_one_hash_and_new_characters(name):
    path = bpe.tokenizer_path(name)
    split, library = bpe.Splitter(path), bpe.library(path)
    # characters that Python's tables don't have but the library's may, and a sample of all others
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (bpe.unknown()[i] and bpe.classes()[i] != 3 or i % 211 == 0 or i < 0x600)]
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}'s{chr(c)}" for c in points[a : a + 16]) for a in range(0, len(points), 16)]
    docs = list(bpe._docs(iter(texts), split))
    words = {h: p[0][a:z] for d in docs for p in d if isinstance(p, tuple) for a, z, h in zip(*(x.tolist() for x in p[1:]), strict=True)}
    h = pa.array(np.array(list(words), np.uint64).view(np.int64))
    last = [w if i % 5 else w + "?" for i, w in enumerate(words.values())]  # every fifth word shares its hash with another
    batch = next(bpe._encoder(path)(iter([pa.RecordBatch.from_arrays([h, pa.array(words.values()), pa.array(last), pa.array([1] * len(h), pa.int32())], ["h", "word", "last", "met"])])))
    table = bpe.Table(pa.chunked_array([batch.column(0)]), pa.chunked_array([batch.column(1)]), split.kind)
    assert len(table.shared) == -(-len(words) // 5)
    assert [bpe.filled(*bpe.known(d, table, path), table).tolist() for d in docs] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_packed_words_merge_and_show_shared_hashes(monkeypatch, limit):
    monkeypatch.setattr(bpe, "MERGED_BYTES", limit)
    monkeypatch.setattr(bpe, "ENCODED_WORDS", 7)
    short = lambda cp, a, z: np.array([z_ - a_ << 60 | int(cp[a_]) for a_, z_ in zip(a.tolist(), z.tolist(), strict=True)], np.uint64)
    monkeypatch.setattr(bpe, "word_hashes", short)  # words of one length and first letter meet
    draw, sent, rows = random.Random(3), [], []
    for _ in range(9):
        words = {(len(w), w[0]): w for w in ("".join(draw.choice("aé漢🎉") for _ in range(draw.randint(1, 3))) for _ in range(12))}
        cp = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words.values()]
        h = np.array([short(c, np.array([0]), np.array([len(c)]))[0] for c in cp], np.uint64)
        order = np.argsort(h)
        rows.append(bpe._packed(h[order], pa.array(words.values()).take(pa.array(order)), 5))
        assert rows[-1].column(0).to_pylist() == sorted({int(k >> np.uint64(32)) * 5 >> 32 for k in h})
        sent += words.values()
    got = [r for b in bpe._merged(iter(rows)) for r in b.to_pylist()]
    key = lambda w: len(w) << 60 | ord(w[0])
    assert [r["h"] for r in got] == sorted({key(w) for w in sent})
    for r in got:
        mine = [w for w in sent if key(w) == r["h"]]
        assert r["met"] == len(mine) and {r["word"], r["last"]} <= {*mine} and (r["word"] == r["last"]) == (len({*mine}) == 1)


@pytest.mark.parametrize(("remembered", "compared"), [(1 << 19, 1 << 20), (3, 5)])
def test_words_of_one_hash_in_one_task_are_told_apart(spark, monkeypatch, remembered, compared):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    monkeypatch.setattr(bpe, "COMPARED", compared)
    short = lambda cp, a, z: np.array([ord(chr(int(cp[i])).lower()) << 40 for i in a.tolist()], np.uint64)
    monkeypatch.setattr(bpe, "word_hashes", short)  # words of one first letter meet
    path = bpe.tokenizer_path("word_bpe_49k.json")
    texts = [["one own one éa", None, "", "two"], ["one one", "éa éb éa " * 3, "x"], ["two ten two", "own", "x x", "漢"]]
    rows = [r for b in bpe._distinct(path, 3)(iter([pa.RecordBatch.from_pydict({"text": pa.array(t)}) for t in texts])) for r in [b]]
    got = {r["word"][0]: r["word"] != r["last"] for b in bpe._merged(iter(rows)) for r in b.to_pylist()}
    assert got == {"o": True, "é": True, "t": True, "x": False, "漢": False}
    table = next(bpe._encoder(path)(bpe._merged(iter(rows))))
    words = bpe.Table(pa.chunked_array([table.column(0)]), pa.chunked_array([table.column(1)]), bpe.Splitter(path).kind)
    flat = [t for b in texts for t in b]
    want = [bpe.library(path).encode(t or "", add_special_tokens=False).ids for t in flat]
    assert [bpe.filled(*bpe.known(d, words, path), words).tolist() for d in bpe._docs(iter(flat), bpe.Splitter(path))] == want


def test_added_tokens_cut_long_texts():
    split = bpe.Splitter(bpe.tokenizer_path("word_bpe_49k.json"))
    a, z = split.added["<|startoftext|>"], split.added["<|endoftext|>"]
    assert list(split.pieces("x<|endoftext|><|startoftext|>y<|end")) == ["x", z, "", a, "y<|end"]
    assert list(split.pieces("")) == [""] and list(split.pieces("<|endoftext|>")) == ["", z, ""]
    assert list(split.pieces("ab<|endoftext|>" * 200_000)) == ["ab", z] * 200_000 + [""]


def test_shards(spark):
    rows = [(i, f"text {i % 50}") for i in range(3000)] + [(7, "text 7"), (None, None)]
    got = sharding.sharded(frame(spark, rows), cell_rows=40).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 16
    assert max(map(len, by.values())) < 1.5 * 3000 / 16
    one = next(r for r in got if r.doc_id == 8)
    assert (one.size, one.text_crc32) == (7, zlib.crc32(b"text 8"))


@pytest.mark.parametrize("n", [1, 7, 8, 15, 23])
def test_a_further_shard_takes_rows_only_into_itself(spark, n):
    got = sharding.sharded(frame(spark, [(i, f"text {i % 50}") for i in range(3000)]), n).collect()
    assert len(got) == 3000 and all(r.grown_shard in (r.shard, n) for r in got)
    for column, k in (("shard", n), ("grown_shard", n + 1)):
        sizes = [sum(r[column] == s for r in got) for s in range(k)]
        assert sum(sizes) == 3000 and 0.6 * 3000 / k < min(sizes) and max(sizes) < 1.5 * 3000 / k


def test_weights_hold_below_the_base_tree(spark):
    ids = spark.range(20_000)
    counts = {r.s: r["count"] for r in ids.groupBy(sharding.shard_of(F.col("id"), 5, {2: 4.0}).alias("s")).count().collect()}
    assert counts[2] == pytest.approx(10_000, rel=0.05) and all(counts[s] == pytest.approx(2500, rel=0.1) for s in (0, 1, 3, 4))


def test_language_and_quality_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.op7(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    marked = quality.op9(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (marked.predicted == marked.quality).mean() > 0.85
    assert quality.op9(spark, sf).where("score < 0 or score > 1 or score is null").count() == 0
    model = language.train(docs.limit(0))
    assert language.identify(frame(spark, [(1, "abc"), (2, None), (3, "123")]), model).where("lang_pred != 'und'").count() == 0
    assert quality.score(frame(spark, [(1, "abc"), (2, None)]), quality.train(docs.limit(0).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))).where("quality_score != 0.5").count() == 0


def test_language_of_many_one_and_late_words(spark):
    draw = random.Random(6)
    words = {f"l{k}": ["".join(draw.choice(string.ascii_lowercase[3 * k : 3 * k + 4]) for _ in range(6)) for _ in range(40)] for k in range(8)}
    text = lambda lang, n=12: " ".join(draw.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate([*words] * 30)] + [(None, "xyz", "l0"), (7, "xyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == sorted(words) and model.codes.shape[1] > 8
    fresh = [(i, text(lang), lang) for i, lang in enumerate([*words] * 5)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in fresh) >= 38
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.where("lang = 'l3'"))).collect()} == {"l3"}
    # what tells the languages apart comes after 20,000 common characters
    late = [(i, "0 " * 10_000 + text(lang, 40), lang) for i, lang in enumerate(["l1", "l5"] * 40)]
    late = spark.createDataFrame(late, "doc_id long, text string, lang string")
    got = language.identify(late, language.train(late)).join(late, "doc_id").where("lang = lang_pred").count()
    assert got >= 78


def test_quality_learns_from_all_chosen_rows_and_whole_texts(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % quality.FOLDS]
    rows = [(i, f"<{i:05d}>" * 60 + " ".join(WORDS[: i % 20]) * (i % 2)) for i in range(3000)]
    rows = [(i, x if i % 7 else x + " " * (9000 - len(x)) + "".join(random.Random(i).choices(string.ascii_letters, k=3000))) for i, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    for q, text in ((1, model.good), (0, model.bad)):
        n = sum(i % 2 == q for i in ids)
        seen = {m for m in re.findall(rb"<(\d{5})>", text)}
        assert len(text) <= quality.DICTIONARY_BYTES and len(seen) > 0.8 * (n - n // 3) > 448
    cut = quality.train(docs.withColumn("text", F.expr("left(text, 8192)")), labels)
    assert model.weights != pytest.approx(cut.weights, rel=1e-6)


def test_sql_is_text_of_registered_queries():
    sql = registry.oracle_sql()
    assert sql.keys() <= registry.queries().keys() and all(isinstance(x, str) for x in sql.values())


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    for df in (suffixes.deduplicated(none), jaccard.linked(none), sharding.sharded(none), bpe.round_trip(none, path), tokenfile.index(tokenfile.write(none, path)), neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")), urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.count() == 0


def near_groups(texts):
    """By brute force: of each doc_id the smallest one that Jaccard links of five-word shingles reach."""
    sets = {}
    for d, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    return roots([(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], ids)


def without_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        if not any(hit):
            out[d] = texts[d]
        elif not all(hit):
            out[d] = bytes(b for b, h in zip(raw, hit, strict=True) if not h).decode("utf-8", "ignore")
    return out


def clean_of(texts, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return {d: t for d, t in texts.items() if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() and each stage on planted copies, passages and benchmark windows, with extra columns whose names clash."""
    import corpus_pipeline as pipeline

    rows = corpus()
    item = rows[4][1].split() if len(rows[4][1].split()) > 14 else rows[1][1].split()
    draw = random.Random(9)
    rows += [(i, " ".join([*(draw.choice(WORDS) for _ in range(30)), *item[2:13], *(draw.choice(WORDS) for _ in range(30))])) for i in range(300, 306)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, n_bytes map<string,int>"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "mine", {"a": 1}) for d, t in rows], schema)
    docs = docs.unionByName(docs.where("doc_id = 5"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i1", " ".join(item)), ("i2", "two words"), ("i3", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, texts = str(tmp_path), dict(rows)
    groups = near_groups(texts)
    one = {d: t for d, t in texts.items() if groups[d] == d}
    cut = without_repeats(one)
    kept = clean_of(cut, [" ".join(item), "two words"])
    assert len(texts) > len(one) and one != cut and len(cut) > len(kept) > 10
    plain = lambda df: {r.doc_id: r.text for r in df.collect()}
    got = docs
    for (name, stage), want in zip(pipeline.STAGES[:-1], (texts, one, cut, kept), strict=True):
        got = stage(spark, got, sf)
        assert got.columns == docs.columns and plain(got) == want, name
        assert got.where("quality_score != 'mine' or n_bytes['a'] != 1 or n_chars != length(coalesce(text, ''))").count() == 0
        assert got.count() == len(want) + (name == "quality classifier")
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    tokens = {d: bpe.library(path).encode(t or "", add_special_tokens=False).ids for d, t in kept.items()}
    ran = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, sf).collect()}
    assert ran == {d: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((kept[d] or "").encode()).hexdigest()) for d, x in tokens.items()}


def test_pipeline_keeps_what_the_classifier_accepts(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) >= quality.THRESHOLD}
    got = pipeline.keep_good(spark, docs, sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want and 0 < len(want) < docs.count() and got.columns == docs.columns


def test_token_segments_leave_no_small_rest(monkeypatch):
    import types

    import pyarrow as pa

    from tidemark.llm import tokenfile as T

    monkeypatch.setattr(T, "SEGMENT", 100)
    monkeypatch.setattr(T, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 7)))
    for sizes in ([], [3], [41] * 10, [250], [100, 100, 1], [99, 300, 5, 5]):
        ids = [np.arange(n, dtype="<u4") * 31 % 49_000 for n in sizes]
        rows = [pa.RecordBatch.from_arrays([pa.array(range(i, i + len(x)), pa.int64()), pa.array([y.tobytes() for y in x], pa.binary())], ["doc_id", "ids"]) for i in range(0, len(ids), 3) for x in [ids[i : i + 3]]]
        got = [b.to_pylist()[0] for b in T._segments(iter(rows))]
        assert [(r["part"], r["segment"]) for r in got] == [(7, k) for k in range(len(got))]
        assert all(r["n_ids"] >= 100 for r in got) or len(got) == 1
        back = [T.unpack(r["data"]) for r in got]
        assert [d for b in back for d in b[0]] == list(range(len(sizes))) and [int(c) for b in back for c in b[1]] == sizes
        assert np.array_equal(np.concatenate([b[2] for b in back] or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0)]))


def test_token_segments_of_texts_beat_the_entropy_of_single_ids():
    import pyarrow.parquet as pq

    from tidemark.llm import packing, tokenfile as T

    found = packing.Runs(bpe.tokenizer_path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.frombuffer(b"".join(found.encoded([(x or "").encode() for x in texts])), "<u4")
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    data = T.pack([1], [len(ids)], ids)
    assert len(data) * 8 / len(ids) < -(share * np.log2(share)).sum()
    assert np.array_equal(T.unpack(data)[2], ids)


def test_token_segments_of_odd_ids():
    from tidemark.llm import tokenfile as T

    r = np.random.default_rng(1)
    rare = np.where(r.random(50_000) < 0.0005, r.integers(0, 1 << 32, 50_000), 3)
    for ids in ([(1 << 32) - 1], np.full(5000, 7), r.integers(0, 1 << 32, 20_000), r.permutation(300_000), rare, np.arange(30_001) % 3 * 49_000):
        ids = np.asarray(ids, "<u4")
        order0 = T.Shares.of(ids)[0]
        assert order0.shares.sum() == 1 << order0.bits and order0.shares.min() > 0
        docs, counts, back = T.unpack(T.pack([1, 2], [len(ids), 0], ids, 1024))
        assert np.array_equal(back, ids) and counts.tolist() == [len(ids), 0]


def test_plain_texts_are_encoded_by_words_and_equal_the_library():
    from tidemark.llm import packing

    path = bpe.tokenizer_path("word_bpe_49k.json")
    found, library, draw = packing.Runs(path), bpe.library(path), random.Random(3)
    parts = [*" \t\n\r\x0b\x0c s re've llTd12éÉßĳŉſ.,!?'", "'s", "'S", " '", "''s", "don't", "I'll", "'RE", "<|", "<|endoftext|>", "\x1c", "\x85", "\xa0", "½", "Σς", "İ", "漢", "🎉", "́", "K", "ﬁ"]
    texts = ["".join(draw.choice(parts if n % 2 else parts[:45]) for _ in range(draw.randint(0, 40))) for n in range(4000)]
    for text in texts:
        assert np.frombuffer(found.encoded([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    plain = packing.Runs(path)
    plain.encoded([b"Plain words, said twice: plain words."] * 2)
    assert set(plain.words) == {"plain", "words", ",", "said", "twice", ":", "."} and not plain.runs
