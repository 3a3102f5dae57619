"""Each operator against a plain computation on small tables, with nulls, empty and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from maskwell.llm import bpe, fingerprints, jaccard, language, packed_ids, pairs, passages, pivots, pseudo_likelihood, raking, toxicity
from maskwell.llm.common import shingle_set, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng, n, size=400):
    return " ".join(f"w{i}" for i in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    texts = [words(rng, int(n)) for n in rng.integers(1, 200, 60)]
    texts += [t + " tail" for t in texts[:10]] + texts[:8] + [None, "", "  \n", "one", "a b c", words(rng, 3000), "Été ÉTÉ", "naïve \x1c x"]
    passage = words(rng, 80)
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(4)]
    return [(i * 3, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_cut_anywhere(monkeypatch):
    from maskwell.llm import common

    text = "Aa bB\tccc " * 50 + "x" * 300
    whole = word_hashes(text.encode(), spans=True)
    monkeypatch.setattr(common, "SEGMENT", 64)
    for a, b in zip(whole, word_hashes(text.encode(), spans=True), strict=True):
        assert a.tolist() == b.tolist()
    assert len(whole[0]) == 151 and len(set(whole[0].tolist())) == 4


def test_bpe_equals_tiktoken(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, P.PATTERN, ids=True, decoded=True).collect()}
    for d, t, *_ in rows:
        assert got[d].ids == enc.encode_ordinary(t or "") and got[d].decoded == (t or "")
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 10_000).astype("<u4")
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, len(ids)) == ids).all()
    f = packed_ids.Frame(memoryview(packed_ids.frame([(1, ids[:77]), (2, ids[77:])], bits, 64) + b"\n"), 0)
    assert (f.document(1) == ids[77:]).all() and (f.read(100, 300) == ids[100:400]).all()


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_blocks_are_unpacked_once_for_all_documents(monkeypatch, block):
    rng = np.random.default_rng(block)
    texts = [rng.integers(0, 1 << 13, n) for n in (0, 1, 700, 0, 5, 20_000, 3, *rng.integers(0, 40, 300), 0)]
    f = packed_ids.Frame(memoryview(packed_ids.frame(list(enumerate(texts)), 13, block) + b"\n"), 0)
    seen, unpack = [], packed_ids.unpack
    monkeypatch.setattr(packed_ids, "unpack", lambda data, bits, n: seen.append(n) or unpack(data, bits, n))
    assert [x.tolist() for x in f.documents()] == [x.tolist() for x in texts]
    assert sum(seen) <= 1.1 * sum(map(len, texts)) + block


def test_word_encoder_equals_the_library():
    e = packed_ids.WordEncoder(P.path("word_bpe_49k.json"), cache=40)
    e.GROUP = 60
    texts = ["\u0130stanbul \u0130. \u0131 Stra\u00dfe \u01c5 \ufb01 e\u0301a x\u0301, don't 's it's. x's!", "\u0958, \u0958 a\u0338\u2260 foo\u2260 \x1cq r", "<|endoftext|> hi", "a\u200bb c\xa0d\x85f 12ab3 ###. (b)", "\u039f\u0394\u039f\u03a3. \u039f\u0394\u039f\u03a3\u0391 \u65e5\u672c\u8a9e\u3001", None, "", "  "]
    want = [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(3):  # the second time from memory, with evictions
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == want


def test_word_encoder_takes_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    e, tok = packed_ids.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y, <|endoftext|>.", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|><|endoftext|>it's"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_learnt_without_garbage_collection(monkeypatch):
    import gc

    encoder, during, keep, marks = packed_ids.WordEncoder(P.path("word_bpe_49k.json")), [], packed_ids.WordEncoder._learn, ["", ".", "$$$"]

    def learn(self, words, added):
        seen = lambda phase, info: during.append(phase)
        gc.callbacks.append(seen)
        try:
            keep(self, words, added)
        finally:
            gc.callbacks.remove(seen)

    monkeypatch.setattr(packed_ids.WordEncoder, "_learn", learn)
    letters = np.array(list("abcdeXYZ"))[np.random.default_rng(4).integers(0, 8, (20_000, 7))]
    text = " ".join("".join(w) + marks[i % 3] for i, w in enumerate(letters))
    got = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert got == encoder.tok.encode(text, add_special_tokens=False).ids and not during and gc.isenabled()


def test_packed_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    packed_ids.write_ids(docs, path, f"file://{tmp_path}/ids", frame_ids=500, frames_per_file=2)
    got = {r.doc_id: r for r in packed_ids.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    tok, at = Tokenizer.from_file(path), 0
    for d, t, *_ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def brute_links(sets):
    """component and number of links of each document, from all pairs."""
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x & y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
                links[a] += 1
                links[b] += 1
    return {d: (find(d), links[d]) for d in sets}


def near_copies(rng, n, first=10_000, changes=7):
    base, out = words(rng, 60).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(i % changes):
            w[int(rng.integers(len(w)))] = f"z{int(rng.integers(50))}"
        out.append((first + i, " ".join(w), "en", "a", 1, "x"))
    return out


def set_of(text):
    return set(shingle_set((text or "").encode()).tolist())


@pytest.mark.parametrize(("small", "cell"), [(2, 300), (4, 1500), (16, 400_000)])
def test_jaccard_components_and_links(spark, rows, empty, monkeypatch, small, cell):
    rng = np.random.default_rng(5)
    # a hot group of near copies, and a common passage in texts that differ otherwise
    passage = words(rng, 30)
    common = [(20_000 + i, f"{passage} {words(rng, int(rng.integers(5, 25)))}", None, None, None, None) for i in range(60)]
    everything = [*rows, *near_copies(rng, 60), *common]
    sets = {d: set_of(t) for d, t, *_ in everything}
    monkeypatch.setattr(jaccard, "LEAST", 3)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "DENSE", 5)
    df = spark.createDataFrame([*everything, (None, "a b c", None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    assert {d: (got[d].component_id, got[d].n_links) for d in sets} == brute_links(sets)
    assert all(got[d].n_shingles == len(s) for d, s in sets.items()) and got[None].component_id is None and got[None].n_links is None
    if small == 2:
        assert jaccard.near_duplicates(empty).count() == 0
        clash = df.withColumns({"n": F.lit(1), "node": F.lit("q"), "component_id": F.lit(2), "sig": F.lit(0), "__text": F.lit("")})
        assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(clash).collect()} == {(d, r.component_id) for d, r in got.items()}


@pytest.mark.parametrize("size", [1, 2, 200, 450])
def test_one_group_of_cells_over_any_slices(spark, size):
    """One group alone, longer than a slice, and one that ends where a slice does."""
    texts = [t for _, t, *_ in near_copies(np.random.default_rng(size), size, changes=9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame([(7, i, i, 56, i % 3, 1) for i in range(size)], "g long, node long, rep long, n long, c long, copies long").coalesce(1)
    sets = {i: set_of(t) for i, t in enumerate(texts)}
    want = {d: n for d, (_, n) in brute_links(sets).items()}
    got = jaccard.in_cells(rows, docs, "text", jaccard.links_counted, "node long, n long").collect()
    assert sorted((r.node, r.n) for r in got) == sorted((d, n) for d, n in want.items())
    across = {(r.a, r.b) for r in jaccard.in_cells(rows, docs, "text", jaccard.across_components, "a long, b long").collect()}
    assert across == {(a, b) for b in sets for a in range(b) if a % 3 != b % 3 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("some", [1, 2, 3])
def test_tokens_met_often_take_twice_their_memory(monkeypatch, some):
    import tracemalloc

    monkeypatch.setattr(jaccard, "SOME", some)
    rng = np.random.default_rng(some)
    for n in (1, 2, 5, 300):
        held = [np.unique(rng.integers(0, 50 * n, 200).astype(np.uint64)) for _ in range(n)] + [np.empty(0, np.uint64)]
        t, c = np.unique(np.concatenate(held), return_counts=True)
        got = jaccard.met_often(held)
        assert not held and got[0].tolist() == t[c >= some].tolist() and got[1].tolist() == c[c >= some].tolist()
    size = 8 * 400_000
    tracemalloc.start()
    held = [np.arange(k * 10_000, (k + 1) * 10_000, dtype=np.uint64) for k in range(40)]
    if some > 1:  # with 1 all values come out
        jaccard.met_often(held)
        assert tracemalloc.get_traced_memory()[1] < 2.5 * size
    tracemalloc.stop()


def test_edges_of_a_clique_are_thinned_out(spark):
    edges = [(a, b) for a in range(60) for b in range(a)] + [(100 + k, 101 + k) for k in range(20)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert pairs.forest(df).count() == 59 + 20
    got = {r.node: r.label for r in pairs.components(df).collect()}
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 121)}
    assert pairs.forest(df.where("a < 0")).count() == 0


def test_buckets_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = np.random.default_rng(0)
    size = {s: int(n) for s, n in enumerate(rng.integers(1, 12, 60))}
    rows = [(s, 100 * s + k, 40, k == 0 and s % 7 == 0) for s, n in size.items() for k in range(n)]
    for step in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("sig", "node", "n", "big"), r, strict=True)) for r in rows[at : at + step]]) for at in range(0, len(rows), step)]
        got = sorted(((r["sig"], r["a"], r["b"]) for b in jaccard.bucket_pairs(iter(batches)) for r in b.to_pylist()), key=str)
        want = []
        for s, n in size.items():
            ids = [100 * s + k for k in range(n)]
            want += [(s, ids[0], x) for x in ids[1:]] if n > 4 or s % 7 == 0 else [(None, x, y) for y in ids for x in ids if x < y]
        assert got == sorted(want, key=str)


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(40):
        v, least, expected = rng.integers(0, 30, int(rng.integers(1, 60))).astype(np.uint64), int(rng.integers(1, 12)), set()

        def split(a, b):
            if b - a + 1 >= least:
                c = a + int(np.argmin(v[a : b + 1]))
                expected.add((a, c, b))
                split(a, c - 1)
                split(c + 1, b)

        split(0, len(v) - 1)
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, least)), strict=True)) == expected


def test_passages_are_found_and_cut(docs, rows, empty):
    found = passages.repeated_passages(docs).collect()
    last = [d for d, *_ in rows[-4:]]
    assert {(r.doc_id, r.first_doc_id) for r in found if r.doc_id in last} == {(d, last[0]) for d in last[1:]}
    assert all(78 <= r.n_words <= 82 for r in found if r.doc_id in last)
    df = passages.without_passages(docs, passages.repeated_passages(docs))
    assert {len(r.text.split()) for r in df.where(F.col("doc_id").isin(last[1:])).collect()} <= set(range(48, 53))
    assert passages.repeated_passages(empty).count() == 0


def test_passages_whose_halves_earlier_documents_hold_apart(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 1 << 40, n))
    rows, want = [], {}
    for k in range(0, 240, 4):
        a, b = fresh(28), fresh(28)
        rows += [(k, f"{fresh(30)} {a} {fresh(30)}"), (k + 1, f"{fresh(30)} {b} {fresh(30)}"), (k + 2, f"{fresh(20)} {a} {b} {fresh(20)}"), (k + 3, f"{fresh(9)} {a} {b} {fresh(40)}")]
        want[k + 3] = (k + 2, 9, 65)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.first_doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(df).collect()}
    assert got == want


@pytest.mark.parametrize("small", [1, 16])
def test_changed_passages_whose_parts_earlier_documents_hold(spark, monkeypatch, small):
    """Values whose least document has only a part of the passage, in groups of either kind; the passage's words change here and there, so that
    no run of 50 repeats."""
    monkeypatch.setattr(passages, "SMALL", small, raising=False)
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"v{i}" for i in rng.integers(0, 1 << 40, n)]
    rows, want = [], set()
    for k in range(0, 150, 5):
        parts = [fresh(28) for _ in range(4)]
        body = [w for p in parts for w in p]
        other = body.copy()
        for i in (20, 56, 92):
            other[i] = "changed"
        rows += [(k + i, " ".join([*fresh(30), *parts[i], *fresh(30)])) for i in range(3)]
        rows += [(k + 3, " ".join([*fresh(20), *body, *fresh(20)])), (k + 4, " ".join([*fresh(9), *other, *fresh(40)]))]
        want.add((k + 4, k + 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(df).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == want
    assert all(r.n_words >= 70 for r in got)


@pytest.mark.parametrize("least", [1, 2, 7, 46])
def test_windows_of_many_texts_are_those_of_each(least):
    rng = np.random.default_rng(least)
    for _ in range(60):
        texts = [rng.integers(0, rng.choice([5, 100, 10**9]), rng.choice([0, 3, 46, 47, 90, 300])).astype(np.uint64) for _ in range(rng.integers(0, 8))]
        x, ends = passages.joined(texts)
        of, v, l, c, r = passages.windows_of(x, ends, passages.SALTS[0], least)
        for i, t in enumerate(texts):
            own, values = of == i, passages.mix(t ^ passages.SALTS[0])
            want = passages.compact_windows(values, least)
            assert [(p[own] - ends[i]).tolist() for p in (l, c, r)] == [p.tolist() for p in want] and v[own].tolist() == values[want[1]].tolist()


@pytest.mark.parametrize("cell", [60, 500, 200_000])
def test_rests_are_compared_with_all_earlier_texts_of_a_value(spark, monkeypatch, cell):
    monkeypatch.setattr(passages, "CELL", cell)
    rng = np.random.default_rng(cell)
    base = [rng.integers(0, 1 << 32, 60) for _ in range(4)]
    texts, sides = [], []
    for d in range(40):
        t = np.concatenate((rng.integers(0, 1 << 32, rng.integers(0, 30)), base[rng.integers(4)], rng.integers(0, 40, 5)))
        t[rng.random(len(t)) < rng.choice([0.05, 0.25])] = d
        kinds = [passages.WHOLE, *([passages.REST] if rng.random() < 0.3 else [])]
        for kind in kinds:
            texts.append((2 * d + kind, t.astype(np.uint32).tobytes()))
            sides += [(g, 2 * d + kind, len(t), d, kind) for g in range(2) if rng.random() < 0.8]
    of = {n: np.frombuffer(t, np.uint32) for n, t in texts}

    def near(x, y):
        hit = np.isin(x, y)
        return any(hit[k : k + passages.LEAST].sum() >= passages.SHARED for k in range(len(x) - passages.LEAST + 1))

    want = {(d, c) for g, x, _, d, kind in sides if kind == passages.REST for h, y, _, c, other in sides if other == passages.WHOLE and g == h and c < d and near(of[x], of[y])}
    rows = spark.createDataFrame(sides, "g long, node long, n long, doc long, kind int").repartition(3)
    got = passages.compared(rows, spark.createDataFrame(texts, "node long, t binary")).collect()
    assert want and {(r.doc, r.c_doc) for r in got} == want


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Of texts that all repeat one another in part, with a word changed every 45: the first has what all others have in common with each other."""
    monkeypatch.setattr(passages, "SMALL", 1)
    seen = []
    keep = passages.materialize

    def counted(df, what="stage"):
        out = keep(df, what)
        if what == "likely":
            seen.append(out.count())
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"v{i}" for i in rng.integers(0, 1 << 40, n)]
    body, n = fresh(225), 40
    rows = [(i, " ".join([*fresh(40), *body[i * 25 : i * 25 + 25], *fresh(40)])) for i in range(9)] + [(9, " ".join(body))]
    for d in range(10, 10 + n):
        own = body.copy()
        for i in range(20 + int(rng.integers(0, 20)), 225, 45):
            own[i] = f"changed{d}"
        rows.append((d, " ".join([*fresh(20), *own, *fresh(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == set(range(10, 10 + n))
    assert sum(seen) <= 4 * n


@pytest.mark.parametrize("cell", [1, 3, 50])
def test_nested_candidates_are_left_out(cell):
    """likely() with fewest: each pair that goes has all its positions in common with an earlier text that stays."""
    rng = np.random.default_rng(cell)
    base = rng.integers(0, 1 << 32, 80)
    lists = lambda n, p: [np.where(rng.random(80) < rng.choice(p), rng.integers(0, 1 << 32, 80), base).astype(np.uint32) for _ in range(n)]
    x, y = lists(cell, [0.0, 0.1]), lists(60, [0.0, 0.1, 0.2, 0.6])
    x_doc, y_doc = np.arange(100, 100 + cell), rng.permutation(120)[:60] + 0
    sides = (x_doc, *passages.joined(x), y_doc, *passages.joined(y))
    every = set(zip(*(c.tolist() for c in passages.likely(*sides)), strict=True))
    few = set(zip(*(c.tolist() for c in passages.likely(*sides, fewest=True)), strict=True))
    own = dict(zip(y_doc.tolist(), y, strict=True))
    assert few <= every and len(few) < len(every)
    for d, c in every - few:
        hit = np.isin(x[d - 100], own[c])
        assert any(e == d and b < c and not (hit & ~np.isin(x[d - 100], own[b])).any() for e, b in few)


def test_shingles_of_earlier_texts_are_told(spark):
    rng = np.random.default_rng(9)
    words_ = lambda n: [f"u{i}" for i in rng.integers(0, 60, n)]
    rows = [(int(d), " ".join(words_(int(n))), [1], [{"l": 3, "r": 9}] if d % 3 == 0 else None) for d, n in enumerate(rng.integers(0, 80, 40))]
    df = spark.createDataFrame(rows, "doc long, text string, gs array<long>, spans array<struct<l:int,r:int>>").repartition(3)
    lists = dict(zip([r[0] for r in rows], passages.tokens([r[1].encode() for r in rows]), strict=True))
    for parts in (1, 5):
        want = set()
        for d, _, _, spans in rows:
            x = lists[d]
            inside = np.zeros(len(x), bool)
            for p in spans or ():
                inside[p["l"] : p["r"]] = True
            earlier = np.concatenate([np.empty(0, np.uint64), *(lists[c] for c in lists if c < d)])
            want |= set(passages.of_owner(passages.part_of(x[np.isin(x, earlier) & ~inside], parts), d).view(np.int64).tolist())
        assert {r.id for r in passages.met_before(df, parts).collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_windows_go_to_parts_as_arrays(spark, monkeypatch, parts):
    """A task gives one row for each part, not one for each window; each value has its links and is open as over all windows."""
    monkeypatch.setattr(passages, "SMALL", 3)
    rng = np.random.default_rng(parts)
    body = words(rng, 70, 1 << 30)
    rows_ = [(d, f"{words(rng, 60)} {body if d % 3 else body[:400]} {words(rng, 60)}") for d in range(24)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(2)
    dealt = passages.window_rows(df, "text", parts)
    assert dealt.count() <= 2 * parts
    met = passages.map_arrow(dealt.repartition("k").sortWithinPartitions("k"), passages.met_windows, "sig long, doc long, c_doc long, h int, a long, b long, large boolean").collect()
    of, around = defaultdict(set), defaultdict(set)
    for d, t in rows_:
        x = next(passages.tokens([t.encode()]))
        for h in range(passages.HASHES):
            _, v, l, c, r = passages.windows_of(x, np.array([0, len(x)]), passages.SALTS[h], passages.LEAST)
            for g, s in zip(v.view(np.int64).tolist(), passages.surroundings(passages.run_sums(x), l, c, r).tolist(), strict=True):
                of[g].add(d)
                around[h, g].add(s)
    want = {(g, d, min(ds)) for g, ds in of.items() if len(ds) > 3 for d in ds if d != min(ds)}
    links = {(r.sig, r.doc, r.c_doc) for r in met if r.doc is not None}
    near = defaultdict(set)
    for g, d, c in links:
        near[g] |= {d, c}
    assert want and {g for g, _, _ in want} <= set(near) and all(near[g] == of[g] for g in near) and all(c < d for _, d, c in links)
    opened = [r.sig for r in met if r.doc is None]
    assert opened and len(opened) == len(set(opened)) and set(opened) == {g for (h, g), s in around.items() if h == 0 and len(s) > 1}


def test_links_of_values_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(passages, "SMALL", 4)
    rng = np.random.default_rng(0)
    size = {s: int(n) for s, n in enumerate(rng.integers(1, 12, 60))}
    rows = [(s, 100 * s + k, 0, (a := 7 + k * (s % 2)), a, k == 1 and s % 7 == 0) for s, n in size.items() for k in range(n)]
    want = set()
    for s, n in size.items():
        ids, large = range(100 * s, 100 * s + n), n > 4 or s % 7 == 0 and n > 1
        want |= {(s, y, ids[0], large) for y in ids[1:]} if large or not s % 2 else {(s, y, x, False) for y in ids for x in ids if x < y}
    for step in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("sig", "doc", "h", "a", "b", "big"), r, strict=True)) for r in rows[at : at + step]]) for at in range(0, len(rows), step)]
        got = [(r["sig"], r["doc"], r["c_doc"], r["large"]) for b in passages.bucket_links(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-40, 40, (300, 8)).astype(float)
    v[200:220] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = pivots.top_k(df.where("vec_id % 50 = 0"), df, 5, block=64, query_block=3).collect()
    for q in range(0, 300, 50):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    # candidates in clusters: most are never evaluated
    centers = rng.integers(-4000, 4000, (12, 8))
    far = [(i, (centers[i % 12] + rng.integers(-40, 40, 8)).astype(float).tolist()) for i in range(3000)] + [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (4000, [])]
    cl = spark.createDataFrame(far, "vec_id long, v array<double>")
    asked = cl.where("vec_id % 50 = 0 AND vec_id < 3000")
    got = pivots.top_k(asked, cl, 5, block=200, query_block=20).collect()
    dense = [(i, np.array(v + [0.0] * (8 - len(v)))) for i, v in far]
    for i in range(0, 3000, 50):
        order = sorted((-int(dense[i][1] @ v), j) for j, v in dense if j != i)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(n + 1, j, -s) for n, (s, j) in enumerate(order)]
    n = pivots.top_k(asked, cl, 5, evaluated=True).agg(F.sum("n")).first()[0]
    assert n < 0.3 * 60 * 3000
    huge = spark.createDataFrame([(0, [3.0e9, 1.0]), (1, [3.0e9 + 1, 5.0]), (2, [3.0e9 + 1, 6.0])], "vec_id long, v array<double>")
    assert [(r.vec_id, r.score) for r in pivots.top_k(huge.where("vec_id = 0"), huge, 2).orderBy("rank").collect()] == [(2, 3 * 10**9 * (3 * 10**9 + 1) + 6), (1, 3 * 10**9 * (3 * 10**9 + 1) + 5)]
    bad = spark.createDataFrame([(0, [1.0, None]), (1, [math.nan, 1.0]), (2, None), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in pivots.integer_vectors(bad).collect()] == [3]
    assert pivots.top_k(df.limit(0), df, 5).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    import unicodedata

    canon = {d: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split()) for d, t, *_ in rows if "\x1c" not in (t or "")}
    by, back = defaultdict(set), defaultdict(set)
    for d, c in canon.items():
        by[c].add(got[d])
        back[got[d]].add(c)
    assert all(len(x) == 1 for x in [*by.values(), *back.values()])
    weak = fingerprints.fingerprints(docs, digest_of=lambda c: F.length(c).cast("string"))  # collisions are told apart by bytes
    back = defaultdict(set)
    for r in weak.collect():
        if r.doc_id in canon:
            back[r.fingerprint].add(canon[r.doc_id])
    assert all(len(x) == 1 for x in back.values())
    assert fingerprints.fingerprints(empty).count() == 0


def test_next_texts(spark, docs, rows):
    got = {r.doc_id: r.next_text for r in fingerprints.next_texts(docs).collect()}
    order = sorted(rows, reverse=True)
    assert got == {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}


def test_fingerprint_query(spark, docs, rows, tmp_path):
    """Against a plain computation of lengths, edited texts and likenesses."""
    import unicodedata

    some = [r for r in rows if "\x1c" not in (r[1] or "")] + [(10**6, "same text", "en", "a", 9, "x"), (10**6 - 1, "SAME  text", "en", "a", 10, "x"), (10**6 - 2, "aaaaaa", "en", "a", 6, "x"), (10**6 - 3, "aaaa", "en", "a", 4, "x")]
    spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op8_fingerprints(spark, str(tmp_path)).collect()}
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    order = sorted(((r[0], r[1] or "") for r in some), reverse=True)
    assert len(got) == len(order)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
    assert got[10**6].near_next == 1 and got[10**6 - 2].near_edited == 1
    clash = docs.withColumns({"__canon": F.lit(1), "canon": F.lit(2), "digest": F.lit(3), "__bad": F.lit(4)})
    keep = ("doc_id", "canon", "__canon", "digest", "__bad")
    assert set(fingerprints.fingerprints(clash, keep=keep, digest_of=lambda c: F.length(c).cast("string")).select(*keep[1:]).distinct().collect()) == {(2, 1, 3, 4)}


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.integers(-4, 5, int(rng.integers(1, 30))).astype(float)
        best = max((s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        found = toxicity.maximal_segments(list(enumerate(s.tolist())), -1.0)
        assert max((x for *_, x in found), default=0) == pytest.approx(max(best, 0))
        assert all(x == pytest.approx(s[a:b].sum()) and x > 0 for a, b, x in found)


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, words(rng, 40, 200) + (" vile scum" if i % 7 == 0 else ""), 1 if i % 7 == 0 else 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[d].predicted == y for d, _, y in held) / len(held) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.score(odd, model).collect())
    assert toxicity.fit(df, df.select("doc_id", "toxic").where("toxic = 0")).weights == {}


def test_raking_meets_targets(docs, empty):
    rng = np.random.default_rng(6)
    cells = {(s, l, t): float(rng.integers(1, 100)) for s in "ab" for l in "xyz" for t in "pq"}
    targets = [{"a": 0.3, "b": 0.7}, {"x": 0.2, "y": 0.3, "z": 0.5}, {"p": 0.6, "q": 0.4}]
    w = raking.rake(cells, targets)
    for axis, target in enumerate(targets):
        for k, v in target.items():
            assert sum(x for c, x in w.items() if c[axis] == k) == pytest.approx(v, abs=1e-6)
    out = raking.mix(docs, raking.own_targets(raking.cell_sums(docs), 0.5), 0.6)
    assert set(docs.columns) < set(out.columns) and 0 < out.count() < docs.count()
    assert raking.mix(empty, raking.own_targets(raking.cell_sums(empty), 0.5)).count() == 0


def test_drawn_tokens_have_the_targets_when_cells_need_repeats(spark):
    rng = np.random.default_rng(9)
    skewed = [(i, words(rng, 10), "en" if i % 3 else "fr", "big" if i % 40 else "small") for i in range(8000)]
    df = spark.createDataFrame(skewed, "doc_id long, text string, lang string, source string")
    source, lang, topic = raking.own_targets(raking.cell_sums(df), 0.5)
    out = raking.mix(df, (source, lang, topic), 0.6)
    source = {r.source: r.target for r in source.collect()}
    source = {k: v / sum(source.values()) for k, v in source.items()}
    got = out.selectExpr("source", "lang", "__tokens * __repeats AS n").collect()
    total = sum(r.n for r in got)
    assert total == pytest.approx(0.6 * 80_000, rel=0.05) and source["small"] > 0.1
    for axis, target in (("source", source), ("lang", lang)):
        for k, v in target.items():
            assert sum(r.n for r in got if r[axis] == k) / total == pytest.approx(v, rel=0.08)


def test_raking_in_the_cluster_equals_that_on_the_driver(spark):
    rng = np.random.default_rng(10)
    rows = [(i, words(rng, 1 + i % 50), ["en", "fr", "de", None][int(rng.integers(4))], [None, *(f"s{k}" for k in range(40))][int(rng.integers(41) ** 0.9)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("own"))
    sums = raking.cell_sums(df)
    targets = raking.own_targets(sums, 0.5)
    a, b = ({(r.source, r.lang, r.topic): r.multiple for r in raking.cell_multiples(sums, targets, 0.5, local).collect()} for local in (10**6, 0))
    assert a.keys() == b.keys() and len(a) > 100 and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)
    out = raking.mix(df, targets, 0.5, sums=sums)
    assert set(out.select("topic").distinct().collect()) == {("own",)}  # a clashing column passes unchanged
    with pytest.raises(ValueError):
        raking.mix(df.withColumn("__Tokens", F.lit(1)), targets, 0.5, sums=sums)


def test_pseudo_likelihood_prefers_order(spark):
    rng = np.random.default_rng(7)
    chain = [f"t{i}" for i in range(30)]
    texts = [" ".join(chain[(s + i) % 30] for i in range(200)) for s in rng.integers(0, 30, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    v, w = pseudo_likelihood.fit(df)
    shuffled = [" ".join(rng.permutation(texts[0].split())) for _ in range(5)]
    test = spark.createDataFrame([(0, texts[0]), *((i + 1, t) for i, t in enumerate(shuffled)), (9, None), (10, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudo_likelihood.score(test, v, w).collect()}
    assert all(got[0].mean_log_probability > got[i].mean_log_probability + 0.5 for i in range(1, 6))
    assert got[9].pseudo_log_likelihood == got[10].pseudo_log_likelihood == 0 and got[9].n_tokens == 0


@pytest.fixture(scope="module")
def small_model():
    v = pseudo_likelihood.Vocabulary([(f"w{i}", 1000 - i) for i in range(500)], 800_000, 5_500)
    net = pseudo_likelihood.Network(v)
    rng = np.random.default_rng(0)
    for _ in range(5):
        net.learn(rng.integers(0, 500, (6, 300)).astype(np.uint16), rng.integers(0, 500, 300).astype(np.uint16))
    return v, net


def chance(v, net, around, i):
    """p(class) * p(id in its class) / words of the id, with plain loops."""
    M = pseudo_likelihood
    h = np.tanh(sum(net.e[k][around[k]].astype(float) for k in range(6)) + net.b)
    z = np.exp(h @ net.w + net.c)
    k = i % M.CLASSES
    y = np.exp(h @ net.v[k] + net.d[k])
    return z[k] / z.sum() * y[i // M.CLASSES] / y.sum() / math.exp(v.log_words[i])


def test_pseudo_likelihood_equals_a_direct_sum(small_model):
    v, net = small_model
    texts = ["w1 w2 unknown w3, w499 w1", None, "", "w7", " ".join(f"w{i % 600}" for i in range(9000))]
    ids = v.encoder()
    n, got = pseudo_likelihood.scores(net, v, ids, texts)
    for t, m, s in zip(texts, n, got, strict=True):
        own = [ids[w] for w in pseudo_likelihood.tokens_of(t)]
        padded = [pseudo_likelihood.PAD] * 3 + own + [pseudo_likelihood.PAD] * 3
        want = sum(math.log(chance(v, net, [padded[3 + k + p] for p in pseudo_likelihood.PLACES], i)) for k, i in enumerate(own))
        assert m == len(own) and s == pytest.approx(want, rel=1e-4, abs=1e-6)
    around = [1, 2, 3, 4, 5, 6]
    every = sum(chance(v, net, around, i) * math.exp(v.log_words[i]) for i in range(pseudo_likelihood.PAD))
    assert every == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("size", [0.1, 40])
def test_a_step_equals_plain_gradients(size):
    """Of moderate weights, and of ones whose exponentials have no finite sum as they are; the classes' steps are taken together."""
    M = pseudo_likelihood
    v = M.Vocabulary([(f"w{i}", 1000 - i) for i in range(500)], 800_000, 5_500)
    net = M.Network(v)
    net.weights[:] = np.random.default_rng(3).standard_normal(len(net.weights)) * size
    plain, each = net._plain()
    assert plain == each.all() == (size < 1)
    rng = np.random.default_rng(1)
    ids, context = rng.integers(0, M.PAD, 300).astype(np.uint16), rng.integers(0, M.IDS, (len(M.PLACES), 300)).astype(np.uint16)
    e, b, w, c, t, d = (x.astype(np.float64) for x in (net.e, net.b, net.w, net.c, net.v, net.d))
    h = np.tanh(sum(e[k][context[k]] for k in range(len(M.PLACES))) + b)
    kind, place = ids % M.CLASSES, ids // M.CLASSES

    def logs(z):
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    p, q, rows = logs(h @ w + c), logs(np.stack([h[i] @ t[k] + d[k] for i, k in enumerate(kind)])), np.arange(300)
    want = p[rows, kind] + q[rows, place]
    assert np.allclose(net.log_probabilities(context, ids), want, rtol=1e-3, atol=1e-3 * max(1, size))
    p, q = np.exp(p), np.exp(q)
    p[rows, kind] -= 1
    q[rows, place] -= 1
    back = (p @ w.T + np.stack([t[k] @ q[i] for i, k in enumerate(kind)])) * (1 - h * h) / 300
    net.learn(context, ids)
    gv = np.zeros_like(t)
    np.add.at(gv, kind, h[:, :, None] * q[:, None, :] / 300)
    big = lambda g: np.abs(g) > 1e-3 * np.abs(g).max()  # noqa: E731  where rounding doesn't count
    for now, was, g in ((net.w, w, h.T @ p / 300), (net.c, c, p.sum(axis=0) / 300), (net.v, t, gv), (net.b, b, back.sum(axis=0))):
        moved = -M.RATE * g / np.sqrt(M.START + g * g)
        assert np.allclose((now - was)[big(g)], moved[big(g)], rtol=1e-2, atol=1e-3)


def test_ids_in_place_of_texts(spark):
    M = pseudo_likelihood
    rows = [(i, t) for i, t in enumerate(["a b c d e" * 3, None, "", "x y, never seen!", " \n", "b " * 200])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    v, w = M.fit(df)
    ids = M.encoded(df, M.vocabulary_of(df))
    assert np.array_equal(M.train(ids, v, "ids"), w)
    assert sorted(M.score(ids, v, w, text="ids").collect()) == sorted(M.score(df, v, w).collect())


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_tokens_cut_once_give_the_same_counts_and_ids(spark, monkeypatch, held):
    M = pseudo_likelihood
    monkeypatch.setattr(M, "HELD", held)
    rows = [(i, t, None if i % 3 else "k") for i, t in enumerate(["a b c d e" * 3, None, "", "x y, never seen! ΑΣ.", " \n", "b " * 700, None, "\x1c \u2028 É\u0301"] * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(2)
    cut = M.cuts(df, ("doc_id", "k"))
    assert sorted(M.counts_of_cuts(cut).collect()) == sorted(M.word_counts(df, "text").collect())
    v = M.vocabulary_of(df)
    got = M.encoded_cuts(cut, v, df.select("doc_id", "k").schema)
    want = M.encoded(df, v, ("doc_id", "k"))
    assert got.schema == want.schema and sorted(got.collect(), key=lambda r: r.doc_id) == sorted(want.collect(), key=lambda r: r.doc_id)
    none = M.cuts(df.limit(0))
    assert none.count() == 0 and M.counts_of_cuts(none).count() == 0


def test_unlisted_words_share_the_chance_of_their_id(small_model):
    v, net = small_model
    assert math.exp(v.log_words[-1]) == pytest.approx(5000 / pseudo_likelihood.HASHED) and v.log_words[0] == 0
    n, got = pseudo_likelihood.scores(net, v, v.encoder(), ["w499", "neverseen"])
    assert got[1] < got[0]


def test_every_token_is_a_target(small_model):
    v, _ = small_model
    stream, at, n = pseudo_likelihood.positions(["w0 w1", None, "w2", " ".join(f"w{i}" for i in range(100))], v.encoder())
    assert stream[at].tolist() == [0, 1, 2, *range(100)] and n.tolist() == [2, 0, 1, 100]
    assert pseudo_likelihood.contexts(stream, at)[:, 0].tolist() == [pseudo_likelihood.PAD] * 3 + [1] + [pseudo_likelihood.PAD] * 2


def test_language_evidence(spark):
    train = spark.createDataFrame([("the cat and the dog were there with them", "en"), ("le chat et la souris dans une maison", "fr")] * 20, "text string, lang string")
    names, logs = language.fit(train)
    assert names == ["en", "fr"]
    pages = [(i, f"http://h{i % 2}.example.{'fr' if i % 2 else 'com'}/", f"<html lang={'fr' if i % 2 else 'en'}><script>the the</script>" + ("la souris et le chat" if i % 2 else "the dog and the cat")) for i in range(20)]
    pages += [(100, "http://h1.example.fr/x", None), (101, None, None), (102, "bad", "")]
    df = language.address_parts(spark.createDataFrame(pages, "page_id long, url string, html string"), "url")
    got = {r.page_id: r for r in language.fuse(language.text_evidence(df, (names, logs), True, ["page_id", "host", "domain", "suffix"], "html"), names).collect()}
    assert all(got[i].lang == ("fr" if i % 2 else "en") for i in range(20))
    assert got[100].lang == "fr" and got[101].host is None and Counter(len(got) for _ in [0])[23] == 1


def test_visible_text():
    cases = {
        b"<p>a<b>c</b> &amp; d": " a c  & d", b"<script>x<y>z</SCRIPT >t": " t", b"<!-- <p> -->t<!-- u": " t<!-- u", b"<style>a": " a", b"a < b": "a < b", b"x<y": "x<y", b"": "",
        b"<script>1</script>2<script>3": " 2 3", b"<a title='<!--'>b": " b",
    }
    for markup, text in cases.items():
        assert language.visible(markup).decode() == text, markup
    import time

    began = time.time()
    for unit in (b"<script ", b"<!-- ", b"<", b"<style>", b"<script></style>"):
        language.visible(unit * 200_000)
    assert time.time() - began < 10


def test_evidence_beside_the_text_decides(spark):
    """Against the formulas in plain Python; half of the rows have no text, or one that fits both languages."""
    rng = np.random.default_rng(2)
    names = ["en", "fr"]
    rows = []
    for i in range(60):
        fr = i % 2
        ll = [0.0, 0.0] if i % 4 < 2 else [-3.0 * fr, -3.0 * (1 - fr)]
        rows.append((i, ll, [None, "en", "fr"][int(rng.integers(3))] if i % 5 else names[fr], f"{'fr' if fr else 'com'}" if i % 7 else None, f"d{fr}.x" if i % 7 else None, f"h{fr}{i % 3}" if i % 7 else None))
    df = spark.createDataFrame(rows, "id int, ll array<double>, declared string, suffix string, domain string, host string")
    got = {r.id: r for r in language.fuse(df, names).collect()}
    p = {r[0]: np.exp(r[1]) / np.exp(r[1]).sum() for r in rows}
    total = sum(p.values())
    overall, k = (total + 1) / (total.sum() + 2), language.KAPPA
    smooth = lambda s, q: (s + k * q) / (s.sum() + k)
    sums = lambda c, v: sum((p[r[0]] for r in rows if r[c] == v), np.zeros(2))
    changed = 0
    for r in rows:
        prior = overall if r[5] is None else smooth(np.maximum(sums(5, r[5]) - p[r[0]], 0), smooth(sums(4, r[4]), overall))
        logs = np.array(r[1]) + np.log(prior)
        for c in (2, 3):
            if r[c] is not None:
                logs += np.log(smooth(sums(c, r[c]), overall) / overall)
        post = np.exp(logs - logs.max())
        post /= post.sum()
        assert got[r[0]].posterior == pytest.approx(post.tolist(), rel=1e-9) and got[r[0]].lang == names[int(post.argmax())]
        changed += got[r[0]].lang != got[r[0]].text_lang
    assert changed > 10  # the text alone is silent there and would say the first language
    silent = [r for r in rows if r[1] == [0.0, 0.0] and r[5]]
    assert np.mean([got[r[0]].lang == names[r[0] % 2] for r in silent]) > 0.8


def test_language_of_empty_and_odd_tables(spark, empty):
    assert language.fit(empty) == (["und"], pytest.approx(np.zeros((1, language.BUCKETS))))
    model = language.fit(spark.createDataFrame([("abc abd", "en"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model[0] == ["en"] or model[0] == ["en", "fr"]
    df = language.address_parts(spark.createDataFrame([], "page_id long, url string, html string"), "url")
    assert language.fuse(language.text_evidence(df, model, True, ["page_id", "host", "domain", "suffix"], "html"), model[0]).count() == 0


def test_files_are_added_up_in_order(spark, monkeypatch):
    monkeypatch.setattr(packed_ids, "PARTS", 3)
    names = [(f"x/part-{p:05d}-u-c{c:03d}.txt", 10 * p + c + 1) for p in range(11) for c in range(3)]
    rows = spark.createDataFrame([(f, n) for f, m in names for n in (m, 1)], "file string, n_tokens long").repartition(4)
    got = {r.file: r.base for r in packed_ids.bases(rows).collect()}
    at = 0
    for f, m in names:
        assert got[f] == at
        at += m + 1
