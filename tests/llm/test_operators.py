"""Each corpus operator against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import json
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from busloom.llm import bytepair, grouping, jaccard, kneserney, mixing, rans, sharding, tokencount, topk, toxicity, vectorlinks, wordpieces  # noqa: E402
from busloom.llm.common import workspace  # noqa: E402
from busloom.llm.wordpieces import WordEncoder  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dawn".split()


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{PROSE[i]}{rng.integers(40)}" for i in rng.integers(0, len(PROSE), n))


TEXTS = [text(0), text(0), None, "", " \n ", "ÉTÉ don't <|endoftext|> 日本語 ½² \x1c\x85 x", text(1, 4000), text(2), " ".join(text(2).split()[:-1]), text(3), "one", "one", 'say "!"']


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a" if i % 3 else None, len(t or ""), "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(None, text(9), "en", "b", 1, None, None), (7, text(2), "en", "b", 1, None, None)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# 1
def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, text(i, 40) + (" vile slur" if bad else ""), "en"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (400, None, "en"), (401, "", "en"), (402, "VILE, slur! " + text(7, 3000), "en")], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training(docs, table))
    got = {r.doc_id: r._s for r in toxicity.scored(docs.select("doc_id", "text"), model, out="_s").collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert got[400] == got[401] < 0.5 < got[402]


def test_toxicity_interactions_and_no_labels(spark, no_docs):
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2, (800, 2))
    rows = [np.flatnonzero(b).astype(np.int32) + 5 for b in both]
    model = toxicity.fit(rows, (both.sum(axis=1) == 2).astype(float))
    slots = model.slots()
    assert model.score(slots, np.array([5, 6])) > 0.5 > max(model.score(slots, np.array([5])), model.score(slots, np.array([6])))
    empty = toxicity.fit(*toxicity.training(no_docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert empty.score(empty.slots(), toxicity.buckets("x")) < 1e-9


def test_toxicity_learns_exclusive_or():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(4000):  # toxic with exactly one of 5 and 6, neither of which tells anything alone
        own = np.flatnonzero(rng.integers(0, 2, 2)) + 5
        rows.append(np.sort(np.concatenate([own, rng.choice(np.arange(100, 400), 20, replace=False)])).astype(np.int32))
        y.append(float(len(own) == 1))
    model = toxicity.fit(rows, np.array(y))
    score = lambda *t: model.score(model.slots(), np.array(t, dtype=int))
    assert max(score(), score(5, 6)) < 0.5 < min(score(5), score(6))


def test_toxicity_training_rows(spark):
    docs = spark.createDataFrame([(i, "common words here " + text(i, 3)) for i in range(100)] + [(1, "a zz"), (1, "b zz"), (3, "x"), (4, "x"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(100)] + [(1, 1), (4, 1), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows, y = toxicity.training(docs.where("doc_id IS NULL OR doc_id NOT IN (3, 4) OR text = 'x'"), labels)
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(rows) == len(learnt) - ({3, 4} <= set(learnt)) and y.sum() == len({1, 4} & set(learnt))
    counts = Counter(t for r in rows for t in r.tolist())
    assert min(counts.values()) >= toxicity.MIN_TEXTS
    few, _ = toxicity.training(docs, labels, entries=50)
    assert 0 < sum(map(len, few)) <= 50
    assert len(toxicity.training(docs, labels, limit=7)[0]) <= 7


def test_toxicity_is_learnt_off_the_driver(spark, no_docs, monkeypatch):
    docs = spark.createDataFrame([(i, text(i, 40) + (" vile slur" if i % 5 == 0 else "")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    there = toxicity.fit(*toxicity.training(docs, labels))
    fit, driver = toxicity.fit, os.getpid()

    def small(rows, labels):
        assert os.getpid() != driver or not len(rows), "fitted on the driver"
        return fit(rows, labels)

    monkeypatch.setattr(toxicity, "fit", small)
    got = toxicity.learnt(docs, labels)
    assert got.bias == there.bias and all((getattr(got, k) == getattr(there, k)).all() for k in ("terms", "weights", "factors"))
    empty = toxicity.learnt(no_docs, labels)
    assert empty.score(empty.slots(), toxicity.buckets("x")) < 1e-9


def test_toxicity_finds_pairs_of_neutral_terms():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(4000):  # 5 and 6 are toxic together only; each alone is toxic as often as any term
        kind = i % 100
        found = rng.choice(np.arange(100, 400), 25, replace=False)
        own = [5, 6] if kind == 0 else [5] if kind < 9 else [6] if kind < 17 else []
        rows.append(np.sort(np.concatenate([own, found])).astype(np.int32))
        y.append(float(kind == 0 or kind >= 89))
    y = np.array(y)
    model = toxicity.fit(rows, y)
    scores = np.array([model.score(model.slots(), r) for r in rows])
    both = np.array([{5, 6} <= set(r.tolist()) for r in rows])
    assert (scores[both] > 0.5).all() and (scores[~both] > 0.5).mean() < 0.01
    assert all(model.score(model.slots(), np.array([t])) < 0.5 for t in (5, 6))


def test_toxicity_learns_rare_terms_of_large_training_sets():
    rng = np.random.default_rng(4)
    rows, y = [], []
    for i in range(6000):  # term 5: 15 texts of 6000, all toxic
        own = [5] if i % 400 == 0 else []
        rows.append(np.sort(np.concatenate([own, rng.choice(np.arange(100, 2000), 20, replace=False)])).astype(np.int32))
        y.append(float(i % 400 == 0 or i % 10 == 1))
    model = toxicity.fit(rows, np.array(y))
    slots = model.slots()
    assert np.mean([model.score(slots, r) > 0.5 for r in rows[::400]]) == 1
    assert np.mean([model.score(slots, r) > 0.5 for r in rows[2::10]]) < 0.01


# 2
def brute_top(vectors, k, every):
    q = {i: np.floor(64 * np.pad(np.array(v, float), (0, 6 - len(v)))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in (i for i in q if i % every == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300 + i, [0.5] * 6) for i in range(60)]  # copies: ties by id
    vectors += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [0.0] * 6), (None, [1.0] * 6), (505, [1.0, 2.0]), (506, [1e4] * 6)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, 7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, 7, 10)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 10 == 0, 7).count() == 0


def test_top_k_of_repeated_ids_and_extra_columns(spark):
    same = [(20, [1.0, 0.0])] * 2 + [(i, [1.0, 0.0]) for i in range(21, 61)] + [(i, [0.5, 0.1]) for i in range(100, 130)]
    same += [(21, [1.0, 0.0])] * 3
    table = spark.createDataFrame([(*r, "x", 1) for r in same], "vec_id long, embedding array<double>, score string, grp int")
    got = [(r.rank, r.vec_id) for r in topk.top_k(table, F.col("vec_id") == 20, 20).orderBy("rank").collect()]
    assert got == [(i + 1, v) for i, v in enumerate([21] * 4 + list(range(22, 38)))]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_top_k_over_many_trees(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "DATA_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 12)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, (centres[i % 12] + spread * rng.normal(size=6)).tolist()) for i in range(900)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, 7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, 7, 10)


def clustered(rng, n, centres, spread):
    return np.floor(64 * (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, centres.shape[1]))))


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(2)
    points = clustered(rng, 3000, np.repeat(rng.normal(0, 50, (9, 3)), 3, axis=0) + rng.normal(0, 2, (27, 3)), 0.3)
    tree = topk.CoverTree.build(np.arange(len(points)), points)
    assert sorted(tree.ids) == list(range(len(points))) and (points[tree.ids] == tree.points).all()
    depth = np.zeros(len(tree.begin), dtype=int)
    for n in range(len(tree.begin)):
        inside = tree.points[tree.begin[n] : tree.end[n]].astype(float)
        assert np.linalg.norm(inside - inside[0], axis=1).max() <= tree.radius[n] + 1e-9
        kids = np.arange(tree.child[n], tree.child[n] + tree.children[n])
        depth[kids] = depth[n] + 1
        if len(kids):
            assert (tree.begin[kids[0]], tree.end[kids[-1]]) == (tree.begin[n], tree.end[n])
            big = [tree.points[tree.begin[c]].astype(float) for c in kids if tree.end[c] - tree.begin[c] > topk.LEAF]
            assert all(np.linalg.norm(x - y) > tree.radius[n] / 2 for x, y in itertools.combinations(big, 2))
        else:
            assert len(inside) <= topk.LEAF or tree.radius[n] == 0
    assert depth.max() >= 3


def test_dual_tree_leaves_products_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(80, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    data, asked = clustered(rng, 4000, centres, 0.02), clustered(rng, 1500, centres, 0.02)
    counted = {}
    tree = topk.CoverTree.build(np.arange(4000), data)
    queries = topk.CoverTree.build(np.arange(4000, 5500), asked)
    place, ids, scores = topk.search(queries, tree, 20, np.full(1500, -np.inf), counted)
    assert counted["products"] < 0.12 * 4000 * 1500
    exact = asked @ data.T
    for i in range(0, 1500, 50):
        row = exact[queries.ids[i] - 4000]
        assert ids[place == i].tolist() == np.lexsort((np.arange(4000), -row))[:20].tolist()


# 3
def test_sharding(spark, docs, no_docs):
    got = sharding.interleave(docs, 4).collect()
    assert len(got) == docs.count()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    known = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in plain(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == known
    assert sharding.interleave(no_docs, 4).count() == 0


def test_sharding_by_hand(spark, docs):
    digest = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    first = lambda x: (x is not None, x or 0)  # noqa: E731  nulls come first
    rows = [(digest(f"shard-1|{'' if r.doc_id is None else r.doc_id}"), first(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "n" if r.source is None else f"s:{r.source}") for r in docs.collect()]
    placed = []
    for stratum in {r[4] for r in rows}:
        own = sorted(r for r in rows if r[4] == stratum)
        phase = digest(f"shard-1-phase|{stratum}") / 2.0**60
        placed += [((k + phase) / len(own), stratum, r) for k, r in enumerate(own)]
    n, want = len(rows), []
    for position, (_, _, r) in enumerate(sorted(placed)):
        shard = position * 8 // n
        want.append((r[1], r[2], r[3], r[4], shard, position - -(-shard * n // 8)))
    got = [(first(r.doc_id), r.size, r.text_crc32, r.stratum, r.shard, r.slot) for r in sharding.interleave(docs, 8).collect()]
    assert sorted(got) == sorted(want)


def test_shards_hold_whole_documents_in_order(spark, docs, no_docs):
    path = workspace(spark, "shards")
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("slot", F.lit("mine"))
    written = sharding.write_shards(odd, 4, path)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
    assert sorted(map(key, written.select("row.*").collect())) == sorted(map(key, docs.collect()))
    assert sorted((r.shard, r.slot) for r in written.collect()) == sorted((r.shard, r.slot) for r in sharding.interleave(docs, 4).collect())
    assert {(r.row["a.b"], r.row["slot"]) for r in written.collect()} == {(1, "mine")}
    for s in range(4):
        slots = [r.slot for r in spark.read.parquet(f"{path}/shard={s}").coalesce(1).collect()]
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.write_shards(no_docs, 4, workspace(spark, "shards")).count() == 0


def test_sharding_keeps_the_mixture(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(1000)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    small = Counter(r.shard for r in got if r.stratum == "s:small")
    assert set(small) == set(range(8)) and max(small.values()) - min(small.values()) <= 2


# 4
def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = base[:40] + rng.normal(0, 0.05, (40, 16))
    x = np.concatenate([base, near, base[:10], base[:10]])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(900, None), (901, [0.0] * 16), (902, [float("inf")] * 16), (903, [None] * 16), (904, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectorlinks.links(table).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == grouping.local_roots(near).tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905))
    assert vectorlinks.links(table.limit(0)).count() == 0


def test_vector_links_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(11)
    d, pairs = 32, 5000
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(rng.normal(size=(pairs, d)))
    away = rng.normal(size=(pairs, d))
    away = unit(away - (away * a).sum(axis=1)[:, None] * a)
    cosine = rng.uniform(0.9005, 0.93, pairs)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * away
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectorlinks.links(table).collect()}
    found = np.mean([got[pairs + i].component_id <= i and got[i].n_links > 0 for i in range(pairs)])
    assert found >= 0.985  # RECALL is 0.99 at the threshold itself


def test_vectors_without_an_id_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (7, [0.0, 2.0]), (8, [-1.0, 0.0])]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectorlinks.links(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")).collect()]
    assert Counter(got) == Counter([(None, 1, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 0, 8)])


def test_vector_plan_grows_slowly():
    assert vectorlinks.plan(10**9)[1] < 30 * vectorlinks.plan(10**4)[1]


# 5
def test_byte_bpe_matches_tiktoken(docs, no_docs):
    import tiktoken

    ranks = bytepair.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(tuple, bytepair.digests(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := reference.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for i, t in plain(docs)]
    assert got == sorted(want, key=repr)
    assert bytepair.digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_one_pass_or_two(spark, docs):
    """Decoding beside encoding, and decoding a column of ids, give the same bytes; columns called like a result are replaced, all others stay."""
    odd = docs.withColumn("DECODED", F.lit("old")).withColumn("a.b", F.lit(5))
    once = bytepair.encoded(odd, RANKS, public_tokenizers.PATTERN, decoded_as="decoded")
    twice = bytepair.decoded(bytepair.encoded(odd, RANKS, public_tokenizers.PATTERN), RANKS)
    assert once.columns == twice.columns == ["doc_id", "lang", "source", "n_chars", "score", "a.b", "ids", "decoded"]
    rows = [sorted(map(tuple, f.collect()), key=repr) for f in (once, twice)]
    assert rows[0] == rows[1]
    assert Counter((r[0], bytes(r[-1]).decode()) for r in rows[0]) == Counter(plain(docs))
    assert {r[5] for r in rows[0]} == {5}
    no_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in bytepair.decoded(no_ids, RANKS).collect()} == {b""}
    with pytest.raises(Exception, match="an id that the vocabulary doesn't have"):
        bytepair.decoded(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>"), RANKS).collect()


def test_byte_bpe_small_memo(monkeypatch):
    monkeypatch.setattr(bytepair, "MEMO_ENTRIES", 5)
    encoder = bytepair.Encoder(bytepair.model_proto(bytepair.read_ranks(RANKS)), public_tokenizers.PATTERN)
    fresh = lambda t: bytepair.Encoder(bytepair.model_proto(bytepair.read_ranks(RANKS)), public_tokenizers.PATTERN).encode([t])[0]
    some = ["a b c d", "d e f", "a"]
    assert encoder.encode(some) == [fresh(t) for t in some]


# 6, 7
def library_ids(docs, plain_specials=False):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = plain_specials  # False is the library's own setting
    return [(i, library.encode(t, add_special_tokens=False).ids) for i, t in plain(docs)]


def test_token_counts(spark, docs, no_docs):
    for table in (docs, no_docs):
        folder = workspace(spark, "t")
        names = tokencount.write_flat(table, WORDS, 49407, f"{folder}/files").cache()
        names.count()
        for block in (7, 1 << 20):
            counts = tokencount.stitch(tokencount.scan_blocks(spark, f"{folder}/files", 49407, block), block)
            got = Counter(tuple(r) for r in names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens").collect())
            assert got == Counter((i, len(ids)) for i, ids in library_ids(table, True))


@pytest.mark.parametrize("plain_specials", [False, True])
def test_word_memo_is_the_librarys_result(monkeypatch, plain_specials):
    from tokenizers import Tokenizer

    encoder = WordEncoder(WORDS, plain_specials=plain_specials)
    library = Tokenizer.from_file(WORDS)
    if plain_specials:
        library.encode_special_tokens = True
    odd = ["a <|endoftext|> b", "a<|endoftext|>b <|ENDOFTEXT|>", "<|EndOfText|>, x", "x., y", "it's, DON'T.", "a,b", "...", "<|startoftext|>,", "ΟΔΟΣ, İ. é,", " a b."]
    odd += ["wordy" * 50 + " " + "wordy" * 50 + ".", "", "a b c d e f a b c"]
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(e, "<u2").tolist() for e in encoder.encode(odd)] == want
    assert max(map(len, encoder)) <= wordpieces.MEMO_BYTES
    monkeypatch.setattr(wordpieces, "MEMO_WORDS", 4)  # starts afresh inside a text
    assert [np.frombuffer(e, "<u2").tolist() for e in encoder.encode(odd)] == want


def test_rans_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 1023, 1025, 300_000):
        ids = np.minimum(rng.zipf(1.4, n), 3000)
        codec = rans.Codec(rans.scaled(np.bincount(ids, minlength=3001)))
        block = codec.encode(ids)
        assert (codec.decode(block) == ids).all()
        if n > rans.LANES * rans.STEPS:
            assert (codec.decode(block, 1, 2) == ids[rans.LANES * rans.STEPS :]).all()
    assert len(block) < 2 * n


def test_ranges_hold_equal_bytes(spark):
    rows = [(None, "n")] * 300 + [(7, "same text")] * 300 + [(7, text(i, 5)) for i in range(300)] + [(i, "x" * (5000 if i % 100 == 0 else 10)) for i in range(1000, 1800)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = workspace(spark, "t")
    edges = rans._edges(table, 8000, folder)
    dealt = rans._ordered(table).toPandas()
    dealt["part"] = rans.route(edges, *(dealt[c].to_numpy() for c in ("known", "id", "tie", "salt")))
    sizes = dealt.groupby("part").text.agg(lambda t: sum(len(x) + 64 for x in t))
    assert len(sizes) > 10 and sizes.max() < 2 * 8000
    by = dealt.sort_values(["known", "id", "tie", "salt"])
    assert (np.diff(by.part) >= 0).all()


def test_rans_files(spark, docs, no_docs):
    import xxhash

    folder = workspace(spark, "t")
    rows = docs.select("doc_id", "text")
    ranges = rans.tokenised(rows, WORDS, 1, f"{folder}/s")
    files, freq = rans.write_files(ranges, f"{folder}/s", f"{folder}/f")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_files(files, f"{folder}/f", freq).collect())
    order = sorted(((i is not None, i or 0, np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64), ids) for (i, t), (_, ids) in zip(plain(docs), library_ids(docs), strict=True)), key=lambda r: r[:3])
    want, start = [], 0
    for known, i, _, ids in order:
        data = [*ids, 1]
        want.append((start, i if known else None, len(data), zlib.crc32(np.array(data, "<u4").tobytes())))
        start += len(data)
    assert got == want
    empty = rans.tokenised(no_docs.select("doc_id", "text"), WORDS, 1, f"{folder}/e")
    files, freq = rans.write_files(empty, f"{folder}/e", f"{folder}/ef")
    assert rans.read_files(files, f"{folder}/ef", freq).count() == 0


def test_work_folder_where_none_is_set(spark, tmp_path):
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession; from busloom.llm.common import workspace, staged; from busloom.sources.sinks import scratch\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert not s.conf.get('spark.checkpoint.dir', None); a = workspace(s, 'x'); assert staged(s.range(3), 'y', a).count() == 3\n"
        "assert scratch(s, 'x').startswith('file:') and not s.conf.get('spark.checkpoint.dir', None)"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120, cwd=tmp_path)


def test_files_under_hadoops_names_of_s3():
    asked = {"s3a://b/k": "s3://b/k", "s3n://b/k": "s3://b/k", "file:///x": "file:///x", "hdfs://h/x": "hdfs://h/x"}
    assert {u: wordpieces.opened_as(u) for u in asked} == asked


# 8
def split_words(t):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})), None]


class BruteKneserNey:
    """The model of triples from plain dictionaries."""

    def __init__(self, texts):
        all_tokens = [split_words(t) for t in texts]
        self.count = Counter(itertools.chain.from_iterable(all_tokens))
        self.threes = Counter(itertools.chain.from_iterable(zip(["<s>", "<s>", *x][: len(x)], ["<s>", *x[:-1]], x, strict=True) for x in all_tokens))
        self.ends = Counter((v, w) for _, v, w in self.threes)
        self.kinds = Counter(w for _, w in self.ends)
        self.n, self.v = sum(self.count.values()), len(self.count)
        by = lambda table: kneserney.discounts([sum(c == i for c in table.values()) for i in (1, 2, 3, 4)])
        self.d, self.e, self.f = by(self.threes), by(self.ends), by(self.kinds)
        self.sum3, self.left3, self.sum2, self.left2 = Counter(), Counter(), Counter(), Counter()
        for (u, v, _), c in self.threes.items():
            self.sum3[u, v] += c
            self.left3[u, v] += self.cut(c, self.d)
        for (v, _), c in self.ends.items():
            self.sum2[v] += c
            self.left2[v] += self.cut(c, self.e)
        self.rest = sum(self.cut(c, self.f) for c in self.kinds.values()) / max(1, len(self.ends)) / (self.v + 1)

    @staticmethod
    def cut(c, by):
        return by[min(c, 3) - 1] if c else 0.0

    def p(self, u, v, w):
        p = (self.kinds[w] - self.cut(self.kinds[w], self.f)) / len(self.ends) + self.rest
        if self.sum2[v]:
            p = (self.ends[v, w] - self.cut(self.ends[v, w], self.e) + self.left2[v] * p) / self.sum2[v]
        if self.sum3[u, v]:
            p = (self.threes[u, v, w] - self.cut(self.threes[u, v, w], self.d) + self.left3[u, v] * p) / self.sum3[u, v]
        return p

    def scores(self, t):
        x = split_words(t)
        base = sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in x)
        full = sum(math.log10(self.p(u, v, w)) for u, v, w in zip(["<s>", "<s>", *x][: len(x)], ["<s>", *x[:-1]], x, strict=True))
        return len(x), sum(self.count[w] > 0 for w in x), base, full


@pytest.mark.parametrize("small", [False, True])
def test_kneser_ney(spark, docs, no_docs, monkeypatch, small):
    if small:  # chunks end inside texts, sums are taken early, and rare words have no code
        monkeypatch.setattr(kneserney, "CHUNK_TOKENS", 50)
        monkeypatch.setattr(kneserney, "MERGE_ROWS", 20)
        monkeypatch.setattr(kneserney, "LEAST_COUNT", 2)
        monkeypatch.setattr(kneserney, "CODES", 40)
    from pyspark.sql import functions as F

    learnt = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    rows = docs.select("doc_id", "text").unionByName(docs.limit(12).select((F.col("doc_id") + 600).alias("doc_id"), F.concat("text", F.lit(" unheard Of words here")).alias("text")))
    if small:
        rows = rows.coalesce(2)
    spec = kneserney.train(rows.where(learnt).select("text"))
    assert spec["heavy"]
    brute = BruteKneserNey([t for i, t in plain(rows) if i is None or i % 3])
    assert sum(brute.p("<s>", "<s>", w) for w in brute.count) == pytest.approx(1 - brute.p("<s>", "<s>", "never"), abs=1e-9)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in kneserney.scored(rows, spec).collect())
    want = sorted((-1 if i is None else i, *brute.scores(t)[:2], brute.n, *brute.scores(t)[2:]) for i, t in plain(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert any(n > known for _, n, known, *_ in got)
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=2e-6)
    if not small:
        empty = kneserney.train(no_docs.select("text"))
        assert empty["tokens"] == 0
        assert all(r.n_known == 0 and math.isfinite(r.score) for r in kneserney.scored(docs.select("doc_id", "text"), empty).collect())


def test_sorted_keys_find_what_was_put_in():
    rng = np.random.default_rng(6)
    for n in (0, 1, 31, 5000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        counts = np.minimum(rng.zipf(1.5, len(h)), 10**6)
        keys = kneserney.SortedKeys(np.frombuffer(kneserney._count_keys(h, counts), np.uint8))
        assert (keys.counts(h) == counts).all()
        assert (keys.counts(np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))) == 0).all()


def test_model_files_can_be_read_without_a_mount(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text")
    spec = kneserney.train(rows.select("text"))
    texts = [kneserney.tokens(t, kneserney.WordHasher()) for _, t in plain(rows)]
    mapped = kneserney.Model(spec).score(texts)
    monkeypatch.setattr(kneserney.os.path, "exists", lambda _: False)
    held = kneserney.Model(spec)
    assert all((a == b).all() for a, b in zip(mapped, held.score(texts), strict=True))
    assert len(held.opened) <= kneserney.HELD


# 9
def test_poisson_mix(spark, docs, no_docs):
    rows = [(i, "a" if i % 4 else "b") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(table, {"a": 1.0, "b": 1.0}).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    share = Counter(r.source for r in got)
    assert abs(share["b"] / len(got) - 0.5) < 0.03 and abs(len(got) - 4000) < 250
    copies = Counter(r.doc_id for r in got)
    of_b = Counter(copies.get(i, 0) for i in range(0, 4000, 4))  # Poisson of mean 2
    assert abs(of_b[0] / 1000 - math.exp(-2)) < 0.04
    again = mixing.mixed(table.repartition(7), {"a": 1.0, "b": 1.0}).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert {r.source for r in mixing.mixed(table, {"a": 1.0}).collect()} == {"a"}
    assert mixing.mixed(docs, epochs=3.0).columns[: len(docs.columns)] == docs.columns
    odd = docs.withColumn("_key", F.lit("k")).withColumn("Copies", F.lit("mine")).withColumn("a.b", F.lit("d")).withColumn("c0", F.lit("z"))
    plainly, named = (sorted(map(repr, m.select("doc_id", "text", "source", "copies", "copy").collect())) for m in (mixing.mixed(docs, epochs=3.0), mixing.mixed(odd, epochs=3.0)))
    assert plainly == named and mixing.mixed(odd).columns == [*docs.columns, "_key", "a.b", "c0", *mixing.ADDED]
    assert {(r._key, r["a.b"], r.c0) for r in mixing.mixed(odd, epochs=3.0).collect()} == {("k", "d", "z")}
    assert mixing.mixed(no_docs).count() == 0


def test_poisson_table_at_any_rate(spark):
    rows = spark.createDataFrame([(str(r), float(r)) for r in (0.0, 0.3, 7.0, 900.0, 250_000.0)], "_key string, _rate double")
    for r in mixing.poisson_table(rows).collect():
        rate = float(r._key)
        want = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0) for k in range(r._first, r._first + len(r._cdf))]
        np.testing.assert_allclose(r._cdf, np.cumsum(want), rtol=0, atol=1e-8)
        assert len(r._cdf) < 30 * math.sqrt(rate) + 70


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 64)
    table = spark.createDataFrame([(i, "a") for i in range(500)] + [(900, "b")], "doc_id long, source string")
    got = mixing.mixed(table, {"a": 1.0, "b": 9.0}).where("source = 'b'").collect()
    assert sorted(r["copy"] for r in got) == list(range(got[0].copies)) and abs(len(got) - 451) < 120


# 10
def brute_classes(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = np.array([[bool(a and b) and len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets])
    np.fill_diagonal(near, False)
    return near.sum(axis=1).tolist(), grouping.local_roots(near)


@pytest.mark.parametrize("small", [512, 4])
def test_jaccard_join(spark, docs, no_docs, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4 * small)
    texts = [(i, t) for i, t in plain(docs)]
    for i in range(40):  # a group of near copies, and of passages that don't make one
        words = text(50, 300).split()
        words[i * 7] = f"changed{i}"
        texts += [(100 + i, " ".join(words)), (200 + i, text(60, 20) + " " + text(300 + i, 200))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    links, roots = brute_classes([t for _, t in texts])
    got = jaccard.near_duplicates(table).collect()
    least = {r: min((i for (i, _), q in zip(texts, roots, strict=True) if q == r and i is not None), default=None) for r in set(roots)}
    want = Counter((i, n, least[r] if t.split() else i) for (i, t), n, r in zip(texts, links, roots, strict=True))
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == want
    blank = sum(not t.split() for _, t in texts)
    assert sum(r.kept for r in got) == len({r for (_, t), r in zip(texts, roots, strict=True) if t.split()}) + blank
    if small == 512:
        assert jaccard.near_duplicates(no_docs).count() == 0
        kept = jaccard.deduplicated(table).collect()
        assert Counter((r.doc_id, r.text) for r in kept) <= Counter(texts) and len(kept) == sum(r.kept for r in got)


def test_jaccard_pairs_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    texts, want = [], []
    for i in range(2500):  # one changed word in the middle costs 5 of 100 - 130 shingles on each side; two or so are changed
        words = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(60, 200)))]
        other = list(words)
        changes = int((len(words) - 4) * 0.107 // 5)
        for at in np.linspace(5, len(words) - 6, max(1, changes)).astype(int):
            other[at] = f"z{i}"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, other))
        want.append(len(a & b) / len(a | b) >= 0.8)
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    texts += [(10_000 + i, text(10_000 + i, 120)) for i in range(5000)]
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    linked = np.array([got[2 * i + 1].class_id == 2 * i for i in range(2500)])
    want = np.array(want)
    assert want.sum() > 1000 and linked[want].mean() >= 0.99 and not linked[~want].any()
    assert all(got[i].n_links == 0 for i in range(10_000, 15_000))


def test_jaccard_of_a_chain_of_texts(spark):
    base = [f"w{i}" for i in range(2200)]
    texts = [(i, " ".join(base[5 * i : 5 * i + 100])) for i in range(400)]  # neighbours share 91 of 101 shingles, those two apart 86 of 106
    links, roots = brute_classes([t for _, t in texts])
    got = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == Counter((i, n, int(r)) for (i, _), n, r in zip(texts, links, roots, strict=True))


def test_sets_move_a_byte_a_position(spark, docs):
    places = [i for _, i in jaccard.roots(0.8, 0.995)]
    table = docs.select("doc_id", "text")
    for r in jaccard._sets(table, places).where("node IS NOT NULL").collect():
        assert (len(r.tokens), len(r.heads)) == (jaccard.POSITIONS, 4 * len(places))
        assert [r.heads[4 * k] for k in range(len(places))] == [r.tokens[i] for i in places]


def test_rows_reached_by_ties():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 3, (60, jaccard.POSITIONS)).astype(np.uint8)
    tokens[20:40] = tokens[3]  # one close group
    tokens[40:50, 64:] = tokens[3, 64:]
    counts, held = (tokens[:, None] == tokens[None]).sum(axis=2), []

    def near(rest_tokens, one, rest, a):
        held.append(len(rest))
        assert (jaccard._alike(rest_tokens, one) == counts[a, rest]).all()
        return jaccard._alike(rest_tokens, one) >= 60

    assert grouping.reached(tokens, near).tolist() == grouping.local_roots(counts >= 60).tolist()
    held.clear()
    assert grouping.reached(tokens[20:40], lambda left, one, rest, a: held.append(len(rest)) or jaccard._alike(left, one) >= 60).tolist() == [0] * 20
    assert sum(held) == 19  # every other row once, not each with each


def test_enough_runs():
    assert jaccard.plan_runs(0.8, 0.995, 1) < jaccard.plan_runs(0.8, 0.995, 3) < 20


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in grouping.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_model_description_is_json(spark, docs):
    json.dumps(kneserney.train(docs.limit(2).select("text")))
