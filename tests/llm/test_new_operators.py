"""Fill-in-middle, trie BPE and the conversation trie against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from busloom.llm import convtrie, fim, triebpe  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
SHAPE = "doc_id long, text string, form string, `Restored` string, `a.b` string, units string, ids string, _row string"
LETTERS = list(" \n\t\r\x0b\x0c\x1c\x85\xa0  'abcdefgstxyzABC0123456789.,;:!?-_éßñ日本語½²😀𝒳<>PSM")


def fuzzed(count, size, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, size))) for _ in range(count)]


TEXTS = [None, "", " ", "\n\n  \t", "one", " one", "one ", "a <P> b", "<M>", "x <|endoftext|>  <|endoftext|>y", "word " * 60_000, "a" * 50_000, "𝒳😀 " * 30, *fuzzed(300, 80), "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "f", "r", "d", "u", "i", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id at all", *"123456"), (3, "three again", *"123456"), (3, "three again", *"123456")], SHAPE)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def arranged(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs):
    done = fim.restored(fim.transformed(docs))
    assert [c for c in done.columns if c != "restored"] == ["doc_id", "text", "a.b", "units", "ids", "_row", *fim.ADDED]
    got = done.collect()
    assert len(got) == docs.count()
    forms = defaultdict(int)
    for r in got:
        text = r.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == arranged(r.doc_id, text)
        assert r.restored == text and (r["a.b"], r._row) in (("d", "w"), ("3", "6"))
        forms[r.form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 5
    assert fim.transformed(docs.limit(0)).collect() == []


def test_fill_in_middle_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = fim.op11(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        *about, output = arranged(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, *about, sha(output), sha(texts[r.doc_id]))


# 12
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_trie_encoder_like_the_library(library):
    description = triebpe._described(JSON)
    encoder = triebpe.TextEncoder(description, public_tokenizers.PATTERN)
    rng = random.Random(2)
    tokens = sorted(t for t in encoder.trie.v.ids if t.isascii())
    texts = [t for t in TEXTS if t] + fuzzed(3000, 60, 9) + [f" {rng.choice(tokens).decode()}{rng.choice(tokens).decode()}" for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "i4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_trie_encodes_shared_prefixes_once(monkeypatch):
    encoder = triebpe.TrieEncoder(triebpe.Vocabulary(triebpe._described(JSON)))
    seen = []
    end = encoder._end
    monkeypatch.setattr(encoder, "_end", lambda word, at, *states: seen.append(word[:at]) or end(word, at, *states))
    words = ["international", "internationally", "interned", "intern", "in"]
    encoder.encode([words])
    encoder.encode([["internet"]])
    prefixes = {w[:i].encode() for w in [*words, "internet"] for i in range(1, len(w) + 1)}
    assert sorted(seen) == sorted(prefixes) and len(encoder.children) == len(prefixes)


def test_trie_memories_are_bounded(monkeypatch, library):
    monkeypatch.setattr(triebpe, "TRIE_NODES", 50)
    monkeypatch.setattr(triebpe, "MEMO_WORDS", 20)
    monkeypatch.setattr(triebpe, "MEMO_PAIRS", 30)
    monkeypatch.setattr(triebpe, "LONG", 8)
    encoder = triebpe.TextEncoder(triebpe._described(JSON), public_tokenizers.PATTERN)
    for t in fuzzed(300, 120, 4):
        assert np.frombuffer(encoder.encode([t])[0], "i4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.trie.pairs) <= 30


def test_trie_bpe_tables(docs, library):
    both = triebpe.decoded(triebpe.encoded(docs, JSON, public_tokenizers.PATTERN), JSON)
    assert both.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    got = both.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") == library.decode(r.ids, skip_special_tokens=False)
    assert triebpe.encoded(docs.limit(0), JSON, public_tokenizers.PATTERN).collect() == []


def test_trie_decoder_on_ids_of_no_text(spark, library):
    rng = random.Random(7)
    lists = [[rng.randrange(50_257) for _ in range(30)] for _ in range(200)] + [[], [50_256, 50_256]]
    got = triebpe.decoded(spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(999, None)], "i long, ids array<int>"), JSON).collect()
    assert all(r.decoded == (library.decode(lists[r.i], skip_special_tokens=False) if r.i < 999 else "") for r in got)
    with pytest.raises(Exception, match="an id that the vocabulary"):
        triebpe.decoded(spark.createDataFrame([([50_257],)], "ids array<int>"), JSON).collect()


def test_trie_bpe_query(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = triebpe.op12(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert tuple(r) == (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(texts[r.doc_id]))


# 13
def trie(rows, rebuild=True):
    """Nodes by dictionaries, from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = dict(own)
    for c in own if rebuild else ():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members, children = defaultdict(set), defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        ends = ",".join(map(str, sorted(c for c in members[node] if len(made[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], sha(ends)))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, depth long, `a.b` string, n_convs string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-25, 90)]), rng.choice([None, *range(6)]), rng.choice([None, "", "u", "a"]), rng.choice([None, "", "x", "x y", "z"])) for _ in range(500)]
    rows += [(c, t, "u", "same") for c in range(100, 180) for t in range(3)] + [(c, t, "u", str(t)) for c in (200, 201, 220) for t in range(40)]
    return [*rows, *[(240, 5, "u", "again")] * 17, (21, 0, "u", "long " * 50_000), (301, 0, "u", "ab"), (302, 0, "ua", "b")]


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("bins", [(4096, 65_536, 1024), (3, 2, 4)])
def test_conversation_trie(spark, turns, rebuild, bins, monkeypatch):
    for name, value in zip(("TURN_BIN", "REPEAT_BIN", "END_BIN"), bins, strict=True):
        monkeypatch.setattr(convtrie, name, value)
    df = spark.createDataFrame([(*t, 7, "x", "y") for t in turns], TURNS)
    assert sorted(map(tuple, convtrie.of_table(df, rebuild).collect())) == trie(turns, rebuild)


def test_conversation_trie_of_chains_and_nothing(spark):
    chains = [(c, t, "u", "w") for c in range(1, 8) for t in range(c)]  # each a beginning of the next
    df = spark.createDataFrame(chains, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, convtrie.of_table(df, False).collect())) == trie(chains, False)
    assert convtrie.of_table(df.limit(0)).collect() == []
    lone = [(33, 0, "u", "w")]  # h = 3, and no conversation 20: it is rebuilt without a turn
    assert sorted(map(tuple, convtrie.of_table(spark.createDataFrame(lone, df.schema)).collect())) == trie(lone)


def test_conversation_trie_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, convtrie.op13(spark, data).collect())) == trie(rows)


# 1, against its definition
def test_toxicity_score_is_the_explicit_sum_over_pairs():
    from busloom.llm import toxicity

    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(1 << toxicity.BITS, 40, replace=False))
    model = toxicity.Model(-0.3, terms, rng.normal(size=40), rng.normal(0, 0.3, (40, 5)))
    slots = model.slots()
    for n in (0, 1, 2, 7, 40):
        own = rng.choice(40, n, replace=False)
        z = model.bias + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        assert model.score(slots, np.concatenate([terms[own], [int(terms[0]) ^ 1]]).astype(np.int32) if int(terms[0]) ^ 1 not in set(terms.tolist()) else terms[own].astype(np.int32)) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_query_columns_and_the_edge_at_a_half(spark, data, monkeypatch):
    from busloom.llm import toxicity

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = toxicity.op1(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.Model(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, toxicity.FACTORS))))
    assert {(r.score, r.predicted) for r in toxicity.op1(spark, data).collect()} == {(0.5, 1)}


def test_toxicity_fit_follows_finite_differences():
    from busloom.llm import toxicity

    rng = np.random.default_rng(4)
    n, terms, k = 30, 6, 3
    has = rng.random((n, terms)) < 0.5
    row, col = np.nonzero(has)
    y, w, v = rng.integers(0, 2, n).astype(float), rng.normal(size=terms), rng.normal(0, 0.5, (terms, k))
    shrink = min(5e-4, 1.5 / n)

    def loss(bias, w, v):
        z = bias + np.array([sum(w[i] for i in own) + sum(v[i] @ v[j] for a, i in enumerate(own) for j in own[a + 1 :]) for own in map(np.flatnonzero, has)])
        return np.mean(np.logaddexp(0, -z * (2 * y - 1))) + 1e-5 * (w**2).sum() + shrink / 2 * (v**2).sum()

    bias, w1, v1, p = toxicity._adam(row, col, y, 0.2, w, v, 1)  # the first step goes 0.05 against the gradient's sign
    off, checked = 1e-6, 0
    for before, after, vary in ((w, w1, lambda d: loss(0.2, w + d, v)), (v, v1, lambda d: loss(0.2, w, v + d)), (np.array(0.2), np.array(bias), lambda d: loss(0.2 + d, w, v))):
        for at in np.ndindex(before.shape):
            d = np.zeros(before.shape)
            d[at] = off
            slope = (vary(d) - vary(-d)) / (2 * off)
            if abs(slope) > 1e-5:
                checked += 1
                assert after[at] - before[at] == pytest.approx(-0.05 * np.sign(slope), rel=1e-2)
    assert checked > 20
