"""BPE encoding by a trie of words: a prefix that many words share is encoded once."""

from __future__ import annotations

import functools
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from busloom.llm.bytepair import FLUSH_BYTES, RUN, _groups, _lists, splitters
from busloom.llm.common import extended, with_column

#: Nodes after which a worker's trie starts afresh; a word of more bytes has a path of its own, outside the trie.
TRIE_NODES, LONG = 400_000, 256
#: Words and pairs of tokens that a worker remembers before it starts afresh.
MEMO_WORDS, MEMO_PAIRS = 300_000, 400_000


def byte_of_char() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others, in order, for those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE tokenizer, described as in the tokenizers library's file: tokens as bytes, ranks of merges, added tokens."""

    def __init__(self, description: str):
        described = json.loads(description)
        model, split = described["model"], described["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if described.get(k)]
        odd += [] if split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] else ["pre_tokenizer"]
        odd += [t["content"] for t in described["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"no plain byte-level BPE: {odd}")
        chars = byte_of_char()
        self.ids = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items()}
        self.merges: dict[int, int] = {}  # left << 32 | right -> rank << 32 | result
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(chars[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            self.merges.setdefault(self.ids[left] << 32 | self.ids[right], rank << 32 | self.ids[left + right])
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}


class TrieEncoder:
    """Encodes words (pre-tokens) by their prefixes.

    BPE's encoding of a prefix is its encoding without the last token, and that token; a sequence is BPE's encoding exactly if
    every two neighbours are (adjacent). So a node of the trie, a prefix, needs two things alone: the last token, and
    the node before it. The last token is the one that ends here, starts at a node already known and is adjacent to that
    node's last token; there is exactly one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.ids))
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self._bare()

    def _bare(self) -> None:
        """The trie with its root alone. A child is found by node * 256 + byte."""
        self.children: dict[int, int] = {}
        self.last, self.before = array("i", [-1]), array("i", [-1])

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Whether BPE, by its definition, merges all of left and all of right and never across: the merge of least rank, leftmost first."""
        get = self.v.merges.get
        ids = [self.v.ids[bytes([b])] for b in left + right]
        edge = len(left)  # tokens on the left
        while True:
            least, at = 1 << 63, -1
            for i in range(len(ids) - 1):
                merge = get(ids[i] << 32 | ids[i + 1])
                if merge is not None and merge < least:
                    least, at = merge, i
            if at < 0:
                return len(ids) == (2 if left else 1)
            if left and at == edge - 1:
                return False
            edge -= at < edge - 1
            ids[at : at + 2] = [least & 0xFFFFFFFF]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE makes just these two tokens of their joined bytes; left -1 is a word's start: whether it makes right of its bytes."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            tokens = self.v.tokens
            known = self.pairs[key] = key not in self.v.merges and self._stays(b"" if left < 0 else tokens[left], tokens[right])
        return known

    def _end(self, word: bytes, end: int, path, last) -> tuple[int, int]:
        """The last token of word[:end] and where it begins; last[path[i]] is the last token of word[:i]."""
        get, pairs = self.v.ids.get, self.pairs
        for begin in range(max(0, end - self.longest), end):
            token = get(word[begin:end])
            if token is not None:
                before = last[path[begin]]
                known = pairs.get(before << 32 | token)
                if known or known is None and self.adjacent(before, token):
                    return token, begin
        raise ValueError("the vocabulary has no token for a byte")

    def _insert(self, words: list[bytes]) -> list[int]:
        """The words' nodes. Words come in order, so each is a step of a depth-first walk: the path shared with the one before it
        stays, and states are handed on along what is new."""
        path, nodes, prior = [0], [], b""
        children, last, before = self.children, self.last, self.before
        for word in words:
            shared = 0
            for a, b in zip(prior, word, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            node = path[-1]
            for depth in range(shared, len(word)):
                step = node << 8 | word[depth]
                node = children.get(step)
                if node is None:
                    token, begin = self._end(word, depth + 1, path, last)
                    node = children[step] = len(last)
                    last.append(token)
                    before.append(path[begin])
                path.append(node)
            nodes.append(node)
            prior = word
        return nodes

    def _alone(self, word: bytes) -> list[int]:
        """Ids of one long word, along a path of its own."""
        last, begins, path = array("i", [-1]), array("q", [0]), range(len(word) + 1)
        for end in range(1, len(word) + 1):
            token, begin = self._end(word, end, path, last)
            last.append(token)
            begins.append(begin)
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at = begins[at]
        return ids[::-1]

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of distinct words into the memo; where it would grow too large, it starts with these alone."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        if len(self.last) > TRIE_NODES:
            self._bare()
        by_bytes = sorted((w.encode(), w) for w in new)
        short = [(b, w) for b, w in by_bytes if len(b) <= LONG]
        for (_, word), node in zip(short, self._insert([b for b, _ in short]), strict=True):
            ids = array("i")
            while node:
                ids.append(self.last[node])
                node = self.before[node]
            ids.reverse()
            self.memo[word] = ids.tobytes()
        for b, word in by_bytes:
            if len(b) > LONG:
                self.memo[word] = array("i", self._alone(b)).tobytes()

    def encode(self, runs: list[list[str]]) -> list[bytes]:
        """The ids of each run of words, packed. All runs' words are put into the trie together."""
        self._learn(set(itertools.chain.from_iterable(runs)))
        return [b"".join(map(self.memo.__getitem__, run)) for run in runs]


class TextEncoder:
    """Whole texts: cut at added tokens, then into words by the vocabulary's pattern, then by the trie.

    The pattern's classes of characters hang on the Unicode version, so the library itself cuts texts with characters
    outside the Latin blocks and general punctuation.
    """

    def __init__(self, description: str, pattern: str):
        import re

        from tokenizers import Tokenizer

        vocabulary = Vocabulary(description)
        self.trie, self.added = TrieEncoder(vocabulary), vocabulary.added
        self.cutter, self.far = Tokenizer.from_str(description).pre_tokenizer, re.compile("[^\x00-\u024f\u2000-\u205f]")
        self.general, self.ascii = splitters(pattern)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The text's words, up to RUN of them at once."""
        if text.isascii() or not self.far.search(text):
            pattern = self.ascii if text.isascii() else self.general
            if len(text) <= RUN:
                yield pattern.findall(text)
                return
            matches = (m[0] for m in pattern.finditer(text))
        else:
            matches = (text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text))
        while run := list(itertools.islice(matches, RUN)):
            yield run

    def _cut(self, text: str) -> list[str | int]:
        """Added tokens as their ids, and what stands between them."""
        if self.cut is None or not self.cut.search(text):
            return [text]
        return [self.added[p] if i % 2 else p for i, p in enumerate(self.cut.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed. Texts of up to RUN characters share a round of learning."""
        out: list[bytes] = []
        for long, group in itertools.groupby(texts, key=lambda t: len(t) > RUN):
            if long:
                out += [b"".join(self._long(part) for part in self._cut(t)) for t in group]
            else:
                parts = [self._cut(t) for t in group]
                plain = [p for cut in parts for p in cut if isinstance(p, str)]
                runs = iter(self.trie.encode([list(itertools.chain.from_iterable(self._runs(p))) for p in plain]))
                out += [b"".join(next(runs) if isinstance(p, str) else array("i", [p]).tobytes() for p in cut) for cut in parts]
        return out

    def _long(self, part: str | int) -> bytes:
        """One run of words after the other."""
        return array("i", [part]).tobytes() if isinstance(part, int) else b"".join(self.trie.encode([run])[0] for run in self._runs(part))


@functools.lru_cache(maxsize=1)
def _encoder(description: str, pattern: str) -> TextEncoder:
    """A worker's encoder, kept from task to task with its trie."""
    return TextEncoder(description, pattern)


def _described(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """Adds out: array<int>, the ids that the tokenizers library gives the text without special tokens around it, truncation or
    padding; packed, binary instead, the ids as little-endian 32-bit integers.

    vocabulary is the path of a byte-level BPE file, read on the driver; its content, of bounded size (some 50 bytes a token),
    goes to the workers. pattern cuts texts into words. Strings of added tokens in a text become those tokens, as in the
    library. A null or empty text has no ids. text_col and other
    columns stay, a column called out is replaced. Row by row: no shuffle, whole texts; a worker's memory is bounded by
    one text and its ids, TRIE_NODES, MEMO_WORDS and MEMO_PAIRS.
    """
    described = df.sparkSession.sparkContext.broadcast(_described(vocabulary))

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(described.value, pattern)
        for batch in batches:
            for start, texts in _groups(batch.column(at)):
                ids = encoder.encode(texts)
                yield extended([c.slice(start, len(texts)) for c in batch.columns], pa.array(ids, pa.binary()) if packed else _lists(ids))

    return with_column(df, run, BinaryType() if packed else ArrayType(IntegerType()), out, text_col)


@functools.lru_cache(maxsize=1)
def _bytes_of(description: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each id's bytes, and all bytes; length -1 for an id that isn't there."""
    tokens = Vocabulary(description).tokens
    size = max(tokens) + 1
    length = np.array([len(tokens[i]) if i in tokens else -1 for i in range(size)], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(np.maximum(length, 0))[:-1]))
    return begin, length, np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)


def text_of(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray) -> str:
    """The text of the ids by inverse mapping, added tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or length[ids].min() < 0):
        raise ValueError("an id that the vocabulary doesn't have")
    pieces = []
    for at in range(0, len(ids), RUN):
        some = ids[at : at + RUN]
        n = length[some]
        where = np.arange(n.sum()) + np.repeat(begin[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        pieces.append(flat[where].tobytes())
    return b"".join(pieces).decode("utf-8", "replace")


def decoded(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds out: the text of the ids in ids_col (array<int>, or packed), special tokens and all; null ids give the empty text, an
    unknown id is an error.

    Other columns stay, a column called out is replaced.
    """
    described = df.sparkSession.sparkContext.broadcast(_described(vocabulary))

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(described.value)
        for batch in batches:
            lists, start, texts, held = batch.column(at), 0, [], 0
            packed = pa.types.is_binary(lists.type) or pa.types.is_large_binary(lists.type)
            for i in range(batch.num_rows):
                if packed:
                    ids = np.frombuffer(lists[i].as_py() or b"", "<i4")
                else:
                    ids = lists[i].values
                    ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
                texts.append(text_of(ids, *table))
                held += len(texts[-1])
                if held >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    yield extended([c.slice(start, len(texts)) for c in batch.columns], pa.array(texts, pa.string()))
                    start, texts, held = i + 1, [], 0

    return with_column(df, run, StringType(), out, ids_col)


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 50k byte-level tokenizer and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decoded(encoded(docs, path, public_tokenizers.PATTERN, packed=True).drop("text"), path)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
