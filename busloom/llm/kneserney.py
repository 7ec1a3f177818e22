"""Perplexity under an interpolated modified Kneser-Ney model of triples, counted in Spark and kept as sorted hash arrays."""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace
from busloom.llm.hashing import WordHasher, mixed
from busloom.llm.toxicity import remainder
from busloom.llm.wordpieces import Output, filesystem

#: Hashes of the beginning and the end of a text; words are hashed from their bytes, which hold neither.
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B27D4EB2F)
#: Tokens a task counts before it sends them on; text bytes counted in one bucket, about; least number of buckets.
CHUNK_TOKENS, BUCKET_BYTES, MIN_BUCKETS = 1_500_000, 16 << 20, 64
#: Triples that a merging task holds before it adds them up; tokens scored at once.
MERGE_ROWS, SCORE_TOKENS = 1_500_000, 300_000
#: The most frequent words have two-byte codes while triples are moved; a word's least count in a chunk to be one of them.
CODES, LEAST_COUNT = 65_535, 8
#: Bits of a local word number; a chunk has fewer distinct words than that gives.
_LOCAL = 21
#: Buckets held in memory where the model's folder can't be mapped.
HELD = 8


def tokens(text: str | None, hasher: WordHasher) -> np.ndarray:
    """Hashes of the text's words, A-Z lowered, and of its end. A null text is empty."""
    words = (text or "").encode(errors="replace").lower().split()  # bytes.split: exactly 0x20 and 0x09-0x0D
    return np.append(hasher(words), END)


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them), in no order."""
    at, distinct = pd.factorize(x)
    return distinct, at


def first_places(at: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    out[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    return out


def triples_of(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last but one, last, word) of every token of texts; what lies before a text is BEGIN."""
    words = np.concatenate(found)
    starts = np.concatenate(([0], np.cumsum([len(f) for f in found])[:-1]))
    out = [words]
    for _ in range(2):
        before = np.empty_like(words)
        before[1:] = out[-1][:-1]
        before[starts] = BEGIN
        out.append(before)
    return out[2], out[1], out[0]


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v + np.uint64(0x9E3779B97F4A7C15)) + w)


def triple_hash(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(pair + np.uint64(0x632BE59BD9B4E019)) + w)


def bucket_of(pair: np.ndarray, v: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of triples by their middle word v; by their first two where v is heavy (sorted hashes), for balance only."""
    return (np.where(_is_in(v, heavy), pair, mixed(v)) % np.uint64(buckets)).astype(np.int64)


def _is_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), dtype=bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _pack_counts(n: np.ndarray) -> bytes:
    """One byte a count; 255 stands for those in the list that follows."""
    small = np.minimum(n, 255).astype(np.uint8)
    return small.tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpack_counts(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    big = int((out == 255).sum())
    out[out == 255] = np.frombuffer(data, "<i8", big, n)
    return out, data[n + 8 * big :]


def pack(levels: list[np.ndarray], counts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> bytes:
    """Rows of word numbers, sorted by the levels in turn, with counts. A level repeats no number that the row before has.

    Words are written as codes; those without one (CODES) as hashes behind them.
    """

    def column(ids: np.ndarray) -> bytes:
        c = codes[ids]
        return c.astype("<u2").tobytes() + words[ids[c == CODES]].astype("<u8").tobytes()

    out, new = [np.array([len(counts)], dtype="<u4").tobytes()], np.zeros(len(counts), dtype=bool)
    new[:1] = True
    for ids in levels[:-1]:
        new[1:] |= ids[1:] != ids[:-1]
        first = np.flatnonzero(new)
        out += [np.array([len(first)], dtype="<u4").tobytes(), _pack_counts(np.diff(np.append(first, len(ids)))), column(ids[first])]
    return zstandard.compress(b"".join([*out, column(levels[-1]), _pack_counts(counts)]), 3)


def unpack(data: bytes, levels: int, top: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels as hashes, and the counts. top: the words of the codes."""
    view = memoryview(zstandard.decompress(data))

    def column(n: int) -> np.ndarray:
        nonlocal view
        c = np.frombuffer(view, "<u2", n)
        rare = np.flatnonzero(c == CODES)
        out = top[np.minimum(c, max(len(top) - 1, 0))] if len(top) else np.zeros(n, dtype=np.uint64)
        out[rare] = np.frombuffer(view, "<u8", len(rare), 2 * n)
        view = view[2 * n + 8 * len(rare) :]
        return out

    n = int(np.frombuffer(view, "<u4", 1)[0])
    view, out = view[4:], []
    for _ in range(levels - 1):
        m = int(np.frombuffer(view, "<u4", 1)[0])
        sizes, view = _unpack_counts(view[4:], m)
        out.append(np.repeat(column(m), sizes))
    out.append(column(n))
    return out, _unpack_counts(view, n)[0]


def _codes(words: np.ndarray, top: np.ndarray, by_hash: np.ndarray) -> np.ndarray:
    """The codes of words: places in top, CODES for others. by_hash sorts top."""
    if not len(top):
        return np.full(len(words), CODES, dtype=np.int64)
    at = by_hash[np.minimum(np.searchsorted(top[by_hash], words), len(top) - 1)]
    return np.where(top[at] == words, at, CODES)


def _local_counts(texts: DataFrame) -> DataFrame:
    """(key, n): each chunk's words that it has LEAST_COUNT times or more, and BEGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LEAST_COUNT
            words, n = np.append(words[keep], BEGIN), np.append(n[keep], len(held))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(tokens(t.as_py(), hasher))
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "key long, n long")


def _count(docs: DataFrame, buckets: int, top: np.ndarray, heavy: np.ndarray) -> DataFrame:
    """(bucket, data): the triples of the training texts, counted within each task."""
    shared = docs.sparkSession.sparkContext.broadcast((top, np.argsort(top), heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, by_hash, heavy = shared.value
        hasher, held, size = WordHasher(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held)
            starts = np.concatenate(([0], np.cumsum([len(f) for f in held])))[:-1]
            held.clear()
            for low in range(0, len(whole), CHUNK_TOKENS):
                part = starts[(starts >= low) & (starts < low + CHUNK_TOKENS)] - low
                before = [BEGIN if at < 0 or np.searchsorted(starts, at, "right") != np.searchsorted(starts, low, "right") else whole[at] for at in (low - 1, low - 2)]
                words, at = distinct_of(np.concatenate([whole[low : low + CHUNK_TOKENS], np.array([BEGIN, *before], dtype=np.uint64)]))
                w, begin = at[:-3], at[-3]
                v = np.append(at[-2], w[:-1])
                v[part] = begin
                u = np.append(at[-1], v[:-1])
                u[part] = begin
                key, n = np.unique(v.astype(np.int64) << 2 * _LOCAL | u.astype(np.int64) << _LOCAL | w, return_counts=True)
                mask = (1 << _LOCAL) - 1
                levels = [key >> 2 * _LOCAL, key >> _LOCAL & mask, key & mask]
                bucket = bucket_of(pair_hash(words[levels[1]], words[levels[0]]), words[levels[0]], heavy, buckets)
                order = np.argsort(bucket, kind="stable")
                levels, n = [x[order] for x in levels], n[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                codes = _codes(words, top, by_hash)
                some = np.flatnonzero(np.diff(cuts))
                data = [pack([x[cuts[b] : cuts[b + 1]] for x in levels], n[cuts[b] : cuts[b + 1]], words, codes) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for t in batch.column(0):
                held.append(tokens(t.as_py(), hasher))
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, data binary")


def sorted_keys(h: np.ndarray, kind: np.ndarray, more: list[np.ndarray]) -> bytes:
    """A sorted hash array: an index by a hash's first bits, and for each hash its next 30 bits with its kind (0 to 3) in four bytes.

    more: columns of the hashes of kind 3. Two hashes are told apart by all bits but about 18: at most 64 hashes share an index entry, on average.
    """
    n = len(h)
    bits = max(0, n.bit_length() - 5)
    slot = h >> np.uint64(64 - bits) if bits else np.zeros(n, dtype=np.uint64)
    index = np.searchsorted(slot, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4")
    data = ((h << np.uint64(bits)) >> np.uint64(34)).astype(np.uint32) << np.uint32(2) | kind.astype(np.uint32)
    big = np.flatnonzero(kind == 3).astype("<u4")
    width = "<u4" if all(int(x.max(initial=0)) < 1 << 32 for x in more) else "<u8"
    head = np.array([n, bits, len(big), len(more), int(width[-1])], dtype="<u8")
    return b"".join([head.tobytes(), index.tobytes(), data.astype("<u4").tobytes(), big.tobytes(), *(x.astype(width).tobytes() for x in more)])


class SortedKeys:
    """Reads a sorted_keys array, mapped or held."""

    def __init__(self, data: np.ndarray):
        self.n, self.bits, m, columns, width = (int(x) for x in data[:40].view("<u8"))
        place = 40

        def part(count: int, size: int = 4) -> np.ndarray:
            nonlocal place
            place += count * size
            return data[place - count * size : place].view(f"<u{size}")

        self.index, self.data, self.big = part((1 << self.bits) + 1), part(self.n), part(m)
        self.more = [part(m, width) for _ in range(columns)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind, place among those of kind 3) of hashes; kind -1: not there."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), dtype=np.int64)
        rest = ((h << np.uint64(self.bits)) >> np.uint64(34)).astype(np.uint32)
        low, end = self.index[slot].astype(np.int64), self.index[slot + 1].astype(np.int64)
        high = end.copy()
        for _ in range(int((end - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (low < high) & (self.data[np.minimum(mid, self.n - 1)] >> np.uint32(2) < rest)
            low, high = np.where(less, mid + 1, low), np.where(less, high, np.where(low < high, mid, high))
        at = self.data[np.minimum(low, max(self.n - 1, 0))] if self.n else np.zeros(len(h), dtype=np.uint32)
        there = (low < end) & (at >> np.uint32(2) == rest)
        return np.where(there, (at & np.uint32(3)).astype(np.int64), -1), np.searchsorted(self.big, low)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of an array of counts: kinds 0 to 2 are counts of 1 to 3."""
        kind, at = self.find(h)
        out, big = kind + 1, np.flatnonzero(kind == 3)
        out[big] = self.more[0][at[big]]
        return out

    def contexts(self, h: np.ndarray) -> np.ndarray:
        """Of an array of contexts: (total, followers seen once, twice, more often), zeros where missing."""
        kind, at = self.find(h)
        out = np.array([(1, 1, 0, 0), (2, 2, 0, 0), (2, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0)], dtype=np.int64)[kind].T.copy()
        big = np.flatnonzero(kind == 3)
        for column, values in zip(out, self.more, strict=True):
            column[big] = values[at[big]]
        return out


def _count_keys(h: np.ndarray, n: np.ndarray) -> bytes:
    return sorted_keys(h, np.minimum(n, 4) - 1, [n[n >= 4]])


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys with their sum of counts and their numbers of counts of 1, 2 and more."""
    distinct, at = distinct_of(keys)
    order = np.argsort(distinct)
    add = lambda x: np.bincount(at, weights=x, minlength=len(distinct)).astype(np.int64)[order]
    return distinct[order], [add(counts), add(counts == 1), add(counts == 2), add(counts >= 3)]


def _context_keys(pair: np.ndarray, n: np.ndarray) -> bytes:
    distinct, (total, ones, twos, more) = _grouped(pair, n)
    kind = np.full(len(distinct), 3)
    kind[(total == 1) & (ones == 1)] = 0
    kind[(total == 2) & (ones == 2)] = 1
    kind[(total == 2) & (twos == 1)] = 2
    return sorted_keys(distinct, kind, [x[kind == 3] for x in (total, ones, twos, more)])


_ROW = {"kind": pa.string(), "key": pa.int64(), "file": pa.string(), "data": pa.binary(), **{f"v{i}": pa.int64() for i in range(1, 7)}}
_ROWS = "kind string, key long, file string, data binary, " + ", ".join(f"v{i} long" for i in range(1, 7))


def _rows(kind: str, keys: np.ndarray, values: list[np.ndarray] = (), file: str | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(keys)
    values = [*values, *[np.zeros(n, dtype=np.int64)] * (6 - len(values))]
    columns = [[kind] * n, keys.astype(np.uint64).view(np.int64), [file] * n, data or [None] * n, *(v.astype(np.int64) for v in values)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.values(), strict=True)], names=list(_ROW))


def _word_rows(v: np.ndarray, w: np.ndarray, s: np.ndarray, words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of pairs (v, w) with s distinct words before them, and of words seen n times: rows 'word' of
    (times, distinct words before it, and as a context the pairs' sum of s, pairs of s 1, 2 and more)."""
    keys, at = distinct_of(np.concatenate([w, v, words]))
    as_word, as_context, seen = at[: len(w)], at[len(w) : len(w) + len(v)], at[len(w) + len(v) :]
    add = lambda i, x=None: np.bincount(i, weights=x, minlength=len(keys))
    values = [add(seen, n), add(as_word), add(as_context, s), add(as_context, s == 1), add(as_context, s == 2), add(as_context, s >= 3)]
    for a in range(0, len(keys), 100_000):
        yield _rows("word", keys[a : a + 100_000], [x[a : a + 100_000] for x in values])


def _by_key(batches: Iterator[pa.RecordBatch], add, done) -> Iterator[pa.RecordBatch]:
    """Feeds add(key, data) with rows sorted by key, and yields from done(key) after each key's last."""
    now = None
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now is not None and key != now:
                yield from done(now)
            now = key
            add(key, data.as_py())
    if now is not None:
        yield from done(now)


class _Sums:
    """Adds up packed rows; what is held stays about twice the distinct ones."""

    def __init__(self, levels: int, top: np.ndarray):
        self.levels, self.top, self.parts, self.held, self.limit = levels, top, [], 0, MERGE_ROWS

    def add(self, data: bytes) -> None:
        columns, n = unpack(data, self.levels, self.top)
        self.parts.append([*columns, n])
        self.held += len(n)
        if self.held > self.limit:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])
            self.limit = max(MERGE_ROWS, 2 * self.held)

    def total(self) -> list[np.ndarray]:
        """hash-sorted distinct rows: levels, then counts, then the hash."""
        columns = [np.concatenate([p[i] for p in self.parts]) for i in range(self.levels + 1)]
        h = pair_hash(columns[1], columns[0]) if self.levels == 3 else pair_hash(columns[0], columns[1])
        if self.levels == 3:  # levels are v, u, w
            h = triple_hash(h, columns[2])
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        at = order[first]
        return [*(c[at] for c in columns[:-1]), np.add.reduceat(columns[-1][order], first), h[first]]

    def take(self) -> list[np.ndarray]:
        out, self.parts, self.held, self.limit = self.total(), [], 0, MERGE_ROWS
        return out


def _merge(parts: DataFrame, buckets: int, top: np.ndarray, heavy: np.ndarray, folder: str) -> DataFrame:
    """Adds up each bucket's triples and writes three sorted hash arrays: triples, pairs as contexts, pairs by their ends.

    Rows: 'file' names a bucket's file, 'sizes' and 'ends' have the numbers of triples, and of pairs' distinct words before
    them, of 1 to 4; 'word' see _word_rows. A heavy middle word's pairs by their ends are spread over the buckets: 'heavy'
    has them, packed, for a bucket of pairs.
    """
    shared = parts.sparkSession.sparkContext.broadcast((top, np.argsort(top), heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, by_hash, heavy = shared.value
        sums = _Sums(3, top)

        def done(bucket: int) -> Iterator[pa.RecordBatch]:
            v, u, w, n, h = sums.take()
            out = Output(f"{folder}/{(name := f'triples-{bucket}-{uuid.uuid4().hex}')}")
            ends = pair_hash(v, w)
            e, at = distinct_of(ends)
            first, s = first_places(at, len(e)), np.bincount(at)
            order = np.argsort(e)
            e, first, s = e[order], first[order], s[order]
            ev, ew = v[first], w[first]
            spread = _is_in(ev, heavy)
            sections = [_count_keys(h, n), _context_keys(pair_hash(u, v), n), _count_keys(e[~spread], s[~spread])]
            out.write(np.array([len(x) for x in sections], dtype="<u8").tobytes() + b"".join(sections))
            out.close()
            yield _rows("file", np.array([bucket]), file=name)
            yield _rows("sizes", np.array([bucket]), [np.array([(n == c).sum()]) for c in (1, 2, 3, 4)])
            yield _rows("ends", np.array([bucket]), [np.array([(s[~spread] == c).sum()]) for c in (1, 2, 3, 4)])
            yield from _word_rows(ev[~spread], ew[~spread], s[~spread], w, n)
            if spread.any():
                e, s = e[spread], s[spread]
                words, at = np.unique(np.concatenate([ev[spread], ew[spread]]), return_inverse=True)
                v, w = at.reshape(2, -1)
                bucket2 = (e % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((w, v, bucket2))
                v, w, s = v[order], w[order], s[order]
                cuts, codes = np.searchsorted(bucket2[order], np.arange(buckets + 1)), _codes(words, top, by_hash)
                some = np.flatnonzero(np.diff(cuts))
                yield _rows("heavy", some, data=[pack([v[cuts[b] : cuts[b + 1]], w[cuts[b] : cuts[b + 1]]], s[cuts[b] : cuts[b + 1]], words, codes) for b in some])

        yield from _by_key(batches, lambda _, data: sums.add(data), done)

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROWS)


def _merge_heavy(parts: DataFrame, top: np.ndarray, folder: str) -> DataFrame:
    """Adds up the pairs (key, data) of heavy words by their ends and writes an array for each key. Rows as _merge's."""
    shared = parts.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(2, shared.value)

        def done(bucket: int) -> Iterator[pa.RecordBatch]:
            v, w, s, h = sums.take()
            out = Output(f"{folder}/{(name := f'ends-{bucket}-{uuid.uuid4().hex}')}")
            out.write(_count_keys(h, s))
            out.close()
            yield _rows("heavy-file", np.array([bucket]), file=name)
            yield _rows("ends", np.array([bucket]), [np.array([(s == c).sum()]) for c in (1, 2, 3, 4)])
            yield from _word_rows(v, w, s, w[:0], s[:0])

        yield from _by_key(batches, lambda _, data: sums.add(data), done)

    return parts.select("key", "data").repartition("key").sortWithinPartitions("key").mapInArrow(run, _ROWS)


#: A word's columns: times, share of probability without context, sum as a context, share left to the lower order.
WORD_COLUMNS = (("n", "<f8"), ("lower", "<f4"), ("total", "<f8"), ("left", "<f4"))


def _write_words(rows: DataFrame, shards: int, folder: str) -> DataFrame:
    """Writes words as sorted arrays, sharded by their hash: first those seen once, which have the same values, as keys alone. Rows: shard, file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table["key"].to_numpy().view(np.uint64)
            once = table["once"].to_numpy()
            order = np.argsort(keys)
            rest = order[~once[order]]
            out = Output(f"{folder}/{(name := f'words-{now}-{uuid.uuid4().hex}')}")
            out.write(np.array([once.sum(), len(rest)], dtype="<u8").tobytes() + keys[order[once[order]]].astype("<u8").tobytes() + keys[rest].astype("<u8").tobytes())
            for c, kind in WORD_COLUMNS:
                out.write(table[c].to_numpy()[rest].astype(kind).tobytes())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name], pa.string())], names=["shard", "file"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    yield done()
                    held = []
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    sharded = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))  # keys are hashes
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, file string")


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's D1, D2, D3+ from the numbers of entries seen one to four times; 0.5, 1, 1.5 where those give none."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(x if 0 < x < k else k / 2 for k, x in enumerate(d, 1))


class Words:
    """Reads a file of _write_words; once: the values of words seen once."""

    def __init__(self, data: np.ndarray, once: list[float]):
        a, b = (int(x) for x in data[:16].view("<u8"))
        self.single, self.keys = data[16 : 16 + 8 * a].view("<u8"), data[16 + 8 * a : 16 + 8 * (a + b)].view("<u8")
        self.once, place, self.columns = once, 16 + 8 * (a + b), []
        for _, kind in WORD_COLUMNS:
            size = int(kind[-1]) * b
            self.columns.append(data[place : place + size].view(kind))
            place += size

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(WORD_COLUMNS), len(keys)))
        out[:, _is_in(keys, self.single)] = np.array(self.once)[:, None]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            for row, column in zip(out, self.columns, strict=True):
                row[found] = column[at[found]]
        return out


class Model:
    """Scores texts with a model written by train(). Files are memory-mapped where the folder is mounted; elsewhere HELD of them are held."""

    def __init__(self, spec: dict):
        self.spec, self.opened = spec, OrderedDict()
        self.heavy = np.array(spec["heavy"], dtype=np.uint64)
        self.fs, self.root = filesystem(spec["folder"])

    def _open(self, name: str, make):
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name]
        path = f"{self.root}/{name}"
        if os.path.exists(path):
            data = np.memmap(path, dtype=np.uint8, mode="r")
        else:
            with self.fs.open_input_stream(path) as f:
                data = np.frombuffer(f.read(), dtype=np.uint8)
            while len(self.opened) >= HELD:
                self.opened.popitem(last=False)
        self.opened[name] = make(data)
        return self.opened[name]

    @staticmethod
    def _sections(data: np.ndarray) -> list[SortedKeys]:
        cuts = 24 + np.concatenate(([0], np.cumsum(data[:24].view("<u8")))).astype(np.int64)
        return [SortedKeys(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _lookup(self, kind: str, keys: np.ndarray, shards: np.ndarray, width: int, make, read) -> np.ndarray:
        """read(opened, keys) of distinct keys by their files, zeros where there is none."""
        out, files = np.zeros((width, len(keys))), self.spec[kind]
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(len(files) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if files[s] is not None:
                some = order[cuts[s] : cuts[s + 1]]
                out[:, some] = read(self._open(files[s], make), keys[some])
        return out

    def score(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, log10 probability) of each text, given its tokens' hashes."""
        s, buckets = self.spec, len(self.spec["triples"])
        u, v, w = triples_of(found)
        starts = np.concatenate(([0], np.cumsum([len(f) for f in found])[:-1]))
        distinct, at = distinct_of(np.append(w, BEGIN))
        shards = (distinct.view(np.int64) % len(s["words"])).astype(np.int64)
        n, lower, total1, left1 = self._lookup("words", distinct, shards, 4, lambda d: Words(d, s["once"]), lambda f, k: f(k))
        base = np.log10((n + 0.5) / (s["tokens"] + 0.5 * (s["types"] + 1)))
        before = np.append(at[-1], at[:-2])  # of v
        before[starts] = at[-1]
        at = at[:-1]
        # pairs by their ends, and as contexts: a context is the pair that ended a token before
        ends = pair_hash(v, w)
        first_context = pair_hash(BEGIN[None], BEGIN[None])
        distinct, back = distinct_of(np.append(ends, first_context))
        first = first_places(back, len(distinct))
        pv, pw = np.append(v, BEGIN)[first], np.append(w, BEGIN)[first]
        context = np.append(back[-1], back[:-2])
        context[starts] = back[-1]
        spread = _is_in(pv, self.heavy)
        by_v = bucket_of(distinct, pv, self.heavy[:0], buckets)
        kinds = np.zeros(len(distinct))
        plain = np.flatnonzero(~spread)
        kinds[plain] = self._lookup("triples", distinct[plain], by_v[plain], 1, self._sections, lambda f, k: f[2].counts(k)[None])[0]
        if spread.any():
            some = np.flatnonzero(spread)
            kinds[some] = self._lookup("ends", distinct[some], (distinct[some] % np.uint64(buckets)).astype(np.int64), 1, SortedKeys, lambda f, k: f.counts(k)[None])[0]
        by_context = bucket_of(distinct, pw, self.heavy, buckets)
        total2, ones, twos, more = self._lookup("triples", distinct, by_context, 4, self._sections, lambda f, k: f[1].contexts(k))
        d = s["discounts"]
        left2 = (d[0] * ones + d[1] * twos + d[2] * more) / np.maximum(total2, 1)
        h = triple_hash(distinct[context], w)
        threes, back3 = distinct_of(h)
        first3 = first_places(back3, len(threes))
        counts = self._lookup("triples", threes, by_context[context[first3]], 1, self._sections, lambda f, k: f[0].counts(k)[None])[0][back3]
        cut = lambda c, by: np.array([0.0, *by])[np.minimum(c, 3).astype(np.int64)]
        p = lower[at] + s["unseen"]
        pair = kinds[back[:-1]]
        p = np.where(total1[before] > 0, (pair - cut(pair, s["end_discounts"])) / np.maximum(total1[before], 1) + left1[before] * p, p)
        p = np.where(total2[context] > 0, (counts - cut(counts, d)) / np.maximum(total2[context], 1) + left2[context] * p, p)
        add = lambda x: np.add.reduceat(x, starts)
        return add((n[at] > 0).astype(np.int64)), add(base[at]), add(np.log10(p))


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Counts the texts' words, pairs and triples, all of them, and writes the model. Returns its description.

    With c the times a triple occurs, s(vw) the distinct words before a pair, k(w) those before a word, and modified
    Kneser-Ney's discounts D, E, F of each: p(w | uv) = (c - D(c)) / c(uv.) + left(uv) p(w | v), p(w | v) = (s - E(s)) / s(v.) +
    left(v) p(w), p(w) = (k - F(k)) / k(.) + what is left of the mass, spread evenly over the vocabulary and one unseen word.
    An unseen context leaves all to the lower order. Two BEGIN come before a text. Texts that are null or empty are one
    end each; an empty table gives a model that knows nothing. Words are 64-bit hashes: among n distinct words about
    n * n / 2**65 pairs are expected to be taken for one; pairs and triples are kept by 46 bits within a bucket of
    bounded size, so that one in about 10**7 that were never seen may be taken for a seen one.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, math.ceil(size / BUCKET_BYTES))
    frequent = _local_counts(texts).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(CODES).toArrow()
    top, n = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    heavy = np.sort(top[n > max(2.0, n.sum() / buckets)])
    merged = staged(_merge(_count(texts, buckets, top, heavy), buckets, top, heavy, f"{folder}/arrays"), "merged", folder)
    spread = staged(_merge_heavy(merged.where("kind = 'heavy'"), top, f"{folder}/arrays"), "heavy", folder)
    both = merged.unionByName(spread)
    names = {(r["kind"], r["key"]): r["file"] for r in both.where("kind IN ('file', 'heavy-file')").select("kind", "key", "file").collect()}  # two rows a bucket
    sizes = {r["kind"]: [int(r[f"v{i}"]) for i in range(1, 5)] for r in both.where("kind IN ('sizes', 'ends')").groupBy("kind").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(1, 5)]).collect()}
    d, e = (discounts(sizes.get(kind, [0] * 4)) for kind in ("sizes", "ends"))
    sums = [F.sum(f"v{i}").alias(c) for i, c in enumerate(("n", "kinds", "total", "ones", "twos", "more"), 1)]
    words = staged(both.where("kind = 'word'").groupBy("key").agg(*sums), "words", folder)
    known = F.col("n") > 0  # BEGIN is a context alone
    stats = words.agg(F.count(F.when(known, 1)), F.sum("n"), F.sum("kinds"), *[F.count(F.when(F.col("kinds") == i, 1)) for i in (1, 2, 3, 4)]).first()
    types, tokens_, kinds = int(stats[0]), int(stats[1] or 0), int(stats[2] or 0)
    f = discounts([int(x) for x in stats[3:7]])
    ones, twos = int(stats[3]), int(stats[4])
    rest = (f[0] * ones + f[1] * twos + f[2] * (types - ones - twos)) / kinds if kinds else 1.0
    cut = F.when(F.col("kinds") == 0, 0.0).when(F.col("kinds") == 1, f[0]).when(F.col("kinds") == 2, f[1]).otherwise(f[2])
    left = (F.col("ones") * e[0] + F.col("twos") * e[1] + F.col("more") * e[2]) / F.greatest("total", F.lit(1))
    once = (F.col("n") == 1) & (F.col("kinds") == 1) & (F.col("total") == 1) & (F.col("ones") == 1)
    table = words.select("key", F.col("n").cast("double").alias("n"), ((F.col("kinds") - cut) / float(max(kinds, 1))).alias("lower"), F.col("total").cast("double").alias("total"), left.alias("left"), once.alias("once"))
    shards = max(8, buckets // 4)
    word_files = {r["shard"]: r["file"] for r in staged(_write_words(table, shards, f"{folder}/arrays"), "word-files", folder).collect()}  # a row a shard
    return {
        "folder": f"{folder}/arrays",
        "heavy": [int(x) for x in heavy],
        "triples": [names.get(("file", i)) for i in range(buckets)],
        "ends": [names.get(("heavy-file", i)) for i in range(buckets)],
        "words": [word_files.get(i) for i in range(shards)],
        "discounts": list(d),
        "end_discounts": list(e),
        "once": [1.0, (1 - f[0]) / max(kinds, 1), 1.0, e[0]],
        "unseen": rest / (types + 1),
        "tokens": tokens_,
        "types": types,
    }


def scored(docs: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to each row's other columns. Whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(json.dumps(spec).encode()))
    rest = [c for c in docs.columns if c != text_col]
    shape = docs.select(*rest, *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = Model(json.loads(zlib.decompress(shared.value))), WordHasher()
        for batch in batches:
            a, held, size = 0, [], 0
            for i, t in enumerate(batch.column(text_col)):
                held.append(tokens(t.as_py(), hasher))
                size += len(held[-1])
                if size >= SCORE_TOKENS or i + 1 == batch.num_rows:
                    known, base, score = model.score(held)
                    columns = [batch.column(c).slice(a, len(held)) for c in rest]
                    numbers = [pa.array([len(h) for h in held], pa.int64()), pa.array(known.astype(np.int64)), pa.array([model.spec["tokens"]] * len(held), pa.int64()), pa.array(base), pa.array(score)]
                    yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*rest, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    a, held, size = i + 1, [], 0

    return docs.select(*rest, text_col).mapInArrow(run, shape)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spec = train(docs.where(remainder("doc_id") != 1).select("text"))
    return scored(docs.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "text"), spec)
