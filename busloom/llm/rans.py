"""A token-file format of independent interleaved rANS blocks over one shared table of frequencies."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace
from busloom.llm.wordpieces import Output, filesystem, rounds, word_encoder

#: log2 of the sum of the scaled frequencies; interleaved states of a block; steps between checkpoints; those in a block.
SCALE, LANES, STEPS, SEGMENTS = 20, 1024, 256, 4
#: Lower end of a state's range; a state is renormalised by one 32-bit word.
LOW = 1 << 31
MAGIC = b"RANS0001"
#: Bytes of text dealt to one file, about.
FILE_BYTES = 32 << 20


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for what occurs; the largest take up what rounding leaves."""
    counts = np.asarray(counts, dtype=np.float64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << SCALE) / max(1.0, counts.sum())))), 0).astype(np.int64)
    if not freq.any():
        freq[0] = 1 << SCALE
    rest = (1 << SCALE) - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):
        step = rest if rest > 0 else max(rest, 1 - int(freq[i]))
        freq[i] += step
        rest -= step
        if not rest:
            break
    return freq


class Codec:
    """Encodes and decodes blocks of up to LANES * STEPS * SEGMENTS ids with one frequency table.

    Id i of a block is in step i // LANES of lane i % LANES. The steps are encoded from the last to the first, so a
    decoder reads forwards: after each step, the lanes that fell below LOW take the next words, in the lanes' order.
    A checkpoint before each STEPS steps holds all states and the place among the words, so that segments decode
    at the same time, or alone.
    """

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(np.argmax(freq))

    def encode(self, ids: np.ndarray) -> bytes:
        steps = -(-len(ids) // LANES)
        padded = np.full(steps * LANES, self.filler, dtype=np.int64)
        padded[: len(ids)] = ids
        grid = padded.reshape(steps, LANES)
        freq, cum = self.freq[grid], self.cum[grid]
        if not freq.all():
            raise ValueError("an id that the frequency table doesn't have")
        limit = freq << np.uint64(63 - SCALE)
        words, out = np.empty((steps, LANES), dtype=np.uint32), np.empty((steps, LANES), dtype=bool)
        x = np.full(LANES, LOW, dtype=np.uint64)
        states, up, scale = [], np.uint64(32), np.uint64(SCALE)
        for t in range(steps - 1, -1, -1):
            np.greater_equal(x, limit[t], out=out[t])
            words[t] = x  # the low 32 bits
            x = np.where(out[t], x >> up, x)
            q = x // freq[t]
            x = (q << scale) + (x - q * freq[t]) + cum[t]
            if t % STEPS == 0:
                states.append(x)
        places = np.concatenate(([0], np.cumsum(out.sum(axis=1))))[0:steps:STEPS].astype("<u4")
        body = words[out].astype("<u4").tobytes()
        return struct.pack("<II", len(ids), len(places)) + places.tobytes() + b"".join(s.astype("<u8").tobytes() for s in states[::-1]) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the segments first to last (exclusive; None: all)."""
        n, segments = struct.unpack_from("<II", block)
        places = np.frombuffer(block, "<u4", segments, 8).astype(np.int64)
        states = np.frombuffer(block, "<u8", segments * LANES, 8 + 4 * segments).reshape(segments, LANES)
        words = np.frombuffer(block, "<u4", offset=8 + segments * (4 + 8 * LANES))
        last = segments if last is None else last
        x, at = states[first:last].astype(np.uint64), places[first:last].copy()
        steps = -(-n // LANES)
        out = np.zeros((last - first, STEPS, LANES), dtype=np.uint32)
        mask, scale, low, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
        words = np.append(words, np.uint32(0))
        for t in range(STEPS):
            live = min(last - first, max(0, -(-(steps - t - first * STEPS) // STEPS)))  # only the block's last segment is short
            if not live:
                break
            y = x[:live]
            slot = y & mask
            ids = self.slots[slot]
            out[:live, t] = ids
            y = self.freq[ids] * (y >> scale) + slot - self.cum[ids]
            need = y < low
            counted = np.cumsum(need, axis=1)
            word = words[np.minimum(at[:live, None] + counted - 1, len(words) - 1)]
            x[:live] = np.where(need, (y << up) | word, y)
            at[:live] += counted[:, -1]
        flat = out.reshape(-1)
        return flat[: min(n, last * STEPS * LANES) - first * STEPS * LANES]


class Writer:
    """A token file: blocks, then a footer with their places, counts and checksums and the documents' ids and lengths."""

    def __init__(self, uri: str, codec: Codec):
        self.codec, self.out, self.place = codec, Output(uri), 0
        self.pending: list[np.ndarray] = []
        self.held, self.blocks, self.docs = 0, [], []

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        size = LANES * STEPS * SEGMENTS
        if self.held >= size:
            all_ids = np.concatenate(self.pending)
            whole = len(all_ids) // size * size
            for a in range(0, whole, size):
                self._block(all_ids[a : a + size])
            self.pending, self.held = [all_ids[whole:]], len(all_ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = self.codec.encode(ids)
        self.blocks.append((self.place, len(data), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        self.out.write(data)
        self.place += len(data)

    def close(self, docs: list[tuple[int | None, int]]) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        footer = zlib.compress(json.dumps({"blocks": self.blocks, "docs": docs}).encode(), 1)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class Reader:
    def __init__(self, uri: str, codec: Codec):
        fs, path = filesystem(uri)
        self.codec, self.file = codec, fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.file.seek(size - 16 - n)
        footer = json.loads(zlib.decompress(self.file.read(n)))
        self.blocks, self.docs = footer["blocks"], footer["docs"]

    def block(self, k: int) -> np.ndarray:
        place, size, n, crc = self.blocks[k]
        self.file.seek(place)
        ids = self.codec.decode(self.file.read(size))
        if len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids


def _ordered(docs: DataFrame) -> DataFrame:
    """Adds the columns that order rows: known, id, tie (a hash of the text) and salt, which parts equal rows."""
    return docs.withColumns(
        {
            "known": F.col("doc_id").isNotNull(),
            "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "tie": F.xxhash64(F.coalesce("text", F.lit(""))),
            "salt": F.monotonically_increasing_id(),
        }
    )


def _edges(docs: DataFrame, bytes_each: int, folder: str) -> list[np.ndarray]:
    """The first row's order columns of each range: ranges hold about bytes_each of text, whatever the ids.

    Ids and sizes alone are dealt by ranges and summed along; one row a range, which is one for bytes_each of the corpus,
    reaches the driver.
    """
    by = [F.col(c) for c in ("known", "id", "tie", "salt")]
    sizes = _ordered(docs).select(*by, (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size"))
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    dealt = staged(sizes.repartitionByRange(max(parallel, docs.count() // 1_000_000), *by).withColumn("p", F.spark_partition_id()), "sizes", folder)
    sums = dealt.groupBy("p").agg(F.sum("size").alias("n"))
    before = sums.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row a partition
    along = dealt.join(F.broadcast(before), "p").withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("p").orderBy(*by)))
    first = along.groupBy(F.floor((F.col("end") - F.col("size")) / bytes_each)).agg(F.min(F.struct(*by)).alias("e")).select("e.*").toArrow()
    first = first.sort_by([(c, "ascending") for c in first.column_names])
    return [first[c].to_numpy() for c in first.column_names]


def route(edges: list[np.ndarray], known: np.ndarray, ids: np.ndarray, tie: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The range of each row: how many ranges begin at it or before it, less one."""
    e_known, e_id, e_tie, e_salt = edges
    nulls = int((~e_known).sum())
    low = np.where(known, nulls + np.searchsorted(e_id[nulls:], ids, "left"), 0)
    high = np.where(known, nulls + np.searchsorted(e_id[nulls:], ids, "right"), nulls)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) >> 1, len(e_id) - 1)
        past = open_ & ((e_tie[mid] < tie) | ((e_tie[mid] == tie) & (e_salt[mid] <= salt)))
        low, high = np.where(past, mid + 1, low), np.where(open_ & ~past, mid, high)
    return np.maximum(low - 1, 0).astype(np.int32)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Packed ids in ascending doc_id order (nulls first; equal ids by a hash of the text), one compressed staging file a range.

    Returns, written once: part (the range's number), file, n_tokens, doc_ids, lengths and counts (by id, of this range).
    Ranges hold about FILE_BYTES of text each, and a repeated id, or a repeated row, may lie in several. Null and empty
    texts are a lone end_id; an empty table has no ranges.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    shared = spark.sparkContext.broadcast(_edges(docs, max(1, -(-(total + 64 * docs.count()) // parts)), folder))

    @F.pandas_udf("int")
    def part(known: pd.Series, ids: pd.Series, tie: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(route(shared.value, *(x.to_numpy() for x in (known, ids, tie, salt))))

    dealt = (
        _ordered(docs).select(part("known", "id", "tie", "salt").alias("part"), "doc_id", "text", "tie")
        .repartition(max(1, len(shared.value[0])), "part")
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "text")
        .drop("tie")
    )
    shape = "part int, file string, n_tokens long, doc_ids array<long>, lengths array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        size = encoder.library.get_vocab_size(with_added_tokens=True)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        now, out = None, None

        def done() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            row = [[now], [name], [sum(lengths)], [ids], [lengths], [counts.tolist()]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "file", "n_tokens", "doc_ids", "lengths", "counts"])

        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now != at[a]:
                    if out:
                        yield done()
                    now, name = int(at[a]), f"{uuid.uuid4().hex}.ids"
                    out, packer, ids, lengths, counts = Output(f"{folder}/{name}"), zstandard.ZstdCompressor(level=1).compressobj(), [], [], np.zeros(size, dtype=np.int64)
                for some, texts in rounds(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist()):
                    coded = encoder.encode(texts)
                    ids += some
                    lengths += [len(c) // encoder.dtype.itemsize + 1 for c in coded]
                    data = end.join([*coded, b""])
                    counts += np.bincount(np.frombuffer(data, encoder.dtype), minlength=size)
                    out.write(packer.compress(data))
        if out:
            yield done()

    return staged(dealt.mapInArrow(run, shape), "ranges", folder)


def write_files(ranges: DataFrame, staging: str, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Encodes each staged range into a token file of folder. Returns part, file, n_tokens (written once) and the frequencies.

    The frequencies come from all ids: a row for each id of the vocabulary reaches the driver, whatever the corpus.
    No ranges give no files; null doc_ids are kept as null in a file's footer.
    """
    spark = ranges.sparkSession
    sums = ranges.select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in sums), default=0) + 1, dtype=np.int64)
    for r in sums:
        counts[r["id"]] = r["n"]
    freq = scaled(counts)
    shared = spark.sparkContext.broadcast(freq)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = None
        for frame in frames:
            for row in frame.itertuples():
                codec = codec or Codec(shared.value)
                name = f"{uuid.uuid4().hex}.rans"
                writer, unpacker, tail = Writer(f"{folder}/{name}", codec), zstandard.ZstdDecompressor().decompressobj(), b""
                fs, root = filesystem(staging)
                with fs.open_input_stream(f"{root}/{row.file}") as f:
                    while data := f.read(1 << 20):
                        data = tail + unpacker.decompress(data)
                        cut = len(data) // 2 * 2
                        writer.add(np.frombuffer(data[:cut], "<u2"))
                        tail = data[cut:]
                writer.add(np.frombuffer(tail + unpacker.flush(), "<u2"))
                docs = zip((None if pd.isna(i) else int(i) for i in row.doc_ids), map(int, row.lengths), strict=True)
                writer.close(list(docs))
                yield pd.DataFrame({"part": [row.part], "file": [name], "n_tokens": [row.n_tokens]})

    one_each = ranges.select("part", "file", "n_tokens", "doc_ids", "lengths").repartition(max(1, ranges.count()), "part")
    return staged(one_each.mapInPandas(run, "part int, file string, n_tokens long"), "files", folder), freq


def read_files(files: DataFrame, folder: str, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' blocks; a damaged block is an error.

    No files give no rows. Rows of null and of equal ids each have their own.
    """
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(freq)
    # a row for each file: ids before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    todo = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = None
        for frame in frames:
            for row in frame.itertuples():
                codec = codec or Codec(shared.value)
                reader = Reader(f"{folder}/{row.file}", codec)
                docs, start, crc, left, d, out = reader.docs, int(row.first), 0, 0, 0, []
                left = docs[0][1] if docs else 0
                for k in range(len(reader.blocks)):
                    data, at = reader.block(k).astype("<u4").tobytes(), 0
                    while at < len(data):
                        piece = data[at : at + 4 * left]
                        crc, at, left = zlib.crc32(piece, crc), at + len(piece), left - len(piece) // 4
                        if not left:
                            out.append((docs[d][0], start, docs[d][1], crc))
                            start, crc, d = start + docs[d][1], 0, d + 1
                            left = docs[d][1] if d < len(docs) else 0
                frame_out = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield frame_out.astype({"doc_id": "Int64"})

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return todo.repartition(max(1, files.count()), "part").mapInPandas(run, shape)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, written to token files in doc_id order and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = workspace(spark, "rans")
    ranges = tokenised(docs, public_tokenizers.path("word_bpe_49k.json"), 1, f"{folder}/staging")
    files, freq = write_files(ranges, f"{folder}/staging", f"{folder}/files")
    return read_files(files, f"{folder}/files", freq)
