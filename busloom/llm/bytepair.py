"""Byte-level BPE on a sentencepiece model that is serialised straight from a table of ranks."""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from busloom.llm import common

#: A byte b is the character BYTE_BASE + b of the model: one code point each, none of them white space.
BYTE_BASE = 0x100
#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMO_ENTRIES = 200_000
#: Pre-tokens of one text that are held at once; characters, and bytes of decoded text, after which a batch goes out.
RUN, FLUSH_CHARS, FLUSH_BYTES = 1 << 17, 1 << 20, 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, float or varint, by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: BYTE_BASE + b for b in range(256)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece takes the id after them.

    Field numbers are those of sentencepiece_model.proto. A piece's score is its negative rank, so the merge of the
    lowest rank comes first; the normaliser is the identity, without dummy prefix or white-space rules.
    Ranks must be 0 .. n-1.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    pieces = [_field(1, mapped(t).encode()) + _field(2, float(-r)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


#: How the classes of a pattern read over ASCII alone; the longer spellings come first.
_ASCII = {
    r"[^\s\p{L}\p{N}]": "[^ \t\n\x0b\x0c\rA-Za-z0-9]",
    r"\p{L}": "[A-Za-z]",
    r"\p{N}": "[0-9]",
    r"\s": "[ \t\n\x0b\x0c\r]",
    r"\S": "[^ \t\n\x0b\x0c\r]",
}


def splitters(pattern: str):
    """The pattern's findall, and a faster one for ASCII texts where the pattern uses no other classes than _ASCII's."""
    import re

    import regex

    general = regex.compile(pattern)
    plain = pattern
    for spelling, ascii_class in _ASCII.items():
        plain = plain.replace(spelling, ascii_class)
    if re.search(r"\\[A-Za-z]|\[[^\]]*\[", plain):
        return general, general
    return general, re.compile(plain)


class Encoder:
    """Encodes texts, each match of the pattern by itself, with a memo of the pre-tokens seen."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.general, self.ascii = splitters(pattern)
        self.memo: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
        ids = self.model.encode([mapped(t.encode()) for t in new], out_type=int, num_threads=1)
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype="<i4").tobytes()
        ends = itertools.accumulate(4 * len(i) for i in ids)
        begin = 0
        for t, end in zip(new, ends, strict=True):
            self.memo[t] = flat[begin:end]
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers. Texts of up to RUN characters share a round of learning."""
        out: list[bytes] = []
        for long, group in itertools.groupby(texts, key=lambda t: len(t) > RUN):
            if long:
                out += [b"".join(p for run in self._runs(t) for p in self._lookup([run])) for t in group]
            else:
                out += self._lookup([(self.ascii if t.isascii() else self.general).findall(t) for t in group])
        return out

    def _runs(self, text: str) -> Iterator[list[str]]:
        matches = (m[0] for m in (self.ascii if text.isascii() else self.general).finditer(text))
        while run := list(itertools.islice(matches, RUN)):
            yield run

    def _lookup(self, runs: list[list[str]]) -> list[bytes]:
        distinct = set(itertools.chain.from_iterable(runs))
        for _ in range(2):  # again, as the first round may have emptied the memo
            self._learn([t for t in distinct if t not in self.memo])
        return [b"".join(map(self.memo.__getitem__, run)) for run in runs]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about FLUSH_CHARS characters: the first row's number and the texts, null as empty."""
    start, texts, held = 0, [], 0
    for i in range(len(column)):
        texts.append(column[i].as_py() or "")
        held += len(texts[-1])
        if held >= FLUSH_CHARS:
            yield start, texts
            start, texts, held = i + 1, [], 0
    if texts:
        yield start, texts


class Decoder:
    """Maps ids back to bytes: a token's bytes are a slice of all tokens' bytes laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, RUN of them at a time; an unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("an id that the vocabulary doesn't have")
        pieces = []
        for at in range(0, len(ids), RUN):
            some = ids[at : at + RUN]
            n = self.length[some]
            where = np.arange(n.sum()) + np.repeat(self.begin[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            pieces.append(self.flat[where].tobytes())
        return b"".join(pieces)


def _in_order(ranks: dict[bytes, int]) -> list[bytes]:
    return sorted(ranks, key=ranks.__getitem__)


def _replaced(df: DataFrame, column: str, outs: dict[str, DataType], make) -> DataFrame:
    """df without column and with outs, types by name, after its other columns; one of an out's name is replaced.

    make(batches) gives Arrow batches of the other columns and the outs; column comes last in what it gets. Columns are
    numbered on the way, so that any name passes.
    """
    taken = {o.lower() for o in outs} | {column.lower()}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    fields = [*((f.name, f.dataType) for f in kept), *outs.items()]
    shape = StructType([StructField(f"c{i}", kind) for i, (_, kind) in enumerate(fields)])
    numbered = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{column}`").alias("last"))
    return numbered.mapInArrow(make, shape).toDF(*[name for name, _ in fields])


def encoded(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "ids", decoded_as: str | None = None) -> DataFrame:
    """Replaces text_col by out: array<int>, the text's byte-level BPE ids; a null or empty text has none.

    vocabulary is the path of a .tiktoken file, read on the driver; the model of bounded size (about 20 bytes a token)
    goes to the workers. Other columns stay, whatever their names; one called out is replaced. With decoded_as, a binary
    column of that name holds the bytes that the ids decode to, made in the same pass: one Python worker a task instead
    of two, and the ids cross to Python and back once less. Work is row by row: no shuffle, whole texts, memory bounded
    by one text and its ids.
    """
    context, ranks = df.sparkSession.sparkContext, read_ranks(vocabulary)
    model = context.broadcast(model_proto(ranks))
    tokens = context.broadcast(_in_order(ranks)) if decoded_as else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model.value, pattern), Decoder(tokens.value) if tokens else None
        for batch in batches:
            *others, texts_of = batch.columns
            for start, texts in _groups(texts_of):
                parts = encoder.encode(texts)
                made = [_lists(parts)]
                if decoder:
                    made.append(pa.array([decoder.decode(np.frombuffer(p, dtype="<i4")) for p in parts], pa.binary()))
                columns = [*(c.slice(start, len(texts)) for c in others), *made]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return _replaced(df, text_col, {out: ArrayType(IntegerType())} | ({decoded_as: BinaryType()} if decoded_as else {}), run)


def decoded(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds out, or replaces it: binary, the bytes that the ids in ids_col stand for; null ids give no bytes. An unknown id is an error."""
    tokens = df.sparkSession.sparkContext.broadcast(_in_order(read_ranks(vocabulary)))

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens.value)
        for batch in batches:
            lists = batch.column(at)
            start, parts, held = 0, [], 0
            for i in range(batch.num_rows):
                ids = lists[i].values
                parts.append(decoder.decode(np.zeros(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)))
                held += len(parts[-1])
                if held >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    yield common.extended([c.slice(start, len(parts)) for c in batch.columns], pa.array(parts, pa.binary()))
                    start, parts, held = i + 1, [], 0

    return common.with_column(df, make, BinaryType(), out, ids_col)


def digests(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every row of docs; with ids, the ids too."""
    both = encoded(docs.select("doc_id", "text"), vocabulary, pattern, decoded_as="decoded")
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *["ids"] * ids,
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
