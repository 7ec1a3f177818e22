"""Encoding with the tokenizers library, word by word through a memo, and flat token files."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np

#: Distinct words a worker remembers before it starts afresh; longest word it remembers; characters of texts in one round.
MEMO_WORDS, MEMO_BYTES, ROUND_CHARS = 1_200_000, 64, 1 << 20
_PUNCTUATION = (ord("."), ord(","))


class WordEncoder(dict):
    """Ids of whole texts as the library gives them, for tokenizers that split at white space and drop it.

    A text is cut at ASCII white space, where such a tokenizer always cuts too; each distinct word is encoded once and
    remembered here, packed as dtype. ASCII letters are lowered first, as the tokenizer's own normaliser does; a word of
    these alone goes straight to its model, and a last dot or comma after one is a token of its own and is looked up by
    itself. As in the library by default, the strings of special tokens become their ids; with plain_specials they are
    ordinary text. A text that holds such a string, in capitals or not, goes to the library as a whole.
    """

    def __init__(self, path: str, dtype: str = "<u2", plain_specials: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.model = self.library.model
        self.specials = [] if plain_specials else [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(dtype)
        if self.library.get_vocab_size(with_added_tokens=True) > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"ids don't fit {dtype}")

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone
            ids = array(self.dtype.char, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        elif len(word) > 1 and word[-1] in _PUNCTUATION and 97 <= word[-2] <= 122:
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = array(self.dtype.char, self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed as dtype."""
        return [self._encoded(t, t.encode().lower()) for t in texts]

    def _encoded(self, text: str, lowered: bytes) -> bytes:
        if any(s in lowered for s in self.specials):
            return array(self.dtype.char, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, lowered.split()))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, dtype: str = "<u2", plain_specials: bool = False) -> WordEncoder:
    """A worker's encoder, kept from task to task with the words it has learnt."""
    return WordEncoder(path, dtype, plain_specials)


def rounds(ids: list, texts: list) -> Iterator[tuple[list, list[str]]]:
    """Rows in runs of about ROUND_CHARS characters; null texts are empty."""
    a, held, some = 0, 0, []
    for i, t in enumerate(texts):
        some.append(t or "")
        held += len(some[-1])
        if held >= ROUND_CHARS or i + 1 == len(texts):
            yield ids[a : i + 1], some
            a, held, some = i + 1, 0, []


def opened_as(uri: str) -> str:
    """The URI by pyarrow's names: Hadoop's names of S3 are its s3."""
    scheme, colon, rest = uri.partition("://")
    return f"s3{colon}{rest}" if scheme in ("s3a", "s3n") else uri


def filesystem(uri: str):
    """pyarrow's file system and the path inside it for a URI that driver and executors can open.

    Credentials of a store come from where pyarrow reads them (the environment), not from Spark's settings.
    """
    from pyarrow import fs

    return fs.FileSystem.from_uri(opened_as(uri))


class Output:
    """A file that appears under its name only when it is whole, so that a lost task leaves no part of one there."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.path + ".part")

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.path + ".part", self.path)
