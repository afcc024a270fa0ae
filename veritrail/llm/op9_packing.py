"""Packing by power-of-two decomposition.

A document's tokens, closed by an end token, are cut into pieces whose lengths are the binary digits of its token
count (whole sequences of 2048 first, then falling powers of two). Pieces of equal length form a bucket; every piece
is a sequence of its own, so no sequence crosses a document and nothing is padded.

Tokens: the vocabulary splits text at white space before anything else, so the ids of a text are the ids of its
blank-separated words in order. Words are encoded when first met and remembered, within a bound, by each Python worker;
beyond it, words not met for long go. Texts with control characters, or with the name of a special token (which becomes
that token), are encoded whole.

All of it is one pass without a shuffle. A sequence's number is made of its bucket, its partition and a running
number there, so it is unique without counting anything across partitions, and a lost task makes the same rows again.

Null or empty text has the end token alone. Repeated rows and ids are packed each for itself. Very long texts are cut
like others. No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import claim, table

LENGTH = 2_048
END = 1
#: Words that a worker remembers before it starts anew, with those known so far at hand until it does so again, and the
#: longest word that it remembers.
REMEMBERED = 200_000
LONGEST = 48

#: How the vocabulary splits a lower-cased word before it looks for pairs to merge (a fixed value).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only need no further normalising than lower case.
PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_NAMES = _byte_names()


class _Words:
    """The vocabulary: ids of a word or text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model
        names = [re.escape(t.content) for t in self.own.get_added_tokens_decoder().values()]
        self.names = re.compile("|".join(names) or "(?!)", re.I)
        #: What all names begin with, up to a letter.
        self.mark = re.match(r"\W*", os.path.commonprefix([t.content for t in self.own.get_added_tokens_decoder().values()]))[0]

    def whole(self, text: str) -> bool:
        """Whether words alone don't tell a text: it holds a name that is one token, or characters that are blanks to some only."""
        return bool(_CONTROLS.search(text) or (self.mark in text and self.names.search(text)))

    def _plain(self, word: str) -> bytes:
        low = word.lower()
        parts = (low,) if low.isalpha() else SPLIT.findall(low)
        tokens = [t.id for p in parts for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_NAMES))]
        return array("I", tokens).tobytes()

    def encode(self, text: str) -> bytes:
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, word: str) -> bytes:
        plain = len(word) <= LONGEST and (word.isprintable() if word.isascii() else PLAIN.fullmatch(word))
        return self._plain(word) if plain else self.encode(word)


class _Known(dict):
    """Ids by word. A word that is not there is taken from the generation of words before, or encoded."""

    def __init__(self, words: _Words, older: dict[str, bytes]):
        super().__init__({"": b""})
        self.words, self.older, self.long = words, older, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            if word not in self.long:
                self.long[word] = self.words.ids(word)
            return self.long[word]
        ids = self.older.get(word)
        self[word] = ids = self.words.ids(word) if ids is None else ids
        return ids

    def next(self) -> _Known:
        """The words for the next texts: beyond the bound a new generation of them, and the one before this goes."""
        self.long.clear()
        if len(self) <= REMEMBERED:
            return self
        self.older = {}
        return _Known(self.words, self)


_vocabularies: dict[str, _Known] = {}


#: A full stop or comma that ends a word together with other signs, with which it is one token.
_GROUPED = re.compile(r"(?:[^\w\s]|_)[.,][ \n]")
#: What matches wherever that does, and is faster to rule out.
_PERHAPS_GROUPED = re.compile("[^0-9a-z\xdf-\xf6\xf8-\xff][.,][ \n]")
#: Characters that are blanks, or nothing, to some only.
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad]")


def _split(text: str) -> list[str]:
    """Words in lower case, full stops and commas behind a word apart from it: fewer different words to encode."""
    sigma = "Σ" in text  # its lower case depends on what follows
    if not sigma:
        text = text.lower()
    # The lower case of "İ" ends in a sign.
    if not (_PERHAPS_GROUPED.search(text) and _GROUPED.search(text)) and not (sigma and "İ" in text):
        text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


def encode(texts: list[str | None], path: str, end: int = END) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, with the end token."""
    known = _vocabularies[path] = _vocabularies[path].next() if path in _vocabularies else _Known(_Words(path), {})
    own, get, tail = known.words, known.__getitem__, int(end).to_bytes(4, "little")
    return [(b"" if not t else own.encode(t) if own.whole(t) else b"".join(map(get, _split(t)))) + tail for t in texts]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, then the binary digits of the rest, largest first."""
    out = [(at, length) for at in range(0, tokens - tokens % length, length)]
    at, rest = tokens - tokens % length, tokens % length
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``length`` is a power of two. ``ids`` are little-endian unsigned 32-bit numbers. Writing the result with
    ``partitionBy("length")`` lays the buckets out as folders of equal-length sequences.
    """
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches):
        claim("packing", _vocabularies.clear)
        place, made = TaskContext.get().partitionId() << 33, [0] * 64
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            for first in range(0, len(batch), 512):
                rows, start, size, crc, total, number, kept = [], [], [], [], [], [], []
                for k, ids in enumerate(encode(texts.slice(first, 512).to_pylist(), path, end), first):
                    for at, n in pieces(len(ids) // 4, length):
                        part = ids[4 * at : 4 * (at + n)]
                        bucket = n.bit_length() - 1
                        rows.append(k)
                        start.append(at)
                        size.append(n)
                        crc.append(zlib.crc32(part))
                        total.append(len(ids) // 4)
                        number.append((bucket << 59) + place + made[bucket])
                        made[bucket] += 1
                        if keep_ids:
                            kept.append(part)
                columns = [keys.take(pa.array(rows, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, size, crc, total, number, np.zeros(len(rows), np.int64))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema + ", ids binary" * keep_ids)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
