"""Packing by power-of-two decomposition.

Each document's tokens are cut into pieces whose lengths are powers of two: as many of the maximum as fit, then the
binary digits of the rest, largest first. Pieces of one length form a bucket, and each piece is a sequence by itself, so
no sequence crosses documents and none needs padding. A training run draws each batch from one bucket.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_cache

CACHED_WORDS = 120_000
MOST_HELD = 2 << 20  # bytes of ids a batch of results may hold, in the worker and again in the executor that reads it
TRAILING = ".,;:!?|%&$*#"
PLAIN = re.compile(rb"([A-Za-z]+)([.,;:!?|%&$*#]*)").fullmatch
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch  # a composed Latin-1 letter: one code point, one lower case


def decompose(length: int, most: int = 4096) -> list[int]:
    """Powers of two of at most `most` that add up to length, largest first. most is a power of two."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    rest = length % most
    return [most] * (length // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit) of words between ASCII white space, as the tokenizer gives them.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words in order. It also
    ends a run of letters or digits before punctuation, so a word's trailing punctuation is encoded apart from a core
    that ends in one; and it folds case, so an ASCII core needs to be met in one case only. A core of Latin letters is
    one word to every step before the tokenizer's model (composed already, nothing to split), so it goes to the model at
    once, in the characters that stand for its bytes. All other words are encoded as they are.

    The cache is bounded: words used since the last turn-over are in the dict, those before in `old`; a hit there moves
    back. Two generations of `most` words bound the memory and change no result.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        give_back()  # what parsing the file took
        self.encode, self.word, self.most, self.old = whole.encode_batch_fast, whole.model.tokenize, most, {}
        self.shown = {b: c for b, c in byte_letters().items() if b >= 128}

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def make(self, word: bytes) -> bytes:
        if m := PLAIN(word):
            core, tail = m.groups()
            low = core.lower()
            if tail:
                return self[low] + self[tail]
            return self[low] if low != word else _packed([t.id for t in self.word(low.decode())])
        text = word.decode("utf-8")
        if LETTERS(text):
            return _packed([t.id for t in self.word(text.lower().encode().decode("latin-1").translate(self.shown))])
        core = text.rstrip(TRAILING)
        if len(core) < len(text) and core[-1:].isalnum() and len(core[-1].lower()) == 1 and "<" not in core:
            return self[core.encode()] + self[text[len(core) :].encode()]
        return _packed(self.encode([text], add_special_tokens=False)[0].ids)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _cut(tokenizer_path: str, end_id: int, most: int):
    """The pieces of rows (id, text), in batches that hold MOST_HELD bytes of ids and one document more at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = worker_cache(f"tokens {tokenizer_path}", lambda: WordTokens(tokenizer_path)), np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, start, length, tokens, total, held = [], [], [], [], [], 0

            def out(b=b):
                cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary()), pa.array(total, pa.int64())]
                return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "tokens", "doc_tokens"])

            for i, text in enumerate(b.column(1).cast(pa.binary())):
                ids = memoryview(b"".join(map(words.__getitem__, (text.as_py() or b"").split())) + end)
                n, at = len(ids) // 4, 0
                for k in decompose(n, most):
                    doc.append(i)
                    start.append(at)
                    length.append(k)
                    tokens.append(bytes(ids[4 * at : 4 * (at + k)]))
                    total.append(n)
                    at += k
                held += 4 * n
                if held > MOST_HELD:
                    yield out()
                    doc, start, length, tokens, total, held = [], [], [], [], [], 0
            if doc:
                yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, tokens, doc_tokens, sequence_id, offset.

    tokens is binary: the ids as little-endian unsigned 32-bit numbers. length names the bucket; sequence_id is unique,
    and offset is 0, as each piece is a whole sequence. start is the number of the document's ids before the piece.

    * null or empty text: the end id alone, one piece of length 1;
    * long texts: as many pieces as needed, nothing is cut off; repeated rows and null ids: packed like any other row;
    * empty input: no rows. Other columns are not read. There is no shuffle.
    """
    decompose(1, most)
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("start", "long").add("length", "long").add("tokens", "binary").add("doc_tokens", "long")

    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, end_id, most), schema)
    return pieces.select(F.col("doc_id").alias(id_col), "start", "length", "tokens", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
