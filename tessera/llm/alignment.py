"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens. A batch of documents is laid end to end; the running sums of token lengths
are then byte offsets in the batch for all its documents at once. One count of token ends per side, by byte offset, shows
where both sides end (the groups' cuts) and where any side ends: between two ends next to each other lies exactly one
overlap of an A with a B token, a link. Prefix sums of these counts, taken at the documents' limits, give each document
its tokens, groups and links.

An id pair's count is the number of documents that hold it linked. The links of each document, distinct with their number,
are written once with the document; counts come from there, and go back to the documents in two ways: the `sent` most
counted pairs go to all tasks (a bounded table), all other pairs are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructType

from .common import stash, worker_cache
from .packing import byte_letters

#: Bytes of text whose distinct pieces are encoded together, and bytes that are aligned together.
ENCODED_BYTES, BATCH_BYTES = 8 << 20, 1 << 20
SENT = 1_000_000
#: Before a space that follows no white space no token of either side goes on, so what lies between can be encoded apart.
CHUNK = re.compile(r"(?<=\S)(?= )")
SPLIT_SPACE = "[\\x09-\\x0D\\x1C-\\x20\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000] "
LATIN = "\u0250"
PATTERN_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value of the vocabulary
COMMA, BAR, SEMICOLON = 44, 124, 59


def byte_level_tokens(path: str) -> tuple[list[bytes], set[int]]:
    """Bytes of each id of a byte-level vocabulary, and the ids of special tokens."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    vocab, special = told["model"]["vocab"], {t["id"]: t["content"] for t in told.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *special]) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if i in special else bytes(back[c] for c in token)
    for i, token in special.items():
        out[i] = token.encode()
    return out, set(special)


def piece_tokens(model) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Encoders:
    """Ids of both tokenizers for a batch of texts; each distinct piece of the batch is encoded once, with its space.

    For pieces below U+0250 side A is encoded with its vocabulary as ranks, where these are the order of the merges; other
    pieces go to the tokenizer itself: letters above have classes that differ by version.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        self.bytes_a, special = byte_level_tokens(path_a)
        with open(path_a, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        vocab = self.whole.get_vocab(with_added_tokens=False)
        made = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in merges]
        self.ranks = None
        if made == sorted(made) and self.whole.normalizer is None and min(made, default=256) >= 256:
            ranks = {t: i for i, t in enumerate(self.bytes_a) if i not in special and t}
            self.ranks = tiktoken.Encoding("side-a", pat_str=PATTERN_A, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b, self.space = piece_tokens(self.pieces), self.pieces.piece_to_id("▁")
        self.len_a, self.len_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        digits = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        if len(digits[-1]) > 7:
            raise ValueError("ids of up to seven digits fit a cell")
        self.width = np.array([len(d) for d in digits], np.uint64)
        self.digits = np.array([int.from_bytes(d, "little") for d in digits], np.uint64)

    def _side_a(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + piece, end to end, and where each piece's begin. The plain ones are one text, cut at the pieces' bytes."""
        ids = np.array(self.ranks.encode_ordinary("".join([" " + p for p in plain])) if plain else [], np.int32)
        limits = np.cumsum([1 + len(p.encode()) for p in plain], dtype=np.int64)
        first = np.searchsorted(np.cumsum(self.len_a[ids]), limits, "right")
        more = [self.whole.encode(" " + p, add_special_tokens=False).ids for p in others]
        sizes = np.concatenate((np.diff(first, prepend=0), np.array([len(m) for m in more], np.int64)))
        return np.concatenate((ids, np.fromiter(chain.from_iterable(more), np.int32))), np.concatenate(([0], np.cumsum(sizes)))

    def _side_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [b if p else [self.space] for p, b in zip(pieces, self.pieces.encode(pieces, num_threads=1), strict=True)]
        return np.fromiter(chain.from_iterable(each), np.int32), np.cumsum([0, *map(len, each)])

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, end to end, and the place where each text's begin.

        A text has none if it is null or empty, or if a side's tokens do not give back its bytes.
        """
        cut = _pieces_of(texts)
        flat = cut.flatten().dictionary_encode()
        of, where = flat.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        found = flat.dictionary.to_pylist()
        plain = [self.ranks is not None and p != "" and not p[-1].isspace() and (p.isascii() or max(p) < LATIN) for p in found]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        pieces = [found[i] for i in order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        of, n = place[of], sum(plain)
        sides, odd = [self._side_a(pieces[:n], pieces[n:]), self._side_b(pieces)], np.zeros(len(pieces), bool)
        for (ids, first), tokens, length in zip(sides, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
            raw, sizes = b"".join([b" " + p.encode() for p in pieces]), np.array([1 + len(p.encode()) for p in pieces], np.int64)
            if (np.diff(np.concatenate(([0], np.cumsum(length[ids])))[first]) != sizes).any() or _joined(tokens, ids) != raw:
                odd |= [_joined(tokens, ids[first[i] : first[i + 1]]) != b" " + p.encode() for i, p in enumerate(pieces)]
        out = []
        for ids, first in sides:
            count = np.diff(first)[of]
            upto = np.concatenate(([0], np.cumsum(count)))
            out.append((ids[np.repeat(first[:-1][of] - upto[:-1], count) + np.arange(upto[-1])], upto[where]))
        if odd.any():
            drop = np.zeros(len(texts), bool)
            for i in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(odd[of])))[where])):
                raw = b" " + texts[int(i)].as_py().encode()
                drop[i] = any(_joined(t, ids[at[i] : at[i + 1]]) != raw for (ids, at), t in zip(out, (self.bytes_a, self.bytes_b), strict=True))
            out = [(ids[~np.repeat(drop, np.diff(at))], np.concatenate(([0], np.cumsum(np.where(drop, 0, np.diff(at)))))) for ids, at in out]
        return out


def _joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join([tokens[i] for i in ids.tolist()])


def _pieces_of(texts: pa.Array) -> pa.ListArray:
    """What stands between the spaces at which both tokenizers cut, space and text taken together; null or empty texts have no piece."""
    void = pc.fill_null(pc.equal(texts, ""), True).to_numpy(zero_copy_only=False)
    texts = texts.take(pa.array(np.arange(len(texts)), mask=void))
    hard = pc.fill_null(pc.or_(pc.starts_with(texts, " "), pc.match_substring_regex(texts, SPLIT_SPACE)), False).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(texts, " ")
    if hard.any():
        some = pa.array([[c[1:] for c in CHUNK.split(" " + t.as_py())] for t in texts.filter(pa.array(hard))], cut.type)
        at = np.arange(len(texts))
        at[hard] = len(texts) + np.arange(hard.sum())
        cut = pa.concat_arrays([cut, some]).take(pa.array(at))
    return cut


def align(enc: Encoders, side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray]) -> dict:
    """All documents of a batch at once: tokens, groups and links of each, their groups' digests, their distinct links.

    A side is the ids of all documents, end to end, and the places where each document's begin. The documents' bytes lie
    end to end, too, so a token's end is the running sum of lengths over the whole batch.
    """
    (a, first_a), (b, first_b) = side_a, side_b
    end_a, end_b = np.cumsum(enc.len_a[a]), np.cumsum(enc.len_b[b])
    limits, n = np.concatenate(([0], end_a))[first_a], len(first_a) - 1
    total = int(limits[-1])
    at_a, at_b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
    cut, any_end = at_a * at_b, at_a | at_b
    cuts = np.cumsum(cut)
    upto_a, upto_b = np.cumsum(at_a), np.cumsum(at_b)
    groups = np.diff(cuts[limits])

    ends = np.flatnonzero(any_end)  # a link ends at each of them
    left, right = upto_a[ends - 1], upto_b[ends - 1]  # tokens that ended before: the index of the one that covers it
    doc_of = np.searchsorted(limits, ends, "left") - 1
    pair = a[left].astype(np.int64) * len(enc.bytes_b) + b[right]
    keys, times = np.unique(doc_of * (len(enc.bytes_a) * len(enc.bytes_b)) + pair, return_counts=True)
    distinct = np.searchsorted(keys, np.arange(n + 1) * (len(enc.bytes_a) * len(enc.bytes_b)))

    # Text of the groups: each id is a cell of its digits and the sign after it; A ids of a group stand before its B ids.
    group_a, group_b = cuts[end_a - 1], cuts[end_b - 1]
    in_a, in_b = np.bincount(group_a, minlength=int(cuts[-1])), np.bincount(group_b, minlength=int(cuts[-1]))
    before_b, with_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + with_a[group_b]
    cells = np.empty(len(a) + len(b), np.uint64)
    for ids, place, end, last in ((a, place_a, end_a, BAR), (b, place_b, end_b, SEMICOLON)):
        sign = np.where(cut[end] > 0, np.uint64(last), np.uint64(COMMA))
        cells[place] = enc.digits[ids] | sign << enc.width[ids] * np.uint64(8)
    flat = cells.astype("<u8", copy=False).view(np.uint8)
    flat = flat[flat != 0]
    signs = np.empty(len(a) + len(b), np.int64)
    signs[place_a], signs[place_b] = enc.width[a], enc.width[b]
    ends_at = np.concatenate(([0], np.cumsum(signs + 1)))[first_a + first_b]
    text = flat.tobytes()
    digests = [hashlib.sha256(text[i : k - 1]).hexdigest() if k > i else "" for i, k in zip(ends_at.tolist(), ends_at[1:].tolist(), strict=False)]
    return {
        "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": groups, "n_links": np.diff(np.cumsum(any_end > 0)[limits]), "groups_sha256": digests,
        "pairs": keys % (len(enc.bytes_a) * len(enc.bytes_b)), "times": times, "distinct": distinct,
    }


def _aligned(path_a: str, path_b: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_cache(f"align {path_a} {path_b}", lambda: Encoders(path_a, path_b))

        def done(ids: pa.Array, sides: list, lo: int, hi: int) -> pa.RecordBatch:
            got = align(enc, *((x[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for x, at in sides))
            limits = pa.array(got["distinct"].astype("<i4"))
            lists = [pa.ListArray.from_arrays(limits, pa.array(got[c].astype(kind))) for c, kind in (("pairs", "i8"), ("times", "i4"))]
            names = ["n_a", "n_b", "n_groups", "n_links"]
            arrays = [ids.slice(lo, hi - lo), *(pa.array(got[c]) for c in names), pa.array(got["groups_sha256"], pa.string()), *lists]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "groups_sha256", "pairs", "times"])

        for batch in batches:
            for lo, hi in _runs(batch.column(1), ENCODED_BYTES):
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                sides = enc.encode(texts)
                for i, k in _runs(texts, batch_bytes):
                    yield done(ids, sides, i, k)

    return run


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold `most` bytes, a row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merge():
            nonlocal keys, counts, held
            k, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            both, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, np.concatenate((counts, n)))
            keys, counts, held = both, sums, []

        size = 0
        for b in batches:
            held.append(b.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > most:
                merge()
                size = 0
                if len(keys) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        merge()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return run


def _looked_up(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for b in batches:
            pairs, times = (b.column(c) for c in ("pairs", "times"))
            where, p, t = np.concatenate(([0], np.cumsum(pc.list_value_length(pairs).to_numpy()))), pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            sums = [np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)]
            sums[0][hit], sums[1][hit] = t[hit] * best[at[hit]], t[hit] * n[at[hit]]
            more = [pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[where])) for x in sums]
            left = np.concatenate(([0], np.cumsum(~hit)))[where].astype(np.int32)
            more += [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (p, t)]
            names = b.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], names=[*names, "n_best", "count_sum", "rest", "rest_times"])

    return run


def _with(schema: StructType, **more: DataType) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """A row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    path_a: a byte-level vocabulary of the tokenizers library, given space and text; path_b: a piece model, given the text.

    * null or empty texts, and texts that the joined tokens of either side do not give back (U+2581, for one): no tokens,
      zeros and an empty digest;
    * special tokens in a text are plain text; very long texts count whole: a batch holds one at least, more up to batch_bytes;
    * ties: every B id with an A id's highest count is a best one; repeated rows and null ids: a document each, in counts, too;
    * empty input: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(c, "long")
    own = schema.add("groups_sha256", "string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_aligned(path_a, path_b, batch_bytes), _with(own, pairs=ArrayType(LongType()), times=ArrayType(IntegerType())))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")

    width = _pieces(path_b)
    counts = rows.select("pairs").mapInArrow(_counted(2_000_000), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stash(counts, "pair-counts").withColumn("a", F.expr(f"pair div {width}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row an A id
    counts = stash(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")

    # As many of the highest counts as fit in `sent` rows: a histogram of some hundred steps tells where they begin.
    step = F.floor(F.log2("n") * 8)
    histogram, first, held = counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect(), None, 0
    for s, size in histogram:
        held += size
        if held > sent:
            break
        first = s
    top = counts.filter(step >= F.lit(first)).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    order = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = rows.select(*order, "pairs", "times")
    found = found.mapInArrow(_looked_up(known), _with(rows.select(*order).schema, n_best=LongType(), count_sum=LongType(), rest=ArrayType(LongType()), rest_times=ArrayType(LongType())))
    out = [F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if held <= sent:  # all pairs went to the tasks
        return found.select(*out)
    found = stash(found, "aligned-found")
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t"))
    sums = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"), F.sum(F.col("t") * F.col("n")).alias("c"))
    found = found.join(sums, "row", "left")
    more = {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))}
    return found.withColumns(more).select(*out)
