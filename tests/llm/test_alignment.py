"""Alignment of two tokenizers against a plain loop over tokens and bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
SIGNS = [*"abXYZ éÉß.,;!?|%#'’\"-<>()01\n\t́藏字İΣσ½\x1c\x85　\xa0😀", "  ", "   ", "\n ", " \n", "<|endoftext|>", "<s>", "<0x41>", "'ll", "▁", " the", "tion"]


@pytest.fixture(scope="module")
def enc():
    return alignment.Encoders(A, B)


def plain_tokens(enc, text):
    if not text:
        return [], []
    a, b = enc.whole.encode(" " + text, add_special_tokens=False).ids, enc.pieces.encode(text)
    fine = b"".join(enc.bytes_a[i] for i in a) == b"".join(enc.bytes_b[i] for i in b) == (" " + text).encode()
    return (a, b) if fine else ([], [])


def plain(enc, rows):
    """Loops over tokens: spans, groups and overlaps, then counts over documents."""
    out, held, counts = [], [], Counter()
    for i, text in rows:
        a, b = plain_tokens(enc, text)
        spans = []
        for ids, tokens in ((a, enc.bytes_a), (b, enc.bytes_b)):
            at, side = 0, []
            for t in ids:
                side.append((at, at + len(tokens[t]), t))
                at += len(tokens[t])
            spans.append(side)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for hi in both:
            halves = []
            for n, side in enumerate(spans):
                lo = at[n]
                while at[n] < len(side) and side[at[n]][1] <= hi:
                    at[n] += 1
                halves.append(",".join(str(t) for _, _, t in side[lo : at[n]]))
            groups.append("|".join(halves))
        links, j = [], 0
        for s, e, t in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((t, spans[1][j][2]))
                j += 1
        counts.update(set(links))
        held.append(links)
        out.append([i, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    best = {}
    for (t, _), n in counts.items():
        best[t] = max(best.get(t, 0), n)
    return sorted(((*o, sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links)) for o, links in zip(out, held, strict=True)), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect()), key=repr)


def odd_rows():
    r = random.Random(5)
    made = [(i, "".join(r.choice(SIGNS) for _ in range(r.randint(0, 40)))) for i in range(300)]
    made += [(1000, None), (1001, ""), (None, "null id here"), (1002, "same text twice."), (1002, "same text twice."), (1003, "a▁b"), (1004, " lead"), (1005, "trail "), (1006, " ")]
    return [*made, (1007, "long words and  spaces, " * 20_000)]


def test_pieces_encode_as_whole_texts(enc):
    r = random.Random(3)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    (a, at_a), (b, at_b) = enc.encode(pa.array([None, *texts]).slice(1))
    for i, t in enumerate(texts):
        assert (a[at_a[i] : at_a[i + 1]].tolist(), b[at_b[i] : at_b[i + 1]].tolist()) == tuple(map(list, plain_tokens(enc, t))), repr(t)


def test_links_between_neighbouring_ends(enc):
    side = lambda text, ids: (np.array(ids, np.int32), np.array([0, len(ids)]))
    a, b = plain_tokens(enc, "untranslatable things")
    got = alignment.align(enc, side("", a), side("", b))
    assert got["n_links"][0] == len(a) + len(b) - got["n_groups"][0]


@pytest.mark.parametrize(("sent", "batch"), [(1_000_000, 1 << 20), (50, 300), (0, 1)])
def test_alignment_equals_loops(spark, enc, sent, batch):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "pairs": F.lit(1), "n_a": F.lit("x")})
    got = alignment.align_documents(docs.repartition(3), A, B, sent=sent, batch_bytes=batch)
    assert rows_of(got) == plain(enc, rows)
    assert alignment.align_documents(docs.limit(0), A, B, sent=sent).count() == 0


def test_alignment_query(spark, enc):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op11_alignment"](spark, sf)) == plain(enc, rows)
