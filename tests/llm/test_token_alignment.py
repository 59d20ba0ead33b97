"""Alignments against all pairs of overlapping byte ranges."""

import bisect
import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)

from quarry.llm import token_alignment

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in plain}
    symbol |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    names = {i: bytes(symbol[c] for c in t)
             for t, i in json.load(open(path))["model"]["vocab"].items() if t != "<|endoftext|>"}
    return a, names, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(libraries, text):
    """(id, start, end) of both sides, or None."""
    a, names, b = libraries
    if not text:
        return None
    out, whole = [], b" " + text.encode()
    pieces = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        pieces.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else
                       p.replace("▁", " ").encode()))
    for tokens in ([(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], pieces):
        at, row = 0, []
        for i, s in tokens:
            row.append((i, at, at + len(s)))
            at += len(s)
        if b"".join(s for _, s in tokens) != whole:
            return None
        out.append(row)
    return out


def plain(libraries, rows):
    """The contract's rows of (doc_id, text), and pair -> (documents, links)."""
    found, docs, links = [], Counter(), Counter()
    for doc_id, text in rows:
        tokens = plain_tokens(libraries, text)
        if not tokens:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = tokens
        pairs, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                pairs.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        sides = []
        for side in tokens:
            sides.append([[] for _ in cuts])
            for i, _, e in side:
                sides[-1][bisect.bisect_left(cuts, e)].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)]
        found.append((doc_id, len(a), len(b), len(cuts), pairs, ";".join(groups)))
        docs.update(set(pairs))
        links.update(pairs)
    top = {}
    for (_, b), n in links.items():
        top[b] = max(n, top.get(b, 0))
    out = [(d, n_a, n_b, n_g, len(p), sum(links[x] == top[x[1]] for x in p),
            sum(links[x] for x in p), text) for d, n_a, n_b, n_g, p, text in found]
    return sorted(out, key=repr), {x: (docs[x], n, n == top[x[1]]) for x, n in links.items()}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [None, "", " ", "  two  spaces ", "a", "Hello <|endoftext|> </s> <unk> world", "tab\tand\nline",
         "über straße naïve 漢字 😀 ½ ﬁ", "é combining", "▁ low", "aaaa" * 40, "\x00\x01",
         "<0x41> bytes", "don't stop, it's 12345!"]


def test_odd_texts_and_documents(spark, libraries, monkeypatch):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (3, "one two"), (3, "one two")]
    docs += [(r.doc_id + 1000, r.text) for r in
             spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()]
    expected, counts = plain(libraries, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(token_alignment.align(df)) == expected
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "")
              for r in expected]
    assert got(token_alignment.align(df, texts=False)) == sorted(hashed, key=repr)
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links, r.best) for r in
            token_alignment.pair_counts(df).collect()} == counts


def test_many_small_blocks_and_slices(spark, libraries, monkeypatch):
    """The same answers when every block holds a few documents in several slices."""
    docs = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{SF001}/documents.parquet").limit(40).collect()]
    expected, _ = plain(libraries, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = token_alignment._index

    def small(*args):
        run = index(*args)

        def wrapped(batches):
            token_alignment.SLICE_BYTES, token_alignment.BLOCK_BYTES = 3000, 12_000
            yield from run(batches)
        return wrapped
    monkeypatch.setattr(token_alignment, "_index", small)
    assert got(token_alignment.align(df)) == expected


def test_edge_rows(spark, edge, no_rows, libraries):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(token_alignment.align(edge)) == plain(libraries, rows)[0]
    assert not got(token_alignment.align(no_rows)) and not got(token_alignment.pair_counts(no_rows))


def test_planes_against_counting():
    rng = random.Random(2)
    indexes, plain_counts = [], Counter()
    for part in range(3):
        links = [(rng.randrange(30), part * 100 + rng.randrange(100)) for _ in range(4000)]
        plain_counts.update(links)
        indexes.append(token_alignment.planes_of(*(np.array(x) for x in zip(*links))))
    planes = token_alignment.merged(indexes)
    pairs, docs, links = token_alignment.popcounts(planes)
    for p, d, n in zip(pairs.tolist(), docs.tolist(), links.tolist()):
        assert d == sum(1 for q, _ in plain_counts if q == p)
        assert n == sum(m for (q, _), m in plain_counts.items() if q == p)
    back = Counter()
    for k, plane in enumerate(token_alignment._packed(pairs, planes)):
        for place, first, word in zip(*token_alignment._unpacked(plane)):
            for lane in range(64):
                if int(word) >> lane & 1:
                    back[int(pairs[place]), int(first) + lane] += 1 << k
    assert back == plain_counts
