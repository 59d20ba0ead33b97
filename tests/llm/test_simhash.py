"""Fingerprints against plain counting, components against all pairs."""

import random

import numpy as np
import xxhash
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)

from quarry.llm import common, simhash

SF001 = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode("utf-8", "replace").translate(
        bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if w]
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42)
              for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id reachable over links of all pairs; rows of (id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return [(d, f, least.get(top(f))) for d, f in rows]


def got(df):
    return sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in df.collect()), key=repr)


def check(df):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    assert got(simhash.components(df)) == sorted(plain_components(rows), key=repr)


def test_documents_against_all_pairs(spark):
    check(spark.read.parquet(f"{SF001}/documents.parquet"))


def test_edge_rows(spark, edge, no_rows):  # noqa: F811
    check(edge)
    found = simhash.components(no_rows)
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and not found.collect()
    got_rows = {r.doc_id: r for r in simhash.components(edge).collect() if r.doc_id}
    assert got_rows[1].fingerprint == "0" * 16 and got_rows[3].component_id == 1


def test_chains_of_near_copies(spark):
    """Copies of copies, each a few words on: linked only over others."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        line = rng.choices(words, k=300)
        for _ in range(15):
            texts.append(" ".join(line))
            line = list(line)
            line[rng.randrange(len(line))] = rng.choice(words)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(df.repartition(3))
    assert len({c for *_, c in got(simhash.components(df))}) < len(texts)


def clusters(rng, n):
    """Distinct fingerprints: crowds around few centres and lone ones."""
    out = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(n):
            flips = rng.sample(range(64), rng.randrange(7))
            out.add(centre ^ sum(1 << b for b in flips))
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def test_bit_sliced_comparison_against_popcounts():
    rng = random.Random(5)
    for _ in range(20):
        sizes = np.array([rng.choice([2, 3, 7, 40, 64, 65, 130, 200]) for _ in range(12)])
        centre = [rng.getrandbits(64) for _ in range(3)]
        prints = np.array([rng.choice(centre) ^ sum(1 << rng.randrange(64) for _ in range(
            rng.randrange(4))) % 2 ** 64 for _ in range(sizes.sum())], np.uint64)
        i, j = simhash._linked(prints, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        plain = {(a, b) for a in range(len(prints)) for b in range(a)
                 if group[a] == group[b] and int(prints[a] ^ prints[b]).bit_count() <= 2}
        assert set(zip(i.tolist(), j.tolist())) == plain and len(i) == len(plain)


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    """Crowded fingerprints with tiny buckets: every linked pair meets in one,
    and no bucket stays above its size but those of the last level."""
    rng = random.Random(7)
    prints = clusters(rng, 120)
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "LEVELS", simhash._levels())
    assert len(simhash.LEVELS) > 5
    df = spark.createDataFrame([(f - 2 ** 64 if f >> 63 else f,) for f in prints], "fp long")
    rows, tables = simhash._buckets(df)
    met = {}
    for r in rows.collect():
        met.setdefault(r.path, []).append(r.fp % 2 ** 64)
    assert max(map(len, met.values())) <= 16
    pairs = {(a, b) for v in met.values() for a in v for b in v if a > b}
    for a in prints:
        for b in prints:
            if a > b and (a ^ b).bit_count() <= 2:
                assert (a, b) in pairs
    for t in tables:
        common.drop_staged(t)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"t{i % 701}" for i in range(5000))
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == plain_fingerprint(text)
