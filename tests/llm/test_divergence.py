"""Source divergences against plain counting with whole numbers."""

import random
import re

import pytest
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)

from quarry.llm import divergence

SF001 = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, top=200):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    docs, counts, groups = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        words = TERM.findall(lower(text))
        for t in set(words):
            docs[lang, t] = docs.get((lang, t), 0) + 1
        for t in words:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= 3]
        v = len(kept)

        def p(of, t, lang=lang, kept=kept, v=v):
            n = sum(counts.get((lang, s, k), 0) for s in of for k in kept)
            c = sum(counts.get((lang, s, t), 0) for s in of)
            return 1 + 10 ** 9 * (c + 1) // (n + v)
        share = {s: {t: p([s], t) for t in kept} for s in sources}
        whole = {t: p(sources, t) for t in kept}
        for s in sources:
            pairs = [(o, sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept))
                     for o in sources if o != s]
            terms = [(t, (share[s][t] - whole[t]) ** 2 // whole[t]) for t in kept
                     if counts.get((lang, s, t)) and share[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(found[:most])]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.divergences(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_random_texts_spilled_often(spark, monkeypatch):
    """Terms in one, two and three documents, ties, sources without kept terms,
    null columns; every step in small pieces."""
    rng = random.Random(11)
    steps = {name: getattr(divergence, name) for name in ("_fold", "_merge", "_diverge")}

    def small(step):
        def made(option):
            run = step(option)

            def wrapped(batches):  # runs in the workers
                for name, size in (("HELD", 5), ("CHUNK", 2), ("CELLS", 8), ("SLICE_BYTES", 64)):
                    setattr(divergence, name, size)
                yield from run(batches)
            return wrapped
        return made
    for name, step in steps.items():
        monkeypatch.setattr(divergence, name, small(step))
    words = ["a", "b", "Ä", "ä", "ß", "wort", "Wort", "x1y", "漢字"] + [f"t{c}" for c in "abcdefgh"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(25))), rng.choice(["en", "de", None, ""]),
             rng.choice(["s0", "s0", "s1", None, "ü"])) for _ in range(60)]
    rows += [(None, "xx", "only"), ("", "xx", "other"), ("lone words here", "yy", "one"),
             ("12 34 ..", "en", "digits"), ("seldom", "en", "rare"), (None, None, None)]
    df = frame(spark, rows).repartition(4)
    assert got(df) == plain(rows)
    assert got(df, top=2) == plain(rows, top=2)


def test_edge_rows(spark, edge, no_rows):  # noqa: F811
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    assert got(edge) == plain(rows)
    empty = divergence.divergences(no_rows)
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert not empty.collect()


def test_documents_of_a_table(spark):
    """(The whole of sf0.01 is held against SQL.)"""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("lang = 'de'")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    found = got(docs)
    assert found == plain(rows) and {r[2] for r in found} == {"pair", "term"}


@pytest.mark.parametrize("count,total", [(0, 1), (9, 10), (10 ** 12, 10 ** 15 + 7),
                                         (8 * 10 ** 15, 8 * 10 ** 15 + 3)])
def test_shares_without_overflow(count, total):
    import numpy as np
    found = divergence.shares(np.array([count], np.int64), total)
    assert found.tolist() == [1 + 10 ** 9 * (count + 1) // total]
