"""Token counts, encoding, quality rules, language: per-row operators."""

import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)
from tokenizers import Tokenizer, models

from quarry.llm import bpe, langid, quality_rules, token_counts

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(
        f"SELECT text FROM '{SF001}/documents.parquet' ORDER BY doc_id").fetchall()]


# ------------------------------------------------------------- token counts

def test_counts_are_those_of_greedy_pieces(texts):
    pieces = token_counts.default_pieces()
    vocab = {"[UNK]": 0}
    for p in pieces:
        if p != "▁":
            vocab.setdefault(p[1:] if p[0] == "▁" else "##" + p, len(vocab))
    greedy = models.WordPiece(vocab=vocab, unk_token="[UNK]", continuing_subword_prefix="##",
                              max_input_chars_per_word=10 ** 6)
    counter = token_counts.Counter(pieces)
    r = random.Random(3)
    words = {w for t in texts for w in token_counts.WORD.findall(t.lower())}
    words |= {"".join(r.choice("abcdeinorstéñ日ж5") for _ in range(r.randint(1, 25)))
              for _ in range(5000)}
    for w in words:
        cut = [t.value for t in greedy.tokenize(w)]
        assert counter.automaton.count(w) == (0 if "[UNK]" in cut else len(cut)), w


def test_automaton_on_small_vocabularies():
    """Against plain longest-match cutting, over all words of a small alphabet."""
    r = random.Random(1)
    for _ in range(40):
        first = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(5)}
        later = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(5)}
        automaton = token_counts.Automaton(first, later)
        for n in range(1, 512):
            word = bin(n)[2:].replace("0", "a").replace("1", "b")
            at, count, vocab = 0, 0, first
            while at < len(word):
                k = next((k for k in range(len(word), at, -1) if word[at:k] in vocab), None)
                if k is None:
                    count = 0
                    break
                at, count, vocab = k, count + 1, later
            assert automaton.count(word) == count, (first, later, word)


def test_token_count_edges(edge, no_rows):
    got = [tuple(r) for r in token_counts.count(edge).collect()]
    assert len(got) == edge.count()
    assert (1, 0, 0, 0) in got and (2, 0, 0, 0) in got and (None, 0, 0, 0) in got
    assert [g for g in got if g[0] == 5] == [g for g in got if g[0] == 5][:1] * 2
    assert token_counts.count(no_rows).collect() == []


# ----------------------------------------------------------------- encoding

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def fuzz(n):
    r = random.Random(1)
    alphabet = "abcdeABCDEé çÀß'’.,!?$<|>0129٣½  \n\t\x1c\x1e\x85\xa0 σΣİıǅ日本語พา้😀👩‍👧ﬁⅧ²​"
    words = ["<|endoftext|>", "<|startoftext|>", "don't", "we'll", "I'VE", "aaaaaaaaaaaaa",
             "hahahahaha", "<|endof", "ΟΔΥΣΣΕΥΣ", "é"]
    for _ in range(n):
        yield "".join(r.choice(alphabet) if r.random() < .8 else r.choice(words)
                      for _ in range(r.randint(0, 60)))
    for _ in range(n // 5):
        yield "".join(r.choice("ab") for _ in range(60))
        yield "".join(r.choice("theinrao") for _ in range(40))


def test_encoding_and_decoding_equal_the_library(texts, library, encoder):
    for t in [*texts, *fuzz(2000), "", "x" * 20_000, "ab" * 20_000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == ids, t[:60]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pair_table_against_merging_by_rank(encoder):
    """Compatible: merging the joint symbols by rank gives the two tokens back."""
    def merged(symbols):
        ids = [encoder_ids[s] for s in symbols]
        while True:
            best = min(((encoder.merges.get(p, bpe.NEVER), i)
                        for i, p in enumerate(zip(ids, ids[1:]))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                return ids
            i = best[1]
            ids[i:i + 2] = [encoder_ids[encoder.tokens[ids[i]] + encoder.tokens[ids[i + 1]]]]

    encoder_ids = {w: i for i, w in encoder.tokens.items()}
    r = random.Random(7)
    inner = [i for i, w in encoder.tokens.items() if ord(w[-1]) < bpe.MARK]
    for _ in range(3000):
        a, b = r.choice(inner[:3000]), r.choice(inner[:3000])
        assert encoder.compatible(a, b) == \
            (merged(encoder.tokens[a] + encoder.tokens[b]) == [a, b])


def test_encoding_frames(edge, no_rows, library, encoder):
    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digest(edge).collect()}
    for doc_id, text, *_ in edge.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id, len(ids)]
        assert r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    back = bpe.decode(bpe.encode(edge)).where("doc_id = 5").collect()
    assert [r.decoded for r in back] == [encoder.decode(r.ids) for r in back]
    assert bpe.digest(no_rows).collect() == [] and bpe.encode(no_rows).collect() == []


# ------------------------------------------------------------ quality rules

def plain_measures(t):
    t = t or ""
    w = re.findall(r"[^ \t-\r]+", t)
    n = len(w)
    windows = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    repeated, covered, longest = [0] * n, [0] * n, [0] * n
    for i in range(n - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            repeated[i:i + 3] = [1] * 3
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
        if longest[i] >= quality_rules.MIN_REPEAT:
            covered[i:i + longest[i]] = [1] * longest[i]
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            sum(repeated), sum(covered), max([x for x in longest if x >= 3], default=0))


def test_quality_measures_against_brute_force():
    r = random.Random(5)
    cases = [None, "", " ", "a", "a a a a a a a a", "a b c a b c", "x y z " * 30]
    for _ in range(300):
        k = r.choice([2, 3, 6, 20])
        t = "".join(r.choice("abcdefghijklmnopqrstuvé#"[:k + 2]) +
                    r.choice([" ", "\n", "  ", "\t", " ", " \x1c"])
                    for _ in range(r.randint(0, 90)))
        cases.append(t + t[:r.randint(0, 60)] if r.random() < .5 else t)
    m = quality_rules.measures(cases)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered",
             "longest_repeat")
    for i, t in enumerate(cases):
        want = plain_measures(t)
        assert tuple(int(m[k][i]) for k in names) == want, t
        base = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert m["base_failed"][i] == base
        assert m["kept"][i] == (not base and want[5] <= .3 * want[0] and
                                (want[6] < 5 or want[6] <= .2 * want[0]))


def test_quality_edges(edge, no_rows):
    got = quality_rules.score(edge).collect()
    assert len(got) == edge.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id not in (7, 8))
    assert all(r.n_words == 120_000 for r in got if r.doc_id in (7, 8))
    assert quality_rules.score(no_rows).collect() == []


# ----------------------------------------------------------------- language

def plain_top(words, n):
    counts = Counter()
    for w in words:
        s = f" {w} "
        counts.update(c for c in w)
        counts.update(s[i:i + 2] for i in range(len(s) - 1))
        counts.update(s[i:i + 3] for i in range(len(s) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]


def test_profiles_and_predictions_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = langid.fit(docs)
    profiles = {lang: plain_top([w for r in rows if r.lang == lang
                                 for w in langid.letter_words(r.text)], langid.PROFILE)
                for lang in {r.lang for r in rows}}
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert learned == {k: list(map(code, v)) for k, v in profiles.items()}
    got = {r.doc_id: r for r in langid.identify(docs, learned, [docs.doc_id]).collect()}
    for r in rows[:60]:
        top = plain_top(langid.letter_words(r.text), langid.PROFILE)
        distance = {k: sum(abs(v.index(g) - i) if g in v else langid.PROFILE
                           for i, g in enumerate(top)) for k, v in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 - distance[best] / langid.PROFILE / len(top))


def test_held_out_accuracy(spark):
    got = langid.op9_language_id(spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").collect()
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > .97


def test_language_edges(spark, edge, no_rows):
    learned = langid.fit(edge)
    got = langid.identify(edge, learned, [edge.doc_id]).collect()
    assert len(got) == edge.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 9))
    assert langid.fit(no_rows) == {}
    assert langid.identify(no_rows, {}, [no_rows.doc_id]).collect() == []
    assert {r.lang_pred for r in langid.identify(edge, {}, [edge.doc_id]).collect()} == {"und"}
    kept = langid.pipeline_stage(spark, edge, SF001)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 9})
    assert kept.where("lang is null").count() == 0
