"""The pipeline's stages, each against what its operator finds in its input."""

import base64
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)

from quarry.llm import bpe, common, decontam, jaccard, langid, suffix_dedup

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = common.staged(stage(spark, docs, SF001))
        assert kept[name].columns == docs.columns
        if name == "language_id":
            learned = langid.fit(docs)
            least = langid.thresholds(docs, learned)
            seen = langid._identify(docs, learned, [docs.doc_id])
            good = {r.doc_id for r in seen.collect() if r.lang_pred != "und"
                    and r.score >= least[r.n_grams.bit_length() - 1]}
            assert {r.doc_id for r in kept[name].collect()} == good
        elif name == "ngram_jaccard_join":
            groups = {}
            for r in jaccard.join(docs).collect():
                groups.setdefault(r.class_id, set()).add(r.doc_id)
            left = {r.doc_id for r in kept[name].collect()}
            assert all(len(left & g) == 1 for g in groups.values())
            assert len(left) == len(groups) < docs.count()
        elif name == "suffix_array_dedup":
            cut = {r.doc_id: (r.kept.decode("utf-8", "ignore"), r.removed)
                   for r in suffix_dedup.dedup(docs).select("doc.doc_id", "kept", "removed")
                   .collect()}
            left = {r.doc_id: r for r in kept[name].collect()}
            for i, (text, removed) in cut.items():
                if i in left:
                    assert left[i].text == text and left[i].n_chars == len(text)
                else:
                    assert removed and not text.strip()
        else:
            hit = {r.doc_id for r in decontam.find(docs, bench).collect() if r.n_hit}
            assert {r.doc_id for r in kept[name].collect()} == \
                {r.doc_id for r in docs.collect()} - hit
        docs = kept[name]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert rows(last) == rows(bpe.encode(docs))
    assert rows(corpus_pipeline.run(spark, SF001)) == rows(last)


def test_stages_take_no_rows_and_odd_rows(spark, edge, no_rows):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_rows, SF001).collect() == []
        edge = common.staged(stage(spark, edge, SF001))
    left = corpus_pipeline.STAGES[-1][1](spark, edge, SF001).collect()
    assert {r.doc_id for r in left} <= {None, 4, 5, 7}


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}
    assert "pipeline" in names


def test_unlike_texts_under_one_id_stay(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    texts = [(1, a), (1, b), (1, a), (2, a), (2, c), (3, b + " b60"), (4, c), (5, ""), (5, "--"),
             (5, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = rows(jaccard.pipeline_stage(spark, docs, SF001))
    assert kept == sorted([(1, a), (1, b), (2, c), (5, ""), (5, "--"), (None, a), (None, a)],
                          key=repr)


def test_a_contaminated_row_takes_no_other_along(spark):
    """Ids that are null, or that clean texts have too."""
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").orderBy(F.length("text").desc()).first()
    bad = f"before it {item.text} and after it"
    clean = " ".join(f"clean{i}" for i in range(40))
    texts = [(None, bad), (None, clean), (None, None), (5, bad), (5, clean), (6, ""), (7, bad),
             (7, bad), (8, clean)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = rows(decontam.pipeline_stage(spark, docs, SF001))
    assert kept == sorted([(None, clean), (None, None), (5, clean), (6, ""), (8, clean)], key=repr)


def test_thresholds_grow_with_the_scores_of_a_size(spark, monkeypatch):
    """No number of scores switches a threshold on."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    learned = langid.fit(docs)
    found = []
    for part in (8, 4, 2, 1):
        sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
        found.append(langid.thresholds(sample, learned))
    assert all(langid.MIN_SCORE <= x < 1 for v in found for x in v)
    middle = [v[6] for v in found]
    assert middle[0] > langid.MIN_SCORE and max(map(abs, np.diff(middle))) < 0.15


PROSE = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni "
              "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille "
               "on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden "
               "hengessä."}


def test_language_stage_rejects_junk_and_unlearned_languages(spark):
    rnd, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    raw = bytes(rnd.randrange(256) for _ in range(900))
    texts = [*PROSE.values(), raw.hex(" ", 4), base64.b64encode(raw).decode(), *(
        " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n))
        for n in (20, 40, 200, 1000))]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    junk = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    mixed = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r.doc_id for r in langid.pipeline_stage(spark, mixed, SF01).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
    # beginnings of clean texts stay as well
    cut = docs.select(F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 12)).alias("text"),
                      F.lit(None).cast("string").alias("lang"), (-F.col("doc_id") - 9).alias("doc_id"))
    kept = langid.pipeline_stage(spark, docs.select("doc_id", "text", "lang").unionByName(cut), SF01)
    lost = cut.join(kept, "doc_id", "left_anti").collect()
    assert len(lost) <= 0.002 * docs.count()
