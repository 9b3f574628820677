import zlib

import numpy as np

from pathloom.llm import langid, queries
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    import os

    import pytest

    sf_dir = "/root/testdata/sf0.01"
    if not os.path.exists(sf_dir):
        pytest.skip("no test tables here")
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98


def model():
    languages = ["aa", "bb"]
    words = {"the": 0, "der": 1}
    grams = {"sch": 2, "th": 3, "a": 4}
    table = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.2, 0.8], [0.7, 0.3], [0.5, 0.5]]))
    return langid.Model(languages, words, grams, table, 3)


def test_words_first_then_shorter_grams():
    m = model()
    assert m.predict("the", 1.0)[0] == "aa"
    assert m.backoff("schth") == (2,)  # the longest order that is known at all
    assert m.backoff("thx") == (3,)
    assert m.backoff("zzz") == ()
    assert m.predict("zzz", 1.0) == ("aa", 0.5)  # nothing known: equal, first in order
    assert np.allclose(m.scores("der der schth"), 2 * m.table[1] + m.table[2])
    for text in (None, "", "12 ² !"):
        assert m.predict(text, 1.0) == ("und", 0.0)


def test_odd_documents(spark, odd_docs, no_docs):
    fitted = langid.fit(odd_docs)
    assert fitted.languages == ["de", "en"]
    got = langid.identify(odd_docs, fitted).collect()
    assert len(got) == odd_docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 9)} == {"und"}
    kept = langid.confident(odd_docs, fitted, least_score=0.0)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["lang_pred"] != "und"}
    empty = langid.fit(no_docs)
    assert empty.languages == [] and langid.identify(no_docs, fitted).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty).collect()} == {"und"}
    assert langid.confident(no_docs, fitted).count() == 0


def test_fold_is_never_learned_from(spark):
    rows = [(i, "uniqueword" if zlib.crc32(str(i).encode()) % 5 == 0 else "common", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = queries.language_model(spark, docs)
    assert "common" in fitted.words and "uniqueword" not in fitted.words
    assert docs.filter(langid.held_out(F.col("doc_id"))).count() == sum("unique" in t for _, t, _ in rows)


def test_pipeline_keeps_short_texts(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    short = ["Thank you very much", "Good morning everyone", "Guten Morgen", "12 34 !", "", None, "\u6f22\u5b57"]
    extra = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(short)], docs.schema)
    stay = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf_dir).collect()}
    assert {i for i in stay if i >= 10_000} == {10_000, 10_001, 10_002}
    assert {r["doc_id"] for r in docs.collect()} <= stay


def brute_model(rows, orders=4, alpha=0.5):
    """Tables by plain counting: {order or 'word': {key: {language: log frequency}}}."""
    import math
    import re
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    for text, lang in rows:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            counts["word"][lang, word] += 1
            marked = f"<{word}>"
            for k in range(1, orders + 1):
                for i in range(len(marked) - k + 1):
                    counts[k][lang, marked[i : i + k]] += 1
    languages = sorted({lang for _, lang in rows})
    tables = {}
    for kind, found in counts.items():
        keys = {key for _, key in found}
        totals = {x: sum(found[x, key] + alpha for key in keys) for x in languages}
        tables[kind] = {key: [math.log((found[x, key] + alpha) / totals[x]) for x in languages] for key in keys}
    return languages, tables


def brute_predict(text, languages, tables, temper=0.1, orders=4):
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0
    total = np.zeros(len(languages))
    for word in words:
        if word in tables["word"]:
            total += tables["word"][word]
            continue
        marked = f"<{word}>"
        for k in range(min(orders, len(marked)), 0, -1):
            known = [tables[k][g] for i in range(len(marked) - k + 1) if (g := marked[i : i + k]) in tables[k]]
            if known:
                total += np.mean(known, axis=0)
                break
    share = np.exp(temper * (total - total.max()))
    return languages[int(share.argmax())], float(share.max() / share.sum())


def test_fit_and_scores_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    learned = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 5]
    languages, tables = brute_model(learned)
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = brute_predict(text, languages, tables)
        assert got[i]["lang_pred"] == want[0] and abs(got[i]["score"] - want[1]) < 1e-9, i


def test_each_language_keeps_its_own_words(spark):
    rows = [(i, " ".join("big" + chr(97 + j % 26) * (1 + j // 26) for j in range(50)), "aa") for i in range(20)] + [(100, "few rare words", "bb")]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=40)
    assert {"few", "rare", "words"} <= set(fitted.words) and len(fitted.words) == 43


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "the der"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model()).collect()} == {"a": "aa", None: "und"}
