import random
import re

import pytest

from pathloom.llm import repetition


def brute(text, least_words=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    covered = {p for i, k in enumerate(longest) if k >= least_words for p in range(i, i + k)}
    windows = {}
    for i in range(n - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(covered), max(longest, default=0))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def test_measures_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        texts = ["".join(rng.choice(["a ", "b ", "c\n", "dd ", "# ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        texts.append(texts[0])  # a repeat in another text is none
        got = repetition.measure(texts, 8)
        assert [tuple(got[n][i] for n in NAMES) for i in range(4)] == [brute(t) for t in texts]


def test_query_and_verdict(spark, sf_dir):
    from pathloom.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_suffix_repetition(spark, sf_dir).collect():
        if len(texts[r["doc_id"]]) > 4000:
            continue
        want = brute(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and want[5] <= 0.2 * want[0] and want[6] <= 100)


def test_clean_prose_stays_and_loops_go(spark):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300))
    rows = [(1, prose), (2, prose + "\n" + prose), (3, "same line of ten words that comes again and again\n" * 30), (4, "spam " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in repetition.repetition(df).collect()} == {1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("segment_chars", [10, 2_000_000])
def test_odd_documents(odd_docs, no_docs, segment_chars):
    got = repetition.repetition(odd_docs, segment_chars=segment_chars).collect()
    small = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 5000]
    have = sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in got if r["doc_id"] != 7), key=str)
    assert have == sorted(((i, *brute(t)) for i, t in small), key=str)
    assert next(r for r in got if r["doc_id"] == 4)["base_failed"]
    assert repetition.repetition(no_docs).count() == 0


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "b c d"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_words"]) for r in repetition.repetition(df).collect()} == {("a", 3), (None, 0)}
