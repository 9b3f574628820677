import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import suffix


def brute(rows, least):
    seen, texts = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + least] for p in range(len(b) - least + 1))
    out = []
    for i, b in texts:
        step = np.zeros(len(b) + 1, int)
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                step[p] += 1
                step[p + least] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, rows = [prose(80) for _ in range(4)], []
    for i in range(60):
        t = prose(rng.randint(5, 120))
        if rng.random() < 0.6:
            q = rng.choice(passages)
            a, k = rng.randint(0, len(q) // 2), rng.randint(0, len(t))
            t = t[:k] + q[a : a + rng.randint(150, 400)] + t[k:]
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in range(4)]
    return [*rows, (3, rows[5][1]), (3, rows[3][1]), (200, None), (201, ""), (202, "ab" * 400), (203, "a" * 700), (204, "x" * 200), (205, "xyz" * 90), (None, rows[1][1]), (None, "q" * 199)]


@pytest.mark.parametrize("options", [{}, {"very_common": 3}, {"very_common": 3, "run_entries": 20}, {"run_entries": 7, "owner_bytes": 500}])
def test_against_brute_force(spark, options):
    rows = planted(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffix.remove_repeats(df, **options).collect()]
    assert sorted(got, key=str) == brute(rows, 200)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = suffix.remove_repeats(odd_docs, with_kept=True)
    got = found.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 200)
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert suffix.remove_repeats(no_docs).count() == 0


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 103, n, np.uint8).tobytes() for n in (5000, 10, 900, 300, 2500)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def windows():
        found = {}
        for piece, ends, rows, shift in suffix._buffers(data, offsets, 200):
            _, place, first, last = suffix.anchors(piece, ends, 200, np.empty(0, np.uint64))
            text = np.searchsorted(ends, place, side="right")
            begins = np.concatenate([[0], ends[:-1]])
            for p, a, b, t in zip(place, first, last, text, strict=True):
                move = shift[t] - begins[t]
                for w in range(a, b + 1):
                    assert (rows[t], w + move) not in found
                    found[rows[t], w + move] = p + move
        return found

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(suffix, "BUFFER", 700)
    assert windows() == whole


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        runs, every = [], []
        for _ in range(rng.randint(1, 6)):
            entries = {(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 8))), b"L", 1, 2, 3) for _ in range(rng.randint(0, 6))}
            runs.append(suffix.build_run(list(entries)))
            every.append(sorted(e[0] for e in entries))
        order = list(suffix.merge([suffix.Run(b) for b in runs]))
        merged = [every[r][i] for r, i, _ in order]
        assert merged == sorted(x for run in every for x in run)
        before = b""
        for text, (_, _, shared) in zip(merged, order, strict=True):
            assert text[:shared] == before[:shared] and (shared in (len(text), len(before)) or text[shared] != before[shared])
            before = text


def test_groups_come_in_both_orders(monkeypatch):
    monkeypatch.setattr(suffix, "GRAM", 3)
    rng = random.Random(4)
    some = lambda most: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, most)))
    for _ in range(100):
        runs = [[(bytes(rng.choice(b"ab") for _ in range(3)) + some(3), some(4), r, 0, i) for i in range(rng.randint(0, 12))] for r in range(rng.randint(1, 4))]
        spans = {}
        blobs = [suffix.build_run(list(run), spans) for run in runs]
        distinct = [sorted({e[:2] for e in run}) for run in runs]
        assert sum(len(v) // 2 for v in spans.values()) == sum(map(len, runs)) - sum(map(len, distinct))
        seen = []
        for members, shared, ordered, left_shared in suffix.merged_groups([suffix.Run(b) for b in blobs]):
            texts = [distinct[r][i] for r, i in members]
            assert sorted(members) == sorted(ordered) and len({t[0][:3] for t in texts}) == 1
            assert [t[0] for t in texts] == sorted(t[0] for t in texts)
            lefts = [distinct[r][i][1] for r, i in ordered]
            assert lefts == sorted(lefts)
            for values, counts in (([t[0] for t in texts], shared), (lefts, left_shared)):
                for a, b, n in zip(values, values[1:], counts[1:], strict=False):
                    assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])
            seen += [m for m in members]
        assert len(seen) == len(set(seen))


def test_ids_of_any_type(spark):
    text = "".join(chr(97 + i % 23) for i in range(300))
    df = spark.createDataFrame([("a", text), ("b", "x" + text), (None, "short")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix.remove_repeats(df).collect()} == {("a", 300), ("b", 300), (None, 0)}
