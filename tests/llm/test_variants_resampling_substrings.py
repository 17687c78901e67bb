"""op11 to op13 against slow restatements of their rules, on small tables with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from pagequarry.llm import crc, resampling, spelling, substring_dedup
from pagequarry.llm.fm_index import FMIndex

EXTRA = "doc_id long, text string, word string, n long, key long, anchor long, rank long, _at long, _row long, score string"


def table(spark, rows):
    """Rows of id and text with further columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, 5, 6, "s") for i, t in rows], EXTRA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- op11

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            code = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and code % 31 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    out = {}
    for w, k in n.items():
        near = sorted((-n[x], x.encode()) for x in n if one_edit(w, x))
        form = near[0][1].decode() if near and -near[0][0] >= 10 * k else None
        out[w] = [form, k, len(near), -near[0][0] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def grouped(spark, rows):
    got = spelling.spelling_groups(table(spark, rows)).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in got}


def test_spelling_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    base = ["Straßenbahn", "naïveté-less", "abcdefg", "aaaaaaaa", "aaaaaaab", "überholt", "encyclopædia", "x" * 400]
    text = []
    for w in base:
        letters = [*w]
        for times in (120, 11, 10, 2, 2, 1):
            text += ["".join(letters)] * times
            letters = [*w]
            for _ in range(rnd.randrange(1, 3)):
                i = rnd.randrange(len(letters))
                letters[i:i + 1] = rnd.choice([[], [rnd.choice("abcäß")], [letters[i], rnd.choice("abcäß")]])
    # A chain, each one letter from the next.
    text += ["chainedword"] * 3000 + ["chainedwrd"] * 200 + ["chainedwr"] * 14
    rnd.shuffle(text)
    rows = [(i, " ".join(text[i::40])) for i in range(40)]
    rows += [(None, "Straßenbahn STRASSENBAHN straßenbahN"), (3, None), (4, ""), (5, "short a ÀÁÂÃÄÅÆ×÷ àáâãäåæ"), (5, "ÀÁÂÃÄÅÆ×÷"), (7, "ÀÁÂÃÄÅÆ×÷"), rows[0], rows[0]]
    want = brute_words(rows)
    got = grouped(spark, rows)
    assert got == want
    assert got["chainedwr"][::4] == ("chainedwrd", "chainedword") and sum(r[0] is not None for r in got.values()) > 5


def test_spelling_ties_and_empty(spark):
    rows = [(1, " ".join(["aaaaaaac"] * 20 + ["aaaaaaab"] * 20 + ["aaaaaaa"] * 2))]
    want = brute_words(rows)
    assert grouped(spark, rows) == want
    assert grouped(spark, []) == {}


def test_signatures_meet_for_every_edit():
    rnd = random.Random(1)
    for _ in range(300):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randrange(7, 14)))
        i = rnd.randrange(len(w))
        near = rnd.choice([w[:i] + w[i + 1:], w[:i] + "f" + w[i + 1:], w[:i] + rnd.choice("abcdef") + w[i:]])
        if len(near) >= 7:
            a, b = spelling.signature_array([w, near])
            assert set(a.tolist()) & set(b.tolist()), (w, near)


# ---- op12

def test_crc_equals_zlib():
    rnd = random.Random(2)
    words = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 7, 8, 63, 64, 65, 200] * 3]
    data = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    found = crc.crcs(data, start, end)
    assert found.tolist() == [zlib.crc32(w) for w in words]
    joined = crc.joined_by_space(found[:-1], found[1:], data, start[1:], end[1:])
    assert joined.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def test_buckets_of_texts():
    texts = ["Hello, Wörld foo2 \x00bar", "", None, "a" * 100 + " b " + "é" * 70 + " c", "K ÀB İ  vier", "one two " * 20000]
    split = pre_tokenizers.Split(Regex(resampling.BETWEEN), "removed")
    n_words, n_features, found = resampling.feature_buckets(split, pa.array(texts), 10000)
    want = [brute_features(t) for t in texts]
    assert [(n, len(f)) for n, f in want] == list(zip(n_words.tolist(), n_features.tolist(), strict=True))
    assert found.tolist() == [b for _, f in want for b in f]


def brute_resampled(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(brute_features(text)[1])
    for _, text in target:
        t.update(brute_features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        n, f = brute_features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2]))
    for k, r in enumerate(enough[:25 * len(enough) // 100]):
        r[5] = k + 1
    return sorted((repr((r[0], r[1], r[2], r[3], r[5])) for r in out))


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(50)] + ["Ärger", "K2", "it's"]
    docs = [(i % 70, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for i in range(200)]
    docs += [(None, None), (None, "x " * 25), (7, ""), (8, "w1 w2 " * 50_000)] + [(9, "w3 w4 " * 15)] * 60
    target = [(i, " ".join(rnd.choices(words[:9], k=12))) for i in range(20)] + [(1, None), (None, "")]
    for goal in (target, []):
        got = resampling.resample(table(spark, docs), table(spark, goal)).collect()
        assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == brute_resampled(docs, goal)
    assert resampling.resample(table(spark, []), table(spark, target)).count() == 0


# ---- op13

def brute_kept(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append(repr((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def planted(rnd):
    words = [f"w{k}" for k in range(400)] + ["Ärger", "K,", "x y", "the", "the"]
    passages = [rnd.choices(words, k=n) for n in (12, 13, 14, 40, 200)]
    docs = []
    for i in rnd.sample(range(1000), 60):
        w = rnd.choices(words, k=rnd.randrange(0, 80))
        for _ in range(rnd.randrange(0, 3)):
            p, at = rnd.choice(passages), rnd.randrange(len(w) + 1)
            w[at:at] = p[rnd.randrange(0, 3):]
        docs.append((i, rnd.choice([" ", "\n", "\t  "]).join(w)))
    docs += [(i + 2000, t) for i, t in docs[:10]] + [docs[3], docs[3], (docs[4][0], docs[5][1])]  # copies, repeated rows, an id twice
    docs += [(None, docs[0][1]), (1, None), (2, ""), (3, "the " * 3000), (4, "The " + "the " * 500), (5, " \t")]
    return docs


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "small": 0, "longest": 2, "shard_words": 50}, {"gram": 13}, {"gram": 1, "hot": 1}])
def test_repeats_equal_brute_force(spark, settings):
    docs = planted(random.Random(11))
    got = substring_dedup.drop_repeats(table(spark, docs), **settings).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_kept(docs, 13)


def test_repeats_of_few_words(spark):
    rnd = random.Random(12)
    docs = [(i, " ".join(rnd.choices("ab", k=rnd.randrange(0, 30)))) for i in range(40)]
    got = substring_dedup.drop_repeats(table(spark, docs), window=5, gram=2, longest=3, shard_words=40).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_kept(docs, 5)
    assert substring_dedup.drop_repeats(table(spark, [])).count() == 0


def test_long_text_and_many_copies(spark):
    body = " ".join(f"t{k}" for k in range(100_000))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.lit(body)).otherwise(F.lit(body[:2000])).alias("text"))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(docs, hot=50).collect()}
    n = len(body[:2000].split())
    assert got[0] == (100_000, 0) and got[1][0] == n and n - got[1][1] <= 1  # its last word may be cut
    assert all(got[i] == (n, n) for i in range(2, 300))


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        depth, letters = int(rng.integers(1, 14)), int(rng.integers(1, 6))
        held = [rng.integers(1, letters + 1, rng.integers(0, 20)).tolist() for _ in range(rng.integers(0, 12))]
        symbols = np.array([x for s in held for x in [*s, 0]], np.int64)
        index = FMIndex(symbols, depth)
        asked = [rng.integers(1, letters + 2, rng.integers(0, 20)).tolist() for _ in range(8)] + held
        size = np.array([len(p) for p in asked])
        begin = np.cumsum(size) - size
        length, row = index.matching_statistics(np.minimum(np.array([x for p in asked for x in p], np.int64), index.sigma), begin, size)
        parts = {tuple(s[i:j]) for s in held for i in range(len(s)) for j in range(i + 1, min(len(s), i + depth) + 1)}
        for p, at in zip(asked, begin, strict=True):
            for i in range(len(p)):
                n = max((k for k in range(min(depth, len(p) - i) + 1) if not k or tuple(p[i:i + k]) in parts))
                assert length[at + i] == n
                if n:
                    place = index.rows[row[at + i]]
                    assert symbols[place:place + n].tolist() == p[i:i + n]
