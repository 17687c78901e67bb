"""Licences, passages, toxicity, URLs, BPE, personal data and language model against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagequarry.llm import bpe, class_lm, decontaminate, license_scan, pii, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, row long, word string"
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def frame(spark, texts, start=0):
    rows = [(start + i, t, None, 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "row without an id", None, None, None)], SCHEMA).repartition(3)


def rows_of(texts, start=0):
    rows = [(start + i, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "row without an id")]


AWKWARD = [None, "", "   \n", "é 😀 ß", "w " * 20_000, "x" * 40_000]


# ------------------------------------------------------------------ licences

def test_licences_equal_brute_force(spark):
    rng = random.Random(1)
    filler = ["the", "of", "under", "license", "mit", "cc", "by", "nc", "version", "2", "alpha", "Größe", "rights"]
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc cc by nc cc by nc",
               "This work is licensed under the GNU General Public License, version 3.", "All Rights Reserved", "under THE mit-license"]
    texts = AWKWARD + [" ".join(rng.choices(filler, k=rng.randint(0, 30)) + [rng.choice(notices)] * rng.randint(0, 2)
                                + rng.choices(filler, k=rng.randint(0, 9))) for _ in range(80)]
    got = license_scan.scan_licenses(frame(spark, texts)).collect()
    want = collections.Counter()
    for d, t in rows_of(texts):
        w, at, labels = words_of(t), [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    text = dict(rows_of(texts))
    assert all(("gpl-3" in r.labels) == ("gnu general public license version 3" in " ".join(words_of(text[r.doc_id]))) for r in got)
    assert any("gpl-3" in r.labels for r in got) and license_scan.scan_licenses(frame(spark, ["a"]).limit(0)).count() == 0


# ------------------------------------------------------------------ benchmark passages

def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_edit_distance_equals_brute_force():
    rng = random.Random(3)
    patterns, pairs = [], []
    for _ in range(300):
        p, t = ("".join(rng.choices("abcé", k=rng.randint(a, b))) for a, b in ((1, 200), (0, 250)))
        patterns.append(p)
        pairs.append((len(patterns) - 1, t))
    # Edges of the 64-bit words, an empty pattern, letters beyond 16 bits, a pattern in many texts.
    for n in (63, 64, 65, 128, 129):
        patterns.append("a" * n)
        pairs += [(len(patterns) - 1, t) for t in ("a" * n, "a" * (n - 1), "b" * n, "b" + "a" * n + "b", "")]
    patterns += ["", "a\U0001f600b"]
    pairs += [(len(patterns) - 2, "abc"), (len(patterns) - 1, "xa\U0001f600bx"), (len(patterns) - 1, "ab"), (0, patterns[0] * 2)]
    expected = [brute_distance(patterns[k], t) for k, t in pairs]
    assert decontaminate.edit_distances(patterns, pairs).tolist() == expected


def test_edited_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "in", "to"] * 12 + [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rn", "lt", "sh", "ng")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, prose(rng.randint(15, 50))) for k in range(40)] + [(90, "short exact item"), (91, ""), (92, None), (93, "---")]
    texts, truth = list(AWKWARD), set()
    for k, item in items[:40]:
        w = item.split()
        for rate in (0, 0.08):
            edited = [x if rng.random() > rate else rng.choice(["", "zz", x.upper() + "!"]) for x in w]
            texts.append(prose(60) + "\n" + " ".join(edited) + " - " + prose(40))
            truth.add((len(texts) - 1, k))
    texts += ["a Short, exact ITEM here", "short inexact item", *[prose(200) for _ in range(40)]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.benchmark_passages(docs, benchmark, block_words=300).collect()}
    assert len(truth - set(got)) <= 1  # the recall aimed at
    joined = {d: " ".join(words_of(t)) for d, t in rows_of(texts)}
    for (d, k), edits in got.items():
        form = " ".join(words_of(dict(items)[k]))
        assert edits == brute_distance(form, joined[d][:3000]) <= 0.2 * len(form)
    assert [k for k in got if k[1] >= 90] == [(len(AWKWARD) + 80, 90)]
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows_of(texts) if d not in {x for x, _ in got})


# ------------------------------------------------------------------ toxicity

def test_toxicity_learns_and_ignores_identity_terms(spark):
    rng = random.Random(2)
    plain = [f"n{k}" for k in range(80)]
    texts, labels = [], []
    for k in range(900):
        bad = rng.random() < 0.4
        w = rng.choices(plain, k=rng.randint(5, 25)) + (rng.choices(["idiot", "scum"], k=2) if bad else [])
        if rng.random() < (0.8 if bad else 0.1):
            w.append("muslim")
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    texts += ["a neutral note on a muslim family", "a neutral note on a christian family"] + AWKWARD
    docs = frame(spark, texts)
    table = spark.createDataFrame([*labels, labels[0], (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k, _ in labels)
    assert np.mean([got[k].predicted == dict(labels)[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    free = toxicity.train(docs, table, strength=0.0)
    tied = toxicity.train(docs, table, strength=3.0)
    gap = {}
    for name, model in (("free", free), ("tied", tied)):
        s = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
        gap[name] = abs(math.log(s[900] / (1 - s[900])) - math.log(s[901] / (1 - s[901])))
    assert gap["tied"] < 0.5 * gap["free"]
    kept = toxicity.drop_toxic(docs, tied)
    assert kept.columns == docs.columns and None in {r.doc_id for r in kept.collect()}
    none = toxicity.toxicity(docs, table.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and toxicity.toxicity(docs.limit(0), table).count() == 0


# ------------------------------------------------------------------ URLs

def test_urls_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["x.com", "m.X.com", "www.example.org", "a.example.org", "notexample.org", "org", "h.net", "casino.h.net"]
    paths = ["", "/", "/fr/1", "/de/2", "/es/3", "/en/1", "/en/12?q=/de/", "/p/#f", "/p"]
    urls = [None, "", "no scheme/fr/", "http://", "a://b://c/fr/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    listed = {"h.net/p", "casino.h.net/p", "x.com/p", "example.org/p"}
    got = url_filter.judge_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, canonical string"),
                                spark.createDataFrame([(u,) for u in [*listed, None]], "canonical string")).collect()
    assert len(got) == len(urls)
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        hit = re.sub(r"^(www|m)\.", "", host) + path.rstrip("/") in listed
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == (host, path, rule, verdict or ("block" if hit else "allow"), hit)


def test_the_bloom_filter_passes_every_listed_url(spark):
    listed = spark.range(5000).selectExpr("concat('u', id) AS u")
    both = spark.range(20_000).selectExpr("concat('u', id) AS u")
    assert url_filter.listed_urls(both, listed, "u").count() == 5000
    assert url_filter.listed_urls(both, listed.limit(0), "u").count() == 0


# ------------------------------------------------------------------ BPE

def test_bpe_equals_the_library_and_round_trips(spark):
    library = Tokenizer.from_file(BPE_PATH)
    rng = random.Random(6)
    texts = AWKWARD + ["<|endoftext|>", "a<|endoftext|> b", "don't we'll I'M", "日本語 テキスト ½ ²", " " * 40 + "a", "\r\n\r\nx\t", "ab" * 900]
    texts += ["".join(rng.choices(["the ", "of", " and", "é", "\n", "42", "!?", "Ärger", " x", "  "], k=60)) for _ in range(60)]
    docs = frame(spark, texts)
    for size in (0, 20, 5000):  # the ids do not depend on the transducer
        got = collections.Counter(map(tuple, bpe.encode_documents(docs, BPE_PATH, size).collect()))
        want = collections.Counter()
        for d, t in rows_of(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert got == want
    sent = bpe.build_lexicon(docs, BPE_PATH, 50)
    back = collections.Counter(map(tuple, bpe.decode_ids(bpe.encode_ids(docs, sent), sent).collect()))
    assert back == collections.Counter((d, t or "") for d, t in rows_of(texts))
    assert bpe.encode_documents(docs.limit(0), BPE_PATH).count() == 0


def test_every_code_point_is_split_as_in_the_library():
    library, vocabulary = Tokenizer.from_file(BPE_PATH), bpe.Vocabulary(BPE_PATH)
    for base in range(0, 0x110000, 512):
        text = "".join(f"a{c}1 {c}b {c}{c}." for c in map(chr, range(base, base + 512)) if not 0xD800 <= ord(c) <= 0xDFFF)
        assert [i for w in vocabulary.split(text) for i in vocabulary.merge(w.encode())] == library.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_exact():
    words = {b"stop": [1], b"stops": [2, 3], b"top": [4], b"tops": [5], b"s": [], b"st\xc3\xb6p": [7]}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(words))
    places = lexicon.find([*words, b"sto", b"", b"stopss", b"x"])
    assert (places[len(words):] == -1).all() and len(set(places[:len(words)].tolist())) == len(words)
    ids, counts = lexicon.take(places[:len(words)])
    assert ids.tolist() == [i for w in words.values() for i in w] and counts.tolist() == [len(w) for w in words.values()]
    accepted = {(tuple(sorted(w[k:] for w in words if w.startswith(p)))) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(lexicon.ends) == len(accepted)  # one state per set of endings
    assert bpe.Lexicon(np.frombuffer(bpe.Lexicon.compile({}), np.uint8)).find([b"a"]).tolist() == [-1]


def test_merging_side_by_side_equals_one_by_one():
    rng = random.Random(1)
    vocabulary = bpe.Vocabulary(BPE_PATH)
    words = [bytes(rng.choices(range(256), k=rng.randint(1, 40))) for _ in range(2000)] + [b"a" * k for k in range(1, 60)] + [b"", b"ab" * 900]
    words += ["".join(rng.choices([" the", "ing", "er", "é", "zz"], k=4)).encode() for _ in range(500)]
    ids, counts = vocabulary.merge_many(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [vocabulary.merge(w) for w in words]


# ------------------------------------------------------------------ personal data

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and check, 8 <= len(d) <= 15][kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_personal_data_base_equals_brute_force(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "@", ".", "+", "1", "22", "255", "256", " ", "-", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "x", "_", "é", "😀",
              "10.0.0.1", "+1 (555) 123-4567", "\n", "%"]
    texts = AWKWARD + ["a@b.c@d.e", "a@b-c.d_e@f.g", "1.2.3.4.5.6.7.8", "0.00.000.0000", "9" * 3000, "1." * 3000, "a" * 9000 + "@b.c", "+1((((" * 50,
                       "call 555-123-4567; joe (at) example (dot) com"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)]
    got = pii.personal_data(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    text = dict(rows_of(texts))
    for r in got:
        base = base_spans(text[r.doc_id] or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        every = [x for x in r.spans.split(",") if x]
        assert set(listed) <= set(every) and len(every) == len(set(every))
        added = [tuple(map(int, x.split(":")[1:])) for x in every if x not in listed]
        assert not any(a < e and s < b for a, b in added for _, s, e in base)
    assert pii.personal_data(frame(spark, ["a"]).limit(0)).count() == 0


def test_the_plan_of_personal_data_and_licences_is_native(spark):
    docs = frame(spark, ["a@b.c"])
    for plan in (pii.propose(docs), license_scan.scan_words(docs)):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())


# ------------------------------------------------------------------ language model

def test_class_model_scores_and_base(spark):
    rng = random.Random(9)
    groups = [[f"{g}{k}" for k in range(12)] for g in "abc"]
    texts = [" ".join(rng.choice(groups[(s + k) % 3]) for k in range(rng.randint(3, 40))) for s in range(250)] + AWKWARD + ["Only ONCE here"]
    rows = rows_of(texts)
    got = class_lm.score_documents(frame(spark, texts), words=37, classes=4, head=20).collect()
    tokens = lambda t: [*low(t).encode().split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for d, t in rows:
        w = tokens(t)
        want[d].append((held(d), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    assert len(got) == len(rows)
    for r in got:
        a = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == a[:4] and r.base_score == pytest.approx(a[4], rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    test = [r for r in got if r.held_out and 3 < r.n_tokens < 60]
    assert sum(r.score for r in test) > 0.75 * sum(r.base_score for r in test)  # the classes carry the order
    assert class_lm.score_documents(frame(spark, ["a"]).limit(0)).count() == 0


def test_class_scores_equal_a_plain_restatement(spark):
    from pyspark.sql import functions as F

    from pagequarry.llm.words import find_words, hash_words
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("r", "lt", "sh", "é")]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 25))) for _ in range(120)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    rows = list(enumerate(texts))
    # One held-out text a thousand times: its words are unknown, or rare where the model learns.
    hot = next(d for d in range(1000, 2000) if held(d))
    rows += [(hot, f"never seen {vocabulary[-1]} never {vocabulary[-2]}")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"words": 9, "classes": 3, "head": 12}
    model, counted = class_lm.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select("text"), **options)
    place = {int(h): k for k, h in enumerate(model.clustered)}
    assert 0 < len(place) <= 9 and 0 < len(model.head) <= 12 < counted.count()

    def kind(word):
        if word is None:
            return "end"
        own = int(hash_words(find_words(pa.array([word], pa.large_string())))[0])
        return int(model.of[place[own]]) if own in place else f"byte {word.encode()[-1] % class_lm.ENDINGS}"

    tokens = lambda t: [*low(t).split(), None]
    counts, steps = collections.Counter(), collections.Counter()
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
            steps.update(zip(["end", *map(kind, tokens(t))], map(kind, tokens(t))))
    before, after, types = collections.Counter(), collections.Counter(), collections.Counter(map(kind, counts))
    for (a, b), c in steps.items():
        before[a] += c
        after[b] += c
    size, total = options["classes"] + class_lm.ENDINGS + 1, sum(steps.values())

    def score(text):
        out, last = 0.0, "end"
        for w in tokens(text):
            k = kind(w)
            share = (after[k] + 1) / (total + size)
            out += math.log10((steps[last, k] + class_lm.PRIOR * share) / (before[last] + class_lm.PRIOR))
            out += 0.0 if w is None else math.log10((counts[w] + 1) / (after[k] + types[k] + 1))
            last = k
        return out

    got = class_lm.score_documents(docs, **options).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert r.score == pytest.approx(score(text[r.doc_id]), rel=1e-9, abs=1e-9)
        assert r.n_known == sum(counts[w] > 0 for w in tokens(text[r.doc_id]))


def test_class_model_is_a_distribution(spark):
    docs = frame(spark, [f"a b c{k % 7} d{k}" for k in range(40)])
    model, counts = class_lm.train(docs, words=6, classes=3)
    assert np.allclose((10 ** model.steps).sum(1), 1)
    table = counts.collect()
    place = {int(h): k for k, h in enumerate(model.clustered)}
    mass = collections.Counter()
    for r in table:
        if r.word == int(class_lm.END):
            continue
        unit = place.get(r.word % (1 << 64), len(place) + r.ending)
        mass[model.of[unit]] += (r.n + 1) / 10 ** model.places[model.of[unit]]
    for c, total in mass.items():  # what is left is the place of unknown words
        assert total + 1 / 10 ** model.places[c] == pytest.approx(1)


def test_exchange_finds_the_classes_of_a_cycle():
    rng = np.random.default_rng(1)
    words, kinds = 30, 3
    pairs = np.zeros((words + 2, words + 2), np.int64)
    for _ in range(20_000):
        a = rng.integers(0, words)
        pairs[a, (rng.integers(0, words // kinds) * kinds + (a + 1) % kinds)] += 1
    of = class_lm.exchange(pairs, words, kinds)
    assert len({(k % kinds, of[k]) for k in range(words)}) == kinds and of[words:].tolist() == [3, 4]


def test_every_word_moves_to_its_best_class(spark):
    from pagequarry.llm.words import find_words, hash_words
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdkm" for b in "aeiou" for c in ("r", "lt", "sh", "é")]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 30))) for _ in range(150)]
    texts += ["echo echo echo bar", "echo echo", None, "seen once", "kept twice kept twice"]
    tokens = lambda t: [*low(t).split(), None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model, counted = class_lm.train(docs, classes=4, head=20, core=9)
    number = lambda w: int(hash_words(find_words(pa.array([w], pa.large_string()))).view(np.int64)[0])
    table = {r.word: r for r in counted.collect()}
    counts = collections.Counter(w for t in texts for w in tokens(t))
    assert len(table) == len(counts) and all(table[number(w) if w else 1].n == n for w, n in counts.items())
    assert all(table[number(w)].kind < 4 for w in counts if w)  # none is left in the class of its last byte
    core = {int(h) for h in model.clustered.view(np.int64)}
    start = {w: "end" if w is None else table[number(w)].kind if number(w) in core else f"byte {w.encode()[-1] % class_lm.ENDINGS}" for w in counts}
    pairs = collections.Counter((a, b) for t in texts for a, b in zip([None, *tokens(t)], tokens(t)))

    def likelihood(of):
        cells, rows, cols = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            cells[of[a], of[b]] += n
            rows[of[a]] += n
            cols[of[b]] += n
        return sum(n * math.log(n) for n in cells.values()) - sum(n * math.log(n) for c in (rows, cols) for n in c.values())
    moved = [w for w in counts if w and number(w) not in core]
    assert 50 < len(moved) == len(counts) - 1 - 9
    for w in moved:
        each = [likelihood({**start, w: k}) for k in range(4)]
        assert each[table[number(w)].kind] == pytest.approx(max(each), abs=1e-7)


def test_scores_with_all_words_clustered_equal_a_plain_restatement(spark):
    from pagequarry.llm.words import find_words, hash_words
    rng = random.Random(13)
    groups = [[f"{g}{k}x" for k in range(150)] for g in "abc"]  # all end alike: only a class tells the groups apart
    texts = [" ".join(rng.choice(groups[(s + k) % 3]) for k in range(rng.randint(0, 60))) for s in range(400)]
    texts += [None, "", "never", "b1x Never met before c1x"] + [f"onlyhere{k}y a1x" for k in range(30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    learned = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string")
    options = {"classes": 6, "head": 40, "core": 30}
    model, counted = class_lm.train(learned, **options)
    table = {r.word: r for r in counted.collect()}
    number = lambda w: int(hash_words(find_words(pa.array([w], pa.large_string()))).view(np.int64)[0])
    tokens = lambda t: [*low(t).split(), None]
    end = options["classes"] + class_lm.ENDINGS

    def kind(w):
        if w is None:
            return end
        known = table.get(number(w))
        return known.kind if known else int(model.of[len(model.clustered) + w.encode()[-1] % class_lm.ENDINGS])
    steps = collections.Counter((a, b) for d, t in rows if not held(d) for a, b in zip([end, *map(kind, tokens(t))], map(kind, tokens(t))))
    before, after, types = collections.Counter(), collections.Counter(), collections.Counter(r.kind for r in table.values())
    for (a, b), n in steps.items():
        before[a] += n
        after[b] += n
    total = sum(steps.values())
    got = class_lm.score_documents(docs, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        want, last = 0.0, end
        for w in tokens(texts[r.doc_id]):
            k, n = kind(w), table[number(w)].n if w and number(w) in table else 0
            share = (after[k] + 1) / (total + end + 1)
            want += math.log10((steps[last, k] + class_lm.PRIOR * share) / (before[last] + class_lm.PRIOR))
            want += 0.0 if w is None else math.log10((n + 1) / (after[k] + types[k] + 1))
            last = k
        assert r.score == pytest.approx(want, rel=1e-9, abs=1e-9)
    test = lambda rows: sum(r.score for r in rows if r.held_out and r.n_tokens > 20)
    few = class_lm.score_documents(docs, words=30, classes=6, head=40).collect()
    assert test(got) > 0.97 * test(few)  # the rare words' classes carry the order


def test_every_notice_of_a_file_is_looked_up(spark):
    from pagequarry.llm import license_scan
    gpl = "this work is licensed under the GNU general public license version 3"
    four = f"licensed under the Apache license version 2 0 . licensed under cc by nc 4 0 . {gpl} . subject to the terms of the Mozilla public license v 2 0"
    rows = [(1, four), (2, f"free charge mozilla redistribution lesser isc fee unencumbered creative attribution 4 2 0 {gpl} words")]
    rows += [(k, gpl) for k in range(10, 60)] + [(k, "licensed under cc by nc 4 0") for k in range(60, 80)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "apache-2,cc-by-nc,gpl-3,mpl-2" and got[2] == "gpl-3" and got[10] == "gpl-3"


def test_a_key_phrase_of_one_word_is_found(spark):
    from pagequarry.llm import license_scan
    rows = [(1, "under the zlib terms"), (2, "no terms")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), [("zlib", "under the zlib terms", ("zlib",))])
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "zlib", 2: ""}


def test_licences_lower_case_only_ascii(spark):
    kelvin = "permission to use the wor\u212a under the mit licen\u017fe and UNDER THE MIT LICENSE"
    row = license_scan.scan_licenses(spark.createDataFrame([(1, kelvin)], "doc_id long, text string")).head()
    assert row.n_base == 1 and row.n_words == len(kelvin.split())


def test_frequent_words_take_all_of_a_count_or_none(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e", 1), ("f", 1)], "word string, n long")
    assert [sorted(bpe.frequent_words(counts, k)) for k in (0, 1, 2, 3, 5, 6)] == [[], ["a"], ["a"], ["a", "b", "c"], ["a", "b", "c"], [*"abcdef"]]
    assert bpe.frequent_words(counts.limit(0), 5) == []


def test_the_toxicity_sample_bounds_rows_that_are_there(spark):
    texts = [(i, f"text {i}") for i in range(100, 160)] + [(100, "text 100")] * 500 + [(101, f"other {k}") for k in range(300)] + [(None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 700)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    rows = toxicity.training_rows(docs, labels, 10_000).collect()
    assert len(rows) == len({(r.doc_id, r.text) for r in rows}) == len({(i, t) for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 5})


@pytest.mark.parametrize("words", [5, 6, 8, 12])
def test_short_items_with_one_edited_character_are_found(words):
    rng = random.Random(words)
    forms = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    items = [" ".join(rng.choices(forms, k=words)) for _ in range(150)]
    block = decontaminate.Items(list(range(150)), items, *decontaminate.repeats(0.99), 1)
    found = 0
    for i, text in enumerate(items):
        at = rng.randrange(len(text))
        doc = "before it all " + text[:at] + ("x" if text[at] != " " else "xx ") + text[at + 1:] + " and after it"
        batch = pa.record_batch({"doc_id": pa.array([i]), "text": pa.array([doc], pa.large_string())})
        found += any(r["item_id"] == i for out in decontaminate.scan(block, iter([batch])) for r in out.to_pylist())
    assert found >= 0.9 * len(items)
