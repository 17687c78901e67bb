"""Shards, near and exact duplicates against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from pagequarry.llm import exact_dedup, sharding, simhash
from pagequarry.llm.common import components

SCHEMA = "doc_id long, text string, lang string, digest string, shard string"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def awkward():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Über", "ÉTÉ", "Z"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)]
    for _ in range(150):  # near copies of copies
        w = rng.choice(texts).split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["Hot copy of a passage that very many rows share"] * 90 + ["hot COPY of a passage that very many rows share"] * 9
    texts += [None, "", "  \t\n", "one", "two words", "now three words", "x" * 30_000, "long text " * 6000]
    rng.shuffle(texts)
    rows = [(i * 3, t, None if i % 4 else "en", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "row without id", None, None, None), (None, rows[7][1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def print_of(text, size=4):
    words = [w for w in low(text).encode().split()]
    runs = [b" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_cover_four_differing_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    (ra, ka), (rb, kb) = simhash.golay_keys(a), simhash.golay_keys(b)
    own = set(zip(ra.tolist(), ka.tolist()))
    assert {r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in own} == set(range(3000))
    x = np.arange(1 << 23)
    assert (np.bincount(simhash.codeword_index(x)) == 2048).all()  # the code is perfect


def test_near_duplicate_classes_equal_brute_force(docs):
    rows = [(r[0], r[1]) for r in awkward()]
    prints = [print_of(t) for _, t in rows]
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p
    distinct = sorted(parent)
    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 4:
                parent[root(p)] = root(q)
    lowest = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            lowest[root(p)] = min(d, lowest.get(root(p), d))
    want = collections.Counter((d, p, lowest.get(root(p))) for (d, _), p in zip(rows, prints))
    got = collections.Counter((r.doc_id, r.prints[0] % (1 << 64), r.component_id) for r in simhash.near_duplicate_classes(docs).collect())
    assert got == want and len(lowest) < len(distinct)


def test_large_buckets_are_split_and_lose_no_class(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base[:2]:
        for _ in range(400):
            prints.add(int(b) ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    df = spark.createDataFrame([(0, p) for p in prints], "number int, print long").repartition(2)
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < 60 * len(prints)

    def classes(pairs):
        parent = {p: p for p in prints}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p
        for a, b in pairs:
            parent[root(a)] = root(b)
        return collections.Counter(frozenset(p for p in prints if root(p) == r) for r in {root(p) for p in prints})
    assert classes(links) == classes((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4)


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    pairs += [(1000, k) for k in range(1001, 1100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_exact_duplicates_equal_brute_force(docs):
    rows = [(r[0], r[1]) for r in awkward()]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    want = collections.Counter()
    for d, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids, default=None)
        want[d, keep, len(groups[low(t)]), d is not None and d == keep, hashlib.sha256(low(t).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, exact_duplicates_rows(docs))) == want


def exact_duplicates_rows(docs):
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()


def test_drop_exact_keeps_one_row_per_text(docs):
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    with_id = [r for r in rows if r.doc_id is not None]
    assert len(with_id) == len({low(r.text) for r in with_id}) and {low(r.text) for r in rows} == {low(t) for _, t, *_ in awkward()}


def test_cuckoo_filter_inserts_deletes_and_grows():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(6000)]
    f = exact_dedup.CuckooFilter.of(keys[:4000], 64)
    assert f.rows > 64 and all(f.may_contain(k) for k in keys[:4000])
    for k in keys[:2000]:
        assert f.delete(k)
    assert all(f.may_contain(k) for k in keys[2000:4000])
    assert sum(f.may_contain(k) for k in keys[4000:]) < 40 and sum(f.may_contain(k) for k in keys[:2000]) < 40


def test_index_applies_deletions_and_overflows(spark):
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    rows = [(digest(k), k, 2) for k in range(3000)] + [(digest(k), k, -2) for k in range(0, 3000, 3)] + [(digest(1), 1, -1)]
    index = exact_dedup.build_index(spark.createDataFrame(rows, "digest binary, keep_id long, n long"), 2).collect()
    live = {bytes(r.digest): (r.keep_id, r.group_size) for r in index if r.digest}
    assert live == {digest(k): (k, 1 if k == 1 else 2) for k in range(3000) if k % 3}
    for shard in (r for r in index if r.filter):
        table = np.frombuffer(bytes(shard.filter), np.uint16).reshape(-1, exact_dedup.SLOTS)
        assert shard.live == np.count_nonzero(table) and len(table) > 256


def shards_hold(rows, n):
    sizes = collections.Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards_are_even_and_gather_copies(docs):
    rows = sharding.shard_documents(docs, shards=5).collect()
    texts = awkward()
    shards_hold(rows, 5)
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in texts)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.text_crc32].add(r.shard)
    counts = collections.Counter(r.text_crc32 for r in rows)
    split = [k for k, n in counts.items() if n > 1 and len(groups[k]) > -(-n // (len(rows) // 5))]
    assert len(split) <= 2  # copies fit the fewest shards but for what quotas forbid


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty).count() == 0
    assert simhash.near_duplicate_classes(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact(empty).count() == 0
    assert simhash.drop_near(empty).columns == empty.columns


def test_drop_near_keeps_one_of_each_class(docs):
    rows = simhash.drop_near(docs, size=5, count=2).collect()
    assert len({r.doc_id for r in rows if r.doc_id is not None}) < len({r[0] for r in awkward()})
    assert sum("hot" in low(r.text) for r in rows) == 1


def flipped(prints, bits):
    """The prints with the given bits (of all of them, in a row) turned over."""
    out = list(prints)
    for b in bits:
        out[b // 64] ^= 1 << b % 64
    return [int(np.uint64(p).astype(np.int64)) for p in out]


def verified(spark, rows, bits=10, most=77):
    nodes = spark.createDataFrame(list(enumerate(rows)), "node long, prints array<long>").repartition(2)
    return {(min(r), max(r)) for r in simhash.verified_links(nodes, bits, most).collect()}


def test_a_pair_that_fails_on_all_bits_hides_no_other_pair(spark):
    rng = random.Random(5)
    base, far = ([rng.getrandbits(64) for _ in range(8)] for _ in range(2))
    # In print 0 all four are next to each other; x and y alone agree in the others, at more than the keys' reach.
    base[0] &= ~0b1111
    z, w = flipped([base[0], *far[1:]], []), flipped([base[0], *(p ^ (1 << 64) - 1 for p in far[1:])], [0])
    apart = [64 * k + 6 * j for k in range(1, 8) for j in range(10)]
    x, y = flipped(base, [1]), flipped(base, [2, *apart])
    assert verified(spark, [z, w, x, y]) == {(2, 3)}


def test_large_buckets_are_verified_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = sorted({tuple(flipped(base, rng.sample(range(512), rng.choice((3, 30, 45))))) for _ in range(60)})
    want = {(i, j) for i in range(60) for j in range(i) if sum(((a ^ b) % (1 << 64)).bit_count() for a, b in zip(rows[i], rows[j])) <= 50}
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "FEW", 5)
    got = {(b, a) for a, b in verified(spark, rows, most=50)}
    assert got <= want

    def classes(pairs):
        root = list(range(60))
        for a, b in pairs:
            root = [root[b] if r == root[a] else r for r in root]
        return len(set(root)), collections.Counter(collections.Counter(root).values())
    assert classes(got) == classes(want)


def test_holders_of_an_equal_print_are_each_compared(spark):
    rng = random.Random(7)
    base, far = ([rng.getrandbits(64) for _ in range(8)] for _ in range(2))
    # The smallest node, x and y hold the same print 0; only x is like y, and v, next to it in print 0, is like x alone.
    first, x = flipped([base[0], *far[1:]], []), flipped(base, [])
    y = flipped(base, [64 * k + 6 * j for k in range(1, 8) for j in range(10)])
    v = flipped(base, [0, *(64 * k + 6 * j + 3 for k in range(1, 8) for j in range(10))])
    assert verified(spark, [first, x, y, v]) == {(1, 2), (1, 3)}


def test_drop_near_removes_rows_not_ids(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(200)) for k in "abc")
    rows = [(1, a), (2, f"{a} end"), (2, b), (3, c), (3, f"{c} end"), (3, c), (None, f"{a} more")]
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} & {(1, a), (2, b), (None, f"{a} more")} == {(1, a), (2, b), (None, f"{a} more")}
    assert len({r.text for r in kept if r.doc_id == 3}) == 1 and (2, f"{a} end") not in {(r.doc_id, r.text) for r in kept}


def test_drop_near_keeps_one_of_each_class_of_four_bits(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    texts, pairs = [], 0
    while pairs < 12:  # pairs within four bits of each other whose texts share less than the test on all bits asks for
        base = rng.choices(words, k=24)
        for _ in range(300):
            other = list(base)
            for at in rng.sample(range(24), 2):
                other[at] = rng.choice(words)
            a, b = " ".join(base), " ".join(other)
            if (print_of(a) ^ print_of(b)).bit_count() <= 4:
                texts += [a, b]
                pairs += 1
                break
    texts += [" ".join(rng.choices(words, k=40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes = collections.defaultdict(set)
    for r in simhash.near_duplicate_classes(df).collect():
        classes[r.component_id].add(r.doc_id)
    kept = {r.doc_id for r in simhash.drop_near(df).collect()}
    assert sum(len(c) > 1 for c in classes.values()) == pairs
    assert kept == set(classes)  # the smallest id of each class, and nothing else goes


def test_texts_that_share_a_print_are_linked_by_it(spark):
    rng = random.Random(22)
    far = [[rng.getrandbits(63) for _ in range(2)] for _ in range(6)]
    rows = [(k, [*p, 5 if k < 4 else 7 if k == 4 else 1 << 40 | 0xFFFF]) for k, p in enumerate(far)]
    tied = simhash._roots(spark.createDataFrame(rows, "doc_id long, prints array<long>"), 4, 2, 0.9, more=True).collect()
    roots = {r.doc_id: r.root for r in tied}
    assert len({roots[k] for k in range(5)}) == 1 and roots[5] != roots[0]
