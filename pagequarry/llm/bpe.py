"""Byte-level BPE with a transducer of frequent words.

Encoding splits a text into pre-tokens and merges each one's bytes by the ranks of
the vocabulary.  The merges of frequent words are computed once and compiled into
a minimal acyclic transducer: an automaton whose states share equal suffixes, and
whose transitions carry numbers that add up to the word's place in a table of ids.
Tasks memory-map it; words it lacks are merged exactly.  So the ids never depend on
which words are in it.

The vocabulary is read on the driver from ``path`` and sent to the tasks: its size
is that of the file, not of the data.
"""

import hashlib
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_and_text, materialize, received, send
from .words import chunks, texts_at

PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the transducer, and words that a task remembers before it starts anew.
LEXICON, REMEMBERED = 100_000, 200_000
#: Bytes from which a pre-token is merged by a queue.
LONG = 400


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the best-ranked neighbours join until none can."""
        parts = [word[k:k + 1] for k in range(len(word))]
        if len(parts) > LONG:
            return self._merge_long(parts)
        while len(parts) > 1:
            ranks = [self.ranks.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            a, b = parts[(at := ranks.index(best))], parts[at + 1]
            joined, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    joined.append(a + b)
                    k += 2
                else:
                    joined.append(parts[k])
                    k += 1
            parts = joined
        return [self.ids[p] for p in parts]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after the other, and their number per word.  They are merged
        side by side: a round joins the best-ranked pair of every word."""
        if "_pairs" not in vars(self):
            known = sorted((self.ids[a] << 20 | self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items())
            self._pairs, self._rank, self._joined = (np.array([k[i] for k in known], np.int64) for i in range(3))
            self._bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        finished, owners, none = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1 << 30
        for k, w in enumerate(words):
            if len(w) > LONG:
                finished.append(np.array(self.merge(w), np.int64))
                owners.append(np.full(len(finished[-1]), k))

        def pair_at(symbols, at):
            key = symbols[at] << 20 | symbols[at + 1]
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            return np.where(self._pairs[place] == key, place, -1) if len(self._pairs) else np.full(len(at), -1)
        size = np.fromiter((len(w) if len(w) <= LONG else 0 for w in words), np.int64, len(words))
        symbols = self._bytes[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, rank = np.full(len(symbols), -1), np.full(len(symbols), none)
        pair[inner] = pair_at(symbols, inner)
        rank[pair >= 0] = self._rank[pair[pair >= 0]]
        while len(symbols):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(symbols)])
            done = best == none
            if done.any():
                live = np.repeat(~done, length)
                finished.append(symbols[~live])
                owners.append(owner[~live])
                symbols, owner, pair, rank = symbols[live], owner[live], pair[live], rank[live]
                best, length = best[~done], length[~done]
            at = np.flatnonzero(rank == np.repeat(best, length))
            if not at.size:
                continue
            # Of pairs that overlap, as in "aaa", every other one joins, from the left.
            first = np.r_[True, np.diff(at) > 1]
            run = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            at = at[run % 2 == 0]
            symbols[at] = self._joined[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = np.cumsum(keep) - 1
            symbols, owner, pair, rank = symbols[keep], owner[keep], pair[keep], rank[keep]
            touched = np.zeros(len(symbols) + 1, bool)
            touched[now[at]] = touched[now[at] - 1] = True  # -1 falls on the spare place
            changed = np.flatnonzero(touched[:-1])
            pair[changed], rank[changed] = -1, none
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[owner[changed] == owner[changed + 1]]
            fresh = pair_at(symbols, changed)
            pair[changed] = fresh
            good = fresh >= 0
            rank[changed[good]] = self._rank[fresh[good]]
        owner = np.concatenate(owners)
        return np.concatenate(finished)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for very long pre-tokens, by a queue over a linked list."""
        import heapq
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            n = after[k]
            if parts[k] != a or n >= len(parts) or parts[n] != b:
                continue
            parts[k], parts[n] = a + b, b""
            after[k] = after[n]
            if after[k] < len(parts):
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else len(parts)
                if left >= 0 and right < len(parts) and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(queue, (r, left, parts[left], parts[right]))
        return [self.ids[p] for p in parts if p]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, in order."""
        if not any(s in text for s in self.special):
            return _pretokens(text)
        out = []
        for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)):
            out += [part] if k % 2 else _pretokens(part)
        return out


#: Texts in letters below this code point go by the standard library's engine, which is about twice as fast.
NEAR = 0x250


def _near_pattern(pattern: str) -> str:
    """The pattern without properties: each class is written out as its code points below ``NEAR``."""
    every = "".join(map(chr, range(NEAR)))

    def listed(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{kind}+", every))
    letters, numbers, spaces = map(listed, (r"\p{L}", r"\p{N}", r"\s"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[{listed(r'[^\s\p{L}\p{N}]')}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return out.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


_all_near = re.compile(rf"[\0-\u{NEAR - 1:04x}]*").fullmatch
_near_pretokens, _far_pretokens = re.compile(_near_pattern(PRETOKENS)).findall, regex.compile(PRETOKENS).findall


def _pretokens(text: str) -> list[str]:
    return _near_pretokens(text) if _all_near(text) else _far_pretokens(text)


def minimal_states(words: list[bytes]):
    """Minimal acyclic automaton of sorted distinct words: per state whether a word ends and its transitions."""
    ends, edges, known = [False], [{}], {}
    path = [0]  # states of the last word that are not shared yet
    last = b""

    def settle(depth: int):
        while len(path) - 1 > depth:
            state = path.pop()
            shape = (ends[state], tuple(edges[state].items()))
            same = known.setdefault(shape, state)
            if same != state:
                edges[path[-1]][last[len(path) - 1]] = same
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        for b in word[common:]:
            ends.append(False)
            edges.append({})
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        ends[path[-1]] = True
        last = word
    settle(0)
    return ends, edges


class Lexicon:
    """A compiled transducer over one block of bytes, which may be a memory-mapped file."""

    def __init__(self, block: np.ndarray):
        head = block[:64].view(np.int64)
        arrays, at = [], 64
        for size, kind in zip(head[:6], (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)):
            width = int(size) * np.dtype(kind).itemsize
            arrays.append(block[at:at + width].view(kind))
            at += -(-width // 8) * 8
        self.keys, self.target, self.skip, self.ends, self.offsets, self.ids = arrays
        self.longest = int(head[6])

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        ordered = sorted(w for w in words if w)
        ends, edges = minimal_states(ordered)
        used, stack = {0: 0}, [0]
        while stack:
            for t in edges[stack.pop()].values():
                if t not in used:
                    used[t] = len(used)
                    stack.append(t)
        counts: dict[int, int] = {}
        todo = [0]
        while todo:  # words below each state, children first
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in counts]
            if missing:
                todo += missing
                continue
            counts[s] = ends[s] + sum(counts[t] for t in edges[s].values())
            todo.pop()
        rows = []
        for s, number in used.items():
            passed = int(ends[s])
            for b, t in sorted(edges[s].items()):
                rows.append((number << 8 | b, used[t], passed))
                passed += counts[t]
        rows.sort()
        keys, target, skip = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int32, np.int32)))
        final = np.zeros(len(used), np.uint8)
        final[[used[s] for s in used if ends[s]]] = 1
        ids = [words[w] for w in ordered]
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int64)
        arrays = [keys, target, skip, final, offsets, np.array([i for x in ids for i in x], np.int32)]
        head = np.array([*map(len, arrays), max(map(len, ordered), default=0), 0], np.int64)
        return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, block: bytes) -> "Lexicon":
        """The transducer in a memory-mapped file without a name: it goes when the task lets it go."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(np.memmap(f, np.uint8, "r"))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table of ids, or -1; all words walk through the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        state[(size == 0) | (size > self.longest)] = -1
        for depth in range(min(self.longest, int(size.max(initial=0)))):
            live = np.flatnonzero((state >= 0) & (size > depth))
            if not live.size:
                break
            key = state[live] << 8 | data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            state[live] = np.where(good, self.target[at], -1)
            place[live] += np.where(good, self.skip[at], 0)
        found = (state >= 0) & (self.ends[np.maximum(state, 0)] == 1) if len(self.ends) else state >= 0
        return np.where(found, place, -1)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at the places, one after the other, and their number per place."""
        low = self.offsets[places]
        size = self.offsets[places + 1] - low
        return self.ids[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.int64), size


class Encoder:
    """Encodes texts in a task: remembered words, then the transducer, then exact merges.

    Per word it keeps its ids as decimals joined by commas, and the bytes they spell.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.texts: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        top = max(vocabulary.bytes_of) + 1
        self.names = [str(i) for i in range(top)]
        self.tokens = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.sizes = np.array([len(t) for t in self.tokens])

    def learn(self, words) -> None:
        """Makes all the words known."""
        if len(self.texts) > REMEMBERED:
            self.texts, self.raw = {}, {}
        fresh = list(set(words).difference(self.texts))
        if not fresh:
            return
        special = [w for w in fresh if w in self.vocabulary.special]
        fresh = [w for w in fresh if w not in self.vocabulary.special] if special else fresh
        for w in special:
            self.texts[w], self.raw[w] = str(self.vocabulary.special[w]), w.encode()
        spelled = [w.encode() for w in fresh]
        places = self.lexicon.find(spelled)
        known, unseen = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        self._keep([fresh[k] for k in known], *self.lexicon.take(places[known]))
        self._keep([fresh[k] for k in unseen], *self.vocabulary.merge_many([spelled[k] for k in unseen]))

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        listed = ids.tolist()
        names, raw = [self.names[i] for i in listed], b"".join([self.tokens[i] for i in listed])
        ends = np.cumsum(counts)
        spelled = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], ends])].tolist()
        ends = [0, *ends.tolist()]
        self.texts.update(zip(words, (",".join(names[a:b]) for a, b in zip(ends, ends[1:]))))
        self.raw.update(zip(words, (raw[a:b] for a, b in zip(spelled, spelled[1:]))))


def _valid(raw: bytes) -> bytes:
    """The bytes of the text that they spell: broken UTF-8 becomes replacement characters."""
    text = raw.decode("utf-8", "replace")
    return text.encode() if "\ufffd" in text else raw


def _encoder(sent) -> Encoder:
    vocabulary, block = sent
    return Encoder(received(Vocabulary, vocabulary), Lexicon.mapped(block.value))


def count_words(docs: DataFrame, sent) -> DataFrame:
    """``word, n`` over all texts: counts of pre-tokens, summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary, counts = received(Vocabulary, sent), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for _, text in texts_at(b, "text"):
                counts.update(vocabulary.split(text))
                if len(counts) > 4 * REMEMBERED:
                    yield out()
                    counts.clear()
        yield out()
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The most frequent words, at most ``size``: all words of a count or none, so ties need no order.

    Counts are few however many words there are, and only words above the cut reach the driver.
    """
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = by_count.withColumn("above", F.sum("words").over(W.orderBy(F.desc("n"))))
    cut = above.where(F.col("above") <= size).agg(F.min("n")).head()[0]
    return counts.where(F.col("n") >= cut).select("word").toArrow()["word"].to_pylist() if cut is not None else []


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON):
    """Vocabulary and compiled transducer of the ``size`` most frequent words, as two broadcasts."""
    context = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(path)
    sent = send(docs.sparkSession, vocabulary)
    frequent = sorted(frequent_words(materialize(count_words(docs, sent), "words"), size))
    words = [w for w in frequent if w not in vocabulary.special]
    spelled = [w.encode() for w in words]
    ids, counts = vocabulary.merge_many(spelled)
    block = Lexicon.compile(dict(zip(spelled, (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])))) if words else {})
    return sent, context.broadcast(block)


def encode_ids(docs: DataFrame, sent, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, ids array<int>``; a null text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = _encoder(sent)
        for batch in batches:
            for part in chunks(batch, "text"):
                split = [encoder.vocabulary.split(text) for _, text in texts_at(part, "text")]
                encoder.learn(chain.from_iterable(split))
                out = [[int(i) for w in words for i in encoder.texts[w].split(",")] for words in split]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, sent) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = received(Vocabulary, sent[0])
        for b in batches:
            texts = [vocabulary.decode(ids.as_py() or ()) for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, sent) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, in one narrow pass.

    The ids are written as decimals joined by commas; the decoded text is what these
    ids spell.  A null text is empty: no tokens, the digests of nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = _encoder(sent)
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, ids, decoded = [], [], []
                split = [encoder.vocabulary.split(text) for _, text in texts_at(part, "text")]
                encoder.learn(chain.from_iterable(split))
                for words in split:
                    listed = ",".join(map(encoder.texts.__getitem__, words))
                    spelled = b"".join(map(encoder.raw.__getitem__, words))
                    counts.append(listed.count(",") + 1 if listed else 0)
                    ids.append(hashlib.sha256(listed.encode()).hexdigest())
                    decoded.append(hashlib.sha256(_valid(spelled)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                                  pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """Counts the words of all documents, compiles the frequent ones, and encodes every document."""
    return encode_digests(docs, build_lexicon(id_and_text(docs), path, size))
