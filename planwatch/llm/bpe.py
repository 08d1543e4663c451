"""Byte-level BPE: frequent words from a minimal acyclic transducer, unseen ones by exact merging; decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import documents, slices, utf8, written
from planwatch.session import own_folder

SHARE = 5e-6  # of all words: the transducer holds those that are at least as frequent, 1 / SHARE at most
MEMO = 600_000  # words that a task remembers
FLUSH = 300_000  # different words that a task counts before it passes their counts on

#: White space as Unicode has it, and how a text falls into words before merging.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n" or c == "\0"]
_LATIN_END = "\u0250"  # behind the letters of Latin, on which all versions of Unicode agree
_NEVER = 1 << 30  # the rank of a pair that doesn't merge
LONG = 256  # characters; longer pieces are neither counted nor remembered


def default_vocabulary() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """Printable bytes are written as themselves, the others as the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


@dataclass
class Vocabulary:
    """Token ids, the rank and result of each merge, and the strings that are tokens wherever they stand."""

    tokens: list[bytes]
    byte_ids: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    added: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for text, i in vocab.items():
            tokens[i] = bytes(names[c] for c in text) if text not in added else text.encode()
        for text, i in added.items():
            tokens[i] = text.encode()
        byte_ids = [0] * 256
        for c, b in names.items():
            byte_ids[b] = vocab[c]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        return Vocabulary(tokens, byte_ids, merges, added)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, the leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        find = self.merges.get
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((m for m in map(find, zip(ids, ids[1:])) if m), default=None)
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and find((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers, as ``merge`` has them. Words of one length merge together, a pair each a
        round, in matrices of their ids and of the ranks of neighbouring ids."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            if length > 64:
                for i in at:
                    out[i] = np.array(self._merge_long([self.byte_ids[b] for b in words[i]]), "<u4").tobytes()
            elif length:
                raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, length)
                self._merge_matrix(np.array(self.byte_ids, np.int32)[raw], np.array(at), out)
        return out

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs as one number each, ascending, with their ranks; the id that the pair of each rank makes."""
        key = np.array([a << 20 | b for a, b in self.merges], np.int64)
        rank, made = np.array(list(self.merges.values()), np.int32).reshape(-1, 2).T
        order, by_rank = np.argsort(key), np.zeros(rank.max(initial=0) + 1, np.int32)
        by_rank[rank] = made
        return key[order], rank[order], by_rank

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, rank, _ = self._pairs
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[at] == want, rank[at], np.int32(_NEVER))

    def _merge_matrix(self, ids: np.ndarray, at: np.ndarray, out: list[bytes]) -> None:
        made = self._pairs[2]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            n, width = ids.shape
            place = ranks.argmin(axis=1) if width > 1 else np.zeros(n, np.int64)
            best = ranks[np.arange(n), place] if width > 1 else np.full(n, _NEVER)
            if (done := best == _NEVER).any():
                flat = ids[done].astype("<u4").tobytes()
                for k, i in enumerate(at[done].tolist()):
                    out[i] = flat[4 * width * k : 4 * width * (k + 1)]
                ids, ranks, at, place, best = (x[~done] for x in (ids, ranks, at, place, best))
                n = len(ids)
                if not n:
                    return
            rows, column = np.arange(n), np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > place[:, None]), 1)
            ids[rows, place] = made[best]
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= place[:, None]), 1)
            left, right = np.flatnonzero(place > 0), np.flatnonzero(place < width - 2)
            ranks[left, place[left] - 1] = self._ranks(ids[left, place[left] - 1], ids[left, place[left]])
            ranks[right, place[right]] = self._ranks(ids[right, place[right]], ids[right, place[right] + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n, find = len(ids), self.merges.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := find((made, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[j]], m[1]))
            if (p := before[i]) >= 0 and (m := find((ids[p], made))):
                heapq.heappush(heap, (m[0], p, ids[p], made, m[1]))
        return [x for x, ok in zip(ids, alive) if ok]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """A minimal acyclic transducer in flat arrays of one memory-mapped file.

    Words with equal continuations share states. Each edge adds the number of words that sort before those behind it, so a
    path's sum is its word's number, under which the word's ids lie. Edges are sorted by state * 256 + byte.
    """

    def __init__(self, path: str):
        flat = np.memmap(path, np.int64, "r")
        sizes = flat[:7]
        self.longest = int(sizes[6])
        ends = 7 + np.cumsum(sizes[:6])
        self.key, self.target, self.adds, self.final, self.offset, ids = np.split(flat[7 : ends[-1]], ends[:-1] - 7)
        self.flat = ids.astype("<u4").tobytes()

    @staticmethod
    def compile(words: dict[bytes, list[int]], path: str) -> None:
        """Sorted words are added one by one; states that can't change any more are replaced by equal ones."""
        ordered = sorted(words)
        children: list[dict[int, int]] = [{}]
        final, equal, open_, last = [False], {}, [0], b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                state = open_.pop()
                twin = equal.setdefault((final[state], tuple(children[state].items())), state)
                children[open_[-1]][last[len(open_) - 1]] = twin

        for w in ordered:
            shared = len(os.path.commonprefix([w, last]))
            close(shared)
            for b in w[shared:]:
                children.append({})
                final.append(False)
                children[open_[-1]][b] = len(children) - 1
                open_.append(len(children) - 1)
            final[open_[-1]] = True
            last = w
        close(0)
        below: dict[int, int] = {}
        stack = [0]
        while stack:  # words behind each state, children first
            s = stack[-1]
            if s in below:
                stack.pop()
            elif todo := [c for c in children[s].values() if c not in below]:
                stack.extend(todo)
            else:
                below[s] = final[s] + sum(below[c] for c in children[s].values())
        number = {s: i for i, s in enumerate(sorted(below))}  # the root stays 0
        edges = []
        for s, i in number.items():
            n = int(final[s])
            for b, c in sorted(children[s].items()):
                edges.append((i * 256 + b, number[c], n))
                n += below[c]
        edges.sort()
        e = np.array(edges, np.int64).reshape(-1, 3)
        ids = [words[w] for w in ordered]
        parts = [e[:, 0], e[:, 1], e[:, 2], np.array([final[s] for s in number], np.int64), np.cumsum([0, *map(len, ids)]), np.array([x for row in ids for x in row], np.int64)]
        sizes = [*map(len, parts), max(map(len, ordered), default=0)]
        np.concatenate([np.array(sizes, np.int64), *parts]).astype(np.int64).tofile(path)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit numbers; None for a word that isn't in the lexicon. All words step together."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        letters, starts = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        dead = np.ones(n, bool)
        dead[live] = False
        step = 0
        while live.size and len(self.key):
            want = state[live] * 256 + letters[starts[live] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            dead[live[~ok]] = True
            live, at = live[ok], at[ok]
            state[live], total[live] = self.target[at], total[live] + self.adds[at]
            step += 1
            live = live[lengths[live] > step]
        if not len(self.key):
            return [None] * n
        known = ~dead & (self.final[state] == 1)
        first, last = self.offset[np.where(known, total, 0)], self.offset[np.where(known, total + 1, 0)]
        flat = self.flat
        return [flat[4 * a : 4 * b] if ok else None for ok, a, b in zip(known.tolist(), first.tolist(), last.tolist())]


def _pieces(text: str) -> list[str]:
    """Pieces of a text that fall into words each on its own: short ones of several words, or single words.

    A single space between two other characters always begins a word, so a text whose white space is only such spaces, and
    newlines not beside a space, is cut there. Any other text is cut into its words at once.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ODD):
        return _WORDS.findall(text)
    pieces = text.replace(" ", "\0 ").split("\0")  # the odd case has those with \0
    if max(map(len, pieces)) > LONG:
        pieces = [w for p in pieces for w in (_WORDS.findall(p) if len(p) > LONG else (p,))]
    return pieces


def _is_word(piece: str) -> bool:
    """Whether a piece is surely one word: a space and Latin letters. Others are told by ``_WORDS``."""
    return piece[:1] == " " and piece[1:].isalpha() and max(piece) < _LATIN_END


@dataclass
class Encoder:
    """Encodes within a task: a memo of pieces and words, then the transducer, then exact merging."""

    vocabulary: Vocabulary
    lexicon: Lexicon
    memo: dict[str, bytes] = field(default_factory=dict)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces: those of the transducer, else of their words, merged unless this task has met them.

        Of the words within pieces the short ones are remembered too."""
        memo, known, single, split = self.memo, {}, [], {}
        for p, ids in zip(pieces, self.lexicon.find([p.encode() for p in pieces])):
            if ids is not None:
                known[p] = ids
            elif _is_word(p):
                single.append(p)
            else:
                split[p] = _WORDS.findall(p)
        new = list(set(single).union(*split.values()).difference(memo, known))
        known.update(zip(new, self.vocabulary.merge_all([w.encode() for w in new])))
        for p, words in split.items():
            known[p] = b"".join([known[w] if w in known else memo[w] for w in words])
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        special, memo = self.vocabulary.added, self.memo
        cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        rows = []
        for text in texts:
            if any(s in text for s in special):
                rows.append([p for part in cut.split(text) for p in ([part] if part in special else _pieces(part))])
            else:
                rows.append(_pieces(text))
        if len(memo) > MEMO:
            memo.clear()
        memo.update((s, np.array([i], "<u4").tobytes()) for s, i in special.items())
        need = set().union(*rows).difference(memo)
        long = [p for p in need if len(p) > LONG]
        memo.update(self._learn([p for p in need if len(p) <= LONG]))
        if not long:
            return [b"".join(map(memo.__getitem__, row)) for row in rows]
        own = self._learn(long)  # used once and not remembered
        return [b"".join([own[p] if p in own else memo[p] for p in row]) for row in rows]


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = SHARE) -> list[str]:
    """The words that make up at least ``share`` of all words of all texts, 1 / ``share`` at most.

    Words are what stands between single spaces, with the space before it (see ``_pieces``)."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            short = {p: n for p, n in seen.items() if len(p) <= LONG}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.string()), pa.array(short.values(), pa.int64())], names=["word", "n"])

        for b in slices(batches):
            for t in utf8(b.column(0)):
                seen.update(_pieces(t.decode("utf-8", "replace")))
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    counts = written(docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where((F.col("n") >= max(2.0, share * total)) & (F.octet_length("word") <= 64))
    return [r["word"] for r in often.select("word").toLocalIterator()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, share: float = SHARE, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs``, of its whole text.

    Null texts count as empty; an empty text has no tokens. Repeated rows have a row each. The transducer file goes to the
    executors by Spark's file distribution; its size is bounded by 1 / ``share`` words of at most 64 bytes.
    """
    spark = docs.sparkSession
    v = Vocabulary.load(vocabulary or default_vocabulary())
    often = [w.encode() for w in frequent_words(docs, text_col, share)]
    words = {w: [i for x in _WORDS.findall(w.decode()) for i in v.merge(x.encode())] for w in often}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(own_folder(), name)
    Lexicon.compile(words, path)
    spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(v)

    def run(batches):
        encoder = Encoder(shared.value, Lexicon(SparkFiles.get(name)))
        for batch in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in utf8(batch.column(1))]
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for raw in encoder.encode(texts):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(encoder.vocabulary.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(raw)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:  # from their bytes: as Python numbers they take ten times as much
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, as ``encode`` says it for nulls, empty texts and repeated rows."""
    return encode(documents(spark, sf_dir))
