"""Packing of tokenised documents into fixed-length sequences by vector bin packing.

Every piece of a document is an item with a demand vector (tokens, segments,
loss-bearing tokens), every sequence a bin with a capacity vector. A bin is
filled by the dot-product heuristic: of the waiting pieces that fit, take the
one whose demand, scaled by the capacities, has the largest inner product with
the capacity that is left. Documents longer than a sequence are cut; a gap that
no waiting piece fits is filled by cutting the largest one.

Each task packs the rows of its own partition, so nothing is shuffled and the
size of the corpus does not matter; at most the last sequences of a partition
stay short, and these are cut to powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import texts_of, word_codes

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS = 2048, 64, 2048
POOL = 1024        # pieces that wait in a task before bins are opened
MIN_CUT = 32       # gaps smaller than this are left as padding
WORD_CACHE = 600_000  # letter runs and odd words a task remembers; with more the memory starts anew at the next texts
CHUNK_WORDS = 1 << 19  # words whose ids are put in a row at once

#: letters that are one code point in every normal form and have one small letter, and signs that such tokenizers part from
#: letters; apostrophes (contractions), digits and < (special tokens) are left out
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "\xaa\xb5\xba")
SIGNS = "".join(c for c in string.punctuation if c not in "'<")
_SMALL = re.compile(f"[{''.join(c for c in LETTERS if c == c.lower())}]+")

_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Token ids of white-space separated words, each distinct word encoded once per task.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words in a row. A word of letters and signs after them has
    the ids of the two in a row, and the letters those of the small letters.
    Small letters are one piece for the tokenizer's model and go to it without
    the steps before; ``parts`` says whether this tokenizer is such a one.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.model = self.tok.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in LETTERS}
        own = lambda w: self.tok.encode(w, add_special_tokens=False).ids
        self.parts = all(own(f"{c}{c}a{SIGNS}") == self._letters(f"{c}{c}a".lower()) + own(SIGNS) for c in LETTERS)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.lengths = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _letters(self, word: str) -> list[int]:
        """Ids of a run of small letters."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the words, one after another."""
        together = " ".join(words)
        odd = []
        if self.mark is None or self.MARK in together or "<|" in together:
            odd = [i for i, w in enumerate(words) if self.mark is None or self.MARK in w or "<|" in w]
        special = set(odd)
        plain = [w for i, w in enumerate(words) if i not in special]
        lengths, ids = [], []
        for k in range(0, len(plain), 2000):  # words joined by a mark that is always a token of its own
            part = plain[k:k + 2000]
            got = np.array(self.tok.encode(f" {self.MARK} ".join([*part, ""]), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(got == self.mark)
            if len(at) != len(part):
                raise ValueError("the tokenizer merges words across the mark")
            lengths.append(np.diff(np.concatenate([[-1], at])) - 1)
            ids.append(got[got != self.mark])
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if not odd:
            return n, flat
        parts, all_n, k = np.split(flat, np.cumsum(n)[:-1]) if len(n) else [], [], 0
        out = []
        for i, w in enumerate(words):
            if i in special:
                got = np.array(self.tok.encode(w, add_special_tokens=False).ids, np.uint32)
            else:
                got, k = parts[k], k + 1
            out.append(got)
            all_n.append(len(got))
        return np.array(all_n, np.int64), np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, one text after another."""
        starts, codes, words = word_codes(texts)
        stems, signs = (x.dictionary_encode() for x in self._parted(words))
        if len(self.index) > WORD_CACHE:
            self.clear()
        place = np.column_stack([self._places(stems), self._places(signs)]).ravel()
        edge = np.concatenate([[0], np.cumsum(self.lengths[place])])
        flat = _in_a_row(self.flat, np.cumsum(self.lengths) - self.lengths, place, edge)  # of the distinct words
        first = edge[::2]
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK_WORDS, side="right")) - 1)
            own = codes[starts[low]:starts[high]]
            before = np.concatenate([[0], np.cumsum(first[own + 1] - first[own])])
            ids = _in_a_row(flat, first, own, before)
            for a, b in itertools.pairwise(before[starts[low:high + 1] - starts[low]].tolist()):
                yield ids[a:b]
            low = high

    def _parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words of letters and signs after them as the small letters and the signs; others whole and without signs."""
        none = pa.array([""] * len(words), words.type)
        if not self.parts:
            return words, none
        stem, signs = pc.utf8_rtrim(words, characters=SIGNS), pc.utf8_ltrim(words, characters=LETTERS)
        a, b, n = (np.asarray(pc.binary_length(x)) for x in (stem, signs, words))
        both = pa.array((a + b == n) & (a > 0))
        return pc.if_else(both, pc.utf8_lower(stem), words), pc.if_else(both, signs, none)

    def _places(self, words: pa.DictionaryArray) -> np.ndarray:
        """Place of each word in ``lengths``; new ones are encoded."""
        names = words.dictionary.to_pylist()
        new = [w for w in names if w not in self.index]
        small = [w for w in new if self.parts and _SMALL.fullmatch(w)]
        if small:
            ids = [self._letters(w) for w in small]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self._learn(small, n, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum())))
        if odd := [w for w in new if w not in self.index]:
            self._learn(odd, *self._encode(odd))
        own = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        return own[words.indices.to_numpy()]

    def _learn(self, words: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])


def _in_a_row(flat: np.ndarray, first: np.ndarray, place: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The ids of some words, in a row; ``first``: where a word begins in ``flat``, ``edge``: where it shall begin."""
    at = np.repeat((first[place] - edge[:-1]).astype(np.int32), np.diff(edge))
    at += np.arange(edge[-1], dtype=np.int32)
    return flat.take(at)


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


class Packer:
    """Fills sequences from a pool of pieces. A piece is (document, start, ids, first loss position)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, sequence: int):
        self.cap = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.pieces: list[tuple] = []
        self.demand = np.zeros((0, 3))
        self.sequence = sequence
        self.out: list[tuple] = []

    def _demand(self, start: int, n: int, free: int) -> np.ndarray:
        """free: ids before this place of the document bear no loss."""
        return np.array([n, 1, max(0, start + n - max(start, free))], np.float64)

    def add(self, doc, ids: np.ndarray, free: int) -> None:
        """Cut a document to pieces that fit an empty sequence and queue them."""
        start, demands = 0, []
        while start < len(ids):
            n = min(len(ids) - start, int(self.cap[0]))
            d = self._demand(start, n, free)
            if d[2] > self.cap[2]:  # shorten it to the loss limit
                n -= int(d[2] - self.cap[2])
                d = self._demand(start, n, free)
            if n == self.cap[0] or d[2] == self.cap[2]:  # fills a sequence by itself
                self._place([(doc, start, ids[start:start + n], free)])
            else:
                self.pieces.append((doc, start, ids[start:start + n], free))
                demands.append(d)
            start += n
        if demands:
            self.demand = np.concatenate([self.demand, demands])

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, _ in pieces:
            self.out.append((doc, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _fill(self) -> None:
        """Open one sequence and fill it."""
        left, scale, chosen = self.cap.copy(), 1 / (self.cap * self.cap), []
        live = np.ones(len(self.pieces), bool)
        while left[1] >= 1 and live.any():
            fits = live & (self.demand[:, 0] <= left[0]) & (self.demand[:, 2] <= left[2])  # a piece is one segment
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, self.demand @ (scale * left), -1)))
            live[best] = False
            left -= self.demand[best]
            chosen.append(self.pieces[best])
        rest: tuple | None = None
        if left[0] >= MIN_CUT and left[1] >= 1 and left[2] >= 1 and live.any():  # cut a piece to fill the gap
            best = int(np.argmax(np.where(live, self.demand[:, 0], -1)))
            doc, start, ids, free = self.pieces[best]
            n = min(int(left[0]), int(left[2]) + max(0, free - start), len(ids) - 1)
            if n >= MIN_CUT:
                chosen.append((doc, start, ids[:n], free))
                rest = (doc, start + n, ids[n:], free)
                live[best] = False
        self._place(chosen)
        self.pieces = [p for p, k in zip(self.pieces, live) if k]
        self.demand = self.demand[live]
        if rest:
            self.pieces.append(rest)
            self.demand = np.concatenate([self.demand, [self._demand(rest[1], len(rest[2]), rest[3])]])

    def reduce(self, below: int) -> None:
        while len(self.pieces) > below:
            self._fill()

    def finish(self) -> None:
        """Place what is left; the last pieces go to sequences of power-of-two length."""
        while len(self.pieces) and (self.demand.sum(axis=0) > self.cap).any():
            self._fill()
        while self.pieces:
            size = 1 << (sum(len(p[2]) for p in self.pieces).bit_length() - 1)
            chosen, room, rest = [], size, []
            for doc, start, ids, free in self.pieces:
                if room:
                    chosen.append((doc, start, ids[:room], free))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], free))
                room -= min(room, len(ids))
            self._place(chosen)
            self.pieces = rest

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = MAX_TOKENS,
                   max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = MAX_LOSS_TOKENS,
                   id_col: str = "doc_id", text_col: str = "text", prompt_words_col: str | None = None) -> DataFrame:
    """Tokenise documents and pack them into sequences of at most ``max_tokens`` ids.

    Returns one row per piece: (doc_id, start, length, ids, doc_tokens,
    loss_tokens, sequence_id, offset). ``ids`` is the piece as little-endian
    unsigned 32-bit numbers; ``start`` counts the document's ids before it and
    ``offset`` the sequence's. ``end_id`` closes every document. Ids of the
    first ``prompt_words_col`` words (if given; null: 0) and a document's first
    id bear no loss. No sequence exceeds any of the three limits.

    Null and empty texts are documents of one id; rows with equal or null
    doc_id are packed as separate documents; other columns are ignored; an
    empty table gives no rows. ``sequence_id`` is unique over the whole result
    (partition number and counter); ties between pieces go to the first that
    waits, so a repeated task gives the same rows.
    """
    if max_tokens & (max_tokens - 1) or min(max_segments, max_loss_tokens) < 1:
        raise ValueError("max_tokens must be a power of two, the other limits positive")
    columns = [id_col, text_col, *([prompt_words_col] if prompt_words_col else [])]

    def rows(pieces: list[tuple], totals: dict) -> pa.RecordBatch:
        doc, start, ids, seq, offset = zip(*pieces)
        n = [len(x) for x in ids]
        loss = [max(0, s + k - max(s, totals[d][2])) for d, s, k in zip(doc, start, n)]
        return pa.RecordBatch.from_arrays([
            pa.array([totals[d][0] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            pa.array([totals[d][1] for d in doc], pa.int64()), pa.array(loss, pa.int64()),
            pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = coder(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss_tokens, TaskContext.get().partitionId() << 40)
        totals: dict[int, tuple] = {}  # of documents with waiting or unsent pieces, by row number
        row, room = 0, 1 << 24

        def send() -> Iterator[pa.RecordBatch]:
            done = packer.take()
            for k in range(0, len(done), 2000):
                yield rows(done[k:k + 2000], totals)
            waiting = {p[0] for p in packer.pieces}
            for d in [d for d in totals if d not in waiting]:
                del totals[d]

        for batch in batches:
            table = texts_of(batch.column(1))
            names = batch.column(0).to_pylist()
            prompts = batch.column(2).to_pylist() if prompt_words_col else None
            sizes = np.asarray(pc.binary_length(table))
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(room, sizes.sum() + room, room)).tolist() + [len(names)]
            low = 0
            for high in cuts:  # texts of about 16 MB at a time
                high = min(max(high, low + 1), len(names))
                if low >= high:
                    continue
                texts = table.slice(low, high - low)
                for i, ids in enumerate(tok.encode(texts)):
                    own = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                    free = 1
                    if prompts and (k := prompts[low + i]):
                        head = pa.array([" ".join((texts[i].as_py()).split()[:k])], pa.large_string())
                        free = max(1, len(next(tok.encode(head))))
                    totals[row] = (names[low + i], len(own), free)
                    packer.add(row, own, free)
                    row += 1
                    if len(packer.pieces) >= 2 * POOL:
                        packer.reduce(POOL)
                low = high
                packer.reduce(POOL)
                yield from send()
        packer.finish()
        yield from send()
        tok.clear()  # the worker may live on for other work
        pa.default_memory_pool().release_unused()

    return docs.select(*columns).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
             "sequence_id long, offset long")
