"""SentencePiece encoding that keeps the source offsets of every piece, and decoding.

A text is normalised here: at each place the longest prefix that the model's
compiled character map knows is replaced, any other character passes, and every
normalised byte records where its source begins. The normalised text falls into
words, each with the word marks before it; no piece holds a mark behind another
character, so the library's merges never cross such a border and the pieces of
a text are those of its words in a row. Each distinct word of a slice of texts
is encoded once; the lengths of the pieces then lead through the recorded
alignment to byte spans of the original text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import quoted, text_slices, texts_of

PART_BYTES = 3 << 20  # texts of a slice; longer texts are encoded part by part
MARK = "▁".encode()   # stands for a space


# ---------------------------------------------------------------- character map

def map_entries(blob: bytes) -> dict[bytes, bytes]:
    """Prefix -> replacement of a compiled character map.

    The map is a double-array trie (its size in bytes, then 32-bit units) and
    a table of replacements, each ended by a zero byte. All nodes of a depth
    are followed at once.
    """
    if len(blob) < 4:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64)
    table = blob[4 + size:]
    step = lambda unit: (unit >> 10) << ((unit >> 6) & 8)  # noqa: E731 - distance of the children
    nodes, prefixes, found = np.array([step(units[0])]), [b""], {}
    labels = np.arange(1, 256)
    while len(nodes):
        child = nodes[:, None] ^ labels
        unit = units[np.minimum(child, len(units) - 1)]
        parent, label = np.nonzero((child < len(units)) & ((unit & 0x800000FF) == labels))
        at, unit = child[parent, label], unit[parent, label]
        prefixes = [prefixes[p] + bytes([b + 1]) for p, b in zip(parent.tolist(), label.tolist())]
        nodes = at ^ step(unit)
        for i in np.flatnonzero(unit >> 8 & 1).tolist():
            start = int(units[nodes[i]] & 0x7FFFFFFF)
            found[prefixes[i]] = table[start:table.index(b"\0", start)]
    return found


class Model:
    """A model file: the library's processors and what the normalisation needs."""

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(data)
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("models whose word mark does not stand before a word are not covered")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not covered")
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.rules = {k.decode(): v for k, v in map_entries(spec.precompiled_charsmap).items()}
        self.finder = None
        if self.rules:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for key in self.rules:
                self.finder.add_word(key, key)
            self.finder.make_automaton()
        mark = MARK.decode()
        self.by_words = not any(mark in p.piece.lstrip(mark) for p in model.pieces)
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), -1)
        byte = [int(p.piece[3:-1], 16) if p.type == kinds.BYTE else -1 for p in model.pieces]
        self.byte = np.array(byte, np.int64)
        self.length = np.array([len(p.piece.encode()) for p in model.pieces], np.int64)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec.Clear()
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


_models: dict[str, Model] = {}


def model_of(name: str) -> Model:
    """The model of a file, or of a public tokenizer's name; one a worker."""
    if name not in _models:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        with open(path, "rb") as file:
            _models[name] = Model(file.read())
    return _models[name]


# ---------------------------------------------------------------- normalisation

def _matches(model: Model, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(start, length, replacement) of the longest known prefixes, from left to right, in bytes of ``data``."""
    out = []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
        text = data[low:high].tobytes().decode()
        longest: dict[int, str] = {}
        for end, key in model.finder.iter(text):
            at = end + 1 - len(key)
            if len(longest.get(at, "")) < len(key):
                longest[at] = key
        places = low + np.append(np.flatnonzero((data[low:high] & 0xC0) != 0x80), high - low)
        done = 0
        for at in sorted(longest):
            if at >= done:
                done = at + len(longest[at])
                out.append((int(places[at]), int(places[done] - places[at]), model.rules[longest[at]]))
    return out


def _spaces(rep: bytes) -> int:
    return len(rep) - len(rep.lstrip(b" "))


def normalise(model: Model, data: np.ndarray, starts: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text starts, alignment) of texts that lie one after another in ``data``.

    The alignment has the source place of each normalised byte, and one more
    for the end of each text.
    """
    n = len(starts) - 1
    if not len(data):
        return data, np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    unit = (data & 0xC0) != 0x80  # a character or the source of a replacement begins
    matches = _matches(model, data, starts) if model.finder else []
    for at, length, _ in matches:
        unit[at + 1:at + length] = False
    place = np.flatnonzero(unit).astype(np.int32)
    taken = np.diff(np.append(place, np.int32(len(data))))
    if matches:
        which = np.searchsorted(place, [m[0] for m in matches])
        taken[which] = [len(m[2]) for m in matches]
        chunks, done = [], 0
        for at, length, rep in matches:
            chunks += [data[done:at].tobytes(), rep]
            done = at + length
        raw = np.frombuffer(b"".join([*chunks, data[done:].tobytes()]), np.uint8)
    else:
        raw = data
    first = np.searchsorted(place, starts)                    # first unit of each text
    text_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    keep = np.ones(len(raw), bool)
    begin = starts[:-1].copy()                                # source place of the word mark before a text
    real = np.diff(starts) > 0                                # texts with anything to encode
    if model.trim:
        head = np.cumsum(np.append(0, taken))[:-1]
        heading = np.zeros(len(place), np.int32)              # spaces at the start of a unit
        single = taken > 0
        heading[single] = raw[head[single]] == 32
        closing = np.zeros(len(place), bool)                  # ends in a space
        closing[single] = raw[(head + taken - 1)[single]] == 32
        plain = (taken == 1) & closing
        if matches:
            heading[which] = [_spaces(m[2]) for m in matches]
        at = np.arange(len(place))
        before = np.maximum.accumulate(np.where(taken > 0, at, -1))
        before = np.append(-1, before[:-1])                   # the last unit that is not empty
        after_space = np.where(before >= first[text_of], closing[np.maximum(before, 0)], True)
        drop = np.where(after_space, heading, 0)
        inside = np.arange(len(raw)) - np.repeat(head, taken)
        keep = inside >= np.repeat(drop, taken)
        solid = np.append(np.where(plain, len(place), at), len(place))
        lead = np.minimum.reduceat(solid, first[:-1])
        real &= lead < first[1:]
        begin[real] = place[lead[real]]
        keep &= np.repeat(real[text_of], taken)
    source = np.repeat(place, taken)[keep]
    text = np.repeat(text_of, taken)[keep]
    raw = raw[keep]
    if prefix and model.prefix:  # a word mark before each text
        at = np.searchsorted(text, np.flatnonzero(real))
        raw, source, text = np.insert(raw, at, 32), np.insert(source, at, begin[real]), np.insert(text, at, np.flatnonzero(real))
    width = np.where(raw == 32, 3, 1)
    spread = np.repeat(raw, width)
    marks = np.cumsum(width)[raw == 32] - 3
    for k in range(3):
        spread[marks + k] = MARK[k]
    source, text = np.repeat(source, width), np.repeat(text, width)
    ends = np.searchsorted(text, np.arange(n), side="right")
    begins = np.append(0, ends[:-1])
    stop = starts[1:].copy()
    if model.trim:
        last = ends.copy()
        while True:  # word marks at the end of a text
            at = np.flatnonzero((last - begins >= 3))
            at = at[(spread[last[at] - 3] == MARK[0]) & (spread[last[at] - 2] == MARK[1]) & (spread[last[at] - 1] == MARK[2])]
            if not len(at):
                break
            last[at] -= 3
            stop[at] = source[last[at]]
        keep = np.arange(len(spread)) < np.repeat(last, ends - begins)
        spread, source, ends = spread[keep], source[keep], np.cumsum(last - begins)
    return spread, np.append(0, ends), np.insert(source, ends, stop)


# ---------------------------------------------------------------- encoding

def _encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, ids, normalised bytes of each piece) of words, one after another."""
    lists = model.encoder.encode(words, num_threads=1) if words else []
    n = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter((i for x in lists for i in x), np.int64, n.sum())
    width = model.length[ids]
    byte = model.byte[ids]
    single = byte >= 0
    width[single] = 0
    lead = np.flatnonzero(single & ((byte < 0x80) | (byte >= 0xC0)))  # the last byte of a character takes its whole span
    size = 1 + (byte[lead] >= 0xC0) + (byte[lead] >= 0xE0) + (byte[lead] >= 0xF0)
    width[lead + size - 1] = size
    ends = np.cumsum(n)
    for w in np.unique(np.searchsorted(ends, np.flatnonzero(ids == model.unknown), side="right")).tolist():
        spans = model.encoder.encode(words[w], out_type="proto").pieces
        width[ends[w] - n[w]:ends[w]] = [p.end - p.begin for p in spans]
    return n, ids, width


def encode_texts(model: Model, data: np.ndarray, starts: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text starts, ids, span starts, span ends) of texts that lie one after another in ``data``; spans count from the text's own start."""
    flat, begins, align = normalise(model, data, starts, prefix)
    mark = np.zeros(len(flat) + 3, bool)
    if model.by_words and len(flat) >= 3:
        mark[3:len(flat) + 1] = (flat[:-2] == MARK[0]) & (flat[1:-1] == MARK[1]) & (flat[2:] == MARK[2])
    border = mark[3:] & ~mark[:-3]
    border = np.append(border, True)
    border[begins[:-1]] = True
    cuts = np.flatnonzero(border)  # the starts of words, and the end
    held = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))
    coded = held.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    n, ids, width = _encode_words(model, coded.dictionary.to_pylist())
    first = np.cumsum(n) - n
    total = np.append(0, np.cumsum(n[codes]))
    at = np.repeat(first[codes] - total[:-1], n[codes]) + np.arange(total[-1])
    width = width[at]
    end = np.cumsum(width)
    offsets = total[np.searchsorted(cuts, begins)]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(offsets))
    low = align[end - width + text] - starts[text]
    high = align[end + text] - starts[text]
    return offsets, ids[at].astype(np.int32), low.astype(np.int32), high.astype(np.int32)


def _parts(model: Model, data: np.ndarray, limit: int) -> list[int]:
    """Cuts of a long text, before spaces that an ASCII character precedes; none if replacements could cross them."""
    if model.finder or model.trim or not model.by_words or len(data) <= limit:
        return [0, len(data)]
    safe = np.flatnonzero((data[1:] == 32) & (data[:-1] < 0x80) & (data[:-1] != 32)) + 1
    cuts = safe[np.searchsorted(safe, np.arange(limit, len(data), limit))[:-1]] if len(safe) else safe
    return [0, *np.unique(cuts[cuts > 0]).tolist(), len(data)]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (doc_id, ids, starts, ends, decoded) of every whole text.

    ``ids`` are those of the sentencepiece library for the model (a file that
    the tasks can read, or a public tokenizer's name), without begin and end
    ids; piece i comes from the bytes ``starts[i]`` to ``ends[i]`` (exclusive)
    of the text in UTF-8, as the library reports it: the spans rise and leave
    out only removed white space, and where several pieces share a source
    character, the last one has it. ``decoded`` is the library's text of the
    ids.

    Null and empty texts give no ids and an empty text; repeated rows and null
    ids are rows of their own; other columns are ignored, and
    an empty table gives an empty result. A text longer than ``part_bytes`` is
    encoded part by part, unless the model's map or its trimming of white space
    could reach across parts: then a task needs some 60 bytes a byte of the
    longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for batch in text_slices(batches, part_bytes):
            texts = texts_of(batch.column(0))
            starts = _offsets(texts)
            buffer = texts.buffers()[2]
            data = np.frombuffer(buffer, np.uint8)[starts[0]:starts[-1]] if buffer is not None else np.zeros(0, np.uint8)
            starts = starts - starts[0]
            if len(texts) == 1:
                cuts = _parts(own, data, part_bytes)
                done = [encode_texts(own, data[a:b], np.array([0, b - a]), a == 0) for a, b in zip(cuts, cuts[1:])]
                offsets = np.array([0, sum(len(d[1]) for d in done)])
                ids = np.concatenate([d[1] for d in done])
                low, high = (np.concatenate([d[k] + np.int32(a) for d, a in zip(done, cuts)]) for k in (2, 3))
            else:
                offsets, ids, low, high = encode_texts(own, data, starts)
            decoded = [own.decoder.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            at = pa.array(offsets.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists, pa.array(decoded, pa.string())],
                                             names=["doc_id", "ids", "starts", "ends", "decoded"])

    rows = docs.select(*[F.col(c) for c in quoted([text_col, id_col])])
    kind = rows.schema.fields[1].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def _offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a large string array, its slice offset included."""
    raw = np.frombuffer(texts.buffers()[1], np.int64)
    return raw[texts.offset:texts.offset + len(texts) + 1]
