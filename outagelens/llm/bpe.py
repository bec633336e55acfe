"""BPE encoding and decoding through a table of distinct words.

Texts are cut before every space that a non-space follows; such a place is
always a border of the tokenizer's own words, so the ids of a text are the ids
of its words in a row. Documents travel in blocks of some megabytes: Spark
splits the words of each block, the distinct words of all blocks are encoded
once each, and the ids come back to the block that holds the words' positions.
Decoding joins ids with the pieces of the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import texts_of, word_hashes

BLOCK_BYTES = 16 << 20     # text of a block

#: a space that a further space, another white space or the end follows: such texts are split one by one
_UNSAFE = r" [\s\p{Z}\x{1c}-\x{1f}\x{85}]| $"
_CUT = re.compile(r"(?= \S)")

_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of a file, without padding and truncation; one a worker."""
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        _tokenizers[path] = tok
    return _tokenizers[path]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, words): words with the space before them, texts as rows of codes."""
    unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    if unsafe.any():
        lists = [_CUT.split(t.as_py()) if u else None for t, u in zip(texts, unsafe)]
        plain = split_words(texts.filter(pa.array(~unsafe))) if not unsafe.all() else (np.zeros(1, np.int64), None, None)
        words = [] if plain[2] is None else plain[2].to_pylist()
        index = {w: i for i, w in enumerate(words)}
        parts, n, k = [], [], 0
        for own in lists:
            if own is None:
                part = plain[1][plain[0][k]:plain[0][k + 1]]
                k += 1
            else:
                part = np.array([index.setdefault(w, len(index)) for w in own if w], np.int64)
            parts.append(part)
            n.append(len(part))
        return np.concatenate([[0], np.cumsum(n)]), np.concatenate(parts), pa.array(list(index), pa.large_string())
    # the split takes the spaces away, so each part but the first gets one back
    lists = pc.split_pattern(texts, " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    flat = lists.flatten().dictionary_encode()
    codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    head = np.zeros(len(codes), bool)
    head[starts[:-1][np.diff(starts) > 0]] = True
    spaced = pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type))
    codes = np.where(head, codes, codes + len(names))
    used, codes = np.unique(codes, return_inverse=True)
    words = pa.concat_arrays([names, spaced]).take(pa.array(used))
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # texts that are empty or begin with a space
        keep = codes != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, starts = codes[keep], before[starts]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return starts, codes, words


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of words, one after another.

    Words without line breaks are encoded many at a time, a line break between
    them: before a space or another character it is a token of its own.
    """
    tok = _tokenizer(path)
    mark = tok.encode("\n", add_special_tokens=False).ids
    plain = np.array([not (w[-1:].isspace() or "\n" in w or "<|" in w or w[:1] != " " and w[:1].isspace()
                           or w[:1] == " " and w[1:2].isspace()) for w in words], bool)
    n = np.zeros(len(words), np.int64)
    parts: list = [None] * len(words)
    at = np.flatnonzero(plain)
    for k in range(0, len(at), 2000):
        own = at[k:k + 2000]
        got = np.array(tok.encode("\n".join([*(words[i] for i in own), ""]), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(got == mark[0]) if len(mark) == 1 else np.zeros(0, np.int64)
        if len(ends) != len(own):  # another tokenizer: no safe mark
            pieces = [np.array(tok.encode(words[i], add_special_tokens=False).ids, np.int64) for i in own]
        else:
            pieces = [got[a + 1:b] for a, b in zip([-1, *ends[:-1].tolist()], ends.tolist())]
        for i, p in zip(own.tolist(), pieces):
            parts[i] = p
    for i in np.flatnonzero(~plain).tolist():
        parts[i] = np.array(tok.encode(words[i], add_special_tokens=False).ids, np.int64)
    for i, p in enumerate(parts):
        n[i] = len(p)
    return n, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary (an id without a piece: empty)."""
    tok = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
    rest = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * (max(tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def _ipc(strings: pa.Array) -> bytes:
    """Arrow arrays as compressed bytes."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([strings], names=["x"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def _blocks(block_bytes: int):
    """Documents of a task in blocks: (block, ids and texts as compressed Arrow arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            texts = pa.concat_arrays([h[1] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                 pa.array([_ipc(ids)], pa.binary()), pa.array([_ipc(texts)], pa.binary())], names=["block", "ids", "texts"])

        for batch in batches:
            texts, ids = texts_of(batch.column(0)), batch.column(1).cast(pa.int64())
            lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(texts):
                done = lengths[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(lengths, done + block_bytes - size, side="right")))
                held.append((ids.slice(low, high - low), texts.slice(low, high - low)))
                size += int(lengths[high - 1] - done)
                low = high
                if size >= block_bytes or low < len(texts):
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()
    return run


def _in_buckets(words: pa.Array, buckets: int) -> list[np.ndarray]:
    """Places of a block's words by bucket of their hash, sorted by hash."""
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    number = (hashes[order] % np.uint64(buckets)).astype(np.int64)
    order, number = order[np.argsort(number, kind="stable")], np.sort(number)
    return np.split(order, np.searchsorted(number, np.arange(1, buckets)))


def _words(buckets: int):
    """Distinct words of each block, a row for each bucket: (bucket, block, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts")):
                _, _, words = split_words(_unpack(texts.as_py()))
                rows = [(b, _ipc(words.take(pa.array(at)))) for b, at in enumerate(_in_buckets(words, buckets)) if len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "words"])
    return run


def _encode_bucket(path: str):
    """Encode the distinct words of one bucket, whatever block they are from, each once."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in group:
            bucket, block, packed = (batch.column(c).to_pylist() for c in ("bucket", "block", "words"))
            for b, k, data in zip(bucket, block, packed):
                words = _unpack(data).to_pylist()
                new = [w for w in words if w not in known]
                n, flat = encode_words(new, path)
                known.update(zip(new, np.split(flat.astype(np.uint32), np.cumsum(n)[:-1]) if new else []))
                own = [known[w] for w in words]
                n = pa.array(np.array([len(x) for x in own], np.int32))
                ids = pa.array(np.concatenate(own) if own else np.zeros(0, np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([b], pa.int32()), pa.array([len(words)], pa.int64()),
                     pa.array([_ipc(n)], pa.binary()), pa.array([_ipc(ids)], pa.binary())],
                    names=["block", "bucket", "words", "lengths", "ids"])
    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode and decode every whole text: (doc_id, n_tokens, ids, decoded).

    ``ids`` has the decimal ids joined by commas, ``decoded`` is the text the
    ids decode to, special tokens included. Ids equal those of the tokenizers
    library without special tokens added.

    Null and empty texts give no ids and an empty text; null or repeated
    doc_ids are separate rows; other columns are ignored; an empty table gives
    an empty result. Very long texts form a block of their own.

    A block is read again from the same shuffled table that its words came
    from, and the words of a block are counted on return, so a repeated task
    that saw other rows fails instead of mixing ids up.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16, min(n, 4096))
    blocks = docs.select(F.col(text_col), F.col(id_col).cast("long")).mapInArrow(
        _blocks(block_bytes), "block long, ids binary, texts binary").repartition(n, "block")
    # all columns of the blocks, so that both readers share one exchange
    words = blocks.mapInArrow(_words(buckets), "bucket int, block long, words binary")
    coded = words.groupBy("bucket").applyInArrow(
        _encode_bucket(tokenizer_path), "block long, bucket int, words long, lengths binary, ids binary")

    def restore(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids by position: the words of a block with their ids, and the texts' codes."""
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
        parts = []
        pieces = _pieces(tokenizer_path)
        got = {r["bucket"]: r for r in right.to_pylist()}
        for row in left.to_pylist():
            texts = _unpack(row["texts"])
            starts, codes, words = split_words(texts)
            lengths, flat = [None] * len(words), [None] * len(words)
            for b, at in enumerate(_in_buckets(words, buckets)):
                if not len(at):
                    continue
                r = got[b]
                if r["words"] != len(at):
                    raise ValueError(f"block {row['block']} was cut differently on a second run")
                of = _unpack(r["lengths"]).to_numpy()
                ids = _unpack(r["ids"]).to_numpy()
                for place, own in zip(at.tolist(), np.split(ids, np.cumsum(of)[:-1])):
                    lengths[place], flat[place] = len(own), own
            shown = [",".join(map(str, x.tolist())) for x in flat]
            decoded = [b"".join([pieces[i] for i in x.tolist()]) for x in flat]
            n_of = np.array(lengths, np.int64) if len(words) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(n_of[codes])]) if len(codes) else np.zeros(1, np.int64)
            del lengths, flat
            s = starts.tolist()
            out_ids = pa.array((",".join([shown[c] for c in codes[a:b].tolist()]) for a, b in zip(s, s[1:])), pa.string())
            out_text = pa.array((b"".join([decoded[c] for c in codes[a:b].tolist()]) for a, b in zip(s, s[1:])), pa.binary())
            parts.append(pa.Table.from_arrays(
                [_unpack(row["ids"]), pa.array(total[starts[1:]] - total[starts[:-1]]),
                 out_ids, out_text], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    found = blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        restore, "doc_id long, n_tokens long, ids string, decoded binary")
    # bytes that are not UTF-8 (a cut id sequence) become replacement characters, as in the library
    return found.withColumn("decoded", F.col("decoded").cast("string"))


_piece_tables: dict[str, list[bytes]] = {}


def _pieces(path: str) -> list[bytes]:
    if path not in _piece_tables:
        _piece_tables[path] = piece_bytes(path)
    return _piece_tables[path]


def decode_ids(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids: rows (doc_id, text) in place of (doc_id, ids array<int>).

    An equi-join of the positions with the id-to-piece table of the vocabulary
    (a bounded table, broadcast), pieces put together in order. Null arrays and
    empty ones give an empty text; ids outside the vocabulary give nothing.
    """
    spark = tokens.sparkSession
    table = spark.createDataFrame(pd.DataFrame({"piece_id": range(len(p := _pieces(tokenizer_path))), "piece": p}),
                                  "piece_id int, piece binary")
    rows = tokens.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    at = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "piece_id")).join(F.broadcast(table), "piece_id", "left")
    texts = at.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("parts"))
    return texts.select("doc_id", F.coalesce(F.unhex(F.array_join(F.transform("parts", lambda p: p["piece"]), "")).cast("string"),
                                             F.lit("")).alias("text"))
