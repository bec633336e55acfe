"""Quality rules: exact text counts and a character n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of order 5 over the
characters of whole texts, runs of white space being one blank, so n-grams cross
word borders and word order counts. Spark counts the n-grams of all documents
and computes discounts, continuation counts and back-off weights. The model is
kept as arrays sorted by 64-bit hash, an array for each hash range. Texts go
through it in groups of slices, one fold after the other: every group asks each
range once for its distinct n-grams and gets the log-probabilities back, by
co-grouped joins, so the model is never in one place and may grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U64, ddl, discard, mix, quoted, stored, sums, text_slices, texts_of, window_hashes, word_codes, word_hashes

ORDER = 5
START, END = "\x02", "\x03"
SLICE = 8 << 20         # bytes of text that a task handles at once
GROUP = 32 << 20        # bytes of text whose n-grams are asked for together
CHUNK = 8 << 20         # characters of a text that are numbered at once
REQUESTS = 1 << 21      # n-grams asked of one hash range
BIN = 0.001             # log-perplexities are counted by thousandths
LEAST = 0.002           # least deviation of a language
MIN_WORDS, REPEAT_SHARE = 10, 20   # fixed values of the base rule
WINDOW = 5
BAND, SHORT = 6.5, 250.0  # width in robust deviations; words at which it is sqrt(2) times that


def model_key(text, lang):
    """Key of the model that judges a text: its fold (0 or 1, by a hash of the text, so copies share it) and its
    language (null is a language of its own). The model of a fold is counted over the texts of the other one, so
    no text is judged by its own n-grams."""
    fold = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("string")
    return F.concat(fold, F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("")))


# ---------------------------------------------------------------- texts to numbered n-grams

def _number(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the n-gram (order 5) that starts at each place, equal n-grams having equal numbers, and how many there are."""
    last = len(points) - ORDER + 1
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters = int(seen.sum())
    code = (np.cumsum(seen, dtype=np.int32) - 1)[points]
    ids, n = code[:last], letters
    for k in range(1, ORDER):
        keys = ids.astype(np.int64)
        keys *= letters
        keys += code[k:last + k]
        if n * letters <= 1 << 25:  # a table of the possible continuations
            seen = np.zeros(n * letters, bool)
            seen[keys] = True
            ids = (np.cumsum(seen, dtype=np.int32) - 1)[keys]
            n = int(seen.sum())
        else:
            found, ids = np.unique(keys, return_inverse=True)
            ids, n = ids.astype(np.int32), len(found)
    return ids, n


def _gram_keys(points: np.ndarray, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hash of the n-grams of order 5 that start at ``at``, for the model key hashed to ``seed``."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed, U64)
        for k in range(ORDER):
            h = h * U64(0x100000001B3) + points[at + k].astype(U64) + U64(1)
            h ^= h >> U64(32)
    return mix(h)


def _streams(texts: pa.Array, langs: pa.Array):
    """Of each model key of some texts: (key, its texts' rows, code points of the padded texts in a row,
    first scored place of each text, number of scored places). Texts without words are left out."""
    plain = pc.ascii_trim_whitespace(texts)
    length = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = langs.dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero((of == code) & (length > 0))
        if len(rows):
            yield lang, rows, *_points(plain.take(pa.array(rows)), length[rows])


def _points(texts: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of trimmed texts in a row, padded and with a blank for each run of white space, the first scored
    place of each text and its number of scored places."""
    pad = START * (ORDER - 1)
    raw = np.frombuffer((pad + (END + pad).join(texts.to_pylist()) + END).encode("utf-32-le"), np.uint32)
    low = np.cumsum(length + ORDER) - length - 1
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    again = np.concatenate([[False], white[1:] & white[:-1]])  # of a run the first place stays
    gone = np.flatnonzero(again)
    first = low - np.searchsorted(gone, low)
    scored = low + length - np.searchsorted(gone, low + length) - first + 1
    return np.where(white, np.uint32(32), raw)[~again], first, scored


def _chunks(points: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]):
    """(place of the first n-gram, their numbers, a place of each number, times each number is scored in each of
    the spans) by chunks; a span is the first scored places and the numbers of scored places of some texts."""
    valid = []
    for first, scored in spans:
        edge = np.zeros(len(points) + 1, np.int8)
        edge[first] += 1
        edge[first + scored] -= 1
        valid.append(np.cumsum(edge[:-1], dtype=np.int8).astype(bool))
    for low in range(0, len(points) - ORDER + 1, CHUNK):
        part = points[low:low + CHUNK + ORDER - 1]
        ids, n = _number(part)
        times = [np.bincount(ids[v[low + ORDER - 1:low + ORDER - 1 + len(ids)]], minlength=n) for v in valid]
        place = np.zeros(n, np.int64)
        place[ids] = np.arange(len(ids)) + low
        yield low, ids, place, *times


def _seed(lang: str) -> np.uint64:
    return word_hashes(pa.array([lang], pa.large_string()))[0]


def _slice_keys(texts: pa.Array, langs: pa.Array) -> np.ndarray:
    """Sorted hashes of the distinct scored n-grams of some texts."""
    found = [np.zeros(0, U64)]
    for lang, _, points, first, scored in _streams(texts, langs):
        for _, _, place, times in _chunks(points, (first, scored)):
            found.append(_gram_keys(points, place[times > 0], _seed(lang)))
    return np.unique(np.concatenate(found))


# ---------------------------------------------------------------- the model

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of the highest order of a slice by language, and their counts in each fold."""
    for batch in text_slices(batches, SLICE):
        fold = pc.equal(pc.utf8_slice_codeunits(batch.column(1), 0, 1), "1").to_numpy(zero_copy_only=False)
        for lang, rows, points, first, scored in _streams(texts_of(batch.column(0)), pc.utf8_slice_codeunits(batch.column(1), 1)):
            one = fold[rows]
            for _, _, place, c0, c1 in _chunks(points, (first[~one], scored[~one]), (first[one], scored[one])):
                used = np.flatnonzero(c0 + c1)
                if not len(used):
                    continue
                shape = points[place[used][:, None] + np.arange(ORDER)]
                text = shape.astype("<u4").tobytes().decode("utf-32-le")
                grams = [text[i:i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used), pa.string()), pa.array(grams, pa.string()), pa.array(c0[used].astype(np.int64)),
                     pa.array(c1[used].astype(np.int64)), pa.array(np.ones(len(used), np.int64))], names=["g", "gram", "c0", "c1", "slices"])


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(g, gram, c0, c1, c, slices): n-grams of order 5 of all texts by language, their counts in each fold and in both,
    and the number of slices that hold them."""
    source = docs.select(F.col(text_col), model_key(F.col(text_col), F.col(lang_col)).alias("g"))
    return (source.mapInArrow(_count, "g string, gram string, c0 long, c1 long, slices long")
            .groupBy("g", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum(F.expr("c0 + c1")).alias("c"), F.sum("slices").alias("slices")))


def cross_counts(counts: DataFrame) -> DataFrame:
    """(g, gram, c): for the model of each fold the n-grams' counts in the other fold, 0 for those of its own fold alone."""
    return counts.select("gram", F.expr("explode(array(struct(concat('0', g) as g, c1 as c), struct(concat('1', g) as g, c0 as c))) as m")
                         ).select("m.g", "gram", "m.c")


def kneser_ney(counts: DataFrame, made: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Modified Kneser-Ney estimates from (g, gram, c) of the highest order.

    Returns (grams, contexts): interpolated log-probabilities (n, g, gram, logp)
    of all n-grams of each order, and back-off weights (n, g, gram, logb) of
    contexts of n characters. An n-gram with c = 0 was never seen: it adds nothing
    to any count and gets the probability that its context leaves to it. Lower orders count distinct preceding characters.
    The discounts of an order come from its counts of counts; where these are
    too few (a zero among them) they are 0.5, 1 and 1.5. The stored tables that
    the results read are added to ``made``.
    """
    made = [] if made is None else made
    keep = lambda df, name: made.append(stored(df, name)) or made[-1]
    levels = [counts.select("g", "gram", "c")]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, keep(levels[0].groupBy("g", F.substring("gram", 2, n).alias("gram"))
                                .agg(F.sum(F.expr("if(c > 0, 1L, 0L)")).alias("c")), f"kn-{n}"))
    grams, contexts, lower = [], [], None
    for n, level in enumerate(levels, 1):
        tally = level.groupBy("g").agg(*(F.sum(F.expr(f"if(c = {k}, 1, 0)")).alias(f"n{k}") for k in (1, 2, 3, 4)),
                                       F.count(F.lit(1)).alias("v"))
        tally = keep(tally.select(
            "g", "v", *(F.expr(f"if(least(n1, n2, n3, n4) > 0, greatest({k} - {k + 1} * n1 / (n1 + 2 * n2) * n{k + 1} / n{k}, 0.01D), {d}D)")
                        .alias(f"d{k}") for k, d in ((1, 0.5), (2, 1.0), (3, 1.5)))), f"kn-tally-{n}")
        # a row for each language; Spark broadcasts the stored table while it is small
        rows = level.join(tally, "g").withColumn("d", F.expr("case c when 0 then 0D when 1 then d1 when 2 then d2 else d3 end"))
        rows = rows.withColumn("ctx", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        weights = rows.groupBy("g", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
        weights = keep(weights, f"kn-ctx-{n}")
        rows = rows.join(weights, ["g", "ctx"])
        if n == 1:
            rows = rows.withColumn("below", F.expr("1D / v"))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, n - 1)).join(
                lower.select("g", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["g", "suffix"])
        lower = keep(rows.select("g", "gram", F.expr("if(total > 0, greatest(c - d, 0D) / total + held / total * below, below)").alias("p")), f"kn-p-{n}")
        grams.append(lower.select(F.lit(n).alias("n"), "g", "gram", F.log("p").cast("float").alias("logp")))
        contexts.append(weights.select(F.lit(n - 1).alias("n"), "g", F.col("ctx").alias("gram"),
                                       F.log(F.expr("if(total > 0, held / total, 1D)")).cast("float").alias("logb")))
    union = lambda parts: [p := parts[0], *[p := p.unionByName(x) for x in parts[1:]]][-1]
    return union(grams), union(contexts)


def hash_arrays(grams: DataFrame, bits: int) -> DataFrame:
    """(r, keys, logp): the n-grams of order 5 by hash range, keys as sorted unsigned 64-bit numbers with floats beside them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, U64)
            coded = batch.column(0).dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            text = batch.column(1).to_pylist()
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(of == code)
                points = np.frombuffer("".join([text[i] for i in mine]).encode("utf-32-le"), np.uint32)
                keys[mine] = _gram_keys(points, np.arange(len(mine)) * ORDER, _seed(lang))
            yield pa.RecordBatch.from_arrays([pa.array(_range(keys, bits)), pa.array(keys.view(np.int64)), batch.column(2)],
                                             names=["r", "key", "logp"])

    def sort(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(U64)
        order = np.argsort(keys)
        return pa.table({"r": table.column("r")[:1], "keys": pa.array([keys[order].tobytes()], pa.binary()),
                         "logp": pa.array([table.column("logp").to_numpy()[order].astype("<f4").tobytes()], pa.binary())})

    return (grams.where(F.col("n") == ORDER).select("g", "gram", "logp").mapInArrow(hashed, "r long, key long, logp float")
            .groupBy("r").applyInArrow(sort, "r long, keys binary, logp binary"))


def _range(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64)


def fit_language_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """(hash arrays, bits of a range number) of two models, one for each fold, for each language. There are so many ranges that the
    slices ask each for about ``REQUESTS`` n-grams."""
    counts = stored(count_ngrams(docs, text_col, lang_col), "kn-5")
    asked = counts.agg(F.sum("slices")).first()[0] or 0
    bits = max(4, (asked // REQUESTS).bit_length())
    made = [stored(cross_counts(counts), "kn-cross")]
    discard(counts)
    arrays = stored(hash_arrays(kneser_ney(made[0], made)[0], bits), "kn-arrays")
    discard(*made)
    return arrays, bits


# ---------------------------------------------------------------- counts of a text

SYMBOLS = "#*$%&|<>"  # fixed value
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def repeated_words(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more."""
    if len(codes) < width:
        return np.zeros(len(starts) - 1, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = window_hashes(hashes[codes], width)
    inside = text[:len(keys)] == text[width - 1:]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        keys = mix(keys[at] ^ (text[at].astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), starts)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(len(texts), np.int64)
    wordy = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    mine = wordy[codes]
    total = np.bincount(text[mine], minlength=len(texts))
    pairs = np.unique(text[mine] * np.int64(len(coded.dictionary)) + codes[mine])
    return total - np.bincount(pairs // len(coded.dictionary), minlength=len(texts))


def text_counts(texts: pa.Array, starts: np.ndarray, codes: np.ndarray, words: pa.Array) -> dict[str, np.ndarray]:
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return {"n_words": np.diff(starts), "word_chars": sums(lengths[codes], starts),
            "n_symbols": sums(_IS_SYMBOL[raw], ends - ends[0]), "n_dup_lines": duplicate_lines(texts),
            "n_repeat_words": repeated_words(codes, starts, mix(np.arange(len(words), dtype=U64)))}


def _slice_groups(batches: Iterator[pa.RecordBatch]):
    """(number of the group, batch) of the slices of a task; a task that reads the same rows again gives the same numbers."""
    number, held = TaskContext.get().partitionId() << 32, 0
    for batch in text_slices(batches, SLICE):
        size = pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        if held and held + size > GROUP:
            number, held = number + 1, 0
        held += size
        yield number, batch


def score_documents(docs: DataFrame, model: tuple[DataFrame, int], text_col: str = "text", lang_col: str = "lang",
                    keep: list[str] | None = None, name: str = "quality") -> DataFrame:
    """The columns ``keep`` and, under names starting with ``_q_``, the counts of each text, its language and
    its log-perplexity by character (null without words).

    ``model`` must have been counted over these rows or more, and ``docs`` must give the same rows in the same order
    whenever it is read, as a table does: slices are cut twice. If an n-gram of a text is missing the job raises.
    The folds are scored one after the other and stored, so that only the texts of one are shuffled at a time.
    """
    keep = ["doc_id"] if keep is None else keep
    arrays, bits = model
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = ddl(docs, keep)
    source = docs.select(F.col(text_col).alias("_q_text"), model_key(F.col(text_col), F.col(lang_col)).alias("_q_model"),
                         *quoted([c for c in keep if c != text_col]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in groupby(_slice_groups(batches), lambda x: x[0]):
            keys = np.zeros(0, U64)
            for _, batch in group:
                keys = np.union1d(keys, _slice_keys(texts_of(batch.column(0)), batch.column(1)))
            r = _range(keys, bits)
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
            parts = [keys[a:b].tobytes() for a, b in zip(head, [*head[1:], len(r)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(head), number, np.int64)), pa.array(r[head]), pa.array(parts, pa.binary())], names=["slice", "r", "asked"])

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        have = np.frombuffer(part.column("keys")[0].as_py(), U64) if part.num_rows else np.zeros(0, U64)
        logp = np.frombuffer(part.column("logp")[0].as_py(), "<f4") if part.num_rows else np.zeros(0, "<f4")
        out = []
        for keys in asked.column("asked"):
            keys = np.frombuffer(keys.as_py(), U64)
            at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
            if not len(have) or (have[at] != keys).any():
                raise ValueError("a text has an n-gram that the language model lacks")
            out.append(logp[at].tobytes())
        return pa.table({"slice": asked.column("slice"), "r": asked.column("r"), "asked": asked.column("asked"), "logp": pa.array(out, pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _slice_groups(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["slice", "rows"])

    def judge(packed: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("r").to_numpy())
        joined = lambda c, kind: np.frombuffer(b"".join(answers.column(c).take(pa.array(order)).to_pylist()), kind)
        keys, logp = joined("asked", U64), joined("logp", "<f4")
        return pa.concat_tables([judge_slice(rows.as_py(), keys, logp) for rows in packed.column("rows")])

    def judge_slice(rows: bytes, keys: np.ndarray, logp: np.ndarray) -> pa.Table:
        batch = pa.ipc.open_stream(rows).read_all().combine_chunks()
        texts, langs = texts_of(batch.column(0)), batch.column(1).combine_chunks()
        starts, codes, words = word_codes(texts)
        found = text_counts(texts, starts, codes, words)
        score = np.full(len(texts), np.nan)
        for lang, rows, points, first, scored in _streams(texts, langs):
            total = np.zeros(len(rows))
            for low, ids, place, times in _chunks(points, (first, scored)):
                used = np.flatnonzero(times)
                own = _gram_keys(points, place[used], _seed(lang))
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                if len(own) and (not len(keys) or (keys[at] != own).any()):
                    raise ValueError("the rows were read in another order than before; write them to a table first")
                value = np.zeros(len(times))
                value[used] = logp[at]
                upto = value[ids]
                np.cumsum(upto, out=upto)
                for sign, end in ((1, first + scored), (-1, first)):
                    at = np.clip(end - ORDER + 1 - low, 0, len(ids))
                    total += sign * np.where(at > 0, upto[at - 1], 0)
            score[rows] = -total / scored
        out = {c: batch.column("_q_text" if c == text_col else c) for c in keep}
        return pa.Table.from_arrays(
            [*out.values(), *(pa.array(found[c].astype(np.int64)) for c in names), pc.utf8_slice_codeunits(langs, 1), pa.array(score, mask=np.isnan(score))],
            names=[*out, *(f"_q_{c}" for c in names), "_q_lang", "_q_logppl"])

    def fold_scores(fold: int) -> DataFrame:
        own = source.where(F.col("_q_model").startswith(str(fold)))
        asked = own.mapInArrow(ask, "slice long, r long, asked binary")
        answers = asked.groupBy("r").cogroup(arrays.groupBy("r")).applyInArrow(answer, "slice long, r long, asked binary, logp binary")
        packed = own.mapInArrow(pack, "slice long, rows binary")
        return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
            judge, kinds + "".join(f"_q_{c} long, " for c in names) + "_q_lang string, _q_logppl double")

    return stored(fold_scores(0), f"{name}-scores-0").unionByName(stored(fold_scores(1), f"{name}-scores-1"))


def _quartiles(values: DataFrame, value) -> DataFrame:
    """(g, q1, middle, q3) of a value by language, from counts by thousandths."""
    bins = values.groupBy(F.col("_q_lang").alias("g"), F.floor(value / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    # a language has at most log(0x110000) * ORDER / BIN bins
    seen = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("g", "bin", F.sum("c").over(seen).alias("upto"), F.sum("c").over(Window.partitionBy("g")).alias("total"))
    at = lambda q: ((F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) + 0.5) * BIN)
    return ranked.groupBy("g").agg(at(0.25).alias("q1"), at(0.5).alias("middle"), at(0.75).alias("q3"))


def room():
    """Standard deviation of a text's log-perplexity, as a multiple of that of a very long one."""
    return F.expr(f"sqrt(1 + {SHORT} / greatest(_q_n_words, 1))")


def perplexity_bands(scored: DataFrame, width: float = BAND) -> DataFrame:
    """(g, middle, reach): for each language the median log-perplexity and half the band's width for a very long text:
    ``width`` robust deviations, from the quartiles of the deviations over ``room`` (thousandths of a unit). Both
    come from all documents that pass the base rule."""
    judged = scored.where("_q_logppl is not null").where(~base_failed())
    middles = stored(_quartiles(judged, F.col("_q_logppl")).select(F.col("g").alias("_q_lang"), "middle"), "lm-middles")
    q = _quartiles(judged.join(middles, "_q_lang"), (F.col("_q_logppl") - F.col("middle")) / room())
    return (q.select(F.col("g").alias("_q_lang"), F.greatest((F.col("q3") - F.col("q1")) / 2, F.lit(LEAST)).alias("deviation"))
            .join(middles, "_q_lang").select(F.col("_q_lang").alias("g"), "middle", (F.col("deviation") * width / 0.6745).alias("reach")))


def base_failed():
    return F.expr(f"_q_n_words < {MIN_WORDS} or 100 * _q_n_repeat_words > {REPEAT_SHARE} * _q_n_words")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None,
                  width: float = BAND, name: str = "quality") -> DataFrame:
    """Counts and verdict for every document.

    Returns the columns ``keep`` (default doc_id; pass all columns to carry the
    documents along) and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, log_perplexity, base_failed, kept, all with the prefix
    ``_q_``. A document is kept unless the base rule fails (under 10 words, or
    over 20 % of the words in 5-word windows that the text repeats) or its
    log-perplexity lies outside the band of its language: ``width`` robust
    deviations below or above the median, wider for short texts (times
    sqrt(1 + 250 / n_words)), whose mean varies more.

    Null and empty texts have no words and fail the base rule; a null language
    is a language of its own; repeated rows count and are judged one by one;
    null ids are carried along; other columns do not matter. Models and bands
    are fitted to all given documents, which must come in the same order whenever
    they are read (a table does). Very long texts go through the model in chunks
    of 8 million characters, their word counts are taken at once. An empty table
    gives an empty result.
    """
    model = fit_language_models(docs, text_col, lang_col)
    scored = score_documents(docs, model, text_col, lang_col, keep, name)
    discard(model[0])
    bands = stored(perplexity_bands(scored, width), f"{name}-bands")
    inside = F.abs(F.col("_q_logppl") - F.col("middle")) <= F.col("reach") * room()
    # a row for each language; Spark broadcasts the stored table while it is small
    judged = scored.join(bands.withColumnRenamed("g", "_q_lang"), "_q_lang", "left")
    judged = judged.withColumn("_q_base_failed", base_failed())
    judged = judged.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(inside, F.lit(True)))
    return judged.withColumnRenamed("_q_logppl", "_q_log_perplexity").drop("middle", "reach", "_q_lang")
