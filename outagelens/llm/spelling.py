"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words that one edit separates have letter counts at a squared distance of
one (an inserted or deleted letter) or two (a replaced one). Words of a length
are dealt to buckets by the counts of three classes of letters; one edit leads
to the same bucket, to one of six next to it or, from the next shorter length, to
one of three, so words meet only in such buckets. In a bucket, NumPy products
of blocks of letter counts give all squared distances of a pair of blocks;
pairs at most two apart are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = 3            # classes of letters that name a bucket
ALPHABET = 26 + 64     # a-z and U+00C0 to U+00FF
BLOCK = 256            # words of a block of a bucket
CELL_LETTERS = 1 << 19  # letters of a part of a bucket
ORDER_LETTERS = 12     # letters that order a bucket's words
HOME, TWIN, GUEST = 0, 1, 2  # a word in its bucket, the same word once more, a word from another bucket


# ---------------------------------------------------------------- words

def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, misprint: int) -> DataFrame:
    """Rows (word, n) of the runs of letters after the deletions, counted with partial aggregation."""
    # a match of at least that many letters is a maximal run
    run = F.explode(F.regexp_extract_all(F.col(quoted([text_col])[0]), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(F.col(quoted([id_col])[0]).cast("string").alias("id"), run.alias("raw"))
    ascii_lower = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", UPPER, UPPER.lower()))
    runs = runs.select("id", ascii_lower.alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % misprint == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- buckets

def _classes() -> list[str]:
    """Letters of each class, dealt in turn."""
    return [(UPPER.lower() + "".join(map(chr, range(0xC0, 0x100))))[c::CLASSES] for c in range(CLASSES)]


def _buckets(words: DataFrame) -> DataFrame:
    """Rows (bucket, role, word, n, len): every word at home, once more as its bucket's own guest, and as a guest elsewhere.

    Of two buckets of one length that an edit connects, only one gets the
    other's words; words of a length go to the buckets of the next length.
    """
    held = [F.length("word") - F.length(F.translate("word", c, "")) for c in _classes()]
    sized = words.select("word", "n", F.length("word").alias("len"), *[c.alias(f"c{i}") for i, c in enumerate(held)])
    place = lambda role, more=0, up=-1, down=-1: F.struct(
        F.concat_ws(":", F.col("len") + more, *[F.col(f"c{i}") + int(i == up) - int(i == down) for i in range(CLASSES)]).alias("bucket"),
        F.lit(role).alias("role"))
    places = [place(HOME), place(TWIN)]
    for up in range(CLASSES):
        places.append(place(GUEST, 1, up))
        places += [F.when(F.col(f"c{down}") > 0, place(GUEST, 0, up, down)) for down in range(up)]
    return sized.select(F.explode(F.array_compact(F.array(*places))).alias("p"), "word", "n", "len").select("p.*", "word", "n", "len")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows with their cell: a part of a bucket's words at home against a part of its guests.

    A bucket is cut into as many parts as its letters ask for, so a task holds
    a bounded part however many words a bucket has. Only buckets of several
    parts are broadcast, a row for over ``CELL_LETTERS`` letters of the table.
    """
    parts = lambda home: F.ceil(F.sum(F.when((F.col("role") == HOME) == home, F.col("len").cast("long"))) / CELL_LETTERS)
    sizes = rows.groupBy("bucket").agg(parts(True).alias("down"), parts(False).alias("across")).where("down > 1 or across > 1")
    rows = rows.join(F.broadcast(sizes), "bucket", "left")
    down, across = F.coalesce("down", F.lit(1)), F.coalesce("across", F.lit(1))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    row = F.transform(upto(across), lambda j: F.pmod(F.xxhash64("word"), down) * across + j)
    column = F.transform(upto(down), lambda i: i * across + F.pmod(F.xxhash64("word"), across))
    return rows.select("bucket", F.explode(F.when(F.col("role") == HOME, row).otherwise(column)).alias("cell"), "role", "word", "n")


# ---------------------------------------------------------------- comparison

def _letters(words: list[str]) -> np.ndarray:
    """Letter numbers (1 to ALPHABET; 0 after the end) of words, a row each."""
    width = max(map(len, words), default=1)
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return np.where(points >= 0xC0, points - (0xC0 - 27), np.where(points > 0, points - 96, 0)).astype(np.uint8)


def _counts(letters: np.ndarray) -> np.ndarray:
    rows = np.arange(len(letters))[:, None] * (ALPHABET + 1)
    return np.bincount((rows + letters).ravel(), minlength=len(letters) * (ALPHABET + 1)).reshape(-1, ALPHABET + 1)[:, 1:].astype(np.int16 if letters.shape[1] < 1 << 15 else np.int64)


class _Side:
    """Words of one length in blocks: similar letter counts stand together, each block knows its box."""

    def __init__(self, at: np.ndarray, words: np.ndarray):
        letters = _letters(words[at].tolist())
        counts = _counts(letters)
        order = np.lexsort(counts[:, np.argsort(counts.var(axis=0))[-ORDER_LETTERS:]].T)  # the letter that varies most comes first
        self.at, self.letters, counts = at[order], letters[order], counts[order]
        self.counts = counts.astype(np.float32 if letters.shape[1] < 2048 else np.float64)  # products stay exact
        self.squares = (self.counts ** 2).sum(axis=1)
        self.starts = np.arange(0, len(order), BLOCK)
        self.low = np.minimum.reduceat(self.counts, self.starts)
        self.high = np.maximum.reduceat(self.counts, self.starts)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words (rows of letters, b as long or one letter shorter) differ by exactly one edit."""
    width = b.shape[1]
    if a.shape[1] == width:
        return (a != b).sum(axis=1) == 1
    head, tail = a[:, :width] != b, a[:, 1:] != b
    first = np.where(head.any(axis=1), head.argmax(axis=1), width)                     # equal before it
    last = np.where(tail.any(axis=1), width - 1 - tail[:, ::-1].argmax(axis=1), -1)    # equal behind it
    return first > last


def _near_pairs(home: _Side, other: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the near pairs of two sides, found block by block."""
    for b, start in enumerate(home.starts):
        gap = np.maximum(np.maximum(home.low[b] - other.high, other.low - home.high[b]), 0)
        meets = np.flatnonzero((gap ** 2).sum(axis=1) <= 2)  # boxes further apart hold no pair
        rows = slice(start, start + BLOCK)
        for low in range(0, len(meets), 16):  # 16 blocks of the other side at a time
            cols = np.concatenate([np.arange(s, min(s + BLOCK, len(other.at))) for s in other.starts[meets[low:low + 16]]])
            gram = home.counts[rows] @ other.counts[cols].T
            distance = home.squares[rows, None] + other.squares[cols] - 2 * gram
            i, j = np.nonzero(distance <= 2)
            i, j = i + start, cols[j]
            fits = _one_edit(home.letters[i], other.letters[j])
            yield home.at[i[fits]], other.at[j[fits]]


def _compare(group: pa.Table) -> pa.Table:
    """Near words of one cell: (word, n_near, form_rank, form), form_rank = minus n of the commonest one."""
    words, n, role = np.array(group.column("word").to_pylist()), group.column("n").to_numpy(), group.column("role").to_numpy()
    length = np.char.str_len(words)
    home = np.flatnonzero(role == HOME)
    pairs = [(home[:0], home[:0])]
    if len(home):
        at_home = _Side(home, words)
        for other in (length[home[0]], length[home[0]] - 1):
            at = np.flatnonzero((role != HOME) & (length == other))
            if len(at):
                pairs.extend(_near_pairs(at_home, _Side(at, words)))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    once = (role[b] == GUEST) | (words[a] < words[b])  # a pair of one bucket meets twice
    a, b = np.concatenate([a[once], b[once]]), np.concatenate([b[once], a[once]])
    rank = np.empty(len(words), np.int64)  # commonest first, then by code points
    rank[np.lexsort((words, -n))] = np.arange(len(words))
    order = np.lexsort((rank[b], a))
    own, first, count = np.unique(a[order], return_index=True, return_counts=True)
    best = b[order][first]
    return pa.table({"word": pa.array(words[own].tolist(), pa.string()), "n_near": pa.array(count.astype(np.int64)),
                     "form_rank": pa.array(-n[best], pa.int64()), "form": pa.array(words[best].tolist(), pa.string())})


# ---------------------------------------------------------------- operator

def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
                      ratio: int = 10, misprint: int = 31) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all words of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower
    case. Where ``misprint`` divides the crc32 of ``<id>:<run>``, the run loses
    the letter at crc32 modulo its length. Words of under ``min_length``
    letters or under ``min_count`` occurrences give no row. Near words differ
    by one inserted, deleted or replaced letter. The form of a word is its near
    word of largest n (ties: the smallest in code-point order) if that n is at
    least ``ratio`` times its own, else null; ``root`` is where following forms
    ends, the word itself without a form.

    Null and empty texts have no words; runs of a row without an id lose no
    letter (there is no crc32); repeated rows count again; other columns are
    ignored; an empty table gives an empty result. A very long text is one row
    whose runs are listed in memory, a very long word is one word.
    """
    if ratio < 2:
        raise ValueError("forms lead to words at least twice as common")
    words = stored(count_words(docs, id_col, text_col, min_length, min_count, misprint), "spelling-words")
    cells = _cells(_buckets(words))  # read twice from the written words: sizes, then rows
    found = cells.groupBy("bucket", "cell").applyInArrow(_compare, "word string, n_near long, form_rank long, form string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("form_rank", "form")).alias("best"))
    rows = words.join(near, "word", "left")
    taken = -F.col("best.form_rank") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(taken, F.col("best.form")).alias("form"),
                              F.when(taken, -F.col("best.form_rank")).alias("form_n")), "spelling-rows")
    return rows.join(_roots(rows, ratio), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps taken along the forms."""
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1  # counts grow by the ratio at each step
    depth = 1
    while ratio ** depth < most:
        depth += 1
    done = 1
    while done < depth:
        nxt = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"spelling-roots{done}")
        done *= 2
    return steps
