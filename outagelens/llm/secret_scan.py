"""Secrets in texts: fixed patterns plus a randomness test battery with false-discovery control.

Besides three pattern kinds the scan looks at every run of 20 or more encoding
characters. The smallest alphabet that holds the run is its inferred encoding;
over that alphabet the run is tested for uniform frequencies (chi-squared), for
runs above and below the middle and for serial correlation. A run is reported
when it passes the battery as random and when the same chi-squared value would
be a discovery against ordinary text: its p-value under the letter frequencies
of the whole corpus is below the Benjamini-Hochberg threshold of its length
stratum (short runs prove little, so each length answers for itself).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ddl, quoted, stored, texts_of

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encodings from the smallest alphabet up; the first that holds all characters is inferred
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER,
    "base32": UPPER + "234567", "lower36": LOWER + DIGITS, "upper36": UPPER + DIGITS, "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
NAMES = list(ENCODINGS)
_SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
_ORDER = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}

BIN, BINS = 0.1, 400  # p-values are counted by tenths of -log10


def normal_tail(z: float) -> float:
    """Lower tail of the standard normal distribution."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_moments(n: int, k: int, s2: float, s3: float) -> tuple[float, float]:
    """Mean and standard deviation of the chi-squared statistic against uniform frequencies over ``k``
    characters when the characters are drawn with sums of squares ``s2`` and cubes ``s3``."""
    pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    var = pairs * (s2 - s2 * s2) + 6 * triples * (s3 - s2 * s2)
    return k / n * (n * (n - 1) * s2 + n) - n, k / n * 2 * math.sqrt(max(var, 1e-12))


def battery(run: str) -> tuple[str, int, float, float]:
    """(encoding, length, chi-squared statistic, combined p-value that the run is random)."""
    body = run.rstrip("=")
    chars = set(body)
    name = next(x for x in NAMES if chars <= _SETS[x])
    place = _ORDER[name]
    x = np.fromiter(map(place.__getitem__, body), np.int64, len(body))
    n, k = len(x), len(place)
    counts = np.bincount(x, minlength=k)
    chi = float(k / n * (counts * counts).sum() - n)
    mean, sd = chi_moments(n, k, 1 / k, 1 / k / k)
    p_chi = 2 * normal_tail(-abs(chi - mean) / sd)
    above = x >= k / 2
    n1 = int(above.sum())
    n2 = n - n1
    if n1 and n2:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mu = 1 + 2 * n1 * n2 / n
        var = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = 2 * normal_tail(-abs(runs - mu) / math.sqrt(max(var, 1e-9)))
    else:
        p_runs = 2.0 ** (1 - n)
    c = x - x.mean()
    ss = float((c * c).sum())
    r = float((c[1:] * c[:-1]).sum()) / ss if ss else 1.0
    p_serial = 2 * normal_tail(-abs(r + 1 / n) * math.sqrt(n))
    t = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))  # Fisher: 2t is chi-squared, 6 degrees
    return name, n, chi, math.exp(-t) * (1 + t + t * t / 2)


def stratum(n: int) -> int:
    """Length stratum: quarter octaves."""
    return int(4 * math.log2(n))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_RUN = "array<struct<encoding:string,start:long,end:long,n:long,chi:double,p_random:double>>"
_T_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_T_RUN = pa.list_(pa.struct([("encoding", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()),
                             ("chi", pa.float64()), ("p_random", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(0))
        hits = pc.or_(pc.or_(pc.match_substring_regex(texts, "(?i)passw|secret|token|api_?key"),
                             pc.match_substring(texts, "AKIA")),
                      pc.match_substring_regex(texts, r"[A-Za-z0-9+/_-]{%d}" % MIN_RUN)).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        letters = np.bincount(raw, minlength=256)[:128]
        spans, runs = [], []
        for i in range(len(texts)):
            s, r = [], []
            if hits[i]:
                text = texts[i].as_py()
                s = base_spans(text)
                for m in RUN.finditer(text):
                    if not any(a < m.end() and m.start() < b for _, a, b in s):
                        name, n, chi, p = battery(m[0])
                        r.append({"encoding": name, "start": m.start(), "end": m.end(), "n": n, "chi": chi, "p_random": p})
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
            runs.append(r)
        n = len(texts)
        rest = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([*spans, None], _T_SPAN), pa.array([*runs, None], _T_RUN),
             pa.array([None] * n + [letters.tolist()], pa.list_(pa.int64()))],
            names=[*batch.schema.names[1:], "_spans", "_runs", "_letters"])


def discoveries(tests: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg by stratum: (stratum, bin) -> count gives stratum -> least bin that is a discovery."""
    out: dict[int, int] = {}
    for s in {k[0] for k in tests}:
        own = sorted(((b, c) for (t, b), c in tests.items() if t == s), reverse=True)
        total, seen = sum(c for _, c in own), 0
        for b, c in own:
            seen += c
            if total * 10 ** (-b * BIN) <= rate * seen:
                out[s] = b
    return out


def scan_secrets(docs: DataFrame, rate: float = 0.01, least_random: float = 1e-3, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns the columns ``keep`` (default doc_id; list the text here if it is
    wanted) and ``_s_spans``: an array of (kind, start, end) in code points, end
    exclusive, sorted by start and then by kind in the order assign, access,
    hex, random. ``rate`` is the false-discovery rate of the random kind
    within a length stratum, ``least_random`` the p-value below which the
    battery calls a run not random. A random span never overlaps one of the
    other kinds.

    Null and empty texts have no spans; repeated rows are scanned one by one;
    null ids are carried along; other columns do not matter; an empty table
    gives an empty result. The counts collected to the driver are bounded: 128
    character counts, and one number for each length stratum and p-value bin.
    """
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(F.col(text_col).alias("_scanned"), *quoted(keep))
    kinds = ddl(docs, keep)
    found = stored(source.mapInArrow(_scan, f"{kinds}_spans {_SPAN}, _runs {_RUN}, _letters array<long>"), "secrets")
    letters = np.zeros(128)
    for r in (found.where("_letters is not null").select(F.posexplode("_letters").alias("c", "n"))
              .groupBy("c").agg(F.sum("n").alias("n")).collect()):
        letters[r["c"]] = r["n"]
    power = {}
    for name, chars in ENCODINGS.items():
        q = np.array([letters[ord(c)] for c in chars]) + 1.0
        q /= q.sum()
        power[name] = (len(chars), float((q ** 2).sum()), float((q ** 3).sum()))

    def place(n: int, chi: float, name: str) -> int:
        """Bin of the p-value against ordinary text."""
        k, s2, s3 = power[name]
        mean, sd = chi_moments(n, k, s2, s3)
        p = normal_tail((chi - mean) / sd)
        return min(BINS, int(-math.log10(max(p, 1e-300)) / BIN))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(stratum(r["n"]), place(r["n"], r["chi"], r["encoding"]))
                    for rs in batch.column(0).to_pylist() for r in rs]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int32()),
                                              pa.array([b for _, b in rows], pa.int32())], names=["stratum", "bin"])

    rows = found.where("_letters is null")
    counted = (rows.where(F.size("_runs") > 0).select("_runs").mapInArrow(bins, "stratum int, bin int")
               .groupBy("stratum", "bin").count().collect())
    least = discoveries({(r["stratum"], r["bin"]): r["count"] for r in counted}, rate)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, runs in zip(batch.column("_spans").to_pylist(), batch.column("_runs").to_pylist()):
                spans = spans + [
                    {"kind": "random", "start": r["start"], "end": r["end"]} for r in runs
                    if r["p_random"] >= least_random
                    and place(r["n"], r["chi"], r["encoding"]) >= least.get(stratum(r["n"]), BINS + 1)]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, _T_SPAN)],
                                             names=[*batch.schema.names[:len(keep)], "_s_spans"])

    return rows.drop("_letters").mapInArrow(finish, f"{kinds}_s_spans {_SPAN}")


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of some kinds, joined by commas (a column)."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text, spans, mark: str = "[SECRET]"):
    """The text without the spans (columns). Spans may overlap; a mark replaces each stretch they cover."""
    step = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(
                acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .otherwise(acc["done"]).alias("done"),
            F.greatest(s["end"], acc["at"]).alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(step["done"], F.substring(text, (step["at"] + 1).cast("int"), F.length(text))))
