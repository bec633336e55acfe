"""URL filter: host rules first, then naive Bayes over segmented host and path tokens.

Concatenated names in hosts are split into words by a unigram Viterbi model
whose counts come from the pages themselves; a multinomial naive Bayes model
over host and path tokens gives the verdict where no rule fits. It is trained
on all pages with weak labels: a page whose host holds a word of a seed list is
an example to block, the others are examples to allow. All counts are Spark tables: names are segmented with
those words of the unigram table that a join finds among their substrings, and
log-odds are sums over a join of tokens with the table of all tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored, texts_of

# fixed values: (verdict, rule)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# fixed values: words of hosts that are unwanted
SEEDS = ("ads adult affiliate bet bets betting bingo casino cheap click clickbait coupon crack dating doubleclick escort "
         "gamble gambling jackpot keygen loan loans lottery payday pharma pills poker popup porn promo prize replica roulette "
         "sex slots spam torrent track tracker tracking viagra warez win winner xxx").split()

LONGEST = 24           # letters of a word the segmenter knows
SEED_SHARE = 1e-4      # least unigram probability of a seed word

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- host, path and rules

def host_and_path(url):
    """(host, path) columns: the host after the first ``://`` with A-Z in lower case, the path up to ? or #."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(host, path, rules=None):
    """(rule, verdict) columns of the longest rule that fits, else null.

    A rule fits its host and all its subdomains when the path starts with the
    rule's; of rules of one length the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(reversed(RULES if rules is None else rules), key=lambda r: len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------- unigram Viterbi

class Segmenter:
    """Splits names into the most likely words under unigram counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: of the counts of all words, if ``counts`` has only some of them."""
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.unknown = math.log(1 / self.total)
        self.learn(counts)

    def learn(self, counts: dict[str, int]) -> Segmenter:
        """Take these words instead of those known."""
        self.logp = dict.fromkeys(SEEDS, math.log(SEED_SHARE))
        for w, c in counts.items():
            if len(w) <= LONGEST:
                self.logp[w] = max(self.logp.get(w, -99.0), math.log(c / self.total))
        return self

    def word(self, w: str) -> float:
        return self.logp.get(w, self.unknown - 2.3 * len(w))  # an unknown word: a tenth for each letter

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = [(best[k] + self.word(name[k:end]), k) for k in range(max(0, end - LONGEST), end)]
            p, k = max(options)
            best.append(p)
            back.append(k)
        words, end = [], len(name)
        while end:
            words.append(name[back[end]:end])
            end = back[end]
        return words[::-1]


def name_parts(host: str, path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Names of a host (h:) and a path (p:) that are to be split, and the tokens of their digits."""
    names = [("h:", w) for w in re.findall(r"[^\W\d_]+", host)] + [("p:", w) for w in re.findall(r"[^\W\d_]+", path.lower())]
    return names, ["h:#" for _ in re.findall(r"\d+", host)] + ["p:#" for _ in re.findall(r"\d+", path)]


def word_counts(pages: DataFrame, text_col: str) -> DataFrame:
    """(word, c): words of ASCII letters, 2 to ``LONGEST`` of them, in the visible text of all pages (not in the urls,
    whose run-together names would count as words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = pc.replace_substring_regex(texts_of(batch.column(0)), r"<[^>]*>", " ")
            lists = pc.split_pattern_regex(pc.ascii_lower(html), r"[^a-z]+")
            found = lists.flatten().value_counts()
            words, c = found.field(0), found.field(1)
            n = pc.utf8_length(words)
            mine = pc.and_(pc.greater_equal(n, 2), pc.less_equal(n, LONGEST))
            yield pa.RecordBatch.from_arrays([words.filter(mine).cast(pa.string()), c.filter(mine).cast(pa.int64())], names=["word", "c"])

    return (pages.select(text_col).mapInArrow(run, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words): each of the distinct names split under all unigram counts (word, c).

    A name meets the words that it holds by an equi-join on its substrings;
    adaptive execution splits the rows of a substring that many names have.
    """
    total = words.agg(F.sum("c")).first()[0] or 0

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                own, found = [], []
                for name in batch.column(0).slice(low, 2000).to_pylist():
                    got = {name[k:k + n] for run in re.finditer("[a-z]{2,}", name) for k in range(run.start(), run.end() - 1)
                           for n in range(2, min(LONGEST, run.end() - k) + 1)}
                    own += [name] * len(got)
                    found += got
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.string())], names=["name", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter({}, total)
        for batch in batches:
            out = [segmenter.learn({f["word"]: f["c"] for f in found or ()}).split(name)
                   for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    held = (names.mapInArrow(substrings, "name string, word string").join(words, "word")
            .groupBy("name").agg(F.collect_list(F.struct("word", "c")).alias("found")))  # of one name
    return names.join(held, "name", "left").select("name", "found").mapInArrow(split, "name string, words array<string>")


# ---------------------------------------------------------------- naive Bayes

def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
               rules=None) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, log_odds).

    ``verdict`` is the longest fitting rule's, else ``block`` where the log-odds
    of the naive Bayes model are positive, else ``allow``. A null url or one
    without ``://`` has an empty host and path and the verdict of the prior.
    Null ids are carried along, repeated rows judged alike and counted each;
    other columns do not matter; an empty table gives an empty result.

    Every word and token counts, however many there are: nothing but totals is
    gathered. Names are split and pages judged once for each distinct name and
    each distinct (host, path).
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    words = stored(word_counts(pages, text_col), "url-words")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, p, pages in zip(*(c.to_pylist() for c in batch.columns)):
                names, digits = name_parts(h, p)
                counts: dict[tuple, int] = {("", None, ""): 1}  # the empty token counts pages
                for key in [(kind, name, None) for kind, name in names] + [("", None, t) for t in digits]:
                    counts[key] = counts.get(key, 0) + 1
                out += [(h, p, pages, *key, n) for key, n in counts.items()]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["host", "path", "pages", "kind", "name", "token", "times"])

    found = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")).mapInArrow(
        parts, "host string, path string, pages long, kind string, name string, token string, times long"), "url-parts")
    named = found.where("name is not null")
    split = stored(split_names(named.select("name").distinct(), words), "url-names")
    whole = ["host", "path", "pages"]
    tokens = found.where("name is null").select(*whole, "token", "times").unionByName(
        named.join(split, "name").select(*whole, F.explode("words").alias("word"), "kind", "times")
        .select(*whole, F.concat("kind", "word").alias("token"), "times"))
    tokens = tokens.groupBy(*whole, "token").agg(F.sum("times").alias("times"))
    tokens = stored(tokens, "url-tokens")
    marked = tokens.where(F.col("token").isin([f"h:{w}" for w in SEEDS])).select("host", "path", F.lit(True).alias("bad")).distinct()
    counted = (tokens.join(marked, ["host", "path"], "left").groupBy("token")
               .agg(F.sum(F.expr("if(bad, pages * times, 0)")).alias("block"), F.sum(F.expr("if(bad, 0, pages * times)")).alias("allow")))
    counted = stored(counted, "url-counts")
    n = counted.where("token = ''").select("block", "allow").first() or (0, 0)
    size, *totals = counted.where("token <> ''").agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    block, allow = (float(t + size + 1) for t in totals)
    weights = counted.select("token", F.when(F.col("token") == "", F.lit(math.log((n[0] + 1) / (n[1] + 1)))).otherwise(
        F.log((F.col("block") + 1) / F.lit(block)) - F.log((F.col("allow") + 1) / F.lit(allow))).cast("decimal(20,14)").alias("weight"))
    # decimals: the sum does not depend on the order of its terms
    odds = (tokens.join(weights, "token").groupBy("host", "path")
            .agg(F.sum(F.col("weight") * F.col("times").cast("decimal(12,0)")).cast("double").alias("log_odds")))
    judged = rows.join(odds, ["host", "path"])
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
