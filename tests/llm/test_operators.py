"""Operators against brute force, exact round trips and held-out accuracy, and on odd rows
(nulls, empty texts, ties, repeated rows, empty tables, extra columns with clashing names)."""

import hashlib
import io
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outagelens.llm import (_common, bpe, jaccard_join, ngram_lm, pairwise_rank, queries, secret_scan, url_filter, vector_graph,
                            vector_packing, warc, wrapper)

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t ", "one", "a  b ", "x<|endoftext|>y 'S DON'T", "é́ ≠ 日本　語 \x01 \xa0 x", "end\n", "word, " * 3000, "same text here", "same text here"]


@pytest.fixture(scope="session")
def llm(spark):
    return _common.ship(spark)


@pytest.fixture(scope="module")
def docs(llm):
    """The small table, odd rows, a null id, a repeated row and extra columns with names that operators use."""
    table = llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = llm.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id " * 8, "en", "s", 5), (10**6 + 3, "one", "en", None, 3)],
                              table.schema)
    return table.unionByName(odd).selectExpr("*", "1 as kept", "2 as score", "'x' as ids", "3 as n_words", "4 as spans").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def tokenizer(name):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary(name))
    tok.no_padding()
    tok.no_truncation()
    return tok


def test_components(llm):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (1000, 1000)] + [(500 + i, 501 + i) for i in range(60)]
    low = {}
    for a, b in edges:
        low[a], low[b] = a, b
    for _ in range(500):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    frame = llm.createDataFrame(edges + [(None, 4)], "a long, b long")
    want = dict(low)
    for limit in (200_000, 0):  # one finishing task, and contraction to the end
        old, _common.FINISH = _common.FINISH, limit
        try:
            got = {r.v: r.component for r in _common.connected_components(frame).collect()}
        finally:
            _common.FINISH = old
        assert got == want


def test_packing(docs, rows):
    pieces = vector_packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json")).collect()
    tok = tokenizer("word_bpe_49k.json")
    want = Counter((i, tuple([*tok.encode(t, add_special_tokens=False).ids, 1])) for i, t in rows)
    by, sequences = {}, {}
    for p in pieces:
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    whole = Counter()
    for (i, n), own in by.items():
        while own:  # repeated rows: follow the pieces from start to end
            got = []
            while len(got) < n:
                piece = next(p for p in own if p.start == len(got))
                own.remove(piece)
                got += np.frombuffer(piece.ids, "<u4").tolist()
            whole[i, tuple(got)] += 1
    assert whole == want
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])[:-1]]).tolist()
        n = sum(p.length for p in own)
        assert n <= 2048 and len(own) <= 64
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else 2048 - n)
    assert padding < 0.01 * total


def test_packing_limits():
    packer = vector_packing.Packer(64, 3, 40, 0)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 300)
    for i, n in enumerate(sizes.tolist()):
        packer.add(i, np.arange(n, dtype=np.uint32), min(n, int(rng.integers(1, 30))))
        packer.reduce(20)
    packer.finish()
    seen, bins = {}, {}
    for doc, start, ids, seq, offset in packer.take():
        seen.setdefault(doc, []).append((start, ids.tolist()))
        bins.setdefault(seq, []).append((doc, start, ids))
    assert all([x for _, ids in sorted(v) for x in ids] == list(range(sizes[d])) for d, v in seen.items()) and len(seen) == 300
    assert all(sum(len(i) for _, _, i in b) <= 64 and len(b) <= 3 for b in bins.values())


def test_letter_runs_are_encoded_once():
    """Letters of Latin-1 and the signs after them are known apart; the ids are the tokenizer's."""
    tok, coder = tokenizer("word_bpe_49k.json"), vector_packing.WordCoder(queries.vocabulary("word_bpe_49k.json"))
    signed = "\u00e9t\u00e9 \u00c9t\u00e9, \u00c9T\u00c9. \u00e9t\u00e9, stra\u00dfe Stra\u00dfe!!"
    assert [x.tolist() for x in coder.encode(pa.array([signed], pa.large_string()))] == [tok.encode(signed, add_special_tokens=False).ids]
    assert set(coder.index) == {"", "\u00e9t\u00e9", "stra\u00dfe", ",", ".", "!!"}
    rng = random.Random(3)
    signs = [*"abCDe'<|>!.,~ 01\t\n\x1c\xa0\x85\u00c0\u00df\u00ff\u00d7\xaa\xb5\u0130\u03a3\u03c2\u0301\u5b57\x01", "'s", "<|endoftext|>"]
    texts = ["", *("".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000))]
    got = [x.tolist() for x in coder.encode(pa.array(texts, pa.large_string()))]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_workers_forget_words_after_packing(llm, docs):
    def known(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((len(c.index) for c in vector_packing._coders.values()), default=0)])], names=["n"])

    vector_packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json")).write.format("noop").mode("overwrite").save()
    assert all(r.n <= 1 for r in llm.range(0, 16, 1, 16).mapInArrow(known, "n long").collect())


def test_secrets(docs, rows):
    got = secret_scan.scan_secrets(docs, keep=["doc_id", "text", "spans"]).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        want = [(m.start(), "assign", m.end()) for m in re.finditer(
            r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.A) if len(m[2]) >= 6]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda s: (s[0], secret_scan.KINDS.index(s[1])))
        assert [(s.start, s.kind, s.end) for s in r._s_spans if s.kind != "random"] == want


def test_secret_battery(llm):
    rng = random.Random(5)
    alphabet = secret_scan.ENCODINGS["base62"]
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(40)]
    words = ["internationalisation" * 2, "abcdefghijklmnopqrstuvwxyz", "z" * 50, "someVeryLongCamelCaseFunctionName", "thismethodreturnsthenumberofelements"]
    # not a pangram: its letters are uniform by construction, which is what the battery looks for
    texts = [f"The value of the long setting is {k} in the usual file of this page." for k in keys + words * 20]
    frame = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r._s_spans if s.kind == "random"] for r in secret_scan.scan_secrets(frame).collect()}
    assert sum(got[i] == [keys[i]] for i in range(40)) >= 36
    assert not any(got[i] for i in range(40, len(texts)))
    redacted = secret_scan.scan_secrets(frame, keep=["doc_id", "text"]).withColumn("clean", secret_scan.redact(F.col("text"), F.col("_s_spans")))
    for r in redacted.collect():
        assert r.clean == (texts[r.doc_id].replace(keys[r.doc_id], "[SECRET]") if got[r.doc_id] else r.text)


def brute_counts(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered)


def test_quality_rules(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = ngram_lm.quality_rules(docs, keep=["doc_id", "text", "kept"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_counts(r.text or "")
        assert tuple(r[f"_q_{c}"] for c in names) == want
        assert r._q_base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r._q_base_failed and r._q_kept)


def test_kneser_ney(llm):
    """Probabilities after a context sum to one, and equal a direct computation at the lowest order."""
    frame = llm.createDataFrame([(1, "abra cadabra abra banana band bandana cab"), (2, "abra abc abd abe")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    grams, contexts = ngram_lm.kneser_ney(ngram_lm.count_ngrams(frame))
    p = {(r.n, r.gram): np.exp(r.logp) for r in grams.collect()}
    b = {(r.n, r.gram): np.exp(r.logb) for r in contexts.collect()}
    letters = {g for n, g in p if n == 1}
    assert abs(sum(p[1, c] for c in letters) - 1) < 1e-6

    def prob(context, c):
        n = len(context) + 1
        if (n, context + c) in p:
            return p[n, context + c]
        return b.get((n - 1, context), 1.0) * prob(context[1:], c) if context else 0.0
    for n, context in b:
        if n:
            assert abs(sum(prob(context, c) for c in letters) - 1) < 1e-5


def test_quality_bands_keep_clean_documents(llm):
    table = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    got = ngram_lm.quality_rules(table).where("not _q_base_failed").join(labels, "doc_id").agg(
        F.avg(F.col("_q_kept").cast("int")).alias("share")).first()
    assert got.share > 0.98


def brute_log_perplexity(rows, order=5):
    """Log-perplexity of each (model key, text) under modified Kneser-Ney counts of the other fold, by recursion."""
    pads = {i: "\x02" * (order - 1) + " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) + "\x03" for i, (_, t) in enumerate(rows)}
    models = {}

    def model(key):
        if key in models:
            return models[key]
        own = [i for i, (k, _) in enumerate(rows) if k[1:] == key[1:] and len(pads[i]) > order]  # texts without words count nothing
        count = lambda ids: Counter(pads[i][j:j + order] for i in ids for j in range(len(pads[i]) - order + 1))
        level = {order: count(i for i in own if rows[i][0] != key)}
        names = {order: set(count(own))}
        for n in range(order - 1, 0, -1):
            level[n] = Counter(g[1:] for g, c in level[n + 1].items() if c > 0)
            names[n] = {g[1:] for g in names[n + 1]}
        facts = {}
        for n in level:
            k = Counter(level[n].values())
            if min(k[1], k[2], k[3], k[4]):
                y = k[1] / (k[1] + 2 * k[2])
                d = [0] + [max(m - (m + 1) * y * k[m + 1] / k[m], 0.01) for m in (1, 2, 3)]
            else:
                d = [0, 0.5, 1.0, 1.5]
            total, held = Counter(), Counter()
            for g, c in level[n].items():
                total[g[:-1]] += c
                held[g[:-1]] += d[min(c, 3)]
            facts[n] = d, total, held

        def p(g):
            n = len(g)
            below = p(g[1:]) if n > 1 else 1 / len(names[1])
            d, total, held = facts[n]
            if not total[g[:-1]]:
                return below
            c = level[n][g]
            return (max(c - d[min(c, 3)], 0) + held[g[:-1]] * below) / total[g[:-1]]
        return models.setdefault(key, p)
    out = []
    for i, (key, _) in enumerate(rows):
        places = range(len(pads[i]) - order + 1)
        out.append(-sum(np.log(model(key)(pads[i][j:j + order])) for j in places) / len(places) if len(pads[i]) > order else None)
    return out


def test_log_perplexity_by_brute_force(llm, monkeypatch):
    """Slices, chunks, hash ranges and folds give the same figures as counts in one dictionary; a null, an empty
    and a repeated text, letters beyond 16 bits and two languages."""
    rng = random.Random(8)
    words = ["band", "bandana", "Cab.", "a", "ab", "été", "\U0001F600x", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    data = [(i, t, rng.choice(["x", "y", None])) for i, t in enumerate([*texts, None, " \n", "a\tb\n a", texts[0]])]
    frame = llm.createDataFrame(data, "doc_id long, text string, lang string").repartition(3, "doc_id")
    keyed = frame.select("doc_id", "text", "lang", ngram_lm.model_key(F.col("text"), F.col("lang")).alias("k")).collect()
    want = brute_log_perplexity([(r.k, r.text or "") for r in keyed])
    got = {r.doc_id: r._q_log_perplexity for r in ngram_lm.quality_rules(frame).collect()}
    for r, w in zip(keyed, want):
        assert (got[r.doc_id] is None) == (w is None)
        assert w is None or abs(got[r.doc_id] - w) < 1e-4
    import pyarrow as pa
    texts, langs = pa.array([r.text or "" for r in keyed], pa.large_string()), pa.array([r.k for r in keyed])
    whole = ngram_lm._slice_keys(texts, langs)
    monkeypatch.setattr(ngram_lm, "CHUNK", 37)
    assert (ngram_lm._slice_keys(texts, langs) == whole).all()


def test_bands_reject_planted_junk(llm):
    """Texts of random letters go and clean documents stay; word order counts: a shuffled text has a higher
    log-perplexity than the text itself."""
    table = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = {r.doc_id: r.quality for r in llm.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows, rng = table.collect(), random.Random(5)
    clean = [r for r in rows if r.lang == "en" and labels.get(r.doc_id) == 1 and len((r.text or "").split()) >= 200]
    source = rng.sample(clean, 20)
    junk = []
    for i in range(20):
        words = source[i].text.split()
        noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)]
        junk += [(10**7 + i, " ".join(rng.sample(words, len(words))), "en"), (2 * 10**7 + i, " ".join(noise), "en")]
    frame = _common.stored(table.unionByName(llm.createDataFrame(junk, table.schema)), "planted")
    got = {r.doc_id: r for r in ngram_lm.quality_rules(frame).where("not _q_base_failed").collect()}
    share = lambda rows: sum(r._q_kept for r in rows) / len(rows)
    assert not any(got[2 * 10**7 + i]._q_kept for i in range(20))
    higher = sum(got[10**7 + i]._q_log_perplexity > got[r.doc_id]._q_log_perplexity for i, r in enumerate(source) if r.doc_id in got)
    assert higher >= 0.95 * sum(r.doc_id in got for r in source)
    assert share([r for i, r in got.items() if labels.get(i) == 1]) > 0.98


def test_warc_format():
    data = b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Payload-Digest", warc.digest(p))], p)
                    for i, p in enumerate([b"", b"x" * 300_000, "é\r\n\r\nz".encode()]))
    assert [p for _, p in warc.read_records(io.BytesIO(data))] == [b"", b"x" * 300_000, "é\r\n\r\nz".encode()]
    with pytest.raises(warc.DigestError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    bad = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", warc.digest(b"a"))], b"b")
    with pytest.raises(warc.DigestError):
        list(warc.read_records(io.BytesIO(bad)))


def test_warc_round_trip(llm):
    big = "<p>" + "copy " * 50
    table = [(1, "http://a/", "small"), (2, "u", "small"), (5, "u", big), (3, "u\r\nx", big), (9, None, big), (3, "u", big), (None, "u", big), (8, "u", None)]
    got = warc.round_trip(llm.createDataFrame(table, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha")).collect()
    assert Counter((r.record_id, r.record_type, r.refers_to) for r in got) == Counter({
        ("<urn:page:1>", "response", None): 1, ("<urn:page:2>", "response", None): 1, ("<urn:page:5>", "revisit", "<urn:page:3>"): 1,
        ("<urn:page:3>", "response", None): 2, ("<urn:page:9>", "revisit", "<urn:page:3>"): 1, ("<urn:page:None>", "response", None): 1,
        ("<urn:page:8>", "response", None): 1})
    assert {r.payload_digest for r in got if r.record_id == "<urn:page:9>"} == {warc.digest(big.encode())}


def brute_jaccard(rows):
    sets = []
    for i, t in rows:
        ws = t.encode().lower().split()
        sets.append((i, frozenset(tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()))
    low = [i for i, _ in sets]
    for _ in range(20):
        for a, (i, x) in enumerate(sets):
            for b in range(a):
                j, y = sets[b]
                if x and y and i is not None and j is not None and low[a] != low[b] and 100 * len(x & y) >= 80 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
    return Counter((i, len(x), c) for (i, x), c in zip(sets, low))


def test_jaccard(docs, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect())
    assert got == brute_jaccard(rows)


def test_jaccard_group_of_near_copies(llm):
    """One base with random edits: a list of many members whose pairs lie around the threshold."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(90):
        ws = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            ws[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(
        llm.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_jaccard(rows)


def test_jaccard_sketch_and_size_classes(llm):
    """Sketches never differ in more bits than sets in tokens, and links across a border of size classes are found at any threshold."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, k).astype(np.uint64)) for k in (1, 3, 60, 300, 900, 900)]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    got = jaccard_join.parity_sketch(owner, np.concatenate(sets), len(sets) + 1)
    assert got.shape == (7, jaccard_join.SKETCH) and not got[6].any()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert sum(int(v).bit_count() for v in (got[i] ^ got[j]).view(np.uint64)) <= len(np.setxor1d(x, y))
    words = [f"w{k}" for k in range(70)]
    rows = [(k, " ".join(words[:k])) for k in (5, 6, 7, 8, 9, 12, 20, 36, 68)]  # 1, 2, 3, 4, 5, 8, 16, 32, 64 shingles
    table = llm.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 80):
        want = {}
        for k, _ in rows:
            near = [want[j] for j, _ in rows if j < k and 100 * (j - 4) >= percent * (k - 4)]
            want[k] = min(near, default=k)
        assert {r.doc_id: r.component_id for r in jaccard_join.similar_documents(table, percent=percent).collect()} == want


def test_bpe(docs, rows):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.encode_documents(docs, path, block_bytes=1 << 16).collect())
    tok = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, len(ids), ",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_decode_join(llm):
    path, tok = queries.vocabulary("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    rows = [(i, tok.encode(t or "", add_special_tokens=False).ids if t is not None else None, t or "") for i, t in enumerate(ODD)]
    got = bpe.decode_ids(llm.createDataFrame(rows, "doc_id long, ids array<int>, text string"), path)
    assert {r.doc_id: r.text for r in got.collect()} == {i: t for i, _, t in rows}


def test_urls(llm):
    urls = ["https://A.Example.NET/en/x?q#f", "http://net", "http://net/", "x://sub.net/a", "http://example.com/de/1", "http://b.example.com/de/", "no scheme",
            None, "http://m.org/fr/#x", "http://casinowinner.info/bets", "http://history.info/page/3", "a://b://c/d", "http://notnet/", "//x"]
    table = llm.createDataFrame([(i, u, "<p>history page info the history of this page") for i, u in enumerate(urls)] * 20,  # the models need counts
                                "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(table.selectExpr("*", "1 as host", "2 as rule")).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host, tail = re.fullmatch(r"([^/?#]*)(.*)", rest, re.S).groups()
            host, path = host.lower(), re.match(r"[^?#]*", tail)[0]
        fits = [(len(r), v, r) for v, r in url_filter.RULES
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[2] if fits else None)
        if fits:
            assert got[i].verdict == max(fits)[1]
    assert url_filter.Segmenter({"history": 50, "page": 30}).split("casinohistorypage") == ["casino", "history", "page"]
    assert got[9].verdict == "block" and got[10].verdict == "allow"


def test_urls_keep_every_word(llm):
    """More distinct words than any table that fits a driver's cap: the rarest word still splits a host, rare tokens are scored."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26 ** k % 26] for k in range(4)) + "q"
    many = " ".join(word(i) for i in range(300_000))
    pages = [(0, "http://none/", f"<p>{many}</p>"), (1, "http://casino.aa/rarepath", "<p>zebrafish</p>"), (2, "http://zebrafishcasino.bb/rarepath", ""),
             (3, "http://zebrafish.cc/rarepath", ""), (4, "http://zebrafish.cc/other", "")]
    got = url_filter.judge_urls(llm.createDataFrame(pages, "page_id long, url string, html string"))
    seen = {r.page_id: r.log_odds for r in got.collect()}
    counts = {"zebrafish": 1, **{word(i): 1 for i in range(300_000)}}
    split = url_filter.Segmenter(counts).split
    assert split("zebrafishcasino") == ["zebrafish", "casino"]
    tokens = {}
    for i, u, _ in pages:
        names, digits = url_filter.name_parts(*re.match(r"http://([^/]*)(.*)", u).groups())
        tokens[i] = [k + w for k, name in names for w in split(name)] + digits
    block = Counter(t for i in (1, 2) for t in tokens[i])
    allow = Counter(t for i in (0, 3, 4) for t in tokens[i])
    size = len(block | allow) + 1
    weight = lambda t: np.log((block[t] + 1) / (block.total() + size)) - np.log((allow[t] + 1) / (allow.total() + size))
    for i in tokens:
        assert abs(seen[i] - np.log(3 / 4) - sum(map(weight, tokens[i]))) < 1e-9


def test_wrapper(llm):
    page = ('<html><head><title>t</title></head><body><nav>menu</nav><div class="cookie-notice">c</div><article><header>h</header><h1>Title {n} &amp; more</h1>'
            '<p>First <b>bold<br>line</b>&nbsp;{n}<script>x("</p>")</script><!-- c --><p>a < b{extra}</p><div class="share">s</div><section id="comments"><p>no</p>'
            '</section></article><aside>side</aside><footer>f</footer>')
    pages = [(n, "http://h/", page.format(n=n, extra="<ul><li>one<li>two</ul>" if n % 2 else "")) for n in range(12)]
    pages += [(100, "http://h/", None), (101, None, ""), (None, "x", "<p>plain"), (102, "http://k/", "<body><div class=menu>m</div><div class=c><p>own<p>text</div>")]
    table = llm.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "'z' as wrapper", "3 as text")
    got = {r.page_id: r.text for r in wrapper.extract_main_text(table).collect()}
    for n in range(12):
        assert got[n] == f"Title {n} & more\nFirst bold line {n}\na < b" + ("\none\ntwo" if n % 2 else "")
    assert (got[100], got[101], got[None], got[102]) == ("", "", "plain", "own\ntext")
    merged = wrapper.align(wrapper.generalise(wrapper.parse("<body><p>a<p>b<div>c</div>")), wrapper.generalise(wrapper.parse("<body><p>x<h2>y</h2>")))
    assert wrapper.expression(merged) == "(<#>(<body>(<p>#TEXT</p>)+ (<h2>y</h2>)? (<div>c</div>)?</body>)</#>)"


@pytest.mark.parametrize("n", [9, 10, 1000])
def test_wrapper_keeps_constant_text(llm, n):
    for box, out in (("article", ""), ("main", ""), ("div class=post", "<div class=menu>m</div>")):
        page = "<body>" + out + f"<{box}><h1>Same title</h1><div class=x>lead same</div><p>body {{}}</p></{box.split()[0]}><footer>f</footer>"
        table = llm.createDataFrame([(i, "http://h/", page.format(i)) for i in range(n)], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in wrapper.extract_main_text(table).collect()}
        assert got == {i: f"Same title\nlead same\nbody {i}" for i in range(n)}


def test_wrapper_mixed_templates(llm):
    """Pages of one host with an article, with main, with a heading above the container and with texts under other parents."""
    kinds = ["<body><nav>m</nav><article><h1>T{0}</h1><p>a {0}</article><aside>s</aside>",
             "<body><nav>m</nav><main><h1>T{0}</h1><p>b {0}</main>",
             "<body><h1>T{0}</h1><div class=hero><p>c {0}</div>",
             "<body><div class=left><h1>T{0}</h1><p>d {0}</div><div class=right><p>e {0}</div><div class=share>no</div>",
             "<body><h1>T{0}</h1><article><p>g {0}<section id=comments>no</section><article class=comment>no</article></article>",
             "<body><table><tr><td><h1>T{0}</h1><td>k {0}</table>"]
    want = ["T{0}\na {0}", "T{0}\nb {0}", "T{0}\nc {0}", "T{0}\nd {0}\ne {0}", "T{0}\ng {0}", "T{0}\nk {0}"]
    for many in (1, 14):
        rows = [(i * 10 + k, "http://h/x", page.format(i)) for i in range(many) for k, page in enumerate(kinds)]
        table = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        got = {r.page_id: r.text for r in wrapper.extract_main_text(table).collect()}
        assert got == {i * 10 + k: text.format(i) for i in range(many) for k, text in enumerate(want)}


def test_wrapper_odd_pages(llm):
    """Deep nesting, quotes that never close, ends without starts: whole texts in linear time."""
    deep, quotes = "<div>" * 100_000 + "deep" + "</div>" * 100_000, '<a ="> "' * 125_000 + "end"
    pages = [(1, deep), (2, quotes), (3, '<a "' * 250_000), (4, "<h1>" * 100_000 + "x"), (5, "<p>t" + "</x>" * 100_000), (6, "a<"),
             (7, "<!--"), (8, "x<!-- y"), (9, "x <script>y"), (10, "<svg/>t<p title=it's>k"), (11, '<p title="a>b">u</p>')]
    table = llm.createDataFrame([(i, f"http://h{i}/", html) for i, html in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract_main_text(table).collect()}
    assert got[1] == "deep" and got[2].endswith("end") and len(got[3]) > 900_000 and got[4] == "x"
    assert [got[i] for i in range(5, 12)] == ["t", "a<", "", "x", "x", "t\nk", "u"]


def test_wrapper_tables(llm):
    """Wrappers survive packing, and aligning is the same in any split of the pages over tasks."""
    pages = [f"<body><ul><li>{i}<li>b</ul>" + ("<p>x" if i % 3 else "") + f"<div class=c{i}>same</div>" for i in range(12)]
    trees = [wrapper.generalise(wrapper.parse(p)) for p in pages]
    whole = None
    for tree in trees:
        whole = wrapper.unpack(wrapper.pack(tree)) if whole is None else wrapper.align(whole, wrapper.unpack(wrapper.pack(tree)))
    assert wrapper.unpack(wrapper.pack(whole)) == whole and whole["n"] == 12
    assert wrapper.expression(whole) == "(<#>(<body>(<ul>(<li>#TEXT</li>)+</ul>) (<p>x</p>)? (<div.c0>same</div>)</body>)</#>)"


def test_features_take_bounded_memory():
    """A batch is cut by the bytes of its texts, and the cuts change no feature."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeXYZ01,.", k=6)) for _ in range(rng.randint(0, 1400))) for _ in range(400)] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["_r_text", "doc_id"])
    tracemalloc.start()
    parts = list(pairwise_rank._add_features(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts))) and peak < 250e6
    x = np.concatenate([p.column(1).flatten().to_numpy() for p in parts]).reshape(len(texts), -1)
    assert (x[:400] == pairwise_rank.features(_common.texts_of(batch.column(0).slice(0, 400))).astype(np.float32)).all()


def test_ranking(llm):
    table = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = llm.createDataFrame([(None, None, "en"), (10**7, "", "en")], "doc_id long, text string, lang string")
    got = pairwise_rank.rank_documents(table.select("doc_id", "text", "lang").unionByName(extra).selectExpr("*", "0.5 as score"), labels).cache()
    assert got.count() == table.count() + 2 and got.where("_r_score is null or _r_score < 0 or _r_score > 1").count() == 0
    held = got.where("_r_held_out").join(labels, "doc_id").select("quality", "_r_predicted").collect()
    assert len(held) > 40 and np.mean([r.quality == r._r_predicted for r in held]) > 0.9
    one = pairwise_rank.rank_documents(table.limit(5), labels.where("quality = 1"))
    assert {r._r_predicted for r in one.collect()} == {1}


def test_ranking_threshold_covers_all_documents(llm):
    """Many unlabelled documents of another quality: the share rejected of all is the share labelled 0, not that of labelled scores."""
    table = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rng = random.Random(4)
    junk = [(10**7 + i, " ".join("".join(rng.choices("x#%7$Q|", k=rng.randrange(1, 9))) for _ in range(60))) for i in range(800)]
    docs = table.unionByName(llm.createDataFrame(junk, "doc_id long, text string"))
    got = pairwise_rank.rank_documents(docs, labels).cache()
    own = docs.join(labels, "doc_id").where(pairwise_rank.training_rows())
    share = own.where("quality = 0").count() / own.where("quality in (0, 1)").count()
    assert abs(got.where("_r_predicted = 0").count() / got.count() - share) < 0.02


def test_vectors(llm):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    near = np.repeat(base[:30], 12, axis=0) + rng.normal(size=(360, 16)) * 0.08
    x = np.concatenate([base, near, base[:5] * 3, base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (None, x[0].tolist()),
           (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [float("inf")] * 16)]
    frame = llm.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as kept", "2 as w")
    got = vector_graph.near_vectors(frame).collect()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(50):
        low = np.minimum(low, np.where(link, low, 10**6).min(axis=1))
    seen = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    found = sum(seen[i].n_links for i in range(len(x)))
    assert 0.97 * link.sum() <= found <= link.sum()
    assert all(seen[i].n_links <= link[i].sum() for i in range(len(x)))
    assert np.mean([seen[i].component_id == low[i] for i in range(len(x))]) > 0.97
    assert all(seen[i].n_links == 0 and seen[i].component_id == i and seen[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9008))
    assert seen[9007].component_id == 9006 and seen[9006].n_links == 1 and not seen[9007].kept


def test_vectors_linked_across_shards(llm, monkeypatch):
    """More near copies that all link with each other than a shard holds, in split shards and in shards dealt by hash."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(500, 16)) * 0.1, rng.normal(size=(400, 16))]).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() > 200_000
    frame = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "MOST", 100)
    for levels in (8, 1):
        monkeypatch.setattr(vector_graph, "LEVELS", levels)
        seen = {r.vec_id: r for r in vector_graph.near_vectors(frame).collect()}
        assert len(seen) == len(x)
        assert np.mean([seen[i].n_links == link[i].sum() for i in range(len(x))]) > 0.99
        assert len({seen[i].component_id for i in range(500)}) == 1


def test_empty_tables(llm):
    d = llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    p = llm.createDataFrame([], "page_id long, url string, html string")
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    word, byte = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
    for frame in (vector_graph.near_vectors(llm.createDataFrame([], "vec_id long, embedding array<float>")), vector_packing.pack_documents(d, word),
                  secret_scan.scan_secrets(d), ngram_lm.quality_rules(d), warc.round_trip(p), jaccard_join.similar_documents(d),
                  bpe.encode_documents(d, byte), url_filter.judge_urls(p), wrapper.extract_main_text(p), pairwise_rank.rank_documents(d, labels)):
        assert frame.count() == 0


def test_digests_of_queries(llm):
    got = queries.QUERIES["op7_bpe_words"](llm, SF)
    texts = {r.doc_id: r.text or "" for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got.collect())
