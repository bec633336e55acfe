"""Centroids, spelling variants and pieces with spans against brute force, and on odd rows
(nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names)."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.llm import _common, centroids, pieces, queries, spelling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def llm(spark):
    return _common.ship(spark)


# ---------------------------------------------------------------- centroids

def lloyd(rows, k, rounds):
    """Plain integers; rows are (id, components)."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in hashed[:k]]
    if not at:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        at = [[sum(x) // own.count(j) for x in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c
              for j, c in enumerate(at)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(at[c])) for i, c, d in out)


def vector_rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(scale=0.4, size=64)).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (9, rows[8][1]), (None, rows[3][1]), (None, None), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65),
             (204, [0.5] * 63 + [None]), (205, [0.5] * 63 + [float("nan")]), (206, [float("inf")] + [0.5] * 63), (207, [-0.0] * 64),
             (208, [3.0e4] * 64), (209, [1 / 2048, -1 / 2048] * 32)]
    return rows


@pytest.mark.parametrize("rounds", [1, 10])
def test_centroids(llm, rounds, monkeypatch):
    rows = vector_rows()
    frame = llm.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    want = lloyd(rows, 8, rounds)
    for cells in (centroids.TABLE_CELLS, 0):  # presence table, and sorted values
        monkeypatch.setattr(centroids, "TABLE_CELLS", cells)
        got = centroids.cluster_vectors(frame, rounds=rounds).collect()
        assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == want


def test_centroids_few_and_none(llm):
    shape = "vec_id long, embedding array<double>"
    three = [(1, [0.1] * 64), (1, [0.1] * 64), (2, [0.9] * 64)]
    got = centroids.cluster_vectors(llm.createDataFrame(three, shape)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == lloyd(three, 8, 10)
    for rows in ([], [(5, None)], [(None, [0.1] * 64)]):
        assert centroids.cluster_vectors(llm.createDataFrame(rows, shape)).collect() == []


def test_distances_by_table():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-centroids.LARGEST, centroids.LARGEST, (50, 64)), rng.integers(-5000, 5000, (8, 64))
    assert (centroids.squared_distances(v, c) == ((v[:, None] - c) ** 2).sum(axis=2)).all()
    with pytest.raises(ValueError):
        centroids.squared_distances(np.full((1, 64), centroids.LARGEST + 1), c)


# ---------------------------------------------------------------- spelling

def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = None if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [o for o in n if near_words(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def misspelt():
    rng = random.Random(2)
    letters = "aeiorstnéÀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(25)]
    rows = []
    for i in range(700):
        own = []
        for _ in range(6):
            w = words[min(int(rng.expovariate(0.4)), 24)]
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1:]])
            own.append(rng.choice([w, w, w.capitalize()]))
        rows.append((i, rng.choice([" ", ", ", "\n", "-1 "]).join(own)))
    chain = "firststep " * 200 + "firststop " * 20 + "firstsstop " * 2  # a form of a form
    long = "é" * 400 + "abcdefg"
    return rows + [(None, chain), (None, None), (8000, None), (8001, ""), (8002, "×÷×÷×÷× " * 3 + "ß" * 8), (8003, f"{long} {long}x {long}"), (8003, f"{long}x")]


@pytest.mark.parametrize("cell,block", [(1 << 19, 256), (90, 3)])
def test_spelling(llm, cell, block, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_LETTERS", cell)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = misspelt()
    frame = llm.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(6)
    got = spelling.spelling_variants(frame).collect()
    want = variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form and r.root != r.form for r in got) and sum(r.n_near for r in got) > 50


def test_spelling_empty(llm):
    frame = llm.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(frame).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame, ratio=1)


def test_spelling_buckets_meet_every_near_pair():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10))) for _ in range(800)}
    arr = np.array(sorted(words))
    sides = {k: spelling._Side(np.flatnonzero(np.char.str_len(arr) == k), arr) for k in (7, 8, 9)}
    found = {tuple(sorted((arr[i], arr[j]))) for a in sides for b in (a, a - 1) if b in sides
             for x, y in spelling._near_pairs(sides[a], sides[b]) for i, j in zip(x, y)}
    assert found == {tuple(sorted((a, b))) for a in words for b in words if a < b and near_words(a, b)}


# ---------------------------------------------------------------- pieces

ODD = ["", " ", "  a", "a  b ", "\n", "▁", "▁ ▁a", "\x00x\x01", "é́ ≠ 日本　語 \xa0 x", "end\n", "<s> <0x41> <unk>", "x" * 5000, " " * 40, "word, " * 900]


def library(rule=None, trim=None, prefix=None):
    """The given model, or with another normalisation; never trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as file:
        model = proto.ModelProto.FromString(file.read())
    if rule:
        model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    if trim is not None:
        model.normalizer_spec.remove_extra_whitespaces = trim
    if prefix is not None:
        model.normalizer_spec.add_dummy_prefix = prefix
    data = model.SerializeToString()
    return data, sentencepiece.SentencePieceProcessor(model_proto=data)


@pytest.mark.parametrize("rule,trim,prefix", [(None, None, None), ("nmt_nfkc", None, None), ("nfkc_cf", False, None), (None, True, None), (None, False, False)])
def test_pieces_and_spans_equal_the_library(rule, trim, prefix):
    data, processor = library(rule, trim, prefix)
    model = pieces.Model(data)
    rng = random.Random(6)
    alphabet = [*"abcDE  \n\t.▁é½ﾊﾞＨ😀日本①ﬁ\x01 ​\x00Å한각", "é", "  ", "▁▁", "가", "ซำ"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(x) for x in raw]))
    offsets, ids, low, high = pieces.encode_texts(model, np.frombuffer(b"".join(raw), np.uint8), starts)
    for i, text in enumerate(texts):
        at = slice(offsets[i], offsets[i + 1])
        want = [(p.id, p.begin, p.end) for p in processor.encode(text, out_type="proto").pieces]
        assert list(zip(ids[at].tolist(), low[at].tolist(), high[at].tolist())) == want, text
    if rule:
        for text in texts[:300]:
            got, _, align = pieces.normalise(model, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), True)
            assert got.tobytes().decode() == processor.normalize(text)


def test_pieces_of_documents(llm):
    _, processor = library()
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdeé\n") for _ in range(rng.randrange(1, 9))) for _ in range(30_000))
    table = llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (3, "again"), (3, "again"), (5, None), (10**7, long), (10**7 + 1, long.replace(" ", "　"))]
    frame = llm.createDataFrame([(*r, "x", 4) for r in rows], "doc_id long, text string, ids string, ends int").repartition(3)
    for part in (pieces.PART_BYTES, 20_000):  # long texts whole, and part by part
        got = pieces.encode_documents(frame, "piece_bpe_32k.model", part_bytes=part).collect()
        want = Counter()
        for i, t in rows:
            spans = processor.encode(t or "", out_type="proto").pieces
            ids = [p.id for p in spans]
            want[i, tuple(ids), tuple(p.begin for p in spans), tuple(p.end for p in spans), processor.decode(ids) if ids else ""] += 1
        assert Counter((r.doc_id, tuple(r.ids), tuple(r.starts), tuple(r.ends), r.decoded) for r in got) == want
    assert pieces.encode_documents(frame.where(F.lit(False)), "piece_bpe_32k.model").collect() == []


def test_pieces_query(llm):
    _, processor = library()
    texts = {r.doc_id: r.text for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_piece_spans"](llm, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = processor.encode(texts[r.doc_id])
        assert (r.n_tokens, r.end_byte) == (len(ids), len(texts[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
