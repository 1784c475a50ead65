"""Token alignment, license scans and hard negatives against brute force, and on odd, empty and repeated rows."""

import bisect
import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import alignment, hard_negatives, license_scan

PATHS = (vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, vocabularies.path("piece_bpe_32k.model"))


# token alignment ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def plain_groups(text, libraries):
    """Groups of ids of a text by byte ends, from the libraries over the whole text; None where tokens do not spell it."""
    a, b = libraries
    if not text:
        return None
    of = alignment._byte_of()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = ([bytes(of[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
    if any(b"".join(d) != (" " + text).encode() for d in data):
        return None
    ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side in (0, 1):
        for i, e in zip(ids[side], ends[side]):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    return groups


def brute_alignment(texts, libraries):
    groups = [plain_groups(t, libraries) or [] for t in texts]
    links = [Counter((x, y) for g, h in one for x in g for y in h) for one in groups]
    documents = Counter(p for one in links for p in one)
    most = Counter()
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    rows = []
    for one, found in zip(groups, links):
        named = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in one)
        rows.append((sum(len(g) for g, _ in one), sum(len(h) for _, h in one), len(one), sum(found.values()),
                     sum(n for p, n in found.items() if documents[p] == most[p[0]]), sum(n * documents[p] for p, n in found.items()),
                     hashlib.sha256(named.encode()).hexdigest() if one else ""))
    return rows, documents


ODD_TEXTS = [None, "", " ", "  ", "a ", " a", "a  b", "x\n  y\t z \n", "▁ piece", "a▁b c", "<s> </s> <|endoftext|>", "naïve café 日本語テキスト",
             "word " * 300, "!!!!" * 50, "aaaa" * 500, "\x1c \x85 　x  y", "don't we'll I'M", "\U0001f600 \U0001f600‍", "á \u0000 b",
             "the same", "the same", "tab\tand\r\nnewline  double", "\n\n \n word", "x" + " " * 40 + "y"]


def test_alignment_against_whole_texts(make_docs, libraries):
    rng = random.Random(7)
    bits = ["the", " ", "  ", "\n", "\t", "Word", "é", "日本", "▁", "123", "!", "'s", "foo", "bar baz", " ", "\x1f", ". ", "<0x0A>"]
    texts = ODD_TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    want, documents = brute_alignment(texts, libraries)
    rows, pairs = alignment.aligned_documents(make_docs(list(enumerate(texts))), *PATHS)
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.collect()}
    for i, expected in enumerate(want):
        assert got[i] == expected, (texts[i], got[i], expected)
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == dict(documents)
    groups = {r["doc_id"]: r["groups"] for r in alignment.align(make_docs(list(enumerate(texts))), *PATHS).collect()}
    assert all((hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else "") == w[6] for i, w in enumerate(want))


def test_alignment_of_odd_rows(odd_docs, make_docs, libraries):
    rows, _ = alignment.aligned_documents(odd_docs, *PATHS)
    given = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want, _ = brute_alignment([t for _, t in given], libraries)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(((i, *w) for (i, _), w in zip(given, want)), key=str)
    rows, pairs = alignment.aligned_documents(make_docs([]), *PATHS)
    assert rows.count() == 0 and pairs.count() == 0


def test_bitmaps():
    rng = np.random.default_rng(1)
    for sizes in ((0, 3), (5, 10), (3000, 3000), (5000, 10), (60_000, 60_000), (4095, 1), (4096, 0)):
        sets = [np.sort(rng.choice(alignment.BLOCK, n, replace=False)) for n in sizes]
        data = [alignment.bitmap(s) for s in sets]
        assert all(np.array_equal(alignment.members(d), s) and alignment.popcount(d) == len(s) for d, s in zip(data, sets))
        union = np.union1d(*sets)
        both = alignment.merged(data)
        assert np.array_equal(alignment.members(both), union) and alignment.popcount(both) == len(union)
    codes, rows, counts = np.array([7, 7, 7, 9, 7]), np.array([0, 1, 1, 2, 4]), np.array([1, 2, 3, 4, 1])
    planes = {(k, c): alignment.members(b).tolist() for k, cs, bs in alignment.planes_of(codes, rows, counts) for c, b in zip(cs.tolist(), bs)}
    assert planes == {(0, 7): [0, 1, 4], (0, 9): [2], (1, 9): [2], (2, 9): [2], (3, 7): [1]} | {k: v for k, v in planes.items() if k[0] and not v}


def test_parts_of_blocks_are_merged(make_docs, monkeypatch, libraries):
    monkeypatch.setattr(alignment, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(alignment, "PART_POSTINGS", 10)
    monkeypatch.setattr(alignment, "SLICE", 30)
    texts = ["one two three", "two three", "three three three four", "one", None, "two four"] * 8
    want, documents = brute_alignment(texts, libraries)
    rows, pairs = alignment.aligned_documents(make_docs(list(enumerate(texts))).coalesce(1), *PATHS)
    assert [tuple(r)[1:] for r in rows.orderBy("doc_id").collect()] == want
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == dict(documents)


# license scans -----------------------------------------------------------------------------------

def plain_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels, score = [], set(), 0.0
    for phrase, label in license_scan.PHRASES:
        want = phrase.split()
        here = [i for i in range(len(found)) if found[i:i + len(want)] == want]
        places += [(i, label) for i in here]
    for label, notice in license_scan.NOTICES:
        want = [w for w in license_scan.plain_words(notice) if w]
        tokens = set(want)
        for start in range(0, len(found), len(want)):
            share = len(tokens & set(found[start:start + 2 * len(want)])) / len(tokens)
            if share >= license_scan.CONTAINMENT:
                labels.add(label)
                score = max(score, share)
    base = {x for _, x in places}
    return (len(found), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else score)


def test_licenses_against_all_blocks(make_docs):
    rng = random.Random(11)
    common = "the of and software use any copy license public under this work is you may general gnu cc by mit apache é ß K 4 0 3".split()
    texts = [None, "", "  ", "MIT license mit License", "Apache-License", "CC.BY CC BY-NC 4.0", "gnu general public licence",
             "GNU General\nPublic\tLicense", "apacheßlicense", "MİT license"]
    for _ in range(250):
        made = [rng.choice(common) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice(license_scan.NOTICES)[1].split()
            if rng.random() < 0.6:
                notice = [w if rng.random() < 0.95 else "xyz" for w in notice]
            at = rng.randint(0, len(made))
            made[at:at] = notice
        texts.append(rng.choice([" ", "\n# ", ", "]).join(made))
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.licensed_documents(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_license(t) for t in texts]
    assert sum(1 for t in got.values() if t[5] != t[4]) > 50


def test_licenses_of_odd_rows(odd_docs, make_docs):
    given = [(r["doc_id"], *plain_license(r["text"])) for r in odd_docs.collect()]
    assert sorted(map(tuple, license_scan.licensed_documents(odd_docs).collect()), key=str) == sorted(given, key=str)
    assert license_scan.licensed_documents(make_docs([])).count() == 0
    _, matches = license_scan.scan(make_docs([(1, "word " * 50 + "Released under the MIT License.")]))
    assert {(r["kind"], r["label"], r["at"]) for r in matches.collect()} == {("phrase", "mit", 53), ("notice", "mit", 45), ("notice", "mit", 50)}


def test_license_plan_has_no_python(make_docs):
    plan = license_scan.licensed_documents(make_docs([(1, "mit license")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# hard negatives ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, unit string, score int"


def brute_negatives(rows, every=100, n_positives=5, n_negatives=10):
    kept = {}
    for i, v, label in sorted((r for r in rows if usable(r)), key=lambda r: (r[2], r[1]), reverse=True):
        kept[i] = (label, np.floor(256 * np.array(v, float)).astype(int))
    width = max((len(v) for _, v in kept.values()), default=0)
    kept = {i: (label, np.pad(v, (0, width - len(v)))) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-int(w @ v), i, other == label) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:n_positives]:
            found = [(i, -t) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:n_negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(found)]
    return sorted(out)


def usable(row):
    return None not in row and all(x is not None and np.isfinite(x) for x in row[1])


def test_negatives_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        v = rng.normal(size=12) + 2 * np.eye(12)[i % 4]
        if i % 3 == 0:
            v = np.round(rng.normal(size=12))  # ties
        rows.append((i, (v / 4).tolist(), int(rng.integers(4))))
    rows += [(1000 + i, [1.0] * 12, i % 3) for i in range(200)]  # copies
    rows += [(2000, None, 1), (2100, [1.0, None] * 6, 1), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] * 12, 2), (2400, [1.0] * 12, None),
             (None, [1.0] * 12, 1), (2500, [0.0] * 12, 1), (2600, [0.5] * 5, 1), (2700, [], 2), (5, [2.0] * 12, 3), (5, [2.0] * 12, 3), (100, [0.3] * 12, 0)]
    frame = spark.createDataFrame([(*r, "u", 1) for r in rows], VECTORS)
    want = brute_negatives(rows)
    assert sorted(map(tuple, hard_negatives.mine(frame).collect())) == want and len(want) > 100
    monkeypatch.setattr(hard_negatives, "UNIT_BYTES", 2_000)  # many units, several rounds and groups of queries
    monkeypatch.setattr(hard_negatives, "QUERY_BYTES", 600)
    monkeypatch.setattr(hard_negatives, "ROUND", 4)
    assert sorted(map(tuple, hard_negatives.mine(frame).collect())) == want


def test_negatives_of_empty_and_small_tables(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1, "u", 1)], VECTORS)).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1, "u", 1), (1, [1.0], 1, "u", 1), (2, [0.5], 0, "u", 1)], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(two).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_index_omits_and_prunes():
    rng = np.random.default_rng(2)
    matrix = (rng.normal(size=(3000, 64)) * np.exp(-np.arange(64) / 8) * 256).astype(np.int64)
    queries = matrix[:20]
    left = hard_negatives.remaining_norms(queries)
    exact = queries @ matrix.T
    thresholds = np.full(20, float(np.quantile(exact, 0.99)))
    index = hard_negatives.UnitIndex(matrix.astype(float), thresholds[0], left.max(0))
    q, y = index.above(queries.astype(float), left, thresholds)
    found = set(zip(q.tolist(), y.tolist()))
    assert {tuple(x) for x in np.argwhere(exact >= thresholds[0]).tolist()} <= found
    assert index.needed.mean() < 6 and len(found) < 0.1 * exact.size
