"""Hard negatives, vector codes and fingerprints against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math

import numpy as np
import pytest
import regex
import xxhash

import __spark_entry__ as entry
from palimpsest.llm import fingerprints, hard_negatives, vector_codes

DATA = "/root/testdata/sf0.001"
RNG = np.random.Generator(np.random.PCG64(11))


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, label int, part int, x double")


def mined(rows):
    """Hard negatives by definition."""
    kept = {i: ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in v]) for i, v, y in rows if i is not None and y is not None and whole(v)}
    out = set()
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, y == label) for i, (y, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:5]:
            fit = [(t, i) for t, i, same in scores if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)}
    return out


@pytest.fixture(scope="module")
def clustered():
    """Clusters of vectors with copies (ties), few labels in some, and rows that take no part."""
    centres = RNG.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + 0.4 * RNG.normal(size=16)).tolist(), int(i % 13 % 4)) for i in range(900)]
    rows += [(1000 + i, rows[i % 5][1], i % 3) for i in range(60)]
    rows += [(2000, None, 1), (2100, [float("nan")] * 16, 1), (2200, [None] * 16, 1), (2300, rows[0][1], None), (2400, rows[1][1], 9), (2500, [0.0] * 16, 0), (None, rows[2][1], 1)]
    return rows


def test_hard_negatives(spark, clustered, monkeypatch):
    for name, value in {"BLOCK": 128, "LEAF": 8, "GROUP": 4, "FEW": 2, "CHUNK": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    got = [tuple(r) for r in hard_negatives.negatives(vectors(spark, clustered + clustered[:3])).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(clustered)


def test_hard_negatives_of_small_tables(spark):
    assert hard_negatives.negatives(vectors(spark, [])).count() == 0
    assert hard_negatives.negatives(vectors(spark, [(100, [1.0, 2.0], 1), (None, None, None)])).count() == 0
    few = [(100, [1.0, 0.5], 1), (101, [1.0, 0.4], 1), (102, [0.7, 0.1], 2)]
    assert {tuple(r) for r in hard_negatives.negatives(vectors(spark, few)).collect()} == mined(few) != set()


def test_node_pairs_are_pruned(monkeypatch):
    """Whole groups of anchors are pruned where vectors lie apart, and nothing is lost."""
    for name, value in {"LEAF": 16, "FEW": 4, "CHUNK": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    x = np.floor(256 * RNG.normal(size=(2048, 2))).astype(np.int64)
    x = x[hard_negatives.ordered(x.astype(float), hard_negatives.LEAF)]
    block = {"id": np.arange(len(x)), "label": np.zeros(len(x), int), "x": x}
    n = hard_negatives.OPEN
    first = hard_negatives.ordered(x[::8].astype(float), hard_negatives.FEW)
    asks = {k: v[::8][first] for k, v in block.items()} | {"low": np.full((len(first), 1), -n), "up": np.full((len(first), 1), n)}
    rows, made = hard_negatives.met(asks, block, 5, True)
    assert made < 0.2 * len(x) * len(first)
    scores = asks["x"] @ x.T
    for q, i in enumerate(asks["id"].tolist()):
        best = sorted((-int(s), j) for j, s in enumerate(scores[q].tolist()) if j != i)[:5]
        assert {(s, d) for a, _, d, s in rows if a == i} == {(-s, j) for s, j in best}


def coded(rows, parts=16, entries=64, rounds=2):
    """Codes by definition, plain scans of whole codebooks."""
    kept = [(i, y, [math.floor(256 * c) for c in v]) for i, v, y in rows if whole(v)]
    n = len(kept[0][2]) // parts
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:entries]
    books = [[r[2][p * n : (p + 1) * n] for r in start] for p in range(parts)]
    for turn in range(rounds + 1):
        codes = [[min((sum((a - b) ** 2 for a, b in zip(v[p * n : (p + 1) * n], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, _, v in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(start)):
                own = [v[p * n : (p + 1) * n] for (_, _, v), c in zip(kept, codes, strict=True) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    labels = {}
    for (_, y, _), e in zip(kept, errors, strict=True):
        labels[y] = labels.get(y, 0) + e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in c), err, labels[y], digest) for (i, y, _), c, err in zip(kept, codes, errors, strict=True))


def test_vector_codes(spark):
    centres = RNG.normal(size=(7, 32))
    rows = [(i, (centres[i % 7] + 0.3 * RNG.normal(size=32)).tolist(), i % 3 or None) for i in range(160)]
    rows += [(500 + i, rows[i][1], 1) for i in range(9)] + [(600, None, 1), (601, [float("inf")] + [0.0] * 31, 1), (602, [None] * 32, 2), (603, [0.0] * 32, 9), (None, rows[4][1], 2)]
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(vectors(spark, rows)).collect())
    assert got == coded(rows)


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.compressed(vectors(spark, [])).count() == 0
    one = [(5, [0.25, -0.5] * 8, 1)]
    (r,) = vector_codes.compressed(vectors(spark, one)).collect()
    assert (r.code, r.error, r.label_error) == ("00" * 16, 0, 0)
    odd = {r.vec_id: r for r in vector_codes.compressed(vectors(spark, one + [(6, [1.0] * 3, 1), (7, [0.5] * 16 + [1.0] * 16, 1)])).collect()}
    assert odd[6].code is None and odd[6].error is None and odd[5].code == odd[7].code == "00" * 16
    with pytest.raises(ValueError):
        vector_codes.compressed(vectors(spark, [(1, [1e300] * 16, 1)])).collect()


def test_exponion_looks_at_a_share_of_the_entries():
    """The sufficient radius leaves most entries out, and the result is that of a whole scan."""
    entries = RNG.integers(-2000, 2000, (64, 4))
    x = entries[RNG.integers(0, 64, 5000)] + RNG.integers(-60, 60, (5000, 4))
    book = vector_codes.Book(entries)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    start = every.argmin(1)
    at, d = book.nearest(x, start)
    assert (at == start).all() and (d == every.min(1)).all()
    assert np.mean([np.searchsorted(book.apart[s], 4 * f, side="right") for s, f in zip(start, d, strict=True)]) < 8
    for other in (np.zeros(5000, int), RNG.integers(0, 64, 5000), book.guess(x)):
        at, d = book.nearest(x, other)
        assert (at == start).all() and (d == every.min(1)).all()


TOKEN = regex.compile(r"(?V1)[[\p{L}\p{M}\p{N}]--[぀-ヿ㐀-鿿豈-﫿]]+|[^\x20\x09-\x0D]")


def winnowed(text, gram=3, window=8):
    """(hash, place) by definition: a hash rolled over the tokens, then the rightmost least one of each window."""
    turn = lambda h, b: ((h << b) | (h >> (64 - b))) & (2**64 - 1) if b else h
    t = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in TOKEN.findall(text.lower())]
    grams, h = [], 0
    for i, x in enumerate(t):
        h = turn(h, 1) ^ x ^ (turn(t[i - gram], gram) if i >= gram else 0)
        if i >= min(gram, len(t)) - 1:
            grams.append(h)
    w = window
    while w > max(1, len(grams) // 8):
        w //= 2
    signed = [g - 2**64 if g >= 2**63 else g for g in grams]
    picked = [min(range(i, i + w), key=lambda j: (signed[j] >> 30, -j)) for i in range(len(grams) - w + 1)]
    return [(grams[j], j) for j in dict.fromkeys(picked)]


def expected(rows):
    """Rows of the query by definition; keys are unique."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        a, b, c = (winnowed(x) for x in (t, edited, u))
        text = lambda f: ",".join(f"{h:x}:{p}" for h, p in f)
        sets = [{h for h, _ in f} for f in (a, b, c)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(sets[0], sets[1]), like(sets[0], sets[2]))
    return out


def found(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, k string, hashes int").repartition(5)


def test_fingerprints_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found(entry.queries()["op13_fingerprints"](spark, DATA)) == expected(rows)


def test_fingerprints_of_odd_texts(spark):
    long = " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, 3)) for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two"), (5, "ab"), (6, "…!?"), (7, "日本語の文章 mixed with words 𝔘𝔫𝔦"), (8, "a " * 500), (9, long), (10**15, long + " x"), (-5, "é́ e f\tg\n" * 9), (12, "x" * 10**6)]
    assert found(fingerprints.fingerprints(docs(spark, rows))) == expected(rows)
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    same = fingerprints.fingerprints(docs(spark, [(3, "one two three"), (3, "one two three"), (None, "z"), (None, None)])).collect()
    assert len(same) == 4 and {r.near_next for r in same if r.doc_id == 3} == {0.0, 1.0}


def test_shared_runs_share_a_chosen_gram():
    """The guarantee of matches: of any window + gram - 1 tokens that two texts share, one chosen gram is shared, at its place in both."""
    words = ["".join(chr(97 + c) for c in RNG.integers(0, 26, 2)) for _ in range(900)]
    for n in (10, 30, 200):
        run = words[:10]
        a, b = words[300 : 300 + n] + run + words[500 : 500 + n], words[600 : 600 + n] + run + words[700:720]
        chosen = [{(h, p - at) for h, p in winnowed(" ".join(t)) if at <= p < at + 8} for t, at in ((a, n), (b, n))]
        assert chosen[0] & chosen[1]
