"""The operators against brute force on small fixtures with nulls, empty texts, copies and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import decontamination, html_text, minhash_dedup, substring_dedup, toxicity, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.Generator(np.random.PCG64(7))


def prose(n):
    return " ".join("".join(chr(97 + c) for c in RNG.integers(0, 26, 5)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, passage = prose(120), prose(90), prose(45)
    rows = [(1, a), (2, a), (3, a.replace(a.split()[60], "changed")), (4, b), (5, None), (6, ""), (7, "two words"), (8, "Two words")]
    rows += [(9, prose(30) + " " + passage + " " + prose(30)), (10, prose(10) + " " + passage), (11, passage + " " + passage)]
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, marks string, id int")


def test_substring_dedup(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs(spark, texts), 20).collect()}
    seen = set()
    for i, t in sorted(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert got[2][1] == got[3][1] == 1 and not got[2][2]
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True)
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False)
    assert got[4][1] == 4


def test_near_duplicates_of_a_star(spark):
    """Copies that are like one original (0.88) but not like each other (under 0.84): only the original connects them."""
    rng = np.random.Generator(np.random.PCG64(12))
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    words = [word(5) for _ in range(200)]
    rows = [(5000, " ".join(words))]
    for i in range(80):
        own = list(words)
        for k in 4 * rng.choice(49, 4, replace=False) + 2:
            own[k] = word(9)
        rows.append((i + 1, " ".join(own)))
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(spark, rows).repartition(4, "doc_id"), 3, 85).collect()}
    assert got == {i: (1, i == 1) for i, _ in rows}


def test_common():
    sets = [np.unique(RNG.integers(0, 9000, n)).astype(np.uint64) for n in (1, 50, 7000, 6000)]
    for x in sets:
        assert minhash_dedup.common(x, sets).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_near_vectors(spark):
    base = RNG.normal(size=(12, 16))
    vectors = [v + RNG.normal(size=16) * s for v in base for s in (0, 0.02, 0.05, 0.3)]
    rows = [(i, v.tolist(), i % 4 // 3) for i, v in enumerate(vectors)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0, None], 0), (104, vectors[0].tolist(), None), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, root int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, 0.98).collect()}
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.arange(len(x)) % 4 // 3
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    for i in range(len(x)):
        assert got[i].n_links == near[i].sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(100, 105))
    assert got[105].n_links == 1 and got[106].component_id == 105


def test_encoding_needs_little_memory():
    """1,024 lists of 768 components: what a batch needs beside its own vectors is under 200 MB."""
    import tracemalloc

    x = RNG.normal(size=(4096, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vector_dedup.Index(x[:1500], 1024)
    tracemalloc.start()
    own, probes, codes, _ = index.encode(x, 0.2)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(own) == len(probes) == len(codes) == len(x) and all(o in p for o, p in zip(own.tolist(), probes, strict=True))


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two   three<p>x &lt; y<div class='comments'>no</div></article><footer>f</footer></body></html>"
    plain = "<body><div>own text {0}</div><div>Every page says this</div></body>"
    rows = [(0, "http://a.org/1", page), (1, None, None), (2, "http://a.org/2", "")] + [(10 + i, f"http://b.org/{i}", plain.format(prose(9))) for i in range(8)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, host int")).collect()}
    assert got[0].text == "A & B\none two three\nx < y"
    assert got[1].text == "" and got[2].n_chars == 0
    assert all(got[10 + i].text.startswith("own text") and "Every" not in got[10 + i].text for i in range(8))


def test_decontamination(spark):
    item = "A train leaves at 9 o'clock and goes 60 km every hour until it meets Peter near the old bridge after 9 stops"
    other = item.replace("60", "75").replace("9", "7").replace("Peter", "Maria")
    broken = item.replace("at 9", "at 7")  # 9 stands for 7 and for 9
    rows = [(1, prose(50) + " " + item), (2, other), (3, broken), (4, prose(80)), (5, None), (6, "")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert {r.doc_id for r in decontamination.clean(docs(spark, rows), bench).collect()} == {3, 4, 5, 6}


def test_decontamination_of_short_items(spark):
    question, short, numbers = "What is the largest lake of Africa", "Lake Victoria", "3 5 8 13 21 34 55 89 144 233"
    bench = spark.createDataFrame([(1, question), (2, short), (3, numbers)], "item_id long, text string")
    rows = [(1, f"Question\n{question}"), (2, f"{prose(9)}, {question} {prose(9)}"), (3, f"{prose(5)} lake victoria. {prose(5)}"), (4, f"{prose(5)} {numbers} {prose(5)}")]
    rows += [(5, "and Paris is the largest lake of Africa"), (6, "Lake Tana"), (7, "4 6 9 14 22 35 56 90 145 234"), (8, "")]
    got = {r.doc_id: r.first_item for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: None, 6: None, 7: None, 8: None}


def test_decontamination_of_copies_in_any_case(spark):
    item = "The engineer said that Anna drove 300 km from Paris to the small harbour near Bremen and paid 45 euros for the old ferry"
    run = "Angela Smith was born in the old town of Hamburg and moved away after 30 years"
    bench = spark.createDataFrame([(1, item), (2, run)], "item_id long, text string")
    around = lambda t: f"{prose(9)} {t} {prose(9)}"
    rows = [(1, item.lower()), (2, around(item.lower())), (3, around(item.upper())), (4, around(item.replace("Paris", "New York"))), (5, around(item.replace("Anna", "Maria Anna Lopez").replace("300", "70"))),
            (6, around(item)), (7, around(run)), (8, around(run.lower())), (9, around(run.replace("Angela Smith", "Peter"))), (10, prose(60)), (11, f"{prose(9)}. {run}")]
    got = {r.doc_id: r.first_item for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 10: None, 11: 2}


def test_decontamination_of_long_runs_of_names(spark):
    """Java's stack didn't hold a run of two thousand names: that ends an executor."""
    item = "Then the old engineer walked along the river and met Peter near the bridge of the town"
    rows = [(1, "so " + "Von " * 20_000 + item), (2, "so " + "Von " * 20_000), (3, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontamination.contaminated(docs(spark, rows), bench).collect()} == {1: True, 2: False, 3: True}


def test_items_of_one_text_are_matched_once(spark):
    a, b = prose(30), prose(30)
    items = [(i, a) for i in range(3, 103)] + [(1, b), (200, None), (201, "")]
    rows = [(1, f"{prose(9)} {a} {prose(9)}"), (2, f"{a} {prose(9)} {b}"), (3, prose(40))]
    bench, calls = spark.createDataFrame(items, "item_id long, text string"), []
    plain, decontamination._hits = decontamination._hits, lambda *x: calls.append(plain(*x)) or calls[-1]
    try:
        got = {r.doc_id: (r.n_items, r.first_item, r.n_found) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    finally:
        decontamination._hits = plain
    assert got == {1: (100, 3, 2300), 2: (101, 1, 2323), 3: (0, None, 0)}
    assert calls[0].count() == 3 * 23


def test_a_window_of_many_items(spark):
    """500 items begin alike: documents with that beginning meet only the items that they share more with, and those are found."""
    begin = prose(14)
    items = [(i, f"{begin} {prose(30)}") for i in range(500)]
    rows = [(i, f"{prose(20)} {begin} {prose(20)}") for i in range(20)] + [(100 + i, f"{prose(9)} {items[i][1]} {prose(9)}") for i in range(4)]
    bench, calls = spark.createDataFrame(items, "item_id long, text string"), []
    plain, decontamination._hits = decontamination._hits, lambda *a: calls.append(plain(*a)) or calls[-1]
    try:
        got = {r.doc_id: (r.n_items, r.first_item) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    finally:
        decontamination._hits = plain
    assert got == {i: (0, None) for i in range(20)} | {100 + i: (1, i) for i in range(4)}
    assert calls[0].count() < 4 * 45


def test_hashes_of_a_long_text_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    from palimpsest.llm import hashing

    words = [prose(1) for _ in range(997)]
    long = " ".join(words * 3000)
    texts = pa.array([long, "", None, " ".join(words)], pa.string())
    tracemalloc.start()
    hashes, first = hashing.words_of(texts)
    assert tracemalloc.get_traced_memory()[1] < 10 * len(long)
    tracemalloc.stop()
    assert first.tolist() == [0, 997 * 3000, 997 * 3000, 997 * 3000, 997 * 3001]
    assert (hashes.reshape(-1, 997) == hashing.words_of(pa.array([" ".join(words)]))[0]).all()


def test_toxicity_learns_marked_words():
    clean, toxic = [prose(40) for _ in range(60)], [prose(20) + " vilewordly " + prose(20) for _ in range(60)]
    model = toxicity.fit(clean + toxic, [0] * 60 + [1] * 60)
    scores = [toxicity.score_of(model, m) for m in toxicity.marginals(model, [prose(40), prose(30) + " vilewordly", ""])]
    assert scores[0] < 0.5 < scores[1] and scores[2] < 0.5


@pytest.mark.parametrize("labels", [[], [(1, 0, None), (2, 0, None)]])
def test_toxicity_without_labels_keeps_documents(spark, tmp_path, labels):
    import corpus_pipeline

    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs(spark, [(1, prose(30)), (2, ""), (3, None)])
    assert {r.doc_id for r in corpus_pipeline.without_toxic(spark, rows, str(tmp_path)).collect()} == {1, 2, 3}


def test_components(spark):
    from palimpsest.llm.components import components, merged

    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 140)] + [(100, 100), (105, 101), (105, 101)]
    zigzag = [(200, 290), (290, 210), (210, 280), (280, 205), (205, 300)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = components(frame(path + star + zigzag))
    got = {r.id: r.root for r in first.collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 205, 210, 280, 290, 300)}}
    more = {r.id: r.root for r in merged(first, frame([(300, 120), (500, 501), (7, 600)])).collect()}
    assert more == {i: 100 if r == 200 else r for i, r in got.items()} | {500: 500, 501: 500, 600: 1}
    assert components(frame([])).count() == 0 and merged(first, frame([])).count() == len(got)


def test_toxicity_learns_from_whole_texts(spark):
    long = prose(4000)  # 23,999 characters
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:120]
    rows = docs(spark, [(i, long + (" vilewordly " if n % 2 else " ") + prose(20)) for n, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.learn(rows, labels)
    scores = [toxicity.score_of(model, m) for m in toxicity.marginals(model, [prose(40), prose(30) + " vilewordly"])]
    assert scores[0] < 0.5 < scores[1]


def test_words_as_lines_of_one_text():
    import numpy as np
    import public_tokenizers

    from palimpsest.llm import token_files

    t = token_files.FileTokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    words = ["a", " a", "'s", "'", " '", "'ll", "!?", " \u00e9t\u00e9", "\u00ff\u0100", "12", " \u00b2", "\n", "\n\n", " \t", "\u00a0", "\x85", "\x00", " " + "x" * 70]
    one = lambda w: np.array(t.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.between is not None and t._made(words) == {w: one(w) for w in words}
    text = "It's 'so'\n\n  and\u00a0'll 12a!? \n'x"
    assert t.encode(text) == one(text)


def test_new_words_are_asked_without_their_places():
    import numpy as np
    from palimpsest.llm.queries import model_path
    from palimpsest.llm.token_files import FileTokenizer

    t = FileTokenizer(model_path("byte_bpe_50k.json"))
    own = t.library
    t.library = type("Fast", (), {"encode_batch_fast": lambda self, texts, add_special_tokens: own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)})()
    for text in ("", "two words, two words\n\nand 12 more", "naïve 你好 x", "<|endoftext|> y"):
        assert t.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
