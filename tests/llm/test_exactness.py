"""The operators against their libraries, against brute force and on edge cases: nulls, empty tables, very long texts, ties, clashing names."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, html_text, minhash_dedup, pii, queries, sentencepiece_bpe, sharding, substring_dedup, token_files, toxicity, vector_dedup
from palimpsest.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BYTES = model_path("piece_bpe_32k.model"), model_path("byte_bpe_50k.json")
LONG = (" " * 200_000, "\n" * 200_000, "a" * 200_000, "é" * 100_000, "." * 100_000, "a." * 50_000, " \n" * 50_000 + "x", "1" * 100_000)


def rng(seed=7):
    return np.random.Generator(np.random.PCG64(seed))


def word(r, n=5):
    return "".join(chr(97 + c) for c in r.integers(0, 26, n))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def docs(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    return spark.createDataFrame([(*r, "x", 0, 1, 2) for r in rows], "doc_id long, text string, marks string, id int, _own int, part int")


# --- 1 and 8: the libraries


def test_pieces_as_the_library():
    e = sentencepiece_bpe.encoder(PIECES)
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    assert [c for c in chars if e.encode(c) != e.library.encode(c)] == []
    letters = sorted({c for p in e.pieces for c in p} | set("²³¼ªº"))
    texts = [f"10 m{a}{m}" for a in letters for m in ",.!?;:"] + [f"{a}{m}{a}{m}{m}" for a in letters for m in ",.!?;:"]
    assert [t for t in texts if e.encode(t) != e.library.encode(t)] == []
    for t in (*LONG, "", "10 m².", "The area is 25 km². It grew.", " a  b   c ", "▁ ▁▁", "\u0000x"):
        assert e.encode(t) == e.library.encode(t) and e.decode(e.encode(t)) == e.library.decode(e.library.encode(t))


def test_pieces_of_random_texts():
    e, r = sentencepiece_bpe.encoder(PIECES), rng()
    some = sorted({c for p in e.pieces for c in p})[:500] + list(" .,!?;:\n\t") * 30
    for _ in range(3000):
        t = "".join(some[i] for i in r.integers(0, len(some), int(r.integers(1, 40))))
        assert e.encode(t) == e.library.encode(t), t


def test_words_that_are_let_go(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_BYTES", 2000)
    e, r = sentencepiece_bpe.PieceEncoder(PIECES), rng(3)
    for _ in range(30):
        t = prose(r, 40)
        assert e.encode(t) == e.library.encode(t) and len(e.words) + len(e.words.old) < 40


def test_token_ids_as_the_library():
    t, r = token_files.tokenizer(BYTES), rng(2)
    own = lambda x: np.array(t.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.by_word
    for c in range(1, 0x500):
        for x in (chr(c), f"a{chr(c)}b {chr(c)} 1{chr(c)}"):
            assert t.encode(x) == own(x), hex(c)
    some = [*token_files.KNOWN_CHARS, *(list(" '\n\tstrevmld") * 30)]
    for x in [*("".join(some[i] for i in r.integers(0, len(some), 25)) for _ in range(3000)), *LONG, "", "it's <|endoftext|> 1st", "日本語 text"]:
        assert t.encode(x) == own(x), x[:40]


def test_planes():
    ids = rng().integers(0, 2**32, 1000, dtype=np.uint32)
    for width in (1, 8):
        for block in (7, 64, 5000):
            got = token_files.decode_chunk(token_files.encode_chunk(np.arange(3), np.array([0, 400, 600]), ids, width, block=block))
            assert (got[2] == ids).all() and got[1].tolist() == [0, 400, 600]


def test_token_files(spark, tmp_path):
    r = rng()
    rows = [(i * 7 % 101, prose(r, int(r.integers(0, 60)))) for i in range(100)] + [(500, None), (501, ""), (None, "no key")]
    token_files.write(docs(spark, rows), f"{tmp_path}/t", BYTES, 2, chunk_ids=300)
    got = [tuple(x) for x in token_files.read_digest(spark, f"{tmp_path}/t").orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    library, want, start = token_files.tokenizer(BYTES).library, [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read(spark, f"{tmp_path}/t").where("doc_id = 501").first().ids == [2]


# --- 2: its SQL


def test_shards_as_the_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, want = queries.op2_sharding(spark, data).toPandas(), con.sql(sharding.SHARDING_SQL).df()
    key = ["doc_id", "size", "text_crc32", "shard", "slot", "stratum"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_shards_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([(i // 2, None if i % 5 == 0 else "t", None if i % 3 == 0 else "s") for i in range(50)], "doc_id long, text string, source string")
    got = sharding.stratified_shards(rows, 16).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in range(16))
    assert {r.size for r in got} == {1, 2}


# --- 3: brute force at several lengths


@pytest.mark.parametrize("length", [1, 9, 13, 20])
def test_windows_of_any_length(spark, length):
    r = rng(length)
    passages = [" ".join(r.choice(list("abcdefgh"), 60)) for _ in range(3)] + [prose(r, 70) for _ in range(3)]
    rows = [(int(i), " ".join([prose(r, int(r.integers(0, 20))), passages[int(r.integers(0, 6))][int(r.integers(0, 40)) :], "x " * int(r.integers(0, 50))])) for i in range(60)] + [(90, None), (91, "")]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup(docs(spark, rows), length).collect()}
    seen = set()
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_levels():
    assert substring_dedup.levels(20) == [5, 10, 20] and substring_dedup.levels(13) == [7, 13] and substring_dedup.levels(1) == [1] and substring_dedup.levels(50)[0] < 10


# --- 4 and 7: components


def roots(ids, links):
    root = {i: i for i in ids}

    def end(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = end(a), end(b)
        root[max(x, y)] = min(x, y)
    return {i: end(i) for i in ids}


def test_vector_components(spark):
    r = rng()
    chain = [np.array([np.cos(t), np.sin(t), 0, 0]) for t in np.arange(30) * 0.15]  # only neighbours are alike
    vectors = chain + [v + r.normal(size=4) * 0.05 for v in r.normal(size=(20, 4)) for _ in range(3)]
    rows = [(int(i), v.tolist(), 1) for i, v in zip(r.permutation(len(vectors)), vectors, strict=True)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(x, 2) if x[a] @ x[b] >= 0.98]
    got = {q.vec_id: (q.n_links, q.component_id) for q in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()}
    want = roots(x, links)
    assert got == {i: (sum(i in p for p in links), want[i]) for i in x}


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    links = []
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}


def test_few_links_in_big_buckets(spark):
    """Edited copies of one text, all alike enough to share buckets, few enough to be linked."""
    r = rng(5)
    base, rows = [word(r) for _ in range(300)], []
    for i in range(250):
        own = list(base)
        for j in 3 * r.choice(100, int(r.choice([4, 5, 6])), replace=False):
            own[j] = word(r, 7)
        rows.append((int(i * 7919 % 5003), " ".join(own)))
    rows += [(9000, None), (9001, ""), (9002, "two Words"), (9003, "two words"), (9004, "One"), (9005, "one\x0b")]
    want = brute_components(rows, 3, 85)
    assert 20 < len({c for _, c in want.values()}) < 240
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(docs(spark, rows).repartition(6), 3, 85).collect()}
    assert got == want


def test_dedup_of_repeated_keys(spark):
    rows = [(1, "a b c d e f"), (1, "zz yy xx ww vv uu"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    df = docs(spark, rows).withColumn("_kept", F.lit(1))
    got = sorted((str(x.doc_id), str(x.text)) for x in minhash_dedup.dedup(df, 3, 85).collect())
    assert got == [("1", "a b c d e f"), ("1", "zz yy xx ww vv uu"), ("3", "None"), ("None", "None"), ("None", "a b c d e f")]
    assert minhash_dedup.dedup(df, 3, 85).columns == df.columns


def test_common():
    r = rng()
    sets = [np.unique(r.integers(0, 900, n)).astype(np.uint64) for n in (1, 50, 700, 600, 3)]
    assert minhash_dedup.common(sets[2], sets).tolist() == [len(np.intersect1d(sets[2], s)) for s in sets]


# --- 5: pages


def page_text(html):
    return html_text.written(html_text.main_parts(html_text.parse(html)))


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='page no-sidebar'><article><p>This does <b>not</b> say</p></article></div>", "This does not say"),
    ("<article class='post-content has-sidebar'><div class='content-header'><h1>T</h1></div><p class=share>shared</p><section id='related-work'>rw</section></article>", "T\nshared\nrw"),
    ("<div class='sidebar'><article>teaser</article></div><article>real</article>", "real"),
    ("<div class='sidebar'><article><p>only</p></article></div>", "only"),
    ("<article>a<div class='comments'><article>no</article></div><aside>no</aside><form>no</form><div role=navigation>no</div></article>", "a"),
    ("<p>a<br/>b &amp; c<p>d<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b & c\nd\nx\ny\n1\n2\n3"),
    ("<main><p>m</p><div class='cookie-banner'>no</div></main><footer>no</footer>", "m"),
    ("", ""), ("<article>", ""), ("a < b &lt; &#x41; <!-- c --> <script>x</article></script>d", "a < b < A d"), ("<article><a href=/x/>link</a> t</article>", "link t"),
])
def test_page(html, text):
    assert page_text(html) == text


def test_pages_of_unmatched_tags():
    import time

    began = time.process_time()
    n = 30_000
    for html in ("<b>" * n + "</i>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<p><b>" * n + "</p>" * n, "<ul>" + "<li><b>" * n, "<" * n, "<a " * n, "<div>" * n):
        page_text(html + "x")
    assert time.process_time() - began < 15


@pytest.mark.parametrize("n", [1, 4, 5, 12, 50])
def test_templates_by_host_size(spark, n):
    r = rng(n)
    # Recurring parts inside an article stay, those of pages without one go from five pages on.
    article = "<nav>menu</nav><article><h2>Ingredients</h2><p>This unique text {0} does <b>not</b> say so.</p><ul><li>salt</li></ul></article><div>All rights</div>"
    plain = "<div>own {0} <i>not</i></div><div><p>All rights</p></div>"
    rows = [(2 * i, f"http://a.org/{i}", article.format(word(r))) for i in range(n)] + [(2 * i + 1, f"http://b.org/{i}", plain.format(word(r))) for i in range(n)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, html in rows:
        own = re.search(r"(?:text|own) (\w+)", html)[1]
        rest = "" if n >= html_text.LEAST_PAGES else "\nAll rights"
        assert got[i] == (f"Ingredients\nThis unique text {own} does not say so.\nsalt" if "a.org" in url else f"own {own} not{rest}")


# --- 6: brute force


def template(text):
    bare = lambda w: w.strip(decontamination.PUNCTUATION) or w
    raw, out = WORD.findall(text or ""), []
    for i, w in enumerate(raw):
        b, before = bare(w), bare(raw[i - 1]) if i else ""
        low = b.lower()
        if b[0] in "0123456789":
            t = "<number>" if re.fullmatch(r"[0-9][0-9.,:/]*%?", b) else "<quantity>" if re.fullmatch(r"[0-9][0-9.,]*[A-Za-z]+", b) else low
        elif low in decontamination.NUMBERS:
            t = "<number>"
        elif low in decontamination.UNITS and i and (before[0] in "0123456789" or before.lower() in decontamination.NUMBERS):
            t = "<unit>"
        elif i and raw[i - 1][-1] not in decontamination.SENTENCE_ENDS and re.fullmatch(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", b):
            t = "<name>"
        else:
            t = low
        out.append((t, low))
    return out


def brute_found(text, item):
    """Windows of the item, and those found in the text on consistent diagonals."""
    t, own = template(text), template(item)
    n = min(len(own), decontamination.WINDOW)
    slot = lambda w: w.startswith("<") and w.endswith(">")
    windows = [s for s in range(len(own) - n + 1) if sum(slot(w) for w, _ in own[s : s + n]) <= int(n * decontamination.MOST_SLOTS)] if n >= decontamination.SHORTEST else []
    bare = not windows
    windows = windows or [s for s in range(len(own) - n + 1) if n]
    diagonals = {}
    for s in windows:
        for p in range(len(t) - n + 1):
            part = [w for w, _ in t[p : p + n]]
            other = [t[p][1], *part[1:]] if part[0] == "<name>" else part
            mine = [w for w, _ in own[s : s + n]]
            if ([r for _, r in own[s : s + n]] == [r for _, r in t[p : p + n]]) if bare else mine in (part, other):
                diagonals.setdefault(p - s, set()).add(s)
    found = set()
    for d, places in diagonals.items():
        values = {}
        for q in {q for s in places for q in range(s, s + n)}:
            if slot(own[q][0]):
                values.setdefault(own[q][1], set()).add(t[q + d][1])
        if all(len(v) == 1 for v in values.values()):
            found |= places
    return len(windows), len(found)


def test_decontamination_by_brute_force(spark):
    r = rng(11)
    names = ["Anna", "Peter", "Maria", "Paris", "Oslo"]
    makers = [lambda: word(r, 4), lambda: str(r.integers(1, 99)), lambda: names[r.integers(0, 5)], lambda: "five", lambda: "km", lambda: f"{r.integers(1, 9)}kg", lambda: word(r, 3) + ".", lambda: "the"]
    text = lambda n: " ".join(makers[r.choice(8, p=[0.3, 0.12, 0.12, 0.05, 0.08, 0.05, 0.13, 0.15])]() for _ in range(n))
    items = [(i, text(int(r.integers(1, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "Which planet is largest?"), (93, "3 5 8 13 21 34 55 89 144 233")]
    rows = []
    for i in range(120):
        own = (items[int(r.integers(0, 25))][1] or "x").split()
        for j in r.choice(len(own), int(r.integers(0, 3))):
            own[j] = makers[r.integers(0, 8)]()
        rows.append((i, " ".join([text(int(r.integers(0, 20))), *own, text(int(r.integers(0, 20)))])))
    rows += [(200, None), (201, ""), (202, "So: which planet is largest?"), (203, "see 3 5 8 13 21 34 55 89 144 233"), (203, "again, Which planet is largest?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        for k, item in items:
            n, m = brute_found(t, item)
            if m:
                want[i, k] = (n, max(m, want.get((i, k), (0, 0))[1]))
    got = {(x.doc, x.item): (x.n_windows, x.n_found) for x in decontamination.matches(docs(spark, rows), bench).collect()}
    assert got == want and len(want) > 80
    left = {x.doc_id for x in decontamination.clean(docs(spark, rows).withColumn("_bad", F.lit(1)), bench).collect()}
    assert left == {i for i, _ in rows} - {i for (i, _), (n, m) in want.items() if 2 * m >= n}


# --- 9: plain patterns

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = pii.digits_of(m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_by_plain_patterns(spark):
    r = rng()
    some = "0123456789.+@-() ab\n%1234567890..  "
    texts = ["".join(some[i] for i in r.integers(0, len(some), 50)) for _ in range(4000)] + [None, "", "1" * 200_000, "1." * 100_000, "a@b" * 50_000, "card 4539 1488 0343 6467, mail x.y@z.co, +49 30 1234567"]
    rows = [(i, t) for i, t in enumerate(texts) if t is None or len(t) < 1000]
    got = {x.doc_id: x for x in pii.detect(docs(spark, rows)).collect()}
    for i, t in rows:
        want = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert [got[i][n] for n in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert len(got[i].scores.split(",")) == len(got[i].spans.split(","))
    assert all(pii.spans_of(t)[0] is not None for t in texts)


@pytest.mark.parametrize(("text", "spans"), [
    ("DE89370400440532013000 IS GOOD", "iban:0:22"), ("iban gb29 nwbk 6016 1331 9268 19.", "iban:5:32"), ("DE89370400440532013001", ""), ("call (030) 123 4567 now", "local_phone:5:19"),
    ("size (030) 123 4567 now", ""), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188"', "secret:9:45"), ("sha256 04dbebab91ab85687d33eeaaf9ac699e1188 token", ""), ("", ""),
])
def test_spans_that_need_more(text, spans):
    assert pii.written(pii.spans_of(text)[1]) == spans


def test_context_moves_scores():
    text = "host 10.0.0.1 and " + "x" * 60 + " version 1.2.3.4"
    assert [pii.score(text, "ip", a, b) for a, _, b in pii.find_base(text)] == [1.0, 0.35]


# --- 10: enumeration of all taggings


def test_marginals_by_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "ROW", 4)
    r, trans = rng(), (0.7, -1.2, 1.5)
    model = toxicity.ToxicModel(transitions=trans)
    pair = np.array([[0, trans[0]], [trans[1], trans[2]]])
    for lengths in ([1], [4], [5], [10, 0, 3, 9, 1]):
        odds = [np.exp(r.normal(size=n)) for n in lengths]
        for x, m in zip(odds, toxicity._marginals(model, odds), strict=True):
            weights = {s: np.prod([x[i] for i in range(len(x)) if s[i]]) * np.exp(sum(pair[s[i], s[i + 1]] for i in range(len(x) - 1))) for s in itertools.product((0, 1), repeat=len(x))}
            total = sum(weights.values())
            want = [sum(w for s, w in weights.items() if s[i]) / total for i in range(len(x))]
            assert np.allclose(m / (1 + m), want)


def test_tokens_packed():
    for text in ("", "a b a", "é ñ a é", "x " * 1000):
        words, at = toxicity.tokens(text)
        back = toxicity.unpacked_tokens(toxicity.packed_tokens(words, at))
        assert back[0] == words and (back[1] == at).all()


def test_tagged_nulls_and_clashes(spark):
    r = rng()
    clean, bad = [prose(r, 40) for _ in range(60)], [prose(r, 20) + " vilewordly vilewordish " + prose(r, 20) for _ in range(60)]
    model = toxicity.fit(clean + bad, [0] * 60 + [1] * 60)
    rows = [(1, None), (2, ""), (3, "a vilewordly b"), (4, prose(r, 30)), (5, prose(r, 30_000) + " vilewordly vilewordish"), (5, prose(r, 3))]
    got = {(x.doc_id, len(x.text or "")): x for x in toxicity.tag(docs(spark, rows).withColumn("score", F.lit(9)), model).collect()}
    made = sorted(got.items())
    assert [x.predicted for _, x in made] == [0, 0, 1, 0, 0, 1] and made[2][1].toxic_spans == "2:12"
    assert made[0][1].score == made[1][1].score and toxicity.tag(docs(spark, []), model).count() == 0


# --- all: empty tables


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_empty_tables(spark, tmp_path, name):
    kinds = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string",
        "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
    }
    for table, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
