"""Repeated word windows: level-wise doubling, only windows repeated at one length go to the next.

The levels' lengths are FIRST (or the wanted length's share of it), twice that, and so on up to the wanted
length. At a level below the last, one window of the level's length is chosen inside each full window that
is still a candidate, by the least hash (so equal full windows choose equally), and only chosen ones are
counted. A full window stays a candidate if its chosen window is repeated somewhere; the others can't be
repeated. The loop ends when no candidate survives or the full windows themselves are compared: a
full window that starts at (document, place) is a repeat if an equal one starts at a smaller one.

All levels use one kind of exchange. A task sorts its windows, settles what it can by itself (of
equal windows in one task only the first is passed on, the others are known to be repeats), and
sends compressed blocks, one for each range of hashes. So a passage that a third of all documents
share costs one entry a task, not one a document, and no group grows with the number of copies.
The number of ranges grows with the bytes of text. Results come back to the documents as runs of
places: packed from each range to each destination of documents, then joined by the document's id.
Windows are told apart by their hashes alone: 128 bits at the last level where a level precedes it, else 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import parts_for, released, staged
from palimpsest.llm.hashing import doubled, mix, packed, pieces, unpacked, windows_of, words_of

#: Words of the shortest windows, about; the levels' lengths are the wanted length halved until it is reached.
FIRST = 5
#: Bytes of text for a range of hashes, at most.
RANGE_BYTES = 1 << 25
#: Windows a task gathers before it sorts and sends them.
HELD = 1 << 20
LEAST_ID = -(1 << 63)
RUNS = "doc long, runs binary"
BLOCK = "part int, known boolean, block binary"


def levels(length: int) -> list[int]:
    """Lengths of the windows of each level, the last the wanted one."""
    out = [length]
    while out[0] >= 2 * FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _full(texts: pa.Array, ids: np.ndarray, length: int):
    """For each piece of a batch that has full windows: hashes of the words, document ids, places in the documents, starts of full windows."""
    for a, b in pieces(texts):
        words, first = words_of(texts.slice(a, b - a))
        n = len(words)
        if n < length:
            continue
        doc = np.repeat(np.arange(a, b), np.diff(first))
        start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
        if len(start):
            yield words, ids[doc], np.arange(n) - first[doc - a], start


def _chosen(words: np.ndarray, start: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `part` words, and the place of the chosen one of each full window: the least hash, the leftmost of equal ones.

    Minima of runs of 1, 2, 4, ... places are made from one another; two of them cover the places of a full window.
    """
    order = mix(windows_of(words, part))
    places = length - part + 1
    best, at, size = order, np.arange(len(order)), 1
    while 2 * size <= places:
        less = best[size:] < best[:-size]
        best, at = np.where(less, best[size:], best[:-size]), np.where(less, at[size:], at[:-size])
        size *= 2
    if rest := places - size:
        at = np.where(best[rest:] < best[:-rest], at[rest:], at[:-rest])
    return order, at[start]


def _known(marks: list) -> np.ndarray:
    """Sorted keys (place of the text in its batch, place in the text) of all runs of the texts' marks."""
    both = np.frombuffer(b"".join(r for own in marks if own for r in own), "<i4").reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(len(marks)), [sum(map(len, own)) // 8 if own else 0 for own in marks])
    n = both[:, 1]
    firsts = owner * (1 << 32) + both[:, 0]
    return np.unique(np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))


def _marked(known: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which (place of the text in its batch, place in the text) are known."""
    if not len(known):
        return np.zeros(len(docs), bool)
    key = docs * (1 << 32) + places
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def _sent(parts: np.ndarray, known: bool, columns: list[np.ndarray]):
    """Rows (part, known, block), one for each part that has entries."""
    order = np.argsort(parts, kind="stable")
    columns, parts = [c[order] for c in columns], parts[order]
    cut = np.flatnonzero(np.diff(parts)) + 1
    edges = [0, *cut.tolist(), len(parts)]
    rows = [(int(parts[a]), known, packed(*(c[a:b] for c in columns))) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    kinds = (pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", "known", "block"])


def _runs(docs: np.ndarray, places: np.ndarray, parts: int) -> pa.Table:
    """Places of documents as runs (document, first, number), packed in a row for each destination of documents."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    owners, firsts, counts = docs[at], places[at].astype("<i4"), (places[last] - places[at] + 1).astype("<i4") if len(at) else np.zeros(0, "<i4")
    dest = (mix(owners.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows = []
    for d in np.unique(dest).tolist():
        own = dest == d
        rows.append((d, packed(owners[own], firsts[own], counts[own])))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["dest", "block"])


def _gathered(table: pa.Table) -> pa.Table:
    """One destination: the runs (first, number) of each of its documents, a row for each document."""
    owners, firsts, counts = (np.concatenate(c) for c in zip(*(unpacked(b.as_py(), "i8", "i4", "i4") for b in table.column("block")), strict=True))
    order = np.lexsort((firsts, owners))
    owners, both = owners[order], np.stack([firsts[order], counts[order]], axis=1).astype("<i4")
    edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
    made = pa.table([pa.array(owners[edges[:-1]], pa.int64()), pa.array([both[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["doc", "runs"])
    released()
    return made


def _settled(blocks: DataFrame, settle, parts: int) -> DataFrame:
    """Runs (doc, runs) of the places that `settle` finds in each range of hashes; a document's runs of all ranges are one row.

    Between the two steps there is a row for each range and destination, not one for each range and document.
    """
    sent = blocks.groupBy("part").applyInArrow(lambda table: settle(table, parts), "dest int, block binary")
    return sent.groupBy("dest").applyInArrow(_gathered, RUNS)


def _candidates(rows: DataFrame, length: int, part: int, before: int | None, parts: int) -> DataFrame:
    """Blocks of the chosen windows of `part` words in full windows whose chosen one of `before` words is marked: known repeats, and the only ones of a task."""

    def sent(batches):
        gathered: list[tuple] = []
        held = 0

        def flush():
            nonlocal gathered, held
            h, d, p = (np.concatenate(c) for c in zip(*gathered, strict=True))
            gathered, held = [], 0
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            repeated = same[:-1] | same[1:]
            lone = ~repeated
            heads = repeated & ~same[:-1]  # one entry for each hash that is repeated here
            # An entry of a hash that is known to be repeated has document and place twice: see _repeated.
            yield _sent((h[lone] % np.uint64(parts)).astype(np.int64), False, [h[lone], d[lone], p[lone]])
            if heads.any():
                for _ in range(2):
                    yield _sent((h[heads] % np.uint64(parts)).astype(np.int64), False, [h[heads], d[heads], p[heads]])
                rest = repeated & ~heads
                yield _sent((d[rest] % parts).astype(np.int64), True, [h[rest], d[rest], p[rest]])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = _known(batch.column(2).to_pylist()) if before else None
            if before and not len(known):
                continue
            for words, docs, place, start in _full(batch.column(1), np.arange(len(ids)), length):
                if before:
                    _, at = _chosen(words, start, length, before)
                    start = start[_marked(known, docs[at], place[at])]
                    if not len(start):
                        continue
                order, at = _chosen(words, start, length, part)
                at = np.unique(at)
                gathered.append((order[at], ids[docs[at]], place[at].astype(np.int32)))
                held += len(at)
                if held >= HELD:
                    yield from flush()
        if gathered:
            yield from flush()
        released()

    return rows.mapInArrow(sent, BLOCK)


def _repeated(table: pa.Table, parts: int) -> pa.Table:
    """One range of hashes of a level below the last: where repeated windows are."""
    docs, places, hashes = [], [], []
    for known, block in zip(table.column("known").to_pylist(), table.column("block"), strict=True):
        h, d, p = unpacked(block.as_py(), "u8", "i8", "i4")
        if known:
            docs.append(d)
            places.append(p)
        else:
            hashes.append((h, d, p))
    if hashes:
        h, d, p = (np.concatenate(c) for c in zip(*hashes, strict=True))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        more = count[back] > 1
        docs.append(d[more])
        places.append(p[more])
    made = _runs(np.concatenate(docs), np.concatenate(places), parts)
    released()
    return made


def _windows(rows: DataFrame, length: int, before: int | None, parts: int) -> DataFrame:
    """Blocks of the full windows whose chosen window of `before` words is marked; its hash and the full one's tell windows apart."""

    def sent(batches):
        gathered: list[tuple] = []
        held = 0

        def flush():
            nonlocal gathered, held
            g, h, d, p = (np.concatenate(c) for c in zip(*gathered, strict=True))
            gathered, held = [], 0
            order = np.lexsort((p, d, h, g))
            g, h, d, p = g[order], h[order], d[order], p[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            yield _sent((g[head] % np.uint64(parts)).astype(np.int64), False, [g[head], h[head], d[head], p[head]])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (d != d[first]) | (p != p[first])
            if later.any():
                yield _sent((d[later] % parts).astype(np.int64), True, [g[later], h[later], d[later], p[later]])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = _known(batch.column(2).to_pylist()) if before else None
            if before and not len(known):
                continue
            for words, docs, place, start in _full(batch.column(1), np.arange(len(ids)), length):
                if before:
                    order, at = _chosen(words, start, length, before)
                    kept = _marked(known, docs[at], place[at])
                    start, at = start[kept], at[kept]
                if len(start):
                    whole = doubled(windows_of(words, before), before) if before and length == 2 * before else windows_of(words, length)
                    whole = mix(whole[start])
                    gathered.append((order[at] if before else whole, whole, ids[docs[start]], place[start].astype(np.int32)))
                    held += len(start)
                    if held >= HELD:
                        yield from flush()
        if gathered:
            yield from flush()
        released()

    return rows.mapInArrow(sent, BLOCK)


def _later(table: pa.Table, parts: int) -> pa.Table:
    """One range of hashes of the last level: where windows start that an equal one precedes."""
    docs, places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
    for known, block in zip(table.column("known").to_pylist(), table.column("block"), strict=True):
        g, h, d, p = unpacked(block.as_py(), "u8", "u8", "i8", "i4")
        if known:
            docs.append(d)
            places.append(p)
        else:
            windows.append((g, h, d, p))
    if windows:
        g, h, d, p = (np.concatenate(c) for c in zip(*windows, strict=True))
        order = np.lexsort((p, d, h, g))
        g, h, d, p = g[order], h[order], d[order], p[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (d != d[first]) | (p != p[first])
        docs.append(d[later])
        places.append(p[later])
    made = _runs(np.concatenate(docs), np.concatenate(places), parts)
    released()
    return made


def _with_runs(rows: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """rows with the list of runs of their document, null if it has none."""
    lists = runs.select("doc", F.array("runs").alias(name))
    return rows.join(lists.hint("shuffle_hash"), F.col("_k") == F.col("doc"), "left").drop("doc")


def repeats(df: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """df's (key, text) as (_k, text), and runs (doc, runs) of the starts of repeated windows."""
    if length < 1:
        raise ValueError("a window has at least one word")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST_ID)).alias("_k"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(parts_for(spark), size // RANGE_BYTES)
    candidates, before = rows, None
    for part in levels(length)[:-1]:
        found = staged(_settled(_candidates(candidates, length, part, before, parts), _repeated, parts), f"windows-{part}")
        candidates, before = _with_runs(rows, found, "marks"), part
        if found.isEmpty():
            break
    return rows, _settled(_windows(candidates, length, before, parts), _later, parts)


def dedup(df: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of df: key, n_words, n_removed, kept_sha256 and, with_text, kept_text.

    A word goes if a window of `length` words over it has an equal one that starts earlier, at a
    smaller key or at the same key and an earlier place; windows are those of the input. Kept words
    are joined by one space. A null text has no words; texts shorter than a window keep theirs.
    Rows of the same key and text are one document: they don't precede each other. A null key
    precedes all others. Other columns of df are not read; an empty table gives an empty result.
    """
    rows, runs = repeats(df, length, key, text)
    fields = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_sha256:string" + ",kept_text:string>" * with_text + ">" * (not with_text))
    def kept(texts: pa.Array, marks: pa.Array) -> pa.Array:
        n, removed, shas, values = [], [], [], []
        for t, m in zip(texts, marks, strict=True):
            words = (t.as_py() or "").encode().split()
            n.append(len(words))
            if starts := m.as_py():
                gone = np.zeros(len(words) + 1, np.int64)
                both = np.concatenate([np.frombuffer(r, "<i4").reshape(-1, 2) for r in starts])
                np.add.at(gone, both[:, 0], 1)
                np.add.at(gone, np.minimum(both[:, 0] + both[:, 1] + length - 1, len(words)), -1)
                left = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, left.tolist(), strict=True) if k]
            removed.append(n[-1] - len(words))
            value = b" ".join(words)
            shas.append(hashlib.sha256(value).hexdigest())
            if with_text:
                values.append(value.decode())
        made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        return pa.StructArray.from_arrays(made + [pa.array(values, pa.string())] * with_text, fields)

    out = _with_runs(rows, runs, "marks").select("_k", kept("text", "marks").alias("made"))
    kind = df.schema[key].dataType
    back = F.when(F.col("_k") == LEAST_ID, F.lit(None)).otherwise(F.col("_k")).cast(kind)
    return out.select(back.alias(key), *(F.col(f"made.{f}").alias(f) for f in fields))
