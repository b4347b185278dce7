"""Token ids in binary chunks: bit-plane or byte-plane shuffling, zstandard, and a chunk index.

Documents are put in ascending order of doc_id over range partitions; each partition writes its
documents in chunks of about CHUNK_IDS ids. A chunk holds whole documents, so it can be read alone:

    magic b"PLT1", version, plane width (8: byte planes, 1: bit planes), u32 documents, u64 ids,
    u32 ids in a block, u32 length and zstandard frame of the documents' ids and lengths (i64, i64),
    for each block of ids and each plane: u32 length (0: all zero), zstandard frame.

Chunks are rows of a Parquet table `chunks`, written by Spark, so its committer keeps one copy of
each however often a task ran, and any store Spark can write will do. `index` has a row for each
chunk with its first place in the whole sequence.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAGIC = b"PLT1"
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
ID_BITS = 32
#: Fixed value: the word pattern of byte-level tokenizers of this family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose kind all libraries agree on: the Latin blocks without the controls that some call white space.
KNOWN_CHARS = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F]
#: Bytes of words and ids that a worker keeps of each of two generations, and characters of the longest word.
KEPT_BYTES, KEPT_CHARS = 128 << 20, 64
#: The key that stands for no key in files.
NO_KEY = -(1 << 63)


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """A block of ids transposed: plane k holds byte (or bit) k of every id."""
    raw = np.ascontiguousarray(ids.astype("<u4"))
    if width == 8:
        return [p.tobytes() for p in np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T)]
    bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(b, bitorder="little").tobytes() for b in bits.T]


def from_planes(planes: list[bytes | None], n: int, width: int) -> np.ndarray:
    """The ids of a block; None is a plane of zeros."""
    if width == 8:
        out = np.zeros((4, n), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                out[k] = np.frombuffer(p, np.uint8)
        return np.ascontiguousarray(out.T).view("<u4").reshape(-1)
    bits = np.zeros((ID_BITS, n), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            bits[k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_chunk(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int = 8, level: int = 3, block: int = BLOCK_IDS) -> bytes:
    """One chunk as bytes, see the module."""
    if width not in (1, 8):
        raise ValueError("planes are of 1 or 8 bits")
    press = zstandard.ZstdCompressor(level=level).compress
    head = press(np.stack([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
    out = [MAGIC, struct.pack("<BBIQII", 1, width, len(doc_ids), len(ids), block, len(head)), head]
    for at in range(0, len(ids), block):
        for plane in to_planes(ids[at : at + block], width):
            data = press(plane) if any(plane) else b""
            out += [struct.pack("<I", len(data)), data]
    return b"".join(out)


def decode_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a chunk."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    _, width, docs, n, block, size = struct.unpack_from("<BBIQII", data, 4)
    at = 4 + struct.calcsize("<BBIQII")
    open_ = zstandard.ZstdDecompressor().decompress
    table = np.frombuffer(open_(data[at : at + size]), "<i8").reshape(2, docs)
    at += size
    ids = np.empty(n, "<u4")
    for first in range(0, n, block):
        planes: list[bytes | None] = []
        for _ in range(4 if width == 8 else ID_BITS):
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
            planes.append(open_(data[at : at + size]) if size else None)
            at += size
        ids[first : first + block] = from_planes(planes, min(block, n - first), width)
    return table[0], table[1], ids


class FileTokenizer:
    """Ids as the tokenizers library gives them for a file, add_special_tokens=False.

    A byte-level BPE with WORD_PATTERN encodes each word of a text alone, so the library is asked once for
    each word and its ids are remembered. Texts with other characters than KNOWN_CHARS or with the string
    of an added token go to the library whole, as does everything if the file is of another kind.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        settings = json.loads(self.library.to_str())
        model, before = settings["model"], settings["pre_tokenizer"] or {}
        by_word = model["type"] == "BPE" and not model.get("dropout") and not settings["normalizer"] and not settings.get("truncation") and not settings.get("padding")
        self.by_word = by_word and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        kinds = {k: "".join(c for c in KNOWN_CHARS if regex.fullmatch(rf"\p{{{k}}}", c)) for k in "LN"}
        letters, numbers = (re.escape(kinds[k]) for k in "LN")
        pattern = WORD_PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self.split = re.compile(pattern).findall
        self.other = re.compile(f"[^{re.escape(''.join(KNOWN_CHARS))}]").search
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        between = self.library.encode("\n", add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a text by the library, which makes no places of them."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _made(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the library.

        Words that are not white space are encoded as lines of one text: a line's end parts words as
        the pattern does, and its id is in none of them.
        """
        lines = [w for w in words if not w.isspace()] if self.between is not None else []
        made = {}
        if lines:
            ids = self._ids("\n".join(lines))
            ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)]
            raw, begin = ids.tobytes(), 0
            for w, end in zip(lines, ends, strict=True):
                made[w] = raw[4 * begin : 4 * end]
                begin = end + 1
        rest = [w for w in words if w not in made]
        found = self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        return made | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, found, strict=True)}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, the new ones by the library."""
        found = {w: self.old[w] for w in words if w in self.old}
        new = [w for w in words if w not in found]
        found |= self._made(new) if new else {}
        for w, ids in found.items():
            if len(w) <= KEPT_CHARS:
                self.size += 200 + len(w) + len(ids)
                if self.size > KEPT_BYTES:
                    self.old, self.kept, self.size = self.kept, {}, 0
                self.kept[w] = ids
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian u32."""
        if not self.by_word or self.other(text) or any(a in text for a in self.added):
            return self._ids(text).tobytes()
        words = self.split(text)
        ids = list(map(self.kept.get, words))
        if None in ids:
            found = self._learn(list({w for w, i in zip(words, ids, strict=True) if i is None}))
            ids = [found[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return b"".join(ids)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> FileTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return FileTokenizer(path)


CHUNK = "part int, chunk int, first_doc long, n_docs long, n_ids long, n_bytes long, payload binary"


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 8, chunk_ids: int = CHUNK_IDS) -> None:
    """Write the ids of df's texts, each followed by end_id, in ascending order of the integer key.

    A null text counts as empty: only end_id. A null key sorts first; NO_KEY stands for it in the files, and
    `read` gives null back. Rows of one key stay beside each other in the order of their texts. Other
    columns are not read. An empty table gives an empty chunk table and index.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def chunks(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        t, end = tokenizer(tokenizer_path), struct.pack("<I", end_id)
        docs, parts, held = [], [], 0

        def made():
            nonlocal docs, parts, held, number
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = encode_chunk(np.array(docs, np.int64), lengths, ids, width)
            row = [part, number, docs[0], len(docs), len(ids), len(data), data]
            docs, parts, held, number = [], [], 0, number + 1
            names = [c.split()[0] for c in CHUNK.split(", ")]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = t.encode(value.as_py()) + end
                docs.append(doc.as_py())
                parts.append(ids)
                held += len(ids) // 4
                if held >= chunk_ids:
                    yield made()
        if docs:
            yield made()

    ordered.mapInArrow(chunks, CHUNK).write.parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "first_doc", "n_docs", "n_ids", "n_bytes")
    # Two steps: places of the partitions (one short row each), then of the chunks in a partition.
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    index = stored.join(totals.select("part", before.alias("before")), "part")
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    index.select("part", "chunk", "first_doc", "n_docs", "n_ids", "n_bytes", (F.col("before") + within).alias("start")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<long>) of every document in the files."""

    def fields(docs, starts, lengths, ids):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return [docs, pa.array(starts), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))]

    return _scan(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", fields)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes, from the files."""

    def fields(docs, starts, lengths, ids):
        ends = np.cumsum(lengths) * 4
        raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        crcs = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return [docs, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())]

    return _scan(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", fields)


def _scan(spark: SparkSession, path: str, schema: str, fields) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")
    chunks = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "payload").join(index, ["part", "chunk"]).select("start", "payload")

    def opened(batches):
        for batch in batches:
            for start, data in zip(batch.column(0), batch.column(1), strict=True):
                docs, lengths, ids = decode_chunk(data.as_py())
                starts = start.as_py() + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                keys = pa.array(docs.astype(np.int64), mask=docs == NO_KEY)
                yield pa.RecordBatch.from_arrays(fields(keys, starts, lengths.astype(np.int64), ids), names)

    return chunks.mapInArrow(opened, schema)
