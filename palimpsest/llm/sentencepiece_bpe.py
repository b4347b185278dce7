"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A BPE encoding is the only sequence of pieces in which every two neighbours are compatible: merging
the text of both again gives the same two pieces. So the encoder walks from the left with the
longest pieces (Aho-Corasick), checks each against the one before by undoing the two pieces' own
merges, falls back to the next shorter piece, and marks positions from which nothing fits in a bit
field, so that no position is tried twice. Time is linear in the text, however long a word is.

Merge order is the order of the scores. Pieces of blanks only share one score; among equal scores
the leftmost merge comes first, so a run of blanks is cut from its left into the longest pieces.
Characters that no piece has are written as UTF-8 byte pieces and separate what stands beside them.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, with_struct

BLANK = "▁"
NEVER = 1 << 60
#: Bytes of words and ids that a worker keeps of each of two generations, and characters of the longest word.
KEPT_BYTES, KEPT_CHARS = 28 << 20, 64
#: Pairs of pieces whose compatibility a worker keeps (about 140 bytes each).
KEPT_PAIRS = 200_000
LETTER = re.compile(r"[^\W\d_]")
MARKS = ",.!?;:"
#: Letters before a mark in pieces, up to which the mark is cut from all others.
FEW_LETTERS = 20


class PieceEncoder:
    """Encoder of one .model file of type BPE with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = {}
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
        self.pieces = pieces
        self.blank_lengths = sorted((len(p) for p in pieces if set(p) == {BLANK}), reverse=True)
        words = [p for p in pieces if len(p) == 1 or set(p) != {BLANK}]
        if any(BLANK in p[1:] for p in words):
            raise ValueError("a piece holds a blank after its beginning: words can't be encoded alone")
        ordered = sorted((p for p in words if len(p) > 1), key=lambda p: -sp.get_score(pieces[p]))
        if len({sp.get_score(pieces[p]) for p in ordered}) != len(ordered):
            raise ValueError("two pieces have the same score")
        self.rank = {p: k for k, p in enumerate(ordered)}
        self.chars = set("".join(words))
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.reachable = set(self.chars)
        for p in ordered:
            if split := self._last_merge(p):
                self.left[p], self.right[p] = split
                self.reachable.add(p)
        # Pieces by number, -1 for none: their last character's distance, next shorter prefix and ids.
        self.names = sorted(self.reachable)
        self.number = {p: k for k, p in enumerate(self.names)}
        self.reach = [len(p) - 1 for p in self.names]
        self.shorter = [next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reachable), -1) for p in self.names]
        self.ids_of = [(pieces[p],) if p in pieces else self._bytes(p) for p in self.names]
        self.blank = self.number[BLANK]
        self.matcher = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            self.matcher.add_word(p, k)
        self.matcher.make_automaton()
        self.fits: dict[int, bool] = {}
        self.split = re.compile(self._words_pattern())
        self.words = _Words(self)
        self.written = [str(i) for i in range(sp.get_piece_size())]

    def _words_pattern(self) -> str:
        """A pattern whose matches, one after another, are the text cut where no piece can reach over.

        That is before a run of blanks, around a character that no piece has (line end), and between a letter
        and a mark if no piece has that letter with a mark behind it: no merge can then join the two.
        """
        before = {c: {p[k] for p in self.rank for k in range(len(p) - 1) if p[k + 1] == c and LETTER.match(p[k])} for c in MARKS}
        chosen = [c for c in MARKS if len(before[c]) <= FEW_LETTERS]
        joined = re.escape("".join(sorted(set().union(*(before[c] for c in chosen)))))
        marks = re.escape("".join(chosen))
        no, yes = (f"(?<![{joined}])", f"|(?<=[{joined}])") if joined else ("", "")
        end = "" if "\n" in self.chars else "\n"
        starts = [f"{BLANK}+"] + [end] * bool(end) + [f"(?<=[^\\W\\d_]){no}[{marks}]"] * bool(marks)
        stops = f"{BLANK}{end}{marks}"
        more = f"(?:(?:(?<![^\\W\\d_]){yes})[{marks}][^{stops}]*)*" * bool(marks)
        return f"(?:{'|'.join(starts)})[^{stops}]*{more}"

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the merge that makes the piece from its characters, None if merging ends elsewhere."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], NEVER), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1])

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text a + b anew gives a and b: no merge over their border comes in time.

        The later of the two pieces' last merges is undone until both sides of the border are
        characters; a merge over the border must not come before the one undone last.
        """
        rank, limit = self.rank, NEVER
        while True:
            if rank.get(a + b, NEVER) < limit:
                return False
            of_a, of_b = rank.get(a, -1), rank.get(b, -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                a, limit = self.right[a], of_a
            else:  # at equal rank the merge more to the left comes first
                b, limit = self.left[b], of_b + 1

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[x] for x in text.encode("utf-8", "surrogatepass"))

    def _fit(self, pair: int) -> bool:
        """Whether the pieces of a pair of numbers are `compatible`, remembered."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        fit = self.fits[pair] = self.compatible(self.names[pair >> 32], self.names[pair & 0xFFFFFFFF])
        return fit

    def _known(self, text: str) -> list[int]:
        """Numbers of the pieces of a text whose characters all have pieces."""
        n, reach, shorter, known = len(text), self.reach, self.shorter, self.fits.get
        longest = [-1] * n
        for end, piece in self.matcher.iter(text):  # later ends are longer
            longest[end - reach[piece]] = piece
        failed = None  # bit field of positions from which no encoding goes on
        out: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = at + reach[piece] + 1
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fit = known(last << 32 | piece)
                    if fit or (fit is None and self._fit(last << 32 | piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, longest[end]
            else:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= reach[piece] + 1
                last = out[-1] if out else -1
                piece = shorter[piece]

    def _blanks(self, n: int) -> list[int]:
        out = []
        while n:
            k = next(k for k in self.blank_lengths if k <= n)
            out.append(self.pieces[BLANK * k])
            n -= k
        return out

    def word(self, text: str) -> list[int]:
        """Ids of a run of blanks and what follows it up to the next cut."""
        body = text.lstrip(BLANK)
        blanks = len(text) - len(body)
        rest = BLANK + body if blanks else body
        ids: list[int] = []
        if self.chars.issuperset(rest):
            found = self._known(rest)
            if blanks:
                free = found[0] == self.blank  # the last blank has not gone into a word
                if blanks > 1 or free:
                    ids = self._blanks(blanks if free else blanks - 1)
                found = found[free:]
            for k in found:
                ids += self.ids_of[k]
            return ids
        for known, run in groupby(rest, self.chars.__contains__):
            if known:
                found = self._known("".join(run))
                if blanks:
                    free = found[0] == self.blank
                    ids, found, blanks = self._blanks(blanks if free else blanks - 1), found[free:], 0
                for k in found:
                    ids += self.ids_of[k]
            else:
                for c in run:
                    ids += self._bytes(c)
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, self.split.findall(BLANK + text.replace(" ", BLANK)))))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


class _Words(dict):
    """Ids of the words seen lately: when a generation has KEPT_BYTES it becomes the old one, and the one before is let go."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder, self.old, self.size = encoder, {}, 0
        self.shared = {i: i for i in range(encoder.library.get_piece_size())}  # one object for each id

    def __missing__(self, word: str):
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(map(self.shared.__getitem__, self.encoder.word(word)))
        if len(word) <= KEPT_CHARS:
            self.size += 220 + 2 * len(word) + 8 * len(ids)
            if self.size > KEPT_BYTES:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(model_path: str) -> PieceEncoder:
    """One encoder for each model and worker process."""
    return PieceEncoder(model_path)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids`, array<int>: exactly what the library's encode gives, no begin or end ids.

    A null text counts as empty and has no ids. Long texts are encoded whole; rows repeat as they
    come; a column called `ids` is replaced, others stay. The model file is found at model_path on
    every executor.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        e = encoder(model_path)
        return pa.array([e.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return df.withColumn(ids, ids_of(F.col(f"`{text}`")))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column `text`: the library's decode of the ids; null or no ids give ''."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        e = encoder(model_path)
        return pa.array([e.decode(x.as_py() or []) for x in lists], pa.string())

    return df.withColumn(text, text_of(F.col(f"`{ids}`")))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Encodes and decodes as `encode` and `decode` do, without carrying the ids through Spark.
    """

    @F.arrow_udf(f"struct<{DIGEST.replace(' ', ':').replace(',:', ',')}>")
    def made(texts: pa.Array) -> pa.Array:
        e = encoder(model_path)
        n, ids_sha, text_sha = [], [], []
        gc.disable()  # no cycles are made here, and looking for them goes over all words kept
        try:
            for t in texts:
                ids = e.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(e.written.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        finally:
            gc.enable()
        released()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return with_struct(df, made(F.col(f"`{text}`")), ["n_tokens", "ids_sha256", "decoded_sha256"], keep)
