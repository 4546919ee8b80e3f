"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For a merge-based vocabulary the last piece of every prefix of a text is
unique.  Walking over the prefixes, an Aho-Corasick automaton names the pieces
that end there, and the one that is compatible with the last piece of the
prefix before it is stored; the ids are then read backwards through the table
(Berglund & van der Merwe, "Formalizing BPE Tokenization", 2023).  A pair of
pieces is compatible if encoding both together gives the two back.  This takes
time in proportion to the text, however long a run without spaces is.

No piece holds a space behind another character, so a text falls apart into
space-led chunks that are encoded by themselves; words fall apart from signs
that no piece joins to a letter, and chunks at characters without a piece, which
become bytes.  Results of chunks are kept in a bounded table per Python worker.

Defined cases: a null text counts as empty and has no ids; texts of any length
are encoded whole; repeated rows, also without ids, each get a row; columns
other than ``doc_id`` and ``text`` may have any name; an empty table gives an
empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
#: Chunks of text and answers on pairs that a worker keeps, each in two generations of half as many: some 70 and 50 MB.
KEEP, PAIRS = 200_000, 500_000


class Pieces:
    """A vocabulary of ``(piece, score, kind)``; kind is ``piece``, ``byte`` or ``control``."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.text = [p for p, *_ in pieces]
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.score = [s for _, s, _ in pieces]
        self.length = [len(p) for p in self.text]
        self.byte = [0] * 256
        self.is_byte = [False] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte[int(p[1:-1], 16)], self.is_byte[i] = i, True
        self.control = [kind == "control" for *_, kind in pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.known = {p for p in self.id if len(p) == 1}
        inner = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.joins = inner
        if any(b == SPACE and a != SPACE for a, b in inner):
            raise ValueError("a piece holds a space behind another character")
        # no merge goes from a letter to one of these
        joined = {b for a, b in inner if LETTER.match(a)}
        apart = "".join(re.escape(c) for c in sorted(self.known - joined) if not LETTER.match(c) and c != SPACE)
        self.chunks = re.compile((f"{SPACE}*[^\\W\\d_]++(?=[{apart}])|" if apart else "") + f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.pair: dict[int, bool] = {}
        self.old_pair: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def merge(self, text: str) -> list[int]:
        """Ids by merging the best pair, leftmost first, until none is left; what compatibility is defined by."""
        at = list(text)
        while len(at) > 1:
            best, k = None, -1
            for i in range(len(at) - 1):
                if (p := self.id.get(at[i] + at[i + 1])) is not None and (best is None or self.score[p] > best):
                    best, k = self.score[p], i
            if k < 0:
                break
            at[k : k + 2] = [at[k] + at[k + 1]]
        return [self.id[x] for x in at]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pair) > PAIRS // 2:
            self.old_pair, self.pair = self.pair, {}
        key = a << 20 | b
        fits = self.old_pair.get(key)
        if fits is None:
            # characters that no piece joins can't merge over the border
            fits = self.merge(self.text[a] + self.text[b]) == [a, b] if (self.text[a][-1], self.text[b][0]) in self.joins else self.whole(b)
        self.pair[key] = fits
        return fits

    def run(self, text: str) -> list[int]:
        """Ids of a text whose every character has a piece."""
        last, length = [-1] * (len(text) + 1), self.length
        known, reached = self.pair.get, self.reached.get  # a generation that ends within a text is kept in hand until it does
        for end, i in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[i]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 20 | i)
                if fits is None:
                    fits = self.compatible(before, i)
            else:
                fits = reached(i)
                if fits is None:
                    fits = self.whole(i)
            if fits:
                last[end] = i
        ids, at = [], len(text)
        while at:
            ids.append(i := last[at])
            at -= length[i]
        ids.reverse()
        return ids

    def whole(self, i: int) -> bool:
        """Whether the piece's own text gives the piece back; some can never be reached by merges."""
        if (known := self.reached.get(i)) is None:
            known = self.reached[i] = self.merge(self.text[i]) == [i]
        return known

    def chunk(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > at:
                    ids += self.run(text[at:k])
                ids += (self.byte[b] for b in c.encode("utf-8", "surrogatepass"))
                at = k + 1
        return ids + self.run(text[at:]) if at < len(text) else ids

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                held += bytes([int(self.text[i][1:-1], 16)])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append("" if self.control[i] else self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


class Coder(dict):
    """Chunks to ``(ids as text, count, decoded text)``, filled as chunks are met."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.old = pieces, {}

    def __missing__(self, chunk: str) -> tuple[str, int, str]:
        value = self.old.get(chunk)
        if value is None:
            if self.pieces.known.issuperset(chunk):  # then the pieces' texts are the chunk's
                ids = self.pieces.run(chunk)
                value = (",".join(map(str, ids)), len(ids), chunk.replace(SPACE, " "))
            else:
                ids = self.pieces.chunk(chunk)
                value = (",".join(map(str, ids)), len(ids), self.pieces.decode(ids))
        if len(chunk) <= 40:
            if len(self) >= KEEP // 2:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def encode(self, text: str) -> list[tuple[str, int, str]]:
        """The text's chunks with their ids; a space is put in front, as the model asks for."""
        return list(map(self.__getitem__, self.pieces.chunks(SPACE + text.replace(" ", SPACE)))) if text else []


@lru_cache(2)
def coder(model_path: str) -> Coder:
    """One for each Python worker, kept from task to task."""
    return Coder(Pieces.load(model_path))


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every text and what they decode to."""

    def make():
        encode = coder(model_path).encode

        def work(keys, texts):
            got = [encode(t or "") for t in texts]
            ids = [[int(i) for x, *_ in g for i in x.split(",")] for g in got]
            return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(x[2] for x in g)[1:] for g in got], pa.string())], names=["doc_id", "ids", "decoded"])

        return work

    return map_texts(docs, make, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As :func:`encode_decode`, with digests in place of ids and text, which then needn't leave Python."""

    def make():
        encode = coder(model_path).encode

        def work(keys, texts):
            n, a, b = [], [], []
            for t in texts:
                got = encode(t or "")
                n.append(sum([x[1] for x in got]))
                a.append(sha256(",".join([x[0] for x in got]).encode()).hexdigest())
                b.append(sha256("".join([x[2] for x in got])[1:].encode("utf-8", "surrogatepass")).hexdigest())
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
