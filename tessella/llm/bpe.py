"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix ends in one certain token. It is the vocabulary entry that
ends at the prefix and that merging would leave apart from the last token of the
shorter prefix before it. An automaton over the vocabulary gives the entries that end
at each place; the pair test undoes merges on both sides of the border, latest first,
and asks whether a merge across it would have come earlier. Following the last tokens
back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ship, text_of
from tessella.llm.pieces import BYTES, CACHE, LONGEST, NAMES, TokenizerFile, broadcast_file, named, opened, public_path

#: Pairs of neighbours whose test is remembered.
PAIR_CACHE = 300_000


class Codec(dict):
    """Ids of each piece met so far, as little-endian 32-bit integers; new pieces are encoded.

    Tokens have numbers inside: single bytes first, then merges by rank.
    """

    def __init__(self, text: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.file = file = TokenizerFile(text)
        if file.suffix or file.kind != "byte":
            raise ValueError("only byte-level files without word ends are encoded")
        number = {name: k for k, name in enumerate(NAMES)}
        self.left, self.right, self.joined = [0] * 256, [0] * 256, {}
        for a, b in file.merges:
            whole = a + b
            if whole in number:
                raise ValueError(f"two merges make {whole!r}")
            self.joined[number[a], number[b]] = number[whole] = len(number)
            self.left.append(number[a])
            self.right.append(number[b])
        self.ids = [file.vocab[name] for name in number]
        self.ends = ahocorasick.Automaton()
        for name, k in number.items():
            self.ends.add_word(name, (k, len(name)))
        self.ends.make_automaton()
        self.bytes = {i: bytes(map(BYTES.__getitem__, name)) for name, i in file.vocab.items()}
        self.bytes |= {i: name.encode() for name, i in file.added.items()}
        self._apart: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens apart when they are neighbours."""
        bound = len(self.ids)
        while True:
            if (made := self.joined.get((a, b))) is not None and made < bound:
                return False
            if a > b:
                if a < 256:
                    return True
                bound, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                bound, b = b + 1, self.left[b]  # of two equal merges the left one comes first

    def numbers(self, piece: str) -> list[int]:
        """Inner numbers of the piece's tokens; the piece has a character for each byte."""
        last, size, known = [-1], [0], self._apart
        at = 0
        for end, (k, n) in self.ends.iter(piece):
            if end < at:
                continue  # this prefix has its token
            before = last[end + 1 - n]
            if before >= 0:
                pair = before << 24 | k
                if (fits := known.get(pair)) is None:
                    if len(known) >= PAIR_CACHE:
                        known.clear()
                    known[pair] = fits = self.apart(before, k)
                if not fits:
                    continue
            last.append(k)
            size.append(n)
            at += 1
        found, at = [], len(piece)
        while at:
            found.append(last[at])
            at -= size[at]
        return found[::-1]

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            ids = self.ids
            found = array("I", [ids[k] for k in self.numbers(named(piece))]).tobytes()
        if len(piece) > LONGEST:
            return found
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        found = []
        for k, segment in enumerate(self.file.segments(text)):
            if k % 2:
                found.append(self.file.added[segment].to_bytes(4, "little"))
            else:
                found += map(self.__getitem__, self.file.pieces(segment))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


def _run(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    """Rows of ``schema`` from (doc_id, value); ``make(codec, value)`` gives the columns after doc_id."""
    spark = docs.sparkSession
    ship(spark)
    file = broadcast_file(spark, path)
    types = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches):
        codec = opened(Codec, file.value)
        for batch in batches:
            made = [make(codec, v.as_py()) for v in batch.column(1)]
            columns = zip(*made, strict=True) if made else [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: exact ids of the whole text, none for a null or empty one."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return _run(picked, path, "doc_id long, ids array<int>", lambda codec, text: (np.frombuffer(codec.encode(text), "<i4"),))


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids make an empty text."""
    picked = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _run(picked, path, "doc_id long, text string", lambda codec, v: (codec.decode(np.asarray(v or [], "<i4").tobytes()),))


def _round_trip(codec: Codec, text: str) -> tuple[int, str, str]:
    ids = codec.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded and its ids are decoded again. A null text is empty: no
    ids, and the digests of nothing. The string of a special token inside a text is
    that token. A null id stays null, repeated rows are encoded each, an empty table
    gives no rows, other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return _run(picked, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _round_trip)


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return round_trip(docs, public_path("byte_bpe_50k.json"))
