"""Token counts by byte-pair merging with a heap and a linked list.

A piece starts as its symbols. The adjacent pair of lowest rank, the leftmost of
equals, is popped and merged until no pair has a rank; the count is the symbols less
the merges. No identifiers are made.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ship, text_of
from tessella.llm.pieces import CACHE, LONGEST, TokenizerFile, broadcast_file, named, opened, public_path

#: A document with more tokens is over the limit.
LIMIT = 2048


class Counter(dict):
    """Tokens of each piece met so far; of a piece that is new, they are counted."""

    def __init__(self, text: str):
        super().__init__()
        self.older: dict[str, int] = {}
        self.file = TokenizerFile(text)
        self.ranks = {pair: rank for rank, pair in reversed([*enumerate(self.file.merges)])}

    def __missing__(self, piece: str) -> int:
        if (found := self.older.get(piece)) is None:
            symbols = list(named(piece))
            symbols[-1] += self.file.suffix
            found = count_merged(symbols, self.ranks)
        if len(piece) > LONGEST:
            return found
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def count(self, text: str) -> int:
        total = 0
        for k, segment in enumerate(self.file.segments(text)):
            total += 1 if k % 2 else sum(map(self.__getitem__, self.file.pieces(segment)))
        return total


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair can be merged. ``symbols`` is used up."""
    n = len(symbols)
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = [*range(1, n + 1)], [*range(-1, n)], n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i] += symbols[j]
        symbols[j] = None
        after[i] = k = after[j]
        before[k] = i
        left -= 1
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
        if k < n and (rank := ranks.get((symbols[i], symbols[k]))) is not None:
            heapq.heappush(heap, (rank, i))
    return left


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Begin and end tokens are not counted; the string of a special token inside a text
    is one token. A null text is empty and has none. A null id stays null, repeated
    rows are counted each, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    file = broadcast_file(spark, path)

    def run(batches):
        counter = opened(Counter, file.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return token_counts(docs, public_path("word_bpe_49k.json"))
