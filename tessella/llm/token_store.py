"""Token ids in ORC files.

Documents are dealt by ranges of doc_id and sorted, encoded where they are, and
written as one file per range. ORC writes the ids in stripes with integer run-length
encoding, an index of row groups, and Bloom filters on doc_id, so that stripes are
read in parallel and a reader that looks for some documents skips the rest.

``shard`` and ``at`` place each document: the number of its range, and the ids before
it in that range. The ids before a range are a running sum over ranges.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, partitions, ship, text_of
from tessella.llm.pieces import LONGEST, NAMES, TokenizerFile, broadcast_file, is_plain, opened, public_path

#: Id 0 ends each document.
END = 0
#: Rows between entries of the row index, and bytes of a stripe.
INDEX_STRIDE = 1000
STRIPE_BYTES = 16 * 2**20
#: Texts whose words are told apart together, in bytes, and distinct words cut into pieces together.
CHUNK, BLOCK = 4_000_000, 40_000

#: Pieces remembered by a Python worker before those met once are forgotten, and pieces encoded in one text. An executor
#: may have more workers than cores for a while, each with a memory of its own.
PIECES = 350_000
TOGETHER = 2000

ROW = "doc_id long, shard int, at long, n_tokens long, ids array<int>"


class LibraryIds:
    """The library's ids of whole texts. Pieces it has encoded before are remembered.

    Where a blank stands before anything but white space, the splitter begins a new
    piece, whatever is around, so the ids of a text are those of its words in turn, each
    with the blank before it, and the ids of a word are those of its pieces. A word whose
    pieces the explicit classes don't tell is one piece here. A text with other white
    space after a blank, or with a special token's string, goes to the library as it is.
    """

    def __init__(self, text: str):
        self.file = TokenizerFile(text)
        if self.file.kind != "byte":
            raise ValueError("only byte-level files have words that stand for themselves")
        self._begins = {lead: self._beginning(NAMES[ord(lead)]) for lead in " \n"}
        # Pieces by number; ``values`` holds their ids in turn and ``ends`` where each one's ids end, from 0.
        self.known: dict[str, int] = {}
        self.values, self.ends, self.blank, self.again = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def _forget(self) -> None:
        """Leave the pieces that were met again in a later block, half of PIECES at most."""
        kept = np.flatnonzero(self.again)[: PIECES // 2]
        names = list(self.known)
        self.known = dict(zip([names[k] for k in kept.tolist()], range(len(kept))))
        self.values = _rows(self.values, self.ends).take(pa.array(kept)).flatten().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(np.diff(self.ends)[kept])])
        self.blank, self.again = self.blank[kept], np.zeros(len(kept), bool)

    def _beginning(self, name: str) -> np.ndarray:
        found = np.zeros(max([*self.file.vocab.values(), *self.file.added.values()]) + 1, bool)
        found[[i for token, i in self.file.vocab.items() if token.startswith(name)]] = True
        return found

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.int32) for found in self.file.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids in turn, and how many each has.

        Many are encoded in one text. A token that begins with a blank begins a piece; to
        pieces without one a line feed is put, whose id is taken off again. White space
        would join it, so such pieces are encoded one by one.
        """
        kinds = np.array([0 if p.isspace() else 1 if p[0] == " " else 2 for p in pieces])
        found, n = [], np.zeros(len(pieces), np.int64)
        for kind, lead in enumerate(("", "", "\n")):
            mine = np.flatnonzero(kinds == kind)
            for at in range(0, len(mine), TOGETHER):
                part = mine[at : at + TOGETHER]
                texts = [lead + pieces[k] for k in part.tolist()]
                if kind == 0:
                    each = self._library(texts)
                    ids, n[part] = np.concatenate(each), [len(x) for x in each]
                else:
                    ids = self._library(["".join(texts)])[0]
                    begins = np.flatnonzero(self._begins[texts[0][0]][ids])
                    n[part] = np.diff(begins, append=len(ids)) - len(lead)
                    ids = np.delete(ids, begins) if lead else ids
                found.append(ids)
        order = np.argsort(kinds, kind="stable")
        ends = np.concatenate([[0], np.cumsum(n[order])])
        back = np.argsort(order)
        return _rows(np.concatenate(found), ends).take(pa.array(back)).flatten().to_numpy(), n

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces. Those not met before are encoded; a long one is had for this block only."""
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        met = numbers >= 0
        self.again[numbers[met]] = True
        gaps = np.flatnonzero(~met).tolist()
        if gaps:
            sought = [pieces[k] for k in gaps]
            new = list(dict.fromkeys(sought))
            short = [p for p in new if len(p) <= LONGEST]
            if len(short) < len(new):
                new = short + [p for p in new if len(p) > LONGEST]
            ids, n = self._encode(new)
            number = dict(zip(new, range(len(self.blank), len(self.blank) + len(new))))
            self.values = np.concatenate([self.values, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.blank = np.concatenate([self.blank, np.array([p[0] == " " for p in new])])
            numbers[gaps] = list(map(number.__getitem__, sought))
            self.known.update(zip(short, range(len(self.known), len(self.known) + len(short))))
        return numbers

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, with the blank before each, and how many each has. None is empty or begins with white space."""
        joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        if is_plain(joined):
            numbers = self._numbers(self.file.pieces(joined))
        else:
            apart = [self.file.pieces(f" {w}") if is_plain(w) else [f" {w}"] for w in words.to_pylist()]
            numbers = self._numbers([p for each in apart for p in each])
        n = np.diff(self.ends)[numbers]
        ids = _rows(self.values, self.ends).take(pa.array(numbers)).flatten().to_numpy()
        sizes = np.add.reduceat(n, np.flatnonzero(self.blank[numbers]))
        short = len(self.known)
        self.values, self.ends, self.blank = self.values[: self.ends[short]], self.ends[: short + 1], self.blank[:short]
        self.again = np.concatenate([self.again, np.zeros(short - len(self.again), bool)])
        if short > PIECES:
            self._forget()
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has.

        Words are told apart and put back together by Arrow; Python sees the pieces of
        each distinct one of the texts once.
        """
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        first = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        odd = pc.or_(pc.utf8_is_space(first), pc.equal(first, "")).to_numpy(zero_copy_only=False)
        sound = np.flatnonzero(~odd)
        made = [self._words(coded.dictionary.take(pa.array(sound[k : k + BLOCK]))) for k in range(0, len(sound), BLOCK)]
        n_words = np.zeros(len(odd), np.int64)
        n_words[sound] = np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)])
        at = coded.indices.to_numpy().copy()
        # A text's first word has no blank before it: it is an entry of its own. So is a text that goes to the library as it is.
        at[starts] = len(odd) + np.arange(len(texts))
        whole = np.zeros(len(texts), bool)
        for added in self.file.added:
            whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        if odd.any():
            whole |= np.add.reduceat(np.concatenate([odd, np.zeros(len(texts), bool)])[at], starts) > 0
        if whole.any():
            inside = np.repeat(whole, np.diff([*starts, len(at)]))
            inside[starts] = False
            at[inside] = len(odd) + len(texts)
        heads = split.flatten().take(pa.array(starts)).to_pylist()
        heads = self._library([texts[k].as_py() if w else h for k, (h, w) in enumerate(zip(heads, whole.tolist(), strict=True))])

        n = np.concatenate([n_words, [len(h) for h in heads], [0]])
        entries = _rows(np.concatenate([*(ids for ids, _ in made), *heads]), np.concatenate([[0], np.cumsum(n)]))
        return entries.take(pa.array(at)).flatten().to_numpy(), np.add.reduceat(n[at], starts)


def _rows(values: np.ndarray, ends: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values))


def _chunks(ids: pa.Array, texts: pa.Array):
    """Slices of CHUNK bytes of text or, where one text is longer, of one text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK, "right")))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def write_tokens(docs: DataFrame, path: str, folder: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text, each followed by ``END``, in ascending doc_id order, and return the files' rows.

    A null text is empty: it has the end id alone. A null id comes first. Rows that
    repeat an id stand together. An empty table writes no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    ship(spark)
    file = broadcast_file(spark, path)
    def run(batches):
        library = opened(LibraryIds, file.value)
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids_of, texts in _chunks(batch.column(0), batch.column(1)):
                flat, n = library.encode(texts)
                ends = np.cumsum(n)
                flat, n = np.insert(flat, ends, END), n + 1
                ends = np.cumsum(n)
                columns = [ids_of, pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - n), pa.array(n)]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([*columns, ids], names=["doc_id", "shard", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    placed = picked.repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    writer = placed.mapInArrow(run, ROW).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES).option("compression", "zstd").orc(folder)
    return read_tokens(spark, folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROW).orc(folder)


def positions(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' rows; start: ids of all documents before."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, pa.array(crc, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    read = rows.select("doc_id", "shard", "at", "ids").mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    # One row for each file.
    return read.join(F.broadcast(sizes), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = Scratch(spark, "tokens").path("orc")
    return positions(write_tokens(docs, public_path("byte_bpe_50k.json"), folder))
