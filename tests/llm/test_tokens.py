"""The tokenizer operators against the library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, pieces, token_counts, token_store

random.seed(5)
ODD = [
    "", " ", "  ", "a  b\n\n c", " \t\x85x\xa0 y", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c<|endoftext|><|endoftext|>", "日本語テキスト ok",
    "ΣΑΣ ς İstanbul ẞ ﬁ é ☃ 👩‍👩‍👧", "\x1c\x1d a\x1eb\x00c\x7f", "don't I'LL we'Re x'sy 's' ''s", " ½²³ 12345 ١٢٣ Ⅷ", "a" * 3000, "ab" * 2000, "=" * 700, "a\n \n b", "a\n <|endoftext|> b",
]
ODD += ["".join(chr(random.choice([random.randrange(0x250), random.randrange(0x250, 0xD800), random.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
ODD += ["".join(random.choice(["a", "b.", " ", " ", "\n", "<|endoftext|>", "\xa0", "\x1d", "é", "'s", "1"]) for _ in range(14)) for _ in range(600)]


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(pieces.public_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def _source(name):
    return open(pieces.public_path(name)).read()


def test_plain_code_points_split_as_the_library_does(library):
    counter = token_counts.Counter(_source("word_bpe_49k.json"))
    for c in range(0x250):
        for text in (f"æ{chr(c)}y", f"1{chr(c)} {chr(c)}é"):
            assert counter.count(text) == len(library["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids), hex(c)


def test_counts(library, texts):
    counter = token_counts.Counter(_source("word_bpe_49k.json"))
    for t in ODD + [*texts.values()]:
        assert counter.count(t) == len(library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids), t[:80]


def test_ids_and_back(library, texts):
    codec, words = bpe.Codec(_source("byte_bpe_50k.json")), token_store.LibraryIds(_source("byte_bpe_50k.json"))
    every = ODD + [*texts.values()]
    flat, n = words.encode(pa.array(every))
    for t, got in zip(every, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        want = library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == want, t[:80]
        assert got.tolist() == want, t[:80]
        assert codec.decode(codec.encode(t)) == t


def test_every_token_is_its_own_encoding():
    """What the dynamic programme rests on."""
    codec = bpe.Codec(_source("byte_bpe_50k.json"))
    names = {v: k for k, v in codec.file.vocab.items()}
    for k in range(0, len(codec.ids), 7):
        assert codec.numbers(names[codec.ids[k]]) == [k]


def test_queries(spark, documents, texts, library):
    n = {r["doc_id"]: r for r in token_counts.op2(spark, documents).collect()}
    six = {r["doc_id"]: r for r in bpe.op6(spark, documents).collect()}
    four = {r["doc_id"]: r for r in token_store.op4(spark, documents).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array(library["byte_bpe_50k.json"].encode(texts[i], add_special_tokens=False).ids, "<u4")
        ended = np.append(ids, 0).astype("<u4")
        count = len(library["word_bpe_49k.json"].encode(texts[i], add_special_tokens=False).ids)
        assert (n[i]["n_bytes"], n[i]["n_tokens"], n[i]["over_limit"]) == (len(texts[i].encode()), count, count > 2048)
        assert (six[i]["n_tokens"], six[i]["ids_sha256"], six[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
        assert (four[i]["start"], four[i]["n_tokens"], four[i]["ids_crc32"]) == (at, len(ended), zlib.crc32(ended.tobytes()))
        at += len(ended)


def test_long_pieces_are_not_remembered(library):
    counter, codec, words = token_counts.Counter(_source("word_bpe_49k.json")), bpe.Codec(_source("byte_bpe_50k.json")), token_store.LibraryIds(_source("byte_bpe_50k.json"))
    blob = "ab" * 500
    for _ in range(2):
        assert counter.count(f"one {blob}") == len(library["word_bpe_49k.json"].encode(f"one {blob}", add_special_tokens=False).ids)
        want = library["byte_bpe_50k.json"].encode(f"one {blob} x", add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(f"one {blob} x"), "<u4").tolist() == want and words.encode(pa.array([f"one {blob} x"]))[0].tolist() == want
    assert all(max(map(len, memory)) <= pieces.LONGEST for memory in (counter, codec, words.known))


def test_a_piece_of_many_words_is_encoded_once(library, monkeypatch):
    """Words of 40 stems and 40 endings, some beyond the explicit classes, in small blocks, and with a memory that is begun anew."""

    class Counted:
        def __init__(self, inner):
            self.inner, self.n = inner, 0

        def encode_batch_fast(self, texts, **how):
            self.n += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **how)

    stems = [f"{a}{b}orenthal" for a in "bcdfg" for b in "aeiouyxz"]
    words = [f"{s}{sign}{t}" for s in stems for sign in ("", ".\n", "&&&") for t in stems]
    texts = [" ".join(["x", *words[k : k + 60]]) for k in range(0, len(words), 60)]
    flat, n = (coder := token_store.LibraryIds(_source("byte_bpe_50k.json"))).encode(pa.array(texts[:1]))
    coder.file.library = counted = Counted(coder.file.library)
    flat, n = coder.encode(pa.array(texts))
    want = [library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    assert counted.n < 0.6 * sum(map(len, texts))

    monkeypatch.setattr(token_store, "BLOCK", 7)
    monkeypatch.setattr(token_store, "PIECES", 50)
    mixed = [f"{t} 日本{k} {'ab' * 40} don't\n\n é{k}." for k, t in enumerate(texts[:20])]
    flat, n = coder.encode(pa.array(mixed))
    want = [library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids for t in mixed]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want and len(coder.known) <= 50 + 40 * 7


def test_encode_and_decode_frames(spark, docs_of):
    docs = docs_of([(1, "one two"), (2, None), (3, "<|endoftext|>é")])
    path = pieces.public_path("byte_bpe_50k.json")
    ids = bpe.encode(docs, path)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(ids, path).collect()} == {1: "one two", 2: "", 3: "<|endoftext|>é"}


def test_store_skips_by_document(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/ids"
    rows = token_store.write_tokens(documents, pieces.public_path("byte_bpe_50k.json"), folder, shards=3)
    assert rows.filter("doc_id = 7").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in rows.filter("doc_id = 7")._jdf.queryExecution().toString()


def test_store_has_stripes_an_index_and_bloom_filters(spark, docs_of, tmp_path, monkeypatch):
    """What the files say of themselves: several stripes, Bloom filters on doc_id alone, and row groups that a reader skips."""
    monkeypatch.setattr(token_store, "STRIPE_BYTES", 200_000)
    rng = random.Random(1)
    docs = docs_of([(10**10 + 2 * i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(120))) for i in range(12_000)])
    token_store.write_tokens(docs, pieces.public_path("byte_bpe_50k.json"), f"file://{tmp_path}/ids", shards=1).count()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc
    path = next(p for p in (tmp_path / "ids").glob("part-*"))
    reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{path}"), orc.OrcFile.readerOptions(conf))
    stripes = reader.getStripes()
    assert stripes.size() > 1 and reader.getRowIndexStride() == token_store.INDEX_STRIDE and reader.getNumberOfRows() == 12_000
    rows = reader.rows()
    for k in range(stripes.size()):
        streams = rows.readStripeFooter(stripes.get(k)).getStreamsList()
        assert {s.getColumn() for s in streams if str(s.getKind()).startswith("BLOOM_FILTER")} == {1}
        assert {s.getColumn() for s in streams if str(s.getKind()) == "ROW_INDEX"} >= {1, 5}

    def read(doc_id):
        """How many rows a reader that looks for one id is left with."""
        kinds = jvm.org.apache.hadoop.hive.ql.io.sarg
        leaf = getattr(kinds, "PredicateLeaf$Type").LONG
        sought = kinds.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", leaf, doc_id).end().build()
        options = reader.options().searchArgument(sought, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        found, batch, n = reader.rows(options), reader.getSchema().createRowBatch(), 0
        while found.nextBatch(batch):
            n += batch.count()
        return n

    # Ids beyond 2**31, so that they reach the reader as longs.
    assert 1 <= read(10**10 + 7_000) <= token_store.INDEX_STRIDE and read(10**10 + 7_001) == 0
