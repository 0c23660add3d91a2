import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from bridgewell.llm import queries, tokenfiles

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


def odd_texts(n=300):
    rng = random.Random(8)
    bits = ["a", " ", "\xa0", "\t", "The", "\n", "é", "É", "ing", "!", "1", "\U0001f600", "ß", "'s", "'S", "<|endoftext|>", "日本", "\x1c", "\x00", "́", "İ", "Σ", "œ", "ª", "×", "ſ", "K", "½", "\x85"]
    return ["", None, "word " * 40_000, "x" * 3000, "A b\xa0c", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def want(library, docs, end=1):
    """(doc_id, start, n_tokens, packed ids) in order of doc_id; distinct ids."""
    out, start = [], 0
    for i, t in sorted(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def rows(df):
    return sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in df.collect())


def test_encoder_equals_the_library(path, library):
    with open(path, encoding="utf-8") as f:
        data = f.read()
    code = tokenfiles.Encoder(data)
    assert code.plain and code.width == 2
    other = tokenfiles.Encoder(data.replace('"Lowercase"', '"NFC"'))
    assert not other.plain
    for t in odd_texts(3000):
        assert code.encode(t) == code.packed(library.encode(t or "", add_special_tokens=False).ids)
    assert other.encode("Ab c") == other.packed(other.tokenizer.encode("Ab c", add_special_tokens=False).ids)


def test_round_trip_and_lookup(spark, path, library, tmp_path):
    texts = odd_texts()
    docs = [(7 * i - 500, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit("clash"), "frame": F.lit(0)}).repartition(6)
    folder = tokenfiles.save(df, path, 1, f"file://{tmp_path}/tokens")
    expected = want(library, docs)
    assert rows(tokenfiles.load(spark, folder)) == expected
    known = tokenfiles.manifest(folder)
    assert known["documents"] == len(docs) and known["ids"] == sum(x[2] for x in expected)
    lie = [tokenfiles.OpenShard(folder, s["name"], known["dictionary"], tokenfiles.dictionary(folder, known["dictionary"])) for s in known["shards"]]
    assert [int(i) for s in lie for i in s.ids] == [x[0] for x in expected]  # ascending over the files
    asked = spark.createDataFrame([(docs[3][0],), (docs[3][0],), (docs[90][0],), (1,), (10**12,), (None,)], "doc_id long")
    assert rows(tokenfiles.lookup(spark, folder, asked)) == [x for x in expected if x[0] in (docs[3][0], docs[90][0])]
    with pytest.raises(ValueError):
        tokenfiles.OpenShard(folder, known["shards"][0]["name"], "1" * 64, b"")


def test_short_documents_are_read_alone(spark, path, tmp_path):
    texts = [f"short text number {i} of the corpus and its ways" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = tokenfiles.save(df, path, 1, str(tmp_path / "t"))
    known = tokenfiles.manifest(folder)
    shard = tokenfiles.OpenShard(folder, known["shards"][0]["name"], known["dictionary"], tokenfiles.dictionary(folder, known["dictionary"]))
    read, whole = [], shard.file

    class Counted:
        def read_at(self, n, at):
            read.append(n)
            return whole.read_at(n, at)

    shard.file = Counted()
    k = len(shard.ids) // 2
    ids = shard.tokens(k, k + 1)[0]
    assert len(ids) == 4 * shard.counts[k] and sum(read) < 100
    assert int(known["dictionary"], 16) != 0 and sum(s["bytes"] for s in known["shards"]) < 2 * known["ids"] * 2


def test_odd_rows(spark, path, library):
    df = spark.createDataFrame([(5, "b"), (5, "a long one"), (None, "c"), (None, None), (5, "b")], "doc_id long, text string")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokenfiles.load(spark, tokenfiles.save(df, path, 1)).collect()))
    assert [g[1] for g in got] == [None, None, 5, 5, 5] and [g[2] for g in got] == [1, 2, 2, 2, 4] and [g[0] for g in got] == [0, 1, 3, 5, 7]
    none = tokenfiles.save(df.limit(0), path, 1)
    assert tokenfiles.load(spark, none).count() == 0 and tokenfiles.lookup(spark, none, df).count() == 0
    assert tokenfiles.manifest(none)["ids"] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op12(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op12_token_files"](spark, SF).collect())
    assert got == [(i, s, n, zlib.crc32(x)) for i, s, n, x in want(library, docs)]
