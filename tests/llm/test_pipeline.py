import base64
import collections
import hashlib
import os
import random

import pytest
from bridgewell.llm import mixing

from . import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        kept.append(docs.count())
        if name != "encoding":
            assert docs.columns == columns
    assert kept[1] < kept[0] and kept[2] < kept[1] and kept[3] == kept[2] and kept[4] < kept[3] and kept[5] == kept[4]
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_near_duplicates_follow_fingerprints(spark, folder):
    """Texts with one fingerprint of which few distinct shingles are shared: op4's rule links them, the Jaccard similarity of sets does not."""
    often = "alpha beta gamma " * 60
    rows = [(i, often + " ".join(f"w{i}x{k}" for k in range(20)), "en", "src1", 0, "c", 1) for i in (3, 1, 2)] + [(9, "another text of its own", "en", "src1", 0, "c", 1)]
    docs = spark.createDataFrame(rows, KIND)
    from bridgewell.llm import simhash

    assert simhash.keep_first(docs).count() == 4
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, folder).collect()} == {1, 9}


KIND = "doc_id long, text string, lang string, source string, n_chars int, copies string, node int"


def odd_rows():
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, near = text(70), text(90).split()
    rows = [(i, text(rng.randint(1, 60)), "en", f"src{i % 3}", 0, "c", i) for i in range(40)]
    rows += [(50, f"{text(20)} {passage}", "en", "src1", 0, "c", 1), (51, f"{passage} {text(20)}", "en", "src1", 0, "c", 1)]
    rows += [(60, " ".join(near), "en", "src2", 0, "c", 1), (61, " ".join(near[:-2] + ["x", "y"]), "en", "src2", 0, "c", 1)]
    rows += [(70, None, None, None, None, None, None), (71, "", "en", "src1", 0, "c", 1), (72, " \t", "en", "src1", 0, "c", 1), (None, text(30), "en", "src1", 0, "c", 1), (None, None, "en", "src1", 0, "c", 1)]
    rows += [(80, text(30), "en", "src1", 0, "c", 1)] * 2 + [(81, text(30), "de", "src2", 0, "c", 1), (81, text(30), "de", "src2", 0, "c", 1)]
    return [*rows, (90, text(30_000), "en", "src1", 0, "c", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, KIND)
    out = stage(spark, docs, folder)
    got = out.collect()
    if name != "encoding":
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0 and set(collections.Counter(tuple(r) for r in got)) <= set(rows) or name == "repeated_passages"
    have = collections.Counter(r.doc_id for r in got)
    if name == "near_duplicates":
        gone = {61, 71, 72}  # a near copy, and the empty texts after the first
        assert set(have) == {r[0] for r in rows} - gone and have[None] == 2 and have[80] == 2 and have[81] == 2
    if name == "repeated_passages":
        shared = (50, 51, 60, 61)  # of each two the later one loses what both hold
        text = {r.doc_id: r.text for r in got if r.doc_id in shared}
        want = plain.kept_words([(r[0], r[1]) for r in rows if r[0] in shared])
        assert all(hashlib.sha256(text[i].encode()).hexdigest() == want[i][2] for i in shared) and want[51][1] == 70 and want[61][1] == 88 and len(got) == len(rows)
        assert sorted((str(r.doc_id), str(r.text)) for r in got if r.doc_id not in shared) == sorted((str(r[0]), str(r[1])) for r in rows if r[0] not in shared)
    if name == "mixing":
        chosen = mixing.mix(docs, mixing.standard_path(), mixing.WEIGHTS, mixing.FRACTION).collect()
        assert not {70, 71, 72} & set(have) and have == sum((collections.Counter({r.doc_id: r.copies}) for r in chosen), collections.Counter())
    if name == "encoding":
        tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(r[0]), plain.packed(own.encode_ordinary(r[1] or ""))) for r in rows)
