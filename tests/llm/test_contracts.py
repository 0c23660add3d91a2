"""Every opN_ query over the smallest tables, column by column against plain versions."""

import base64
import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

from bridgewell.llm import media, mixing, queries, quality, toxicity

from . import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op1_byte_bpe")
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        ids = own.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(plain.packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_op2(spark, docs):
    want = plain.kept_words(list(docs.items()))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op2_substring_dedup")} == want


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_quality_classifier")}
    assert set(got) == set(docs)
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in label if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == label[i] for i in held]) > 0.8


def test_op4(spark, docs):
    prints = {i: plain.simhash(t) for i, t in docs.items()}
    ids = sorted(docs)
    want = plain.groups(ids, lambda a, b: (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op4_simhash")} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_op5(spark, docs):
    got, size = rows(spark, "op5_source_mix"), {i: len(plain.words(t)) for i, t in docs.items()}
    assert all(r.tokens == size[r.doc_id] > 0 and 1 <= r.copies <= 4 for r in got) and len({r.doc_id for r in got}) == len(got)
    where = {r.doc_id: (r.domain, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", *[c.alias(k) for k, c in mixing.standard_path().items()]).collect()}
    have, used = collections.Counter(), collections.Counter()
    for i, n in size.items():
        have[tuple(x or "" for x in where[i])] += n
    for r in got:
        assert (r.domain, r.lang, r.source) == tuple(x or "" for x in where[r.doc_id])
        used[(r.domain, r.lang, r.source)] += r.tokens * r.copies
    given = mixing.budgets({k: n for k, n in have.items() if n}, mixing.FRACTION * sum(have.values()), mixing.WEIGHTS, 4)
    assert all(used[k] <= given[k] for k in used)


def test_op6(spark, docs):
    count = collections.Counter(w for i, t in docs.items() if crc(i) % 7 != 2 for w in [*plain.words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    for r in rows(spark, "op6_lm_score"):
        w = [*plain.words(docs[r.doc_id], lower=True), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_op7(spark):
    got = rows(spark, "op7_audio_alignment")
    asked = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.vec_id % 20 == 0}
    assert {r.query_id for r in got} == asked and all(r.error <= media.MAX_ERROR and r.hits >= media.MIN_HITS for r in got)
    assert all(any(r.query_id == q and r.rec_id <= q and r.offset == 12 for r in got) for q in asked)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op8_toxicity")}
    assert set(got) == set(docs)
    assert all(r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for i, r in got.items())


def test_op9_with_ties(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"create table t as select * from '{SF}/conversations.parquet'")
    c.execute(r"insert into t select 900001, 1, 'user', x from (values ('['), ('A'), ('<'), ('\'), (NULL), (']')) v(x)")
    c.execute("insert into t select 900001, NULL, 'assistant', x from (values ('<'), ('A'), ('<')) v(x)")
    c.execute("insert into t select NULL, 1, 'assistant', 'z'")
    c.execute(f"copy t to '{tmp_path}/conversations.parquet'")
    c.execute("create view conversations as select * from t")
    key = lambda r: tuple(r)
    want = sorted((key(r) for r in c.execute(queries.OP9_SQL).fetchall()), key=str)
    got = queries.QUERIES["op9_chat_format"](spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted((key(r) for r in got), key=str) == want


def test_op10(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in t], float), np.array([r.vec_id for r in t])
    by = collections.defaultdict(list)
    for r in rows(spark, "op10_inverted_multi_index"):
        by[r.query_id].append(r)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(by[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(float(x[q] @ x[ids == r.vec_id][0]), abs=1e-12) for r in mine)
        hit += len(best & {r.vec_id for r in mine})
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_quality_features_by_hand():
    a, b, c = quality.features([b"One two two.", b"one two two.", b""])
    assert len(a) and len(c) == 0 and set(a.tolist()) != set(b.tolist())  # case is a feature
    rows_, y = quality.features([b"good words here, plain text." if k % 2 else b"zz## %% zz## &&" for k in range(40)]), np.arange(40) % 2
    m = quality.fit(rows_, y)
    counts = [np.ones(1 << quality.BITS) for _ in (0, 1)]
    for k, r in enumerate(rows_):
        if k % 5 != 4:
            counts[y[k]][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(m.ratio, ratio)
    s = m.scores(rows_)
    assert s[1] > 0.5 > s[0] and s[1] == pytest.approx(1 / (1 + np.exp(-(m.slope * (m.weights[rows_[1]].sum() / np.sqrt((ratio[rows_[1]] ** 2).sum()) + m.weights[-1]) + m.offset))))
