import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgewell.llm import bpe, chat, components, interpolation, media, mixing, neighbours, quality, queries, simhash, substrings, toxicity
from bridgewell.llm import words as W

from . import plain

DOCS = "doc_id long, text string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Words


def test_words_and_hashes():
    texts = [b"", b" a  b\tA\x0bc ", "é ü".encode(), b"a", b"\x85x y"]
    b = W.Block(texts)
    assert [b.data[s:e] for s, e in zip(b.start, b.end, strict=True)] == [w for t in texts for w in plain.WORD.findall(t)]
    assert np.diff(b.first).tolist() == [len(plain.WORD.findall(t)) for t in texts]
    h = b.hashes()
    assert h[0] == h[6] != h[2] and W.Block(texts, lower=True).hashes()[0] == W.Block(texts, lower=True).hashes()[2]


def test_buckets_cover_all():
    h = np.sort(W.mix(np.arange(1000, dtype=np.uint64)))
    edge = W.buckets(h, 7)
    assert edge[0] == 0 and edge[-1] == 1000 and len(edge) == 8 and (np.diff(edge) > 80).all()


# 1 Byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=400):
    rng = random.Random(4)
    bits = ["a", " ", "  ", "\xa0", "\t", "b", "ab", "the", "\n", "é", "ing", "aa", "!", "1", "\U0001f600", "ß", "'s", "<|endoftext|>", "日本", "\x1c", "\x00"]
    return ["", None, "a" * 300, "abaabaab" * 40, "x" * 20_000, " " * 50, "a b ", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n))]


def test_bpe_equals_the_library(spark, encoding):
    texts = odd_texts()
    df = frame(spark, texts).withColumn("ids", F.lit("clash"))
    path = queries.vocabulary_path()
    for got in (bpe.round_trip(df, path), bpe.decode(bpe.encode(df, path), path)):
        rows = got.orderBy("doc_id").collect()
        for r, t in zip(rows, texts, strict=True):
            want = encoding.encode_ordinary(t or "")
            assert bytes(r.ids) == plain.packed(want) and r.n_tokens == len(want) and bytes(r.decoded) == (t or "").encode()
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_replay_order_of_equal_and_lower_ranks(tmp_path):
    # xy may be a token of lower rank than x: the pair that comes up goes first
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"bc", b"bca", b"aa", b"caa"]
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    voc = bpe.Vocabulary(path.read_bytes())
    rank = {t: i for i, t in enumerate(tokens)}
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for w, ids in zip(words, voc.replay([w.encode() for w in words]), strict=True):
        parts = [bytes([c]) for c in w.encode()]
        while True:
            best = min(((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert ids == plain.packed([rank[p] for p in parts])


# 2 Substring dedup


def passages(seed=2):
    rng = random.Random(seed)
    shared, other = prose(rng, 80), prose(rng, 51)
    texts = [prose(rng, rng.randint(0, 160)) for _ in range(60)]
    for k in range(5, 40, 3):
        texts[k] += " " + shared
    for k in range(20, 50, 5):
        texts[k] = other + "\n" + texts[k] + " " + other
    texts[3] = "the " * 200
    texts[9] = "the " * 120
    texts += [texts[7]] * 6 + ["", None, "one two", shared, " \t\n"]
    return texts


@pytest.mark.parametrize(("length", "period", "blocks"), [(50, 31, None), (50, 31, 3), (20, 12, 2), (10, 1, 1), (50, 50, 2)])
def test_substrings(spark, length, period, blocks):
    texts = passages()
    df = frame(spark, texts).withColumn("block", F.lit("clash"))
    got = {r.doc_id: r for r in substrings.dedup(df, length, period, blocks).collect()}
    want = plain.kept_words(list(enumerate(texts)), length)
    assert {i: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in got.items()} == want
    for r in got.values():
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed


def test_substrings_odd_rows(spark):
    t = prose(random.Random(5), 90)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None)], DOCS)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(df).collect()), key=str)
    assert got == sorted([(1, 90, 90), (1, 90, 90), (2, 90, 90), (None, 90, 0), (3, 0, 0)], key=str)
    no_null = sorted((r.doc_id, r.n_removed) for r in substrings.dedup(df.where("doc_id is not null")).collect())
    assert no_null == [(1, 0), (1, 0), (2, 90), (3, 0)]
    assert substrings.dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup(df, 5, 6)


def test_cover_is_complete():
    for period in (1, 2, 7, 12, 31, 50):
        c = np.flatnonzero(substrings.cover_of(period))
        assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_kept_changes_only_texts_with_repeats(spark):
    texts = passages()
    df = frame(spark, texts).select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("removed"))
    out = substrings.kept(df)
    assert out.columns == df.columns
    want = plain.kept_words(list(enumerate(texts)))
    for r in out.collect():
        if want[r.doc_id][1] == 0:
            assert r.text == texts[r.doc_id]
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)


# 3 Quality


def labelled(spark, n=300):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = prose(rng, 30).split()
        rows.append((i, " ".join(w) + "." if good else " ".join(f"{x}!!".upper() for x in w)))
        labels.append((i, int(good), int(i % 5 == 0)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels, quality.learns(5, 0))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.3) == (truth[i] == 1) for i in held) and all(0 <= s <= 1 for s in got.values())
    kept = quality.accepted(docs.withColumn("x", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "x"] and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_quality_odd_rows(spark):
    docs, labels, _ = labelled(spark, 60)
    model = quality.train(docs, labels.union(labels).union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema)), F.lit(True))
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 50_000)], DOCS).withColumn("score", F.lit(1))
    s = quality.score(odd, model).collect()
    assert len(s) == 4 and s[0].score == s[1].score == s[2].score
    assert quality.score(empty(spark), model).count() == 0
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    alone = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert quality.score(docs, alone).first().score > 0.9


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels, _ = labelled(spark, 60)
    docs = docs.union(spark.createDataFrame([(1000 + i, "Some longer text, number %d. " % i * 40) for i in range(5)], docs.schema))
    labels = labels.union(spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(5)], labels.schema))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y, **_: seen.append(sorted(r.nbytes for r in rows)))
    for most in (1, 20_000, quality.SAMPLE_BYTES):
        quality.train(docs, labels, F.lit(True), sample_bytes=most)
    one, some, every = seen
    assert len(one) == 1 and 1 < len(some) < len(every) == labels.select("doc_id").distinct().count()
    assert sum(some) < 20_000 + max(every)  # the row that passes the bound is the last one


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    rows, values = [np.arange(6)] * 40, list(x)
    w = quality._descend(rows, values, y, 6, 1.0, 400, 1)
    weight = np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()
    best = loss(w)
    assert all(best <= loss(w + 0.02 * rng.normal(size=7)) + 1e-6 for _ in range(200))


# 4 SimHash


def near_copies(seed=7):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    for k in range(0, 12):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [*texts, texts[0].upper(), texts[1], texts[1], None, "", "  ", "a", "A", "a b"]


@pytest.mark.parametrize("segments", [2, 4, 8])
def test_simhash(spark, segments):
    texts = near_copies()
    df = frame(spark, texts, 10).withColumn("fingerprint", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.near_duplicates(df, segments=segments).collect()}
    want = [plain.simhash(t) for t in texts]
    assert [got[i + 10].fingerprint % 2**64 for i in range(len(texts))] == want
    assert {i: r.component_id for i, r in got.items()} == plain.groups(list(range(10, 10 + len(texts))), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)


def test_simhash_links_across_tiles_and_chains(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:10]:
        x = int(b)
        for _ in range(12):  # a chain of steps of one or two bits
            for bit in rng.choice(64, rng.integers(1, 3), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fingerprint long")
    want = plain.groups(list(range(len(prints))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for tile in (3, 2048):
        found = {(r.node % 2**64): r.component for r in components.components(simhash.links(df, segments=4, tile=tile)).collect()}
        label = collections.defaultdict(set)
        for k, x in enumerate(prints):
            label[want[k]].add(found.get(x, ("alone", x)))
        assert all(len(v) == 1 for v in label.values()) and len({next(iter(v)) for v in label.values()}) == len(label)


def test_simhash_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a"), (3, None), (2, ""), (2, "")], DOCS)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()) == [(2, 0, 2), (2, 0, 2), (3, 0, 2)]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_similar_documents(spark):
    rng = random.Random(9)
    texts, sets = [], []
    for k in range(30):
        t = prose(rng, 300, 5000).split()
        texts.append(" ".join(t))
        for edits in (3, 60):  # similarity of about 0.9, and of about 0.2
            u = list(t)
            for p in rng.sample(range(300), edits):
                u[p] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(u))
    texts += [texts[0], None, ""]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, texts)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (plain.words(t, lower=True) for t in texts)]
    want = plain.groups(list(range(len(texts))), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert got == want
    df = frame(spark, texts).union(spark.createDataFrame([(None, "x")], DOCS)).withColumn("node", F.lit(1))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*want.values(), None}
    assert simhash.similar(empty(spark)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"BIG": 3, "TILE_SETS": 5}])
def test_similar_documents_near_the_bound(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "POSTINGS", 4)  # full shingles are cut
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(12)
    texts = []
    for n in [*range(5, 21), 40, 300]:
        for k in range(4):  # the same words and some more: 4 of 5, 5 of 6, ... shingles; and changed last words
            t = [f"v{n}_{k}_{i}" for i in range(n)]
            more = round((n - 4) / 4) + rng.choice([-1, 0, 0, 1])
            texts += [" ".join(t), " ".join(t + ["more"] * max(1, more)), " ".join(t[: -max(1, more // 2)] + ["last"])]
    base = [f"c{i}" for i in range(60)]  # a group of near copies that are joined by chains, and a passage that others share
    texts += [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 60, 2)]
    texts += [" ".join(base[:30] + [f"y{k}_{i}" for i in range(rng.randrange(4, 12))]) for k in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, texts)).collect()}
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} for w in (plain.words(t, lower=True) for t in texts)]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [alike(a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b]]
    assert sum(0.8 <= x < 0.84 for x in near) > 20 and sum(0.76 < x < 0.8 for x in near) > 20
    assert got == plain.groups(list(range(len(texts))), lambda a, b: alike(a, b) >= 0.8)


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_chains(spark, few):
    rng = np.random.default_rng(3)
    name = rng.permutation(4000).astype(int)
    edges = [(int(name[i]), int(name[i + 1])) for i in range(3999) if i % 40 != 39] * 2
    links = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {int(n): int(name[i // 40 * 40 : i // 40 * 40 + 40].min()) for i, n in enumerate(name)}
    made = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = components.components(links, few=few)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - made
    rows = got.collect()
    assert len(rows) == 4000 and {r.node: r.component for r in rows} == want
    assert few == 0 or jobs <= 16  # no round of joins for few links


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (None, 1)] + [(900, 1000 + i) for i in range(50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    have = {tuple(sorted(e)) for e in edges if None not in e}
    assert got == plain.groups(ids, lambda a, b: tuple(sorted((ids[a], ids[b]))) in have)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 Mixing


def test_share_and_budgets():
    assert mixing.share(90, [1, 1, 1], [10, 100, 100]) == pytest.approx([10, 40, 40])
    assert mixing.share(90, [2, 1], [100, 100]) == pytest.approx([60, 30])
    assert mixing.share(500, [1, 1], [10, 20]) == pytest.approx([10, 20])
    # the shortage of (a, x) goes to its sibling (a, y), not to b
    have = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.budgets(have, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    # all of a falls short: b takes the rest
    assert mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert mixing.budgets({}, 5, {}, 1) == {}


def plain_mix(rows, path, weights, fraction, epochs, per_bucket, order):
    """rows: (doc_id, leaf, tokens); order(doc_id, whole): the seeded number. per_bucket: None for the root of a leaf's rows."""
    total = collections.Counter()
    count = collections.Counter()
    for _, leaf, n in rows:
        total[leaf] += n
        count[leaf] += 1
    given = mixing.budgets(total, fraction * sum(total.values()), weights, epochs)
    out = {}
    for leaf in total:
        whole, rest = divmod(given[leaf], total[leaf])
        buckets = max(1, count[leaf] // (per_bucket or int(count[leaf] ** 0.5)))
        mine = sorted(((order(i, whole) % 2**64 >> 1) % buckets, order(i, whole), i, n) for i, at, n in rows if at == leaf)
        upto, open_ = 0, True
        for _, _, i, n in mine:
            upto += n
            open_ = open_ and upto <= rest
            if whole + open_:
                out[i] = whole + open_
    return out


@pytest.mark.parametrize(("fraction", "epochs", "per_bucket"), [(0.5, 4, 4096), (0.7, 1, 5), (1.6, 3, 10), (9.0, 2, 5), (0.7, 4, None)])
def test_mix(spark, fraction, epochs, per_bucket):
    rng = random.Random(10)
    docs = [(i, prose(rng, rng.randint(0, 40)), rng.choice(["en", "en", "de"]), f"src{min(3, rng.randrange(9))}") for i in range(300)]
    docs += [(900, None, "en", "src1"), (901, "a b", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    path = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 3.0, ("en", "src3"): 5.0}
    got = {r.doc_id: r.copies for r in mixing.mix(df, path, weights, fraction, epochs, 42, per_bucket).collect()}
    rows = [(i, (lang or "", s or ""), len(plain.words(t))) for i, t, lang, s in docs if plain.words(t)]
    wholes = {w: {r.i: r.h for r in df.select(F.col("doc_id").alias("i"), F.xxhash64(F.lit(42), F.lit(w).cast("long"), "doc_id", F.xxhash64("text")).alias("h")).collect()} for w in range(epochs + 1)}
    assert got == plain_mix(rows, path, weights, fraction, epochs, per_bucket, lambda i, w: wholes[w][i])
    assert max(got.values()) <= epochs


def test_budgets_of_many_leaves():
    have = {(f"d{i % 4}", "en", f"s{i}"): 1 + i % 7 for i in range(100_000)}
    began = time.time()
    given = mixing.budgets(have, 0.7 * sum(have.values()), mixing.WEIGHTS, 4)
    assert time.time() - began < 5 and set(given) == set(have)


@pytest.mark.parametrize("most_sent", [10**5, 3])
def test_budgets_by_level(spark, most_sent):
    rng = random.Random(15)
    have = {(f"d{rng.randrange(3)}", rng.choice(["en", "en", "de", ""]), f"s{i % 90}"): rng.choice([1, 7, 7, 50, rng.randrange(1, 3000)]) for i in range(250)}
    leaves = mixing.saved(spark.createDataFrame([(*k, v, 1) for k, v in have.items()], "a string, b string, c string, _sum long, _n long"))
    weights = {("d0",): 3.0, ("d1",): 0.25, ("d0", "de"): 0.0, ("d2", "en"): 5.0, ("d1", "en", "s1"): 40.0, ("d0", "en", "s3"): 0.0}
    for fraction, epochs, w in ((0.3, 1, weights), (1.0, 3, weights), (9.0, 2, {})) if most_sent > 3 else ((0.9, 1, {}), (2.5, 3, weights)):
        got = {(r.a, r.b, r.c): r._given for r in mixing.budgets_by_level(leaves, ["a", "b", "c"], fraction, w, epochs, most_sent).collect()}
        want = mixing.budgets(have, fraction * sum(have.values()), w, epochs)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in want)  # a token where a sum rounds
        assert sum(got[k] != want[k] for k in want) <= 2


def test_mix_over_more_leaves_than_are_sent(spark):
    rng = random.Random(16)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 30)), "en" if i % 3 else "de", f"host{i % 3 and i % 40}") for i in range(400)], "doc_id long, text string, lang string, source string")
    path = {"lang": F.col("lang"), "source": F.col("source")}
    rows = [sorted(map(tuple, mixing.mix(docs, path, {("en",): 3.0}, 0.6, 2, most_sent=m).collect())) for m in (10**5, 2)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    rows = [sorted(map(tuple, mixing.mixed(docs, fraction=0.6, most_sent=m).collect())) for m in (10**5, 2)]
    assert rows[0] == rows[1] and rows[0]
    with pytest.raises(ValueError):
        mixing.mix(docs, {"tokens": F.col("lang")}, {}, 0.5)


def test_mix_of_200_000_leaves(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("host"), "id").alias("source"))
    got = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, {}, 0.5, 1)
    n, used, least = got.agg(F.count("*"), F.sum("tokens"), F.max("tokens")).first()
    # the line lies between two and three words a host: shorter documents fit, longer ones do not
    assert least == 2 and n == sum(i % 7 + 1 <= 2 for i in range(200_000)) and used <= 0.5 * sum(i % 7 + 1 for i in range(200_000))


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, f"word {i} text", "en", f"src{i % 3}", 10) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs, fraction=2.0).count() > 60
    assert mixing.mixed(docs.limit(0)).count() == 0
    # null and repeated ids, null texts, columns whose names clash: as many rows as mix() has copies
    odd = spark.createDataFrame([(None, f"w {i}", "en", "src1", i) for i in range(20)] + [(5, f"v {i % 4}", "en", "src2", i) for i in range(20)] + [(9, None, "en", "src1", 1), (10, " ", None, None, 2)],
        "doc_id long, text string, lang string, source string, copies int").withColumn("_order", F.lit(1)).withColumn("tokens", F.lit("x"))
    for fraction in (0.5, 1.0, 1.7):
        want = mixing.mix(odd, mixing.standard_path(), mixing.WEIGHTS, fraction)
        got = mixing.mixed(odd, fraction=fraction)
        assert got.columns == odd.columns and got.count() == want.agg(F.sum("copies")).first()[0]
        assert got.where("doc_id is null").count() == want.where("doc_id is null").agg(F.sum("copies")).first()[0] > 0
    every = mixing.mixed(odd, fraction=9.0)  # more than all epochs of all leaves
    assert every.count() == 4 * 40 and every.select("text", "copies").distinct().count() == 40
    dom = spark.createDataFrame([("src13",), ("x",), (None,)], "s string").select(mixing.domain_of(F.col("s"))).collect()
    assert [r[0] for r in dom] == ["domain1", "other", "other"]


# 6 LM scoring


def test_lm_counts(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 60), 80).upper() if i % 3 else prose(rng, 30, 80) for i in range(120)] + [None, "", "never seen words"]
    df = frame(spark, texts).withColumn("train", F.lit("clash"))
    learn = quality.learns(7, 2)
    got = {r.doc_id: r for r in interpolation.score(df, learn, dev_modulus=4).collect()}
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for i in known for w in [*plain.words(texts[i], lower=True), None])
    n, v = sum(count.values()), len(count)
    model = base = tokens = 0
    for i, t in enumerate(texts):
        w = [*plain.words(t, lower=True), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r.score) and r.score < 0
        model, base, tokens = model + r.score, base + r.base_score, tokens + len(w)
    assert model > base


def test_lm_scores_by_hand(spark, monkeypatch):
    texts = ["a b a b", "a b c", "b a"]
    w = np.tile(np.array([0.5, 0.3, 0.2]), (interpolation.CONTEXTS, 1))
    monkeypatch.setattr(interpolation, "mixture", lambda h, t: w)
    got = {r.doc_id: r.score for r in interpolation.score(frame(spark, texts), F.col("doc_id") < 2, blocks=2).collect()}
    seqs = [["<", *t.split(), ">"] for t in texts]
    uni = collections.Counter(x for s in seqs[:2] for x in s[1:])
    bi = collections.Counter(p for s in seqs[:2] for p in zip(s, s[1:], strict=False))
    ctx = collections.Counter(x for s in seqs[:2] for x in s[:-1])
    n, v = sum(uni.values()), len(uni)
    for i, s in enumerate(seqs):
        want = sum(math.log10(0.5 * (bi[a, b] / ctx[a] if ctx[a] else 0) + 0.3 * uni[b] / n + 0.2 / (v + 1)) for a, b in zip(s, s[1:], strict=False))
        assert got[i] == pytest.approx(want)


def test_lm_odd_tables(spark):
    assert interpolation.score(empty(spark), F.lit(True)).count() == 0
    r = interpolation.score(frame(spark, ["a b", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [x.train_tokens for x in r] == [0, 0] and r[0].score == pytest.approx(3 * math.log10(1 / 6)) and r[0].n_known == 0
    twice = interpolation.score(spark.createDataFrame([(1, "a"), (1, "a")], DOCS), F.lit(True)).collect()
    assert [x.train_tokens for x in twice] == [4, 4]


def test_mixture_weights_prefer_what_predicts():
    two, one = 1 + int(0.05 * interpolation.PER_DECADE), 1 + 3 * interpolation.PER_DECADE
    w = interpolation.mixture(np.array([[5, two, one, 1000], [6, 0, one, 1000]]), 10**6)
    assert w[5, 0] > 0.9 and w[6, 1] > 0.9 and w[0, 0] == 0 and w.sum(axis=1) == pytest.approx(1)


# 7 Media


def test_chroma_and_integers():
    t = np.arange(media.RATE) / media.RATE
    c = media.chroma(np.sin(2 * np.pi * 440 * t))
    assert (c.argmax(axis=1) == 0).all()
    assert len(media.chroma(np.zeros(10))) == 0 and not media.integers(media.chroma(np.zeros(20_000))).any()


def test_alignment(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=64).clip(-0.3, 0.3).tolist()) for i in range(30)] + [(31, None), (32, [float("nan")] * 64)]
    rows += [(40, rows[0][1]), (41, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("prints", F.lit("clash"))
    got = media.find_excerpts(df, F.col("vec_id") % 20 == 0).collect()
    found = {(r.query_id, r.rec_id): r for r in got}
    assert {q for q, _ in found} == {0, 20, 40}
    for q, own in ((0, 0), (20, 20), (40, 0)):
        r = found[q, own]
        assert r.offset == 12 and r.error < 0.05 and r.copies == (3 if own == 0 else 1)
    prints = {r.rec_id: r.prints for r in media.fingerprints(df.select(F.col("vec_id").alias("rec_id"), "embedding"), media.as_recordings).collect()}
    asks = {r.rec_id: r.prints for r in media.fingerprints(df.select(F.col("vec_id").alias("rec_id"), "embedding"), media.as_excerpts).collect()}
    for q in (0, 20):  # every recording against every query
        for i in range(30):
            votes = collections.Counter(j - k for k, x in enumerate(asks[q]) for j, y in enumerate(prints[i]) if x == y and x)
            best = max(((n, -o) for o, n in votes.items()), default=(0, 0))
            if best[0] >= media.MIN_HITS:
                o = -best[1]
                a, b = asks[q][max(0, -o) :], prints[i][max(0, o) :]
                m = min(len(a), len(b))
                error = sum((x ^ y & 0xFFFFFFFF if x >= 0 and y >= 0 else (x ^ y) & 0xFFFFFFFF).bit_count() for x, y in zip(a[:m], b[:m], strict=True)) / (32 * m)
                assert ((q, i) in found) == (error <= media.MAX_ERROR and (error <= media.SURE_ERROR or best[0] >= media.MIN_SHARE * m))
                if (q, i) in found:
                    assert (found[q, i].hits, found[q, i].offset) == (best[0], o) and found[q, i].error == pytest.approx(error)
            else:
                assert (q, i) not in found
    assert media.find_excerpts(df.limit(0), F.lit(True)).count() == 0


def test_alignment_under_noise(spark):
    rng = np.random.default_rng(21)
    df = spark.createDataFrame([(i, (0.12 * rng.normal(size=64)).tolist()) for i in range(150)], "rec_id long, embedding array<float>").repartition(4)
    known = components.saved(media.fingerprints(df, media.as_recordings))
    for loud in (0.05, 0.1, 0.2):

        def noisy(batch, loud=loud):
            for i, x in zip(batch["rec_id"].to_pylist(), media.as_excerpts(batch), strict=True):
                yield x + loud * np.random.default_rng(i).normal(size=len(x))

        got = media.align(media.fingerprints(df, noisy), known).collect()
        assert len({r.query_id for r in got if r.rec_id == r.query_id and r.offset == 12}) >= 0.9 * 150
        assert all(r.rec_id == r.query_id for r in got)


def _crowded(spark, n: int):
    """Recordings over few integers, so that nearly all meet by chance; some excerpts of them as queries."""
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(-8, 9, size=int(rng.integers(1, 60))).tolist()) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, [7] * 200), (n + 2, [0] * 30)]
    asks = [(1000 + i, v[3:]) for i, v in rows[::4] if len(v) > 8] + [(2000, [7] * 150), (2001, rows[1][1]), (2002, [0] * 9)]
    schema = "rec_id long, prints array<int>"
    return rows, asks, spark.createDataFrame(asks, schema).repartition(2), spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize(("bundle", "most"), [(1 << 21, 1 << 20), (60, 1 << 20), (1 << 21, 50), (100, 7)])
def test_alignment_counts_in_parts(spark, bundle, most):
    rows, asks, asked, known = _crowded(spark, 24)
    got = {(r.query_id, r.rec_id): (r.hits, r.offset, r.copies, r.error) for r in media.align(asked, known, 2, 0.9, 0.2, 0.1, bundle, most).collect()}
    first, copies = {}, collections.Counter(tuple(v) for _, v in rows)
    for i, v in rows:
        first.setdefault(tuple(v), i)
    want = {}
    for q, x in asks:
        for y, i in first.items():
            votes = collections.Counter(j - k for k, a in enumerate(x) for j, b in enumerate(y) if a == b and a)
            hits, back = max(((n, -o) for o, n in votes.items()), default=(0, 0))
            if hits >= 2:
                a, b = x[max(0, back) :], y[max(0, -back) :]
                m = min(len(a), len(b))
                error = sum(((u ^ w) & 0xFFFFFFFF).bit_count() for u, w in zip(a[:m], b[:m], strict=True)) / (32 * m)
                if error <= 0.9 and (error <= 0.1 or hits >= 0.2 * m):
                    want[q, i] = (hits, -back, copies[y], error)
    assert got == want and len(want) > 50


def test_alignment_with_null_integers(spark):
    schema = "rec_id long, prints array<int>"
    known = spark.createDataFrame([(1, [5, 6, 7, 8, 9, None]), (2, [5, 6, 7, 8, 9, 1])], schema)
    got = media.align(spark.createDataFrame([(0, [5, 6, 7, 8, 9]), (3, [5, 6, 7, 8, 9, 1]), (4, None)], schema), known).collect()
    assert {(r.query_id, r.rec_id) for r in got} == {(0, 1), (0, 2), (3, 2)}


def _rows_made(df) -> tuple[int, int]:
    """The rows of df, and the most rows that an operator of its plan makes."""
    n = len(df.collect())
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            made = p.metrics().get("numOutputRows")
            most = max(most, made.get().value() if made.isDefined() else 0)
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return n, most


def test_chance_meetings_make_no_rows(spark):
    _, asks, asked, known = _crowded(spark, 200)
    n, made = _rows_made(media.align(asked, known))
    assert made <= n + 200 + 3 + len(asks)


def test_melody_plays_every_component(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=64).clip(-0.3, 0.3).tolist()
    y = x[:32] + rng.normal(size=32).clip(-0.3, 0.3).tolist()
    assert len(media.melody(x)) == 64 * media.NOTE and len(media.melody([])) == 0
    found = media.find_excerpts(spark.createDataFrame([(0, x), (1, y)], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r.rec_id, r.copies) for r in found if r.error < 0.05] == [(0, 1)]


def test_pcm(spark):
    x = (np.sin(np.arange(30_000) * 0.5) * 20_000).astype("<i2").tobytes()
    df = spark.createDataFrame([(1, bytearray(x)), (2, None), (3, bytearray(b"a"))], "rec_id long, pcm binary")
    got = {r.rec_id: r.prints for r in media.fingerprints(df, media.from_pcm()).collect()}
    assert len(got[1]) > 0 and got[2] == got[3] == []


# 8 Toxicity


def test_toxicity(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, 25).split()
        if bad := i % 9 == 0:
            w[rng.randrange(25)] = rng.choice(["Scum!", "scums", "vileness,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(0)), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.train(docs, known, quality.learns(3, 1))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i].score >= 0.7) == (i % 9 == 0) for i in held)
    assert any(got[i].evidence for i in held) and all(e.doc_id not in held for r in got.values() for e in r.evidence)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "!!!"), (2, "scum " * 30_000)], DOCS)
    s = toxicity.score(odd, index).collect()
    assert s[0].score == s[1].score == s[2].score == pytest.approx(index.base) and s[3].score > 0.7
    assert toxicity.score(empty(spark), index).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, known.limit(0), F.lit(True))).collect()} == {0.0}


def test_nearest_is_exact_and_skips_postings():
    rng = np.random.default_rng(14)
    known = np.sort(W.mix(np.arange(1, 201, dtype=np.uint64)))
    rows = []
    for i in range(1500):  # two kinds of text with common terms of their own, and rare terms
        t = np.unique(np.concatenate([rng.choice(20, 8) + 20 * (i % 2), rng.choice(160, 3) + 40]))
        rows.append((i, int(rng.integers(2)), known[t], rng.integers(1, 9, len(t))))
    ix = toxicity.build(rows, known, rng.integers(1, 500, 200).astype(float), 1000, (1.0, 1.0))
    assert (ix.common >= 0).any() and (ix.common < 0).any()
    by = {r[0]: r for r in rows}
    full = np.zeros((1500, 200))
    for k, i in enumerate(ix.ids):
        t = np.searchsorted(known, by[i][2])
        full[k, t] = ix.weights(np.zeros(len(t), int), t, by[i][3])
    read = every = 0
    for k in range(0, 1500, 7):
        t = np.flatnonzero(full[k])
        ((e, s),), n = ix.nearest(np.zeros(len(t), int), t, by[ix.ids[k]][3], 1)
        want = np.round(full @ full[k], 12)
        order = np.lexsort((np.arange(1500), -want))[: ix.neighbours]
        assert np.allclose(s, want[order], atol=1e-11) and set(e[s > s[-1] + 1e-9]) == set(order[want[order] > s[-1] + 1e-9])
        read, every = read + n, every + np.where(ix.common[t] < 0, ix.first[t + 1] - ix.first[t], len(ix.blocks) * toxicity.RANGE).sum()
    assert read < 0.8 * every


def plain_toxicity(docs, labels, learn, asked, k=15):
    """Votes of the k nearest examples for the texts asked, with dictionaries alone."""
    def terms(text):
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", (text or "").encode())]
        return collections.Counter([("w", w) for w in words] + [(n, w[:n]) for w in words for n in (5, 6, 7) if len(w) > n])

    bags = {i: terms(t) for i, t in docs}
    examples = {i: bags[i] for i, y in labels if learn(i)}
    label = dict(labels)
    df = collections.Counter(t for b in bags.values() for t in b)
    toxic, other = (collections.Counter(t for i, b in examples.items() if label[i] == y for t in b) for y in (1, 0))
    known = set().union(*examples.values())
    value = {t: (math.log((len(docs) + 1) / (df[t] + 1)) + 1) * math.log2(2 + toxic[t] / max(1, other[t])) for t in known}

    def vector(bag):
        v = {t: (1 + math.log(n)) * value[t] for t, n in bag.items() if t in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    made = {i: vector(b) for i, b in examples.items()}
    out = {}
    for i in asked:
        q = vector(bags[i])
        near = sorted(((round(sum(x * e.get(t, 0.0) for t, x in q.items()), 12), j) for j, e in made.items()), reverse=True)
        out[i] = [(c, j) for c, j in near if c > 0][:k]
    return out, label


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(21)
    docs = [(i, prose(rng, rng.randint(1, 40), 120) + (" idiotically" if i % 7 == 0 else "") + (" Lumpen!" if i % 3 else "")) for i in range(240)]
    labels = [(i, int(i % 7 == 0)) for i in range(200)]
    learn = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    frame_, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.train(frame_, known, quality.learns(3, 1))
    got = {r.doc_id: r for r in toxicity.score(frame_, index).collect()}
    want, label = plain_toxicity(docs, labels, learn, [i for i, _ in docs])
    rates = dict(zip(index.labels, index.votes, strict=True))
    for i, near in want.items():
        found = [(e.cosine, e.doc_id) for e in got[i].evidence]
        assert [c for c, _ in found] == pytest.approx([c for c, _ in near], abs=1e-9)
        if len({round(c, 9) for c, _ in near}) == len(near):
            w = [c * rates[label[j]] for c, j in near[:-1]]
            assert [j for _, j in found][:-1] == [j for _, j in near[:-1]] and len(w) == len(near) - 1
        vote = sum(e.cosine * rates[e.label] * e.label for e in got[i].evidence) / sum(e.cosine * rates[e.label] for e in got[i].evidence)
        z = math.log((vote + 0.01) / (1.01 - vote))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(index.curve[0] * z + index.curve[1]))), abs=1e-9)


def test_toxicity_sample_is_bounded_by_text(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(60)], DOCS)
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, known, F.lit(True), sample_bytes=5000).ids) < 10
    assert len(toxicity.train(docs, known, F.lit(True), positive_rows=4, negative_rows=7).ids) == 11


# 9 Chat


CONTROL = "</s>[INST] ok [/INST]"
TURNS = [(1, 0, "system", "be \\l brief <s>"), (1, 1, "user", CONTROL), (1, 2, "assistant", "\\s\\b[x]</s>\n<s>[user]\nhi"), (1, 3, "user", None), (1, 4, "assistant", "")]
TURNS += [(2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "assistant", "é😀"), (3, 1, "assistant", "a"), (3, None, "odd]\n[role", "x"), (4, 0, None, "n")]
TURNS += [(5, 1, "user", "["), (5, 1, "user", "A"), (5, 1, "user", "<"), (5, 1, "user", "\\"), (5, 2, "assistant", "["), (5, 2, "assistant", "A"), (5, 2, "assistant", "A")]  # ties go by the text itself
TURNS += [(None, 2, "assistant", "p"), (None, 1, "user", "q")]


def test_chat(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    shown = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(shown).collect()}
    examples = collections.defaultdict(list)
    for r in chat.expand_examples(shown).select("*", chat.target().alias("target")).orderBy("target_end").collect():
        examples[r.conv_id].append(r)
    assert set(got) == {1, 2, 3, 4, 5, None}
    for c in got:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in TURNS if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine] and got[c].n_turns == len(mine)
        assert [e.target for e in examples[c]] == [x for _, r, x in mine if r == "assistant"]
        assert all(got[c].formatted.startswith(e.example) and e.example[e.target_start : e.target_end] in got[c].formatted for e in examples[c])
        assert got[c].formatted.count("<s>[") == len(mine)
    outer = chat.expand_examples(shown, ["n_turns"], outer=True).where("conv_id = 2").collect()
    assert len(outer) == 1 and outer[0].example is None and outer[0].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<x> "), "id").alias("text"))
    rows = chat.expand_examples(chat.format_conversations(df)).select("target_turn", chat.target().alias("t"), F.length("example").alias("n"), "target_end").collect()
    assert len(rows) == 1500 and all(r.t == f"<x> {r.target_turn}" and r.n == r.target_end for r in rows)


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.expand_examples(chat.read_back(chat.format_conversations(df)), ["turns"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


# 10 Nearest neighbours


def brute(x, ids, q, k):
    s = x.astype(float) @ x[q].astype(float)
    s[np.asarray(ids) == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [ids[i] for i in order if np.isfinite(s[i])]


def test_search_finds_all_of_a_small_table(spark):
    rng = np.random.default_rng(15)
    x = np.round(rng.normal(size=(200, 8)), 2).astype(np.float32)
    x[100:160] = x[3]
    ids = list(range(200))
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [1.0] * 7), (None, [1.0] * 8), (1100, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, candidates=10_000, cell=20).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 200, 20))
    for q, rows in by.items():
        assert [r.vec_id for r in rows] == brute(x, ids, q, 20) and [r.rank for r in rows] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[q].astype(float) @ x[r.vec_id].astype(float)), abs=1e-12) for r in rows)
    cut = neighbours.search(df, F.col("vec_id") % 20 == 0, candidates=10_000, cell=100, part=16).collect()
    assert sorted(cut) == sorted(got)  # cells in several buckets, queries in several groups
    few = neighbours.search(df.where("vec_id < 5"), F.lit(True)).collect()
    assert len(few) == 20
    assert len(neighbours.search(df.where("vec_id < 5").union(df.where("vec_id < 5")), F.lit(True)).collect()) == 20  # repeated rows
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(got[q]) == 20 for q in range(0, 4000, 20))
    hit = np.mean([len(got[q] & set(brute(x, list(range(4000)), q, 20))) / 20 for q in range(0, 4000, 20)])
    assert hit >= 0.9


def test_bounds_lose_nothing_and_skip_cells(spark):
    rng = np.random.default_rng(17)
    middle = rng.normal(size=(40, 16)) * 4
    x = (middle[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16)))
    books = tuple(neighbours.centroids(h, 80) for h in neighbours.halves(x))
    index = neighbours.Index(books, x[:500])
    i, j = (neighbours.nearest(h, b) for h, b in zip(neighbours.halves(x), books, strict=True))
    count, radius = np.bincount(i * 80 + j, minlength=6400), (np.zeros(80), np.zeros(80))
    for r, h, b, c in zip(radius, neighbours.halves(x), books, (i, j), strict=True):
        np.maximum.at(r, c, np.linalg.norm(h - b[c], axis=1))
    index.fill(count, radius, 300)
    q = x[:50]
    row, cell, least = index.visits(q, 4000, 20)
    seen = np.zeros((50, 6400), bool)
    seen[row, cell] = True
    s = q @ x.T
    s[np.arange(50), np.arange(50)] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    assert (np.take_along_axis(s, top, 1) >= least[:, None]).all() and seen[np.arange(50)[:, None], (i * 80 + j)[top]].all()
    assert (seen * count).sum() < 0.5 * 50 * 4000
    size = collections.Counter()
    for c in range(6400):
        for p in range(index.parts[c]):
            size[index.first[c] + p] += count[c] / index.parts[c]
    assert max(size.values()) <= 300


def test_traverse_visits_cells_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0])
    cells = neighbours.traverse(a, b, np.ones(6, int), 6)
    s = [a[c // 2] + b[c % 2] for c in cells]
    assert sorted(cells) == list(range(6)) and s == sorted(s, reverse=True)
    assert neighbours.traverse(a, b, np.array([0, 5, 1, 1, 1, 1]), 5) == [1]


# Words that a polynomial modulo 2**64 cannot tell apart


@pytest.mark.parametrize("size", [1024, 2048])
def test_regular_words_are_told_apart(spark, size):
    word = "".join("ab"[k.bit_count() & 1] for k in range(size))
    other = "".join("ba"[k.bit_count() & 1] for k in range(size))
    df = frame(spark, [" ".join([word] * 60), " ".join([other] * 60)])
    assert [(r.doc_id, r.n_removed) for r in substrings.dedup(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0)]
    assert simhash.keep_first(df).count() == 2
    got = {r.doc_id: r.n_known for r in interpolation.score(df, F.col("doc_id") == 0).collect()}
    assert got == {0: 61, 1: 1}  # the end alone is known
