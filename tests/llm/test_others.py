import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from foliant.llm import ann, mixing, packing, toxicity
from tests.llm.cases import documents, frame


def test_mixing_meets_its_contract(spark):
    rows = mixing.mix(frame(spark)).collect()
    again = mixing.mix(frame(spark)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == len(documents())
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += len((r[1] or "").encode().split())
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        by[r.source].append(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # water filling, a round at a time
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    for s, some in by.items():
        assert abs(some[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in some) - target[s]) <= max(r.size for r in some)
    assert any(len({(r.copies) for r in some if r.size}) > 1 for some in by.values())
    repeated = mixing.mixed(frame(spark))
    assert repeated.columns == frame(spark, []).columns
    assert repeated.count() == sum(r.copies for r in rows)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_longer_documents_are_taken_at_higher_rates(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([5, 300])), None, "ab"[i % 2], None, None, None) for i in range(4000)]
    got = mixing.mix(frame(spark, rows), weights=(1, 1), share=0.6).collect()
    rate = {n: np.mean([x.copies for x in got if x.size == n]) for n in (5, 300)}
    assert abs(rate[300] / rate[5] - 9 / 3) < 0.5  # binary digits of 300 and 5
    for s in "ab":
        some = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in some) - some[0].target) <= 300
    same = [(7, "a b c", None, "s", None, None, None)] * 50
    assert {x.copies for x in mixing.mix(frame(spark, same), share=0.5).collect()} == {0, 1}


def test_plan_is_a_packing():
    for seed in range(4):
        r = random.Random(seed)
        counts = Counter(r.choice([r.randint(1, 1024), r.randint(1, 70), 1024]) for _ in range(r.choice([1, 50, 4000])))
        runs, n = packing.plan(dict(counts))
        fill, placed = defaultdict(list), Counter()
        for length, lo, hi, first, at, each in runs:
            placed[length] += hi - lo
            for j in range(hi - lo):
                fill[first + j // each].append((at + j % each * length, length))
        assert placed == counts and len(fill) == n
        for v in fill.values():
            end = 0
            for at, length in sorted(v):
                assert at == end
                end += length
            assert end <= 1024
        assert n <= 1.25 * -(-sum(k * c for k, c in counts.items()) // 1024) + 1
    assert packing.plan({}) == ([], 0)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 4)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = [*documents(), (900, "hi <|endoftext|> there", None, None, None, None, None), (901, "<|endoftext|>" * 1500, None, None, None, None, None), (902, "<|endoftext", None, None, None, None, None)]
    rows = packing.pack(frame(spark, docs), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = Counter()
    for r in docs:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        a, c = 0, len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        k = 0
        while a < len(ids):
            want[r[0], k, a, c - a, zlib.crc32(np.array(ids[a:c], "<u4").tobytes())] += 1
            a, c, k = c, c + 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for v in fill.values():
        end = 0
        for at, length in sorted(v):
            assert at == end
            end += length
        assert end <= 1024
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_encoders_agree():
    r = random.Random(1)
    texts = ["", "  a   b\n\n c   x  ", "<|endoftext|> hi", "日本語 😀😀 \"don't\" they'll 123456 ½", "a" * 5000, " " * 5000 + "x"]
    texts += ["".join(r.choice(" \n\tab1é漢😀's.,") for _ in range(200)) for _ in range(100)]
    from tokenizers import Tokenizer

    e, own = packing.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts:
        assert e.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids
    assert 50256 in e.encode("a<|endoftext|>b").tolist()


def test_marginals_equal_brute_force():
    r = np.random.default_rng(0)
    n = 3000
    w, starts = r.normal(size=n) * 3, r.random(n) < 0.01
    starts[0] = True
    trans, first = np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.7, 0.3])
    p, _, _ = toxicity.marginals(w, starts, trans, first)
    e = np.stack([np.ones(n), np.exp(w)], 1)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        a[t] = (first if starts[t] else a[t - 1] @ trans) * e[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        if not starts[t + 1]:
            b[t] = trans @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
    q = a * b
    assert np.abs(p - q[:, 1] / q.sum(1)).max() < 1e-9


def labelled(spark, n=1200):
    r = random.Random(2)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * r.randint(1, 4)):
            w.insert(r.randint(0, len(w)), r.choice(["grobnak", "zluffer", "vexing"]))
        docs.append((i, " ".join(w), None, None, None, None, None))
        labels.append((i, toxic))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    rows = docs + [(5000, None, None, None, None, None, None), (5001, "", None, None, None, None, None), (None, "grobnak zluffer", None, None, None, None, None), docs[3]]
    got = toxicity.score_toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 200
    assert np.mean([r.predicted == truth.get(r.doc_id, 0) for r in held]) > 0.97
    texts = {r[0]: r[1] for r in docs}
    for r in got:
        if r.doc_id in texts and r.toxic_spans:
            a, b = map(int, r.toxic_spans.split(",")[0].split(":"))
            assert any(x in texts[r.doc_id][a:b] for x in ("grobnak", "zluffer", "vexing")) or r.predicted == 0
    kept = toxicity.clean_documents(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.score_toxicity(frame(spark, rows), labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0.0
    assert toxicity.score_toxicity(frame(spark, []), labels).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000 + i, x[7].tolist(), 1) for i in range(60)]  # a very common vector
    rows += [(3000, None, 1), (3020, [0.0] * 16, 1), (3040, [float("nan")] * 16, 1), (3060, [None] * 16, 1), (3080, [1.0] * 5, 1), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = defaultdict(list)
    for q in ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=600, beam=64).collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    f = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i < 3000}
    ids = sorted(f)
    m = np.array([f[i] for i in ids])
    hit = total = 0
    for q in (i for i in ids if i % 20 == 0):
        s = (m * f[q]).sum(axis=1)
        want = [v for _, v in sorted((-sc, i) for sc, i in zip(s, ids, strict=True) if i != q)[:20]]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        assert all(abs(sc - float((f[v] * f[q]).sum())) < 1e-9 for _, v, sc in mine)
        assert [(-sc, v) for _, v, sc in mine] == sorted((-sc, v) for _, v, sc in mine)
        hit += len({v for _, v, _ in mine} & set(want))
        total += 20
    assert len(got) == len([i for i in ids if i % 20 == 0]) and hit / total >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few).count() == 20


def test_recall_in_full_shards_with_varied_norms_and_lengths(spark):
    r = np.random.default_rng(5)
    rows, truth = [], {}
    for dim, first in ((48, 0), (96, 100_000)):
        x = r.normal(size=(11_000, dim)) * r.uniform(0.5, 2, (11_000, 1)) ** 2
        rows += [(first + i, v) for i, v in enumerate(x.tolist())]
        for q in range(0, 11_000, 100):
            s = x @ x[q]
            s[q] = -np.inf
            truth[first + q] = {first + int(i) for i in np.argsort(-s)[:20]}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for q in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got[q.query_id].add(q.vec_id)
    assert len(got) == len(truth)
    assert sum(len(got[q] & t) for q, t in truth.items()) / (20 * len(truth)) >= 0.9


def test_graph_recall_in_one_shard_beyond_the_beam():
    r = np.random.default_rng(6)
    x = r.normal(size=(12_000, 64)) * r.uniform(1, 1.2, (12_000, 1))
    low = ann.directions(x)
    graph, entry = ann.build_graph(low)
    q = x[:200]
    found, _ = ann.beam_search(low, graph, entry, low[:200], 256)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    best = [set(f[np.argsort(-(x[f] @ v))[:20]].tolist()) for f, v in zip(found, q, strict=True)]
    assert np.mean([len(b & set(w.tolist())) / 20 for b, w in zip(best, want, strict=True)]) >= 0.9


def test_toxicity_sample_is_bounded_and_takes_an_id_once(spark):
    docs, labels = labelled(spark)
    toxic = next(r.doc_id for r in labels.where("toxic = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    many = docs + [docs[toxic]] * 3000 + [(6000, "word " * 400_000, None, None, None, None, None)]
    more = labels.unionByName(spark.createDataFrame([(6000, 0)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(frame(spark, many), more, sample_bytes=300_000).where("held_out").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([r.predicted == truth.get(r.doc_id, 0) for r in got]) > 0.95


def test_what_operators_wrote_can_be_released(spark):
    from foliant.llm import common

    common.cut(spark.range(3).toDF("i"), "x")
    path = common.folders[-1].removeprefix("file://")
    import os

    assert os.path.isdir(path)
    table = common.stay(spark.range(3).toDF("i"), "y")
    assert table.count() == 3
    common.release(spark)
    assert not os.path.isdir(path) and not common.tables
