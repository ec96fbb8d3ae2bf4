import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from foliant.llm import exact, lines, simhash, substrings
from tests.llm.cases import documents, frame


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        code = exact.golomb_encode(v)
        assert (exact.golomb_decode(code) == v).all()
    assert len(exact.golomb_encode(np.arange(0, 1 << 20, 1 << 8, dtype=np.uint64))) < 4096 * 2


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (d, t, *_) in enumerate(rows):
        norm = (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        groups[norm].append((-len(t or ""), d if d is not None else 1 << 63, i, d))
    out = Counter()
    for norm, g in groups.items():
        g.sort()
        for k, (_, _, _, d) in enumerate(g):
            out[d, g[0][3], len(g), k == 0, hashlib.sha256(norm).hexdigest()] += 1
    return out


def test_exact_duplicates(spark):
    got = Counter(tuple(r) for r in exact.exact_duplicates(frame(spark)).collect())
    assert got == brute_exact(documents())
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_covering_masks_lose_no_pair():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    r = random.Random(3)
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(int(m) & d == 0 for m in masks)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rows = documents()
    fps = [slow_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps)
    least = {}
    for c, r in zip(comp, rows, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()) == want
    kept = simhash.one_of_each(frame(spark)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets_are_exact(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = brute_components(fps)
    for block in (3, 16384):
        links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).collect()
        at = {x: i for i, x in enumerate(signed)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for e in links:
            assert bin(fps[at[e.a]] ^ fps[at[e.b]]).count("1") <= 64
            a, b = find(at[e.a]), find(at[e.b])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] if rows[i][0] is not None else 1 << 62, i))
    seen, out = [], {}
    for i in order:
        t = rows[i][1]
        keep = []
        for line in (t or "").split("\n"):
            s = line.strip(" \t\n\x0b\x0c\r")
            if len(s) < 10:
                keep.append(line)
                continue
            if not any(within_one(s, x) for x in seen):
                keep.append(line)
            seen.append(s)
        out[i] = None if t is None else "\n".join(keep)
    return Counter((rows[i][0], out[i]) for i in out)


def test_line_dedup(spark):
    rows = documents()
    r = random.Random(9)
    lines_ = ["the quick brown fox jumps", "the quick brown fox jump", "the quick brown fix jumps", "he quick brown fox jumps", "aaaaaaaaaaaa", "aaaaaaaaaaa", "aaaaaabaaaaaa", "  the quick brown fox jumps\t", "短い行です、これは日本語の行", "短い行です、これは日本語の列"]
    for i in range(40):
        rows.append((1000 + i, "\n".join(r.sample(lines_, r.randint(1, 6))), "en", "s", 1, None, None))
    got = lines.dedup_lines(frame(spark, rows))
    assert got.columns[: len(frame(spark, []).columns)] == frame(spark, []).columns
    assert Counter((x.doc_id, x.text) for x in got.collect()) == brute_lines(rows)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def brute_repeats(texts, n, keep_first):
    occ = defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - n + 1):
            occ[t[k : k + n]].append((i, k))
    marks = [np.zeros(len(t), bool) for t in texts]
    for v in occ.values():
        if len(v) > 1:
            for i, k in v[keep_first:]:
                marks[i][k : k + n] = True
    out = []
    for t, m in zip(texts, marks, strict=True):
        d = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        out.append((len(t), int(m.sum()), int((d == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return out


def repeated_texts():
    r = random.Random(5)
    para = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [para(n) for n in (390, 420, 500, 800, 1500)]
    out = []
    for _ in range(50):
        t = para(r.choice([0, 50, 300, 700]))
        for _ in range(r.randint(0, 3)):
            t += r.choice(shared)[r.randint(0, 60) :] + para(r.choice([0, 1, 100, 400]))
        out.append(t)
    return out + [out[5], out[5], out[7], "", None, "a" * 3000, "x" + "a" * 450, "ab" * 900 + "q", "zz" + "ab" * 203, "line one two. " * 90, "a" * 399, "a" * 400]


def test_repeated_substrings(spark):
    texts = repeated_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for keep_first, block in ((False, 4096), (True, 4096), (False, 8), (True, 8), (False, 2), (True, 2)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, 400, keep_first, block).collect()}
        want = brute_repeats([(t or "").encode() for t in texts], 400, keep_first)
        assert got == dict(enumerate(want)), (keep_first, block)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_repeats_with_awkward_rows(spark):
    rows = documents()
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 400, False), strict=True))
    assert Counter(tuple(r) for r in substrings.remove_repeats(frame(spark)).collect()) == want


def test_longest_previous_factors_equal_a_stackless_brute_force():
    r = random.Random(1)
    for _ in range(100):
        n = r.randint(1, 40)
        text = bytes(r.choice(b"ab") for _ in range(n))
        order = sorted(range(n), key=lambda i: text[i:])

        def common(a, b):
            k = 0
            while max(a, b) + k < n and text[a + k] == text[b + k]:
                k += 1
            return k

        lcp = np.array([0] + [common(order[i - 1], order[i]) for i in range(1, n)], np.int64)
        factor, source = substrings.longest_previous(np.array(order), lcp, n.bit_length())
        for i, p in enumerate(order):
            assert factor[i] == max((common(p, q) for q in range(p)), default=0)
            assert not factor[i] or (order[source[i]] < p and common(p, order[source[i]]) == factor[i])


def test_anchors_of_long_texts_come_in_segments(monkeypatch):
    data = np.random.default_rng(3).integers(97, 104, 60000).astype(np.uint8).tobytes()
    whole = substrings.anchors(data, 400)
    monkeypatch.setattr(substrings, "SEGMENT", 4096)
    assert all((a == b).all() for a, b in zip(whole, substrings.anchors(data, 400), strict=True))


def test_a_passage_that_a_third_of_all_documents_share(spark):
    r = random.Random(8)
    para = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    hot = para(900)
    texts = [para(r.randint(100, 500)) + (hot if i % 3 == 0 else "") + para(300) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for keep_first in (False, True):
        got = {x.doc_id: tuple(x)[1:] for x in substrings.remove_repeats(df, 400, keep_first, 10).collect()}
        assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 400, keep_first)))


def test_lines_with_one_very_common_key(spark):
    half = "a very common first half of a line, and then "
    rows = [(i, f"{half}{i:04d}{'x' * 40}\nalone {i} " + "abcdefghij"[i % 10] * 30, None, "s", None, None, None) for i in range(400)]
    assert Counter((x.doc_id, x.text) for x in lines.dedup_lines(frame(spark, rows)).collect()) == brute_lines(rows)


def test_lines_whose_keys_count_as_hot(spark, monkeypatch):
    import functools

    monkeypatch.setattr(lines, "SAMPLED", 1)
    monkeypatch.setattr(lines, "hot_keys", functools.partial(lines.hot_keys, share=0, least=2))
    half = "a very common first half of a line, and then "
    rows = documents() + [(2000 + i, f"{half}{i % 60:04d}{'x' * 40}\nalone {i} " + "abcdefghij"[i % 10] * 30, None, "s", None, None, None) for i in range(120)]
    assert Counter((x.doc_id, x.text) for x in lines.dedup_lines(frame(spark, rows)).collect()) == brute_lines(rows)
