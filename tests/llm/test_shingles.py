import itertools
import random

import corpus_pipeline
from foliant.llm import shingles
from tests.llm.cases import SCHEMA, documents, frame


def brute(rows, least=0.8):
    """Ids kept, by comparing all pairs of sets of five-word shingles."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both >= least * either - 1e-9:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({min((r[0] for k, r in enumerate(rows) if find(k) == find(i) and r[0] is not None), default=None) for i in range(len(rows))})


def near_copies():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    texts = []
    for g in range(12):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(6 if g else 40):
            w = list(base)
            for at in r.sample(range(200), r.randint(1, 7)):
                w[at] = word()
            texts.append(" ".join(w))
    r.shuffle(texts)
    return [(i, t, "en", "s", len(t), 0.5, "p") for i, t in enumerate(texts)]


def test_near_copies_against_brute_force(spark):
    rows = near_copies()
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    got, want = sorted(r.doc_id for r in kept.collect()), brute(rows)
    assert got == want and len(want) < len(rows) / 2


def test_awkward_documents_against_brute_force(spark):
    rows = documents()
    assert sorted(r.doc_id for r in shingles.one_of_each(frame(spark)).collect()) == brute(rows)
    assert shingles.one_of_each(frame(spark, [])).count() == 0


def test_large_candidate_groups_against_brute_force(spark):
    rows = near_copies()
    # a chain of documents, each near the next, so that one group holds what is far apart
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(500)]
    rows += [(1000 + i, " ".join(words[8 * i : 8 * i + 200]), "en", "s", 1, 0.5, "p") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (1, 3, 10):
        assert sorted(x.doc_id for x in shingles.one_of_each(df, block=block).collect()) == brute(rows), block


def test_sets_of_one_key_are_linked_across_ranges(spark):
    r = random.Random(2)
    rows = [(i, [5] if i % 3 == 0 else [r.randint(6, 40), 100 + i]) for i in range(3000)]
    links = shingles._linked(spark.createDataFrame(rows, "set long, keys array<long>").repartition(3)).collect()
    root = list(range(3000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, keys in rows:
        for k in keys:
            by.setdefault(k, set()).add(i)
    for x in links:
        assert any(x.a in s and x.b in s for s in by.values())
        root[max(find(x.a), find(x.b))] = min(find(x.a), find(x.b))
    assert all(len({find(i) for i in s}) == 1 for s in by.values()) and len(links) <= sum(len(s) for s in by.values())


def test_covering_masks_give_candidates_of_their_own(spark, monkeypatch):
    """Without bands, pairs within 4 bits are still found, and still compared by their sets."""
    monkeypatch.setattr(shingles, "_linked", lambda sets: sets.sparkSession.createDataFrame([], "a long, b long"))
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    pairs = {}
    while len(pairs) < 4:
        a = [word() for _ in range(200)]
        b = list(a)
        for at in r.sample(range(200), r.randint(1, 6)):
            b[at] = word()
        x, y = (shingles.shingle_set(" ".join(t)) for t in (a, b))
        bits = (shingles.majority(x) ^ shingles.majority(y)).bit_count()
        similar = len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
        pairs.setdefault((bits <= 4, similar), (" ".join(a), " ".join(b)))
    order = sorted(pairs)
    rows = [(10 * i + k, t, "en", "s", 1, 0.5, "p") for i, p in enumerate(order) for k, t in enumerate(pairs[p])]
    kept = sorted(x.doc_id for x in shingles.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert order[-1] == (True, True) and kept == [0, 1, 10, 11, 20, 21, 30]
