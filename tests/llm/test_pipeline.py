import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import mixing, toxicity
from foliant.llm.common import cut
from tests.llm.test_dedup import brute_lines
from tests.llm.test_shingles import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, SF), name)
        assert name == "best_fit_packing" or docs.columns == columns
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.score_toxicity(first, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    assert {r.doc_id for r in out["toxicity"].collect()} == {r.doc_id for r in scores.collect()}
    rows = [tuple(r) for r in out["toxicity"].orderBy("doc_id").collect()]
    lines = out["line_dedup"].collect()
    assert Counter((r.doc_id, r.text) for r in lines) == brute_lines(rows)
    assert all(r.n_chars == len(r.text) for r in lines)
    rows = sorted((tuple(r) for r in lines), key=lambda r: r[0])
    assert sorted(r.doc_id for r in out["simhash_near_dedup"].collect()) == brute(rows)
    # the mix, against SQL over what the stage before kept
    duckdb = pytest.importorskip("duckdb")
    kept = out["simhash_near_dedup"].toPandas()
    c = duckdb.connect()
    c.register("documents", kept)
    want = {r[0]: r[1] for r in c.sql(f"SELECT doc_id, copies FROM ({mixing.MIX_SQL})").fetchall()}
    mixed = Counter(r.doc_id for r in out["mixing"].collect())
    assert dict(mixed) == {d: n for d, n in want.items() if n}
    # the packing, against the tokenizer and by laying the pieces out
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = dict(zip(kept["doc_id"], kept["text"], strict=True))
    pieces, fill, got = Counter(), {}, out["best_fit_packing"].collect()
    for d, times in mixed.items():
        ids = [*t.encode(text[d] or "", add_special_tokens=False).ids, 2]
        a, z, k = 0, len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024, 0
        while a < len(ids):
            pieces[d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += times
            a, z, k = z, z + 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 1024
    assert len(fill) <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1
