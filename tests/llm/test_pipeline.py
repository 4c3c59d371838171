import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_quality import make

import corpus_pipeline
from quarryline.llm import bpe

ITEM = " ".join(f"bench{i}" for i in range(14))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    base = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"src{i % 3}") for i, t, _ in make(400, 2)]
    long = " ".join(rng.choices([f"word{k}" for k in range(900)], k=300)) + "."
    near = long.replace(" ", " extra ", 1)
    rows += [(1000, long, "en", "src0"), (1001, long, "en", "src1"), (1002, near, "en", "src2"), (1003, "The intro. " + ITEM + ". The end.", "en", "src1")]
    rows += [(2000 + i, f"the shared banner of the site\nSome own and other text number {i} the thing is in.", "de", "site") for i in range(40)]
    rows += [(2000, rows[-40][1], "de", "site"), (3000, "", "en", "src0"), (3001, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in make(400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    held = {}
    out = docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, out, tables)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            out = corpus_pipeline.stage(out)
        held[name] = {r.doc_id: r for r in out.collect()}
        assert len(held[name]) == out.count() or name in ("quality_classifier", "line_dedup")
    truth = {i: y for i, _, y in make(400, 2)}
    kept = held["quality_classifier"]
    assert sum(i in kept for i, y in truth.items() if y) > 0.98 * sum(truth.values())
    assert sum(i in kept for i, y in truth.items() if not y) < 0.1 * sum(1 - y for y in truth.values())
    lines = held["line_dedup"]
    assert set(lines) == set(kept)
    banner = [i for i in kept if 2000 <= i < 3000]
    assert len(banner) > 30 and all("banner" not in lines[i].text and f"number {i - 2000} " in lines[i].text and lines[i].n_chars == len(lines[i].text) for i in banner)
    near = held["simhash_near_dedup"]
    assert 1000 in near and 1001 not in near and 1002 not in near
    clean = held["benchmark_decontamination"]
    assert 1003 in near and set(near) - set(clean) == {1003}
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    for i, r in held["byte_bpe"].items():
        ids = peer.encode_ordinary(clean[i].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((clean[i].text or "").encode()).hexdigest()
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert whole == held["byte_bpe"]


def test_no_documents(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
