"""Every registered query of this subpackage and the pipeline, as the driver runs them, and stages on awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import prose
from verdictflow.llm import catalog, near_dedup, secrets, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(names) == sorted(catalog.queries()) and len({n.split("_")[0] for n in names}) == len(names)
    assert "pipeline" in __spark_entry__.queries()


COLUMNS = {
    1: "doc_id size text_crc32 law shard slot grown_shard", 2: "doc_id n_bytes n_removed n_spans kept_sha256", 3: "doc_id held_out n_tokens n_known train_tokens base_score score",
    4: "doc_id n_words n_hit n_items items_sha256 contaminated", 5: "doc_id held_out score predicted", 6: "doc_id class_id", 7: "doc_id n_tokens ids_sha256 decoded_sha256",
    8: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 9: "doc_id n_assign n_access n_hex base_sha256 spans", 10: "doc_id held_out lang_pred score",
    11: "vec_id code error label_error codebooks_sha256", 12: "lang source part item value rank", 13: "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_entry(spark, documents, name):
    out = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert set(COLUMNS[int(re.match(r"op(\d+)_", name)[1])].split()) <= set(out.columns)
    if "doc_id" in out:
        assert Counter(out[out["piece"] == 0]["doc_id"] if "piece" in out else out["doc_id"]) == Counter(d["doc_id"] for d in documents)


def spark_xxhash64(*values) -> int:
    """Spark's xxhash64: each value is hashed with the hash of those before it as seed; strings as bytes, ints as four bytes."""
    h = 42
    for x in values:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(4, "little"), h)
    return h


def test_shards_are_those_of_the_definition(spark, documents):
    def cost(key, s):
        return -math.log(((spark_xxhash64(sharding.SEED, s, key) >> 11) + 0.5) / 2**53)

    out = __spark_entry__.queries()["op1_sharding"](spark, SF).toPandas().set_index("doc_id")
    for d in documents:
        costs = [cost(str(d["doc_id"]), s) for s in range(41)]
        best = min(range(40), key=costs.__getitem__)
        got = out.loc[d["doc_id"]]
        assert (got["shard"], got["grown_shard"]) == (best, 40 if costs[40] < costs[best] else best)
        text = (d["text"] or "").encode()
        assert (got["size"], got["text_crc32"]) == (len(text) + 16, zlib.crc32(text))


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    patterns = (
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(patterns) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n)


def test_base_spans_are_those_of_the_contract(spark, documents):
    out = __spark_entry__.queries()["op9_secret_scans"](spark, SF).toPandas().set_index("doc_id")
    for d in documents:
        spans = brute_spans(d["text"] or "")
        got = out.loc[d["doc_id"]]
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert got["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(got["spans"].split(",")) or not text


def test_secret_scan_time_follows_the_length():
    import time

    import public_tokenizers

    ratio = secrets.Ratio(public_tokenizers.path(secrets.VOCABULARY))
    for text in ("abcdefghij" * 100_000, "0123456789" * 100_000, "secret " * 100_000, "Zq8vK2mX9p" * 100_000):
        began = time.perf_counter()
        secrets.find_spans(text, ratio)
        assert time.perf_counter() - began < 3


def test_pipeline(spark, documents):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left.append(corpus_pipeline.materialize(stage(spark, left[-1], SF), "test-stage"))
        assert left[-1].columns == docs.columns
    assert sorted(out["doc_id"]) == sorted(r["doc_id"] for r in left[-1].select("doc_id").collect())
    sizes = [x.count() for x in left]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    # stage by stage: one of each class; no window of the benchmark; no base secret
    classes = near_dedup.classify_documents(left[1]).toPandas()
    assert sorted(r["doc_id"] for r in left[2].select("doc_id").collect()) == sorted(classes["class_id"].unique())
    assert all(not brute_spans(r["text"].replace("[SECRET]", " ")) for r in left[4].select("text").collect())


CLASHING = "doc_id long, text string, _vf_key string, _vf_words int, key int, root int, ident int, times int, first_key int, bad_id int, bad_digest int, row int, n_chars int"


def test_stages_on_awkward_rows(spark):
    texts = [prose(1, 200), prose(1, 200), None, "", " \n", prose(2, 30_000), prose(3, 120), prose(3, 120), "ab " * 40]
    ids = [1, 2, 3, 4, 5, 6, 7, 7, None]
    rows = [(i, t, f"u{n}", n, n, n, n, n, n, n, n, n, len(t or "")) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, SF)
            assert out.schema.simpleString() == docs.schema.simpleString()
            got = [r.asDict() for r in out.collect()]
            assert all(r["_vf_key"] == f"u{r['key']}" for r in got)  # columns stay with their rows
            assert bool(got) == (table is docs)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 5, 6, 7]
    again = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(5), SF).collect()
    assert {r["key"] for r in again} == {r["key"] for r in kept}  # the same one of rows with equal id and text
    last = corpus_pipeline.token_stage(spark, docs, SF).collect()
    assert len(last) == len(rows)
