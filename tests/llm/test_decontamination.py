"""Word forms and running time of decontamination."""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import functions as F

from verdictflow.llm import decontamination


def test_words_of_differ_where_they_should(spark):
    """Every character of the planes that have capitals, in four surroundings: no two have equal forms."""
    points = spark.createDataFrame(pd.DataFrame({"c": [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]}))
    texts = points.select(F.explode(F.array("c", F.concat("c", F.lit("")), F.concat("c", F.lit("1")), F.concat(F.lit("s"), "c", F.lit("S")))).alias("t"))
    texts = texts.union(spark.createDataFrame([(x,) for x in "abkåω"], "t string"))
    out = texts.distinct().select("t", decontamination.words_of(F.col("t")).alias("w")).agg(F.count_distinct("t"), F.count_distinct("w"), F.max(F.size("w"))).first()
    assert out[0] == out[1] and out[2] == 1


def test_words_of_are_those_of_the_pattern(spark):
    texts = ["", "Ab aB", "ΑΣ Σας ΣΑΣ", "Éa éA x X", "a_b-c9٣d", "Å Å Ω Ω K K k", "x\x00y\x7fz", "İi i̇I ǅ ǆ Ǆ", "ẞß"]
    for t, w in spark.createDataFrame([(t,) for t in texts], "t string").select("t", decontamination.words_of(F.col("t"))).collect():
        brute = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert len(w) == len(brute) and [[a == b for b in w] for a in w] == [[a == b for b in brute] for a in brute]


def test_time_of_a_contaminated_text_follows_its_length(spark):
    item = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([("a", item), ("b", "é É " * 6), ("c", "É é " * 6)], "item_id string, text string")
    took = []
    for times in (25, 200, 400):
        docs = spark.createDataFrame([(1, f"{item} " * times), (2, "é É " * 6)], "doc_id long, text string")
        began = time.perf_counter()
        out = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items).collect()}
        took.append(time.perf_counter() - began)
        assert (out[1]["n_words"], out[1]["n_hit"], out[1]["n_items"]) == (40 * times, 40 * times, 1)
        assert out[2]["n_hit"] == 12 and out[2]["n_items"] == 2
        began = time.perf_counter()
        assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()] == []
    assert took[2] < 3 * took[1] + 2 and took[2] < 30
