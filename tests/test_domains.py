from __future__ import annotations

from pyspark.sql import functions as F

from verdictflow.operators import domains


def test_catalog_is_whole():
    found = domains.domains()
    assert len(found) == 43 and sum(d.evaluation_only for d in found) == 5
    assert all(len(d.labels) == len(d.thresholds) + 1 and list(d.thresholds) == sorted(d.thresholds) for d in found)
    assert all(d.first.english() and d.second.english() for d in found)


def test_bands_at_their_thresholds(spark):
    d = next(x for x in domains.domains() if x.name == "ecommerce_orders")
    rows = spark.createDataFrame([(v,) for v in (24.99, 25.0, 49.99, 50.0, 150.0, None)], f"{d.field} double")
    assert [r[0] for r in rows.select(d.band()).collect()] == [d.labels[0], d.labels[1], d.labels[1], d.labels[2], d.labels[3], None]
    table = domains.apply_bands(rows, domains.band_table(spark).where("domain = 'ecommerce_orders'"), d.field)
    assert [r[0] for r in table.orderBy(F.col(d.field)).select("band").collect()] == [None, *[d.labels[i] for i in (0, 1, 1, 2, 3)]]
