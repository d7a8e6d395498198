import duckdb
import pytest
from pyspark.sql import functions as F

from featstab.llm import mixing
from featstab.llm.common import table

from .helpers import AWKWARD, documents, write


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def oracle(folder):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
        return sorted(tuple(str(x) for x in r) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken, position FROM ({mixing.OP3_SQL})").fetchall())


def test_query_equals_sql(spark, sf):
    got = mixing.op3_curriculum_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken", "position")
    assert rows(got) == oracle(sf)


def test_totals_come_near_targets(spark, sf):
    got = mixing.op3_curriculum_mix(spark, sf)
    assert got.where("taken > 2 * size").count() == 0
    docs = table(spark, sf, "documents").select("doc_id", "source")
    off = got.join(docs, "doc_id").groupBy("source").agg((F.sum("taken") - F.max("target")).alias("off")).where("abs(off) > 1")
    assert off.count() == 0


def test_awkward_rows(spark, tmp_path):
    full = [(*r[:2], None, "s" if i % 2 else None) for i, r in enumerate(AWKWARD)]
    folder = write(spark, documents(spark, full), tmp_path)
    got = mixing.op3_curriculum_mix(spark, folder).select("doc_id", "size", "source_size", "target", "taken", "position").collect()
    assert len(got) == len(full) and all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mix(documents(spark, full))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_clashing_names_and_empty_table(spark):
    docs = documents(spark, [(i, "a b c d " * (i + 1), None, f"s{i % 3}") for i in range(12)])
    clash = docs.selectExpr("*", "1 AS _size", "2 AS size", "3 AS _rank", "4 AS position", "5 AS _row", "6 AS _plays")
    assert mixing.mix(clash).columns == clash.columns
    assert rows(mixing.mix(clash).select(*docs.columns)) == rows(mixing.mix(docs))
    assert mixing.mix(docs.where("false")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2])
def test_time_inverts_the_integrated_schedule(spark, k):
    plan = mixing.Curriculum(schedules=(((0.0, 1.0), (0.5, 3.0), (1.0, 0.0)), mixing.RISING, mixing.FALLING))
    knots, total = plan.schedules[k], plan.integral(k)
    for r in spark.range(21).select((F.col("id") / 20).alias("u")).withColumn("t", plan.time(k, F.col("u"))).collect():
        got = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            t = min(max(r.t, t0), t1)
            got += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
        assert got / total == pytest.approx(r.u, abs=1e-9)
