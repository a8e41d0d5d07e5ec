"""Every query of the record log against its SQL in DuckDB, and the pinned figures at sf0.01."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeframe.plans.record_log import QUERIES
from lodeframe.plans.record_log_sql import SQL


def rows(table):
    """Rows as text, columns by name, in any order."""
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in table.select(names).to_pylist())


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in SQL:
        names, want = rows(duck.sql(SQL[name]).to_arrow_table())
        assert rows(got) == (names, want)
    assert got.num_rows or name in ("alias_check",)


def test_pinned_figures(spark, sf_dir):
    if not sf_dir.endswith("sf0.01"):
        pytest.skip("figures of sf0.01")
    r = QUERIES["verify_report"](spark, sf_dir).first()
    assert (r.put_records, r.put_bytes, r.live_records, r.live_bytes, r.dead_records, r.dead_bytes, r.current_commit_seq) == (7986, 632304, 121, 9584, 7865, 622720, 1188)
    c = QUERIES["gc_candidates"](spark, sf_dir).orderBy(F.desc("reclaimable"), "segment_id").first()
    assert (c.segment_id, c.reclaimable) == (1, 65600)
    x = QUERIES["relocation_result"](spark, sf_dir).first()
    assert (x.candidates, x.relocated, x.skipped) == (264, 65, 199)
    a = QUERIES["cas_admission"](spark, sf_dir)
    assert a.where("accepted").count() == 7961 and a.where("not accepted").count() == 2039
    last = a.groupBy("record_id").agg(F.max_by("revision", "seq").alias("r")).agg(F.sum("r")).first()[0]
    assert last == 1472759
    p = QUERIES["radix_nodes_by_level"](spark, sf_dir).where("level = 0").first()
    assert (p.nodes, p.bytes) == (1500, 204000)
    q = QUERIES["segment_rotation"](spark, sf_dir).selectExpr("max(segment_id) m", "sum(segment_id) s", "sum(seg_off) o").first()
    assert (q.m, q.s, q.o) == (3, 1784, 469161824)


def test_every_order_batch_is_answered(spark, sf_dir, duck):
    """multi_record_admission over all orders, against a plain serial pass."""
    seen, batches = {}, {}
    for order, customer in duck.sql("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey").fetchall():
        batch, record = order // 2 + 1, customer + 1
        last = seen.get(record, 0)
        seen[record] = batch
        expected = last if order % 2 == 1 and last != batch else None
        entries = batches.setdefault(batch, {})
        entries[record] = expected if entries.get(record) is None else max(entries[record], expected or 0)
    state, want = {}, {}
    for batch, entries in sorted(batches.items()):
        want[batch] = all(e is None or state.get(r, 0) == e for r, e in entries.items())
        if want[batch]:
            state.update(dict.fromkeys(entries, batch))
    got = QUERIES["multi_record_admission"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r.batch_id: r.accepted for r in got} == want
