"""A hot customer holding a third of all orders and line items (and a hot
order key): the mart must still equal its SQL definition."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from retentio.plans import oracle_sql as O
from retentio.plans.mart import customer_mart


def _write(tmp, n_cust=60, n_orders=900, seed=5):
    rnd = random.Random(seed)
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    prios = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cust = pa.table({"c_custkey": pa.array(range(n_cust), pa.int64()),
                     "c_name": [f"c{i}" for i in range(n_cust)],
                     "c_nationkey": pa.array([rnd.randint(0, 24) for _ in range(n_cust)], pa.int32()),
                     "c_acctbal": [rnd.uniform(-100, 900) for _ in range(n_cust)],
                     "c_mktsegment": [rnd.choice(segs) for _ in range(n_cust)]})
    base = dt.datetime(1995, 1, 1)
    o_cust = [1 if i % 3 == 0 else rnd.randint(0, n_cust - 1) for i in range(n_orders)]  # customer 1 is hot
    orders = pa.table({"o_orderkey": pa.array(range(n_orders), pa.int64()),
                       "o_custkey": pa.array(o_cust, pa.int64()),
                       "o_orderstatus": ["O"] * n_orders,
                       "o_totalprice": [round(rnd.uniform(10, 5000), 2) for _ in range(n_orders)],
                       "o_orderdate": pa.array([base + dt.timedelta(days=rnd.randint(0, 800)) for _ in range(n_orders)],
                                               pa.timestamp("us")),
                       "o_orderpriority": [rnd.choice(prios) for _ in range(n_orders)]})
    rows = []
    for i in range(n_orders * 3):
        ok = 7 if i % 3 == 0 else rnd.randint(0, n_orders - 1)  # order 7 is a hot key
        rows.append((ok, rnd.randint(0, 30), rnd.randint(0, 30), i % 7 + 1, float(rnd.randint(1, 50)),
                     round(rnd.uniform(100, 9000), 2), rnd.randint(0, 10) / 100, 0.02, rnd.choice("ANR"), "O"))
    li = pa.table({"l_orderkey": pa.array([r[0] for r in rows], pa.int64()),
                   "l_partkey": pa.array([r[1] for r in rows], pa.int64()),
                   "l_suppkey": pa.array([r[2] for r in rows], pa.int64()),
                   "l_linenumber": pa.array([r[3] for r in rows], pa.int32()),
                   "l_quantity": [r[4] for r in rows], "l_extendedprice": [r[5] for r in rows],
                   "l_discount": [r[6] for r in rows], "l_tax": [r[7] for r in rows],
                   "l_returnflag": [r[8] for r in rows], "l_linestatus": [r[9] for r in rows],
                   "l_shipdate": pa.array([base] * len(rows), pa.timestamp("us"))})
    ev = pa.table({"event_id": pa.array(range(300), pa.int64()),
                   "ts": pa.array([base] * 300, pa.timestamp("us")),
                   "user_id": pa.array([1 if i % 3 == 0 else rnd.randint(0, 10) for i in range(300)], pa.int64()),
                   "event_type": ["view"] * 300, "value": [round(rnd.uniform(0, 100), 2) for _ in range(300)],
                   "props": ["{}"] * 300})
    for name, t in [("customer", cust), ("orders", orders), ("lineitem", li), ("events", ev)]:
        pq.write_table(t, f"{tmp}/{name}.parquet")


def test_mart_with_hot_keys(spark, tmp_path):
    _write(tmp_path)
    got = customer_mart(spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.sql(O.chain("mart", "SELECT * FROM mart")).to_arrow_table()

    def rows(t):
        cols = sorted(t.column_names)
        d = {c: t.column(c).to_pylist() for c in cols}
        return sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in (d[c][i] for c in cols))
                      for i in range(t.num_rows))
    assert rows(got) == rows(want)
    hot = [r for r in got.to_pylist() if r["CustomerID"] == "1"][0]
    assert hot["OrderCount"] > 300
