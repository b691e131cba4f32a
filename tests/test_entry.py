"""The driver's contract: names, SQL, and that the rest works without the corpus operators."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_give_what_sql_gives(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in ("orders", "lineitem", "events", "customer"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    for name in ("transaction_summary", "ip_activity", "tx_bursts", "prefix_lookup", "orphan_checks", "collaborative_detector", "top_budget_capture", "ingestion_rejects", "ingested_observations", "enrichment_recheck", "address_classes", "feature_key_checks", "graph_checks"):
        want = db.sql(entry.oracle_sql()[name])
        columns = sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        found = entry.queries()[name](spark, path)
        assert sorted(found.columns) == columns
        assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall()), name


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """The smallest tables, with users whose hosts have a third part beyond 255 and beyond 65,535."""
    import duckdb

    at = tmp_path_factory.mktemp("many")
    for name in ("orders", "lineitem"):
        (at / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN user_id + 65536 WHEN 1 THEN user_id + 16777216 ELSE user_id END AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{at}/events.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["address_classes", "ingested_observations", "ingested_transactions", "ingestion_rejects"])
def test_users_without_a_host_in_10_0_give_what_sql_gives(spark, many_users, name):
    import duckdb

    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for table in ("orders", "lineitem", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{many_users}/{table}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    found = entry.queries()[name](spark, many_users)
    rows = sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
    assert len(rows) > 0 and sorted(found.columns) == columns and sorted(str([r[c] for c in columns]) for r in found.collect()) == rows


def test_hosts_and_addresses_name_each_other(spark):
    from ipaddress import ip_address

    from pyspark.sql import functions as F
    from txstrata.plans.testdata import address_of, host_of

    hosts = ["10.0.0.0", "10.0.255.255", "10.0.256.0", "10.0.300.5", "10.0.351.143", "10.0.65536.7", "192.168.1.0", "192.168.1.99", None]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("a", address_of(F.col("h"))).withColumn("back", host_of(F.col("a"))).collect()
    assert [r["back"] for r in rows[:-1]] == hosts[:-1] and len({ip_address(r["a"]) for r in rows[:-1]}) == len(hosts) - 1
    assert rows[3]["a"] == "10.1.44.5" and rows[-1]["back"] is None


def test_ingestion_refuses_texts_that_are_no_address_but_plants_none(spark, many_users):
    import json

    from pyspark.sql import functions as F
    from txstrata.plans import ingestion
    from txstrata.plans.testdata import canonical
    from txstrata.sources.records import read_lines

    found = {r["error_code"] for r in entry.queries()["ingestion_rejects"](spark, many_users).select("error_code").distinct().collect()}
    assert len(found) > 1 and found <= {"TXID_CONTENT_CONFLICT", *(d[2] for d in ingestion.DEFECTS)}
    told = ingestion.source_texts(canonical(spark, many_users)).filter("record_index % 41 <> 17").limit(1).first()
    bad = json.dumps(json.loads(told["value"]) | {"src_ip": "10.0.300.5"})
    assert read_lines(spark.createDataFrame([(0, bad)], "record_index long, value string"), "x").select(F.col("error_code")).first()[0] == "INVALID_IP"


def test_texts_that_are_no_address_have_no_class(spark):
    from txstrata.operators.enrich import address_classes

    rows = {r["ip"]: tuple(r)[1:] for r in address_classes(spark.createDataFrame([("10.0.300.5",), ("",), (None,), ("10.0.0.1",), ("ff02::1",)], "ip string")).collect()}
    assert rows["10.0.300.5"] == rows[""] == rows[None] == (None,) * 7
    assert rows["10.0.0.1"] == (4, True, False, False, False, False, False) and rows["ff02::1"][0] == 6 and rows["ff02::1"][5]


def test_the_rest_imports_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('txstrata.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.HERE)
