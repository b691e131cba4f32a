"""Record rules and sources: each rule with its code, three syntaxes with one result, quarantine, publication."""

import json
from datetime import UTC, datetime
from decimal import Decimal, localcontext

import pytest
from hypothesis import given
from hypothesis import strategies as st
from txstrata.functions.records import ALL_UNITS, RecordError, to_coins, to_time, to_units, validate
from txstrata.operators.ingest import canonical_tables
from txstrata.operators.integrity import canonical_checks
from txstrata.sources import records as sources
from txstrata.sources.store import StoreError, open_store, publish

BASE = {
    "timestamp": "2024-02-29T06:07:08Z", "src_ip": "203.0.113.77", "dst_ip": "198.18.4.9", "src_port": 40123, "dst_port": 443, "txid": "5eed" * 16, "input_addresses": ["mill"], "output_addresses": ["bakery"],
    "input_amounts": ["3.25"], "output_amounts": ["3.2"], "fee": "0.05", "script_type": "p2tr", "geo_country": "NO", "asn": 64496,
}


def code_of(**changes):
    with pytest.raises(RecordError) as e:
        validate(BASE | changes)
    return e.value.code, e.value.field


@given(st.integers(0, ALL_UNITS))
def test_money_round_trip(units):
    assert to_units(to_coins(units)) == units


@given(st.decimals(allow_nan=True, allow_infinity=True))
def test_amounts_are_read_as_exact_decimals(value):
    """Against decimal arithmetic."""
    with localcontext() as c:
        c.prec, c.Emax, c.Emin = 400, 10**6, -(10**6)
        want = "INVALID_AMOUNT" if not value.is_finite() else "NEGATIVE_AMOUNT" if value < 0 else "INVALID_AMOUNT" if value.adjusted() > 20 and value else None
        if want is None:
            units = value * 100_000_000 if value.adjusted() > -300 or not value else Decimal("0.1")
            want = "AMOUNT_PRECISION_EXCEEDED" if units % 1 and units <= ALL_UNITS else "INVALID_AMOUNT" if units > ALL_UNITS else int(units)
    try:
        assert to_units(str(value)) == want
    except RecordError as e:
        assert e.code == want or (want == "INVALID_AMOUNT" and e.code == "AMOUNT_PRECISION_EXCEEDED")


RULES = [
    ({"timestamp": "2024-02-29 06:07"}, "INVALID_TIMESTAMP", "timestamp"), ({"timestamp": 7}, "INVALID_TIMESTAMP", "timestamp"), ({"timestamp": "2023-02-29T00:00:00Z"}, "INVALID_TIMESTAMP", "timestamp"),
    ({"src_ip": "203.0.113"}, "INVALID_IP", "src_ip"), ({"dst_ip": None}, "INVALID_IP", "dst_ip"), ({"src_port": False}, "INVALID_PORT", "src_port"), ({"dst_port": "70000"}, "INVALID_PORT", "dst_port"),
    ({"txid": "5eed" * 15}, "INVALID_TXID", "txid"), ({"output_addresses": {}}, "MALFORMED_ARRAY", "output_addresses"), ({"output_amounts": "3"}, "MALFORMED_ARRAY", "output_amounts"), ({"input_addresses": ["mi ll"]}, "INVALID_ADDRESS", "input_addresses"),
    ({"input_addresses": [""]}, "INVALID_ADDRESS", "input_addresses"), ({"fee": "-0.5"}, "NEGATIVE_AMOUNT", "fee"), ({"fee": "1.123456789"}, "AMOUNT_PRECISION_EXCEEDED", "fee"), ({"fee": 0.25}, "INVALID_AMOUNT", "fee"),
    ({"fee": "Infinity"}, "INVALID_AMOUNT", "fee"), ({"fee": "1e30"}, "INVALID_AMOUNT", "fee"), ({"fee": "five"}, "INVALID_AMOUNT", "fee"), ({"fee": "21000000.5"}, "INVALID_AMOUNT", "fee"), ({"geo_country": "NOR"}, "INVALID_COUNTRY", "geo_country"),
    ({"geo_country": "  "}, "INVALID_COUNTRY", "geo_country"), ({"asn": -3}, "INVALID_ASN", "asn"), ({"asn": 5_000_000_000}, "INVALID_ASN", "asn"), ({"script_type": ["p2tr"]}, "MALFORMED_SOURCE_RECORD", "script_type"),
    ({"input_amounts": ["1", "1", "1"]}, "INPUT_CARDINALITY_MISMATCH", None), ({"output_addresses": []}, "OUTPUT_CARDINALITY_MISMATCH", None), ({"weather": "fine"}, "MALFORMED_SOURCE_RECORD", "weather"),
    ({"asn": "x", "src_ip": "x"}, "INVALID_IP", "src_ip"),
]


@pytest.mark.parametrize("changes,code,field", RULES)
def test_every_rule_has_its_code(changes, code, field):
    assert code_of(**changes) == (code, field)


def test_values_in_canonical_form():
    out = validate(BASE | {"geo_country": " no", "script_type": "\t", "asn": "", "src_ip": " 2001:DB8:0::7 ", "txid": "5EED" * 16, "src_port": "08"})
    assert (out["geo_country"], out["script_type"], out["asn"], out["src_ip"], out["txid"], out["src_port"]) == ("NO", None, None, "2001:db8::7", BASE["txid"], 8)
    assert to_time("2024-02-29T01:00:00-09:30") == datetime(2024, 2, 29, 10, 30, tzinfo=UTC)
    assert [to_coins(x) for x in (0, 1, 100_000_000, 250_000_010)] == ["0", "0.00000001", "1", "2.5000001"]


TWO = [
    BASE | {"input_addresses": ["mill", "farm"], "output_addresses": ["bakery", "till"], "input_amounts": ["2", "0.75"], "output_amounts": ["2.5", "0.2"], "script_type": " p2tr", "geo_country": "no"},
    BASE | {"timestamp": "2024-02-29T15:37:08+09:30", "src_ip": "2001:0DB8:0:0::7", "dst_ip": "2001:db8::8", "src_port": 0, "dst_port": 65535, "input_addresses": ["mill", "farm"], "output_addresses": ["bakery", "till"], "input_amounts": ["2.0", "0.750"], "output_amounts": ["2.5", "0.2"]},
]


def write(tmp_path, rows):
    (tmp_path / "r.json").write_text(json.dumps(rows))
    head = list(rows[0])
    cell = lambda v: '"' + json.dumps(v).replace('"', '""') + '"' if isinstance(v, list) else str(v)
    (tmp_path / "r.csv").write_text("\n".join([",".join(head), *[",".join(cell(r[h]) for h in head) for r in rows]]) + "\n", encoding="utf-8-sig")
    part = lambda k, v: "".join(f"<{sources.ITEMS[k]}>{x}</{sources.ITEMS[k]}>" for x in v) if isinstance(v, list) else v
    (tmp_path / "r.xml").write_text("<records>" + "".join("<record>" + "".join(f"<{k}>{part(k, v)}</{k}>" for k, v in r.items()) + "</record>" for r in rows) + "</records>")


def test_three_syntaxes_give_one_result(spark, tmp_path):
    write(tmp_path, TWO)
    found = []
    for kind in ("json", "csv", "xml"):
        t = canonical_tables(sources.read_records(spark, str(tmp_path / f"r.{kind}")))
        inputs = [tuple(r) for r in t["transaction_inputs"].orderBy("input_index").collect()]
        seen = {r["src_ip"]: r["observed_at"] for r in t["network_observations"].collect()}
        found.append((inputs, t["transactions"].collect()[0]["fee_sats"], seen, t["rejected_records"].count()))
    assert found[0] == found[1] == found[2]
    assert found[0][0] == [(BASE["txid"], 0, "mill", 200_000_000), (BASE["txid"], 1, "farm", 75_000_000)]
    assert set(found[0][2]) == {"203.0.113.77", "2001:db8::7"} and len(set(found[0][2].values())) == 1 and found[0][1] == 5_000_000


def test_conflicts_and_bad_records_are_quarantined_and_published_once(spark, tmp_path):
    write(tmp_path, [BASE, BASE | {"txid": "short"}, BASE | {"fee": "0.04"}, BASE | {"src_port": 1}])
    (tmp_path / "r.json").write_text((tmp_path / "r.json").read_text()[:-1] + ", 7]")
    t = canonical_tables(sources.read_records(spark, str(tmp_path / "r.json")))
    assert {(r["record_index"], r["error_code"], r["field_name"]) for r in t["rejected_records"].collect()} == {(1, "INVALID_TXID", "txid"), (2, "TXID_CONTENT_CONFLICT", "txid"), (4, "MALFORMED_SOURCE_RECORD", None)}
    assert (t["source_records"].count(), t["network_observations"].count(), t["transactions"].count()) == (5, 2, 1)
    store = str(tmp_path / "store")
    manifest = publish(t, store, "1")
    back, stated = open_store(spark, store, "1")
    assert stated == manifest and back["source_records"].count() == 5
    assert all(r["breaches"] == 0 for r in canonical_checks(back).collect())
    with pytest.raises(StoreError):
        publish(t, store, "1")
    with pytest.raises(StoreError):
        open_store(spark, store, "2")


@pytest.mark.parametrize("kind,text", [("json", "{}"), ("json", "[1] 2"), ("csv", "a,a\n"), ("csv", "timestamp\n"), ("xml", "<x/>"), ("xml", "<!DOCTYPE x><records/>"), ("xml", "<records><y/></records>"), ("json", "[1 2]")])
def test_files_that_are_no_source(kind, text):
    with pytest.raises(sources.SourceFileError):
        list(sources.DECODERS[kind](text.encode()))
    with pytest.raises(sources.SourceFileError):
        sources.detect_format("x.txt")
