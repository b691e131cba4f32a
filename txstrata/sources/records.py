"""CSV, JSON and XML sources of records, read by Spark and decoded one file to a task, record by record."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import ARRAYS, FIELDS, OPTIONAL, RecordError, validate

#: The most characters of one record, and rows in a batch that leaves a task.
RECORD_CHARS, BATCH_ROWS = 1 << 20, 4096

Decoded = Iterator[tuple[dict | None, RecordError | None]]


class SourceFileError(ValueError):
    """A file that is no source at all; nothing of it is taken."""


def detect_format(path: str) -> str:
    """csv, json or xml, by the path's ending."""
    found = path.rsplit(".", 1)[-1].lower()
    if found not in DECODERS:
        raise SourceFileError(f"{path}: the format must be one of {', '.join(DECODERS)}")
    return found


def _malformed(message: str, field: str | None = None, code: str = "MALFORMED_SOURCE_RECORD") -> RecordError:
    return RecordError(code, message, field)


def decode_csv(data: bytes) -> Decoded:
    """Rows under a checked header; the four array cells hold JSON arrays."""
    try:
        rows = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)
        header = next(rows, None)
        if header is None:
            raise SourceFileError("the CSV file has no header")
        if len(set(header)) != len(header):
            raise SourceFileError("the CSV header repeats a column")
        if missing := sorted(set(FIELDS) - set(OPTIONAL) - set(header)):
            raise SourceFileError(f"the CSV header lacks {', '.join(missing)}")
        if unknown := sorted(set(header) - set(FIELDS)):
            raise SourceFileError(f"the CSV header has unsupported columns: {', '.join(unknown)}")
        for row in rows:
            if not row:
                continue
            if len(row) > len(header):
                yield None, _malformed("the CSV row has more values than the header")
                continue
            record: dict = dict(zip(header, [*row, *[None] * (len(header) - len(row))], strict=True))
            try:
                for name in ARRAYS:
                    record[name] = _array_cell(record[name], name)
            except RecordError as e:
                yield None, e
                continue
            yield record, None
    except UnicodeDecodeError:
        raise SourceFileError("the CSV file is not UTF-8") from None
    except csv.Error as e:
        raise SourceFileError(f"the CSV file is malformed: {e}") from None


def _array_cell(cell: str | None, name: str) -> list:
    try:
        value = json.loads(cell or "", parse_float=Decimal, parse_constant=str)
    except ValueError:
        value = None
    if not isinstance(value, list):
        raise RecordError("MALFORMED_ARRAY", f"{name} must contain a JSON array", name)
    return value


def decode_json(data: bytes) -> Decoded:
    """Elements of exactly one top-level array, decoded one at a time with exact numbers."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise SourceFileError("the JSON file is not UTF-8") from None
    decoder = json.JSONDecoder(parse_float=Decimal, parse_constant=str)

    def skip(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n":
            i += 1
        return i

    at = skip(0)
    if text[at : at + 1] != "[":
        raise SourceFileError("the JSON file must hold one top-level array")
    at, index = skip(at + 1), 0
    if text[at : at + 1] == "]":
        at = skip(at + 1)
    else:
        while True:
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError as e:
                raise SourceFileError(f"the JSON file is malformed near record {index}: {e}") from None
            if end - at > RECORD_CHARS:
                raise SourceFileError(f"record {index} is too long")
            yield (value, None) if isinstance(value, dict) else (None, _malformed("an entry of the JSON array must be an object"))
            at, index = skip(end), index + 1
            mark = text[at : at + 1]
            at = skip(at + 1)
            if mark == "]":
                break
            if mark != ",":
                raise SourceFileError(f"',' or ']' is missing after record {index - 1}")
    if at != len(text):
        raise SourceFileError("there is more after the JSON array")


# The child elements of XML arrays.
ITEMS = {"input_addresses": "address", "output_addresses": "address", "input_amounts": "amount", "output_amounts": "amount"}


def decode_xml(data: bytes) -> Decoded:
    """``record`` elements directly under ``records``, without attributes, name spaces, entities or stray text."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise SourceFileError("document types and entities are not allowed in XML")
    depth = 0
    try:
        for event, e in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
            if not isinstance(e.tag, str) or "}" in e.tag:
                raise SourceFileError("name spaces are not allowed in XML")
            if event == "start":
                depth += 1
                if depth == 1 and (e.tag != "records" or e.attrib):
                    raise SourceFileError("the XML root must be <records> without attributes")
                continue
            depth -= 1
            if depth == 1:
                if e.tag != "record" or (e.tail or "").strip():
                    raise SourceFileError("<records> may hold <record> elements only")
                try:
                    yield _xml_record(e), None
                except RecordError as error:
                    yield None, error
                e.clear()
            elif depth == 0 and (e.text or "").strip():
                raise SourceFileError("<records> may hold <record> elements only")
    except ElementTree.ParseError as e:
        raise SourceFileError(f"the XML file is malformed: {e}") from None


def _xml_record(record: ElementTree.Element) -> dict:
    out: dict = {}
    stray = [record.text, *(c.tail for c in record)]
    if record.attrib or any((s or "").strip() for s in stray):
        raise _malformed("an XML record must hold fields only")
    for child in record:
        name = child.tag
        if name not in FIELDS or name in out:
            raise _malformed(f"the XML record has an unsupported or repeated field <{name}>", name if name in out else None)
        if name in ITEMS:
            if (child.text or "").strip() or child.attrib or any(i.tag != ITEMS[name] or len(i) or i.attrib or (i.tail or "").strip() for i in child):
                raise _malformed(f"<{name}> must hold <{ITEMS[name]}> elements only", name, "MALFORMED_ARRAY")
            out[name] = [(i.text or "").strip() for i in child]
        elif len(child) or child.attrib:
            raise _malformed(f"<{name}> must hold text only", name)
        else:
            out[name] = (child.text or "").strip()
    return out


DECODERS = {"csv": decode_csv, "json": decode_json, "xml": decode_xml}

_SIDE = pa.list_(pa.struct([("address", pa.string()), ("amount_sats", pa.int64())]))
_ARROW = pa.schema(
    [
        ("source_file", pa.string()), ("source_format", pa.string()), ("source_file_sha256", pa.string()), ("record_index", pa.int64()), ("observed_at", pa.timestamp("us", tz="UTC")), ("src_ip", pa.string()), ("dst_ip", pa.string()),
        ("src_port", pa.int64()), ("dst_port", pa.int64()), ("txid", pa.string()), ("inputs", _SIDE), ("outputs", _SIDE), ("fee_sats", pa.int64()), ("script_type", pa.string()), ("reported_geo_country", pa.string()), ("reported_asn", pa.int64()),
        ("error_code", pa.string()), ("error_message", pa.string()), ("field_name", pa.string()),
    ]
)
SCHEMA = (
    "source_file string, source_format string, source_file_sha256 string, record_index long, observed_at timestamp, src_ip string, dst_ip string, src_port long, dst_port long, txid string, "
    "inputs array<struct<address:string,amount_sats:long>>, outputs array<struct<address:string,amount_sats:long>>, fee_sats long, script_type string, reported_geo_country string, reported_asn long, "
    "error_code string, error_message string, field_name string"
)


def _row(base: dict, index: int, data: dict | None, error: RecordError | None) -> dict:
    row = dict.fromkeys(_ARROW.names) | base | {"record_index": index}
    if error is None:
        try:
            v = validate(data or {})
        except RecordError as e:
            error = e
        else:
            side = lambda s: [{"address": a, "amount_sats": n} for a, n in zip(v[f"{s}_addresses"], v[f"{s}_amounts"], strict=True)]
            return row | {
                "observed_at": v["timestamp"], "src_ip": v["src_ip"], "dst_ip": v["dst_ip"], "src_port": v["src_port"], "dst_port": v["dst_port"], "txid": v["txid"], "inputs": side("input"), "outputs": side("output"),
                "fee_sats": v["fee"], "script_type": v["script_type"], "reported_geo_country": v["geo_country"], "reported_asn": v["asn"],
            }
    return row | {"error_code": error.code, "error_message": error.message, "field_name": error.field}


def read_records(spark: SparkSession, path: str, source_format: str | None = None) -> DataFrame:
    """One row per record of the file or files at ``path``: canonical values, or the first rule it breaks."""
    kind = source_format or detect_format(path)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        decode = DECODERS[kind]
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = {"source_file": name, "source_format": kind, "source_file_sha256": sha256(content).hexdigest()}
                rows: list[dict] = []
                for i, (data, error) in enumerate(decode(content)):
                    rows.append(_row(base, i, data, error))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.mapInArrow(run, SCHEMA)


def read_lines(rows: DataFrame, source: str, value: str = "value", index: str = "record_index") -> DataFrame:
    """The same from a frame of JSON texts, one record each, wherever they lie; their places are given.

    Sources of any size come in this form: the texts are never in one task.
    """
    base = {"source_file": source, "source_format": "json", "source_file_sha256": sha256(source.encode()).hexdigest()}
    texts = rows.select(F.col(index).cast("long").alias("i"), F.col(value).cast("string").alias("v"))

    def parse(text: str | None) -> tuple[dict | None, RecordError | None]:
        try:
            data = json.loads(text or "", parse_float=Decimal, parse_constant=str) if len(text or "") <= RECORD_CHARS else None
        except ValueError:
            data = None
        return (data, None) if isinstance(data, dict) else (None, _malformed("the text holds no JSON object"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                yield pa.RecordBatch.from_pylist([_row(base, i, *parse(v)) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], schema=_ARROW)

    return texts.mapInArrow(run, SCHEMA)
