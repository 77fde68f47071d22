"""WARC: whole round trips, chunking, and the records' form."""

import base64
import hashlib
from collections import defaultdict

import pytest

from mercato.llm import warc
from mercato.llm._store import new_path
from mercato.llm.queries import ORACLE_SQL, op10_warc

from oracle_compare import compare, duck
from .helpers import SF

ROWS = [(1, "http://a/\r\n", "a\r\n\r\nb"), (2, None, None), (3, "u", ""), (4, "u", "é\r\n\r\n" * 50 + "x"),
        (5, "u", "é\r\n\r\n" * 50 + "x"), (6, "u", "\r\n\r\n"), (7, "u", "x"), (8, "u", "\r\n"),
        (9, "u", "WARC/1.1\r\n\r\n\r\n"), (10, "u", "\n\r\n\r\n\r\n\r\n"), (11, "ü", "😀" * 9), (12, "u", "x")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def frame(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, ID string")


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_round_trip(spark, chunk):
    path = new_path(spark, "warc")
    warc.write(frame(spark), path, chunk=chunk)
    texts = {i: t or "" for i, _, t in ROWS}
    records = {r.id: r for r in warc.read_records(spark, path).collect()}
    assert set(records) == set(texts)
    for i, r in records.items():
        assert (r["size"], r.digest) == (len(texts[i].encode()), digest(texts[i]))
        last = max(k for k, t in texts.items() if t == texts[i])
        assert (r.type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
    payloads, size = defaultdict(bytes), defaultdict(int)
    for r in warc.read_chunks(spark, path).where("type = 'response'").orderBy("id", "chunk").collect():
        assert len(r.payload.decode()) <= chunk
        payloads[r.id] += bytes(r.payload)
        size[r.id] += len(r.payload)
        assert r["size"] == size[r.id] and r.digest == digest(payloads[r.id].decode())
    assert all(payloads[i].decode() == texts[i] for i in payloads)


def test_least_size_of_a_revisit(spark):
    path = new_path(spark, "warc")
    warc.write(frame(spark), path, least=2)
    kinds = {r.id: r.type for r in warc.read_records(spark, path).collect()}
    assert [i for i, k in kinds.items() if k == "revisit"] == [4]


def test_records_have_the_format(spark):
    text = warc.record_text(warc.chunks(warc.roles(frame(spark)), 7)).collect()
    for r in text:
        head, _, block = r.value.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and int(fields["Content-Length"]) == len(block.encode())
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= set(fields)


def test_query_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    ok, message = compare(op10_warc(spark, SF), con, ORACLE_SQL["op10_warc"])
    assert ok, message


def test_empty_table_and_null_id(spark):
    path = new_path(spark, "warc")
    warc.write(frame(spark).limit(0), path)
    assert warc.read_records(spark, path).count() == 0
    with pytest.raises(Exception, match="without an id"):
        warc.write(spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string"),
                   new_path(spark, "warc"))


def test_reader_refuses_broken_archives():
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc._Reader().feed(b"something"))
    reader = warc._Reader()
    list(reader.feed(b"WARC/1.1\r\nContent-Length: 99"))
    assert reader.open()
