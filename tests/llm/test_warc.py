import base64
import gzip
import hashlib
import io

from check_oracles import compare, connect
from conftest import SF

from tidemark.llm import queries, warc
from tidemark.session import scratch_dir


def test_query_against_oracle(spark):
    assert compare(queries.op6_warc(spark, SF).toPandas(), connect(SF).execute(queries.ORACLES["op6_warc"]).fetchdf()) is None


def brute(pages):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = max(same, default=None)
        n = sum((h or "") == (html or "") for _, _, h in pages)
        kind = "response" if i == first or n == 1 else "revisit"
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, str(first if kind == "revisit" else None)))
    return sorted(out)


def test_odd_rows(spark):
    pages = [(1, "http://a/ü?x=1 2\r\nWARC-Type: evil", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.0\r\n\r\n\r\n" * 3)]
    pages += [(None, "u", "alone"), (None, "u", ""), (6, "u", "x" * 300_000), (2, None, "<p>é</p>"), (7, "u", "\x00퟿")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, first string")
    got = warc.round_trip(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(pages)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/ü?x=1%202%0D%0AWARC-Type:%20evil"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pushed_predicates_and_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 4}", f"page {i % 6}") for i in range(20)], "page_id long, url string, html string")
    path = scratch_dir(spark, "warc")
    warc.write_archives(warc.page_records(pages), path)
    responses = warc.read_archives(spark, path).where("record_type = 'response' and url in ('http://h/1', 'http://h/3')")
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.url, bytes(r.payload)) for r in responses.collect()) == sorted((f"http://h/{i % 4}", f"page {i % 6}".encode()) for i in range(14, 20) if i % 2)
    assert "Filter (isnotnull(record_type" not in plan and "record_type#" in plan
    heads = warc.read_archives(spark, path, payloads="none").collect()
    assert len(heads) == 20 and all(r.payload is None for r in heads)


class Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def record(i, body):
    return warc.record_bytes(
        {"record_type": "response", "record_id": f"urn:page:{i}", "url": f"u{i}", "date": warc.DATE, "payload_digest": "X", "refers_to": None, "payload_length": len(body), "payload": body}
    )


def test_unwanted_payloads_are_skipped_and_foreign_files_read():
    bodies = [b"".join(hashlib.sha512(f"{i} {k}".encode()).digest() for k in range(1500)) for i in range(6)]
    raws = [record(i, b) for i, b in enumerate(bodies)]
    wanted = lambda h: True if h["warc-target-uri"] == "u4" else None
    for packed, skips in ((b"".join(map(warc.member, raws)), True), (b"".join(map(gzip.compress, raws)), False), (b"".join(raws), True)):
        file = Counting(packed)
        found = list(warc._Source(file, len(packed)).records(wanted))
        assert [warc._row(h, b)[-1] for h, b in found] == [bodies[4]]
        assert (file.bytes_read < len(packed) / 2) == skips
        assert len(list(warc._Source(Counting(packed), len(packed)).records(lambda h: False))) == 6
    assert gzip.decompress(b"".join(map(warc.member, raws))) == b"".join(raws)
