import gzip
import hashlib
import io

from pyspark.sql import functions as F
from tocsin.llm import warc


def test_archives_round_trip_and_predicates_reach_the_reader(spark, tmp_path):
    long = "é" * 700
    rows = [(1, "http://a/\r\nx%41", long), (5, None, long), (5, None, long), (3, "u", long), (2, "u", "short"), (4, "u", "short")]
    rows += [(6, "u", None), (7, "u", "x" * 300_000), (None, "u", long)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, response long, payload string")
    warc.write_archives(pages, str(tmp_path))
    read = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in read) == sorted((p or 0, u or "") for p, u, _ in rows)
    for r in read:
        html = next((h or "").encode() for p, u, h in rows if p == r.page_id and u == r.url)
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = html.decode() == long and r.page_id != 5
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 5, None) if revisit else ("response", None, html))
    slim = warc.read_archives(spark, str(tmp_path), payload=False)
    assert sorted(r.page_id or 0 for r in slim.where("record_type = 'revisit'").collect()) == [0, 1, 3]
    assert slim.where(F.col("page_id").isin(2, 7) & (F.col("payload_bytes") > 10)).count() == 1


def test_unwanted_payloads_stay_packed():
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 500_000}
    data = b"".join(
        warc.packed(warc.record(row | {"page_id": n, "payload": bytes(500_000), "payload_digest": "00" * 20}, "d")) for n in range(3)
    )

    class Counted(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            out = super().read(size)
            Counted.taken += len(out)
            return out

    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3  # other readers see plain gzip members
    assert [r["page_id"] for r in warc.records(Counted(data), lambda r: r["page_id"] == 2, False)] == [2]
    assert len(next(warc.records(io.BytesIO(data), lambda r: True, True))["payload"]) == 500_000


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path)).collect() == []


def foreign(kind, number, block, **more):
    """A record as other programs write it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{number}>", "WARC-Date": "2024-01-01T00:00:00Z"}
    head |= {"Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
PAGE = b"<html>" + bytes(range(256)) * 3000 + b"</html>"
OTHERS = [
    foreign("warcinfo", 1, b"software: x\r\n", Content_Type="application/warc-fields"),
    foreign("request", 2, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
    foreign("response", 3, HTTP + PAGE, Content_Type="application/http; msgtype=response", WARC_Target_URI="<http://a/%20b%>"),
    foreign("resource", 4, b"plain block", Content_Type="text/plain", WARC_Payload_Digest="sha1:" + "a" * 40),
    foreign("response", 5, HTTP, Content_Type="application/http;msgtype=response", WARC_Payload_Digest="md5:zz"),
]
WANT = [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", PAGE), ("resource", b"plain block"), ("response", b"")]


def test_archives_of_other_programs(spark, tmp_path):
    files = {
        "plain.warc": b"".join(OTHERS),
        "members.warc.gz": b"".join(map(gzip.compress, OTHERS)),
        "one.warc.gz": gzip.compress(b"".join(OTHERS)),
        "empty.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        found = list(warc.records(io.BytesIO(data), lambda r: True, True))
        assert [(r["record_type"], r["payload"]) for r in found] == (WANT if data else []), name
        some = list(warc.records(io.BytesIO(data), lambda r: r["record_type"] == "resource", False))
        assert [r["record_id"] for r in some] == (["<urn:uuid:4>"] if data else [])
    read = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in read) == sorted(WANT * 3)
    assert {r.page_id for r in read} == {None} and {r.date for r in read} == {"2024-01-01T00:00:00Z"}
    assert {r.url for r in read if r.record_id == "<urn:uuid:3>"} == {"http://a/%20b%"}
    assert {r.payload_digest for r in read} == {None, "a" * 40}
    slim = warc.read_archives(spark, str(tmp_path), payload=False).where("record_type = 'response'")
    assert slim.count() == 6


def test_damaged_archives_tell_so_once():
    whole = b"".join(OTHERS)
    for pack in (lambda d: d, gzip.compress):
        for cut in (20, 400, len(whole) // 2, len(whole) - 3000):
            data = pack(whole)[: cut if pack(whole) == whole else max(12, int(len(pack(whole)) * cut / len(whole)))]
            found = list(warc.records(io.BytesIO(data), lambda r: True, True))
            kinds = [r["record_type"] for r in found]
            assert kinds[-1:] == ["broken"] and kinds.count("broken") == 1
            assert kinds[:-1] == [k for k, _ in WANT][: len(kinds) - 1]
    for junk in (b"not an archive at all" * 100, OTHERS[0] + b"junk\r\n\r\n" + OTHERS[1], b"\x1f\x8b\x08\x00" + b"\xff" * 500):
        assert [r["record_type"] for r in warc.records(io.BytesIO(junk), lambda r: True, True)][-1] == "broken"
    # One of our own members, then one of another program.
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload": b"abc", "payload_digest": "00" * 20}
    data = warc.packed(warc.record(row, "d")) + gzip.compress(OTHERS[3])
    assert [r["payload"] for r in warc.records(io.BytesIO(data), lambda r: True, True)] == [b"abc", b"plain block"]
