"""Archives written, converted and read back."""

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from movara.llm.queries import op11
from movara.llm.registry import ORACLES
from movara.llm.web_archive import convert_arcs, read_arc, read_warc, write_arc

from tests.oracle import connect, differences

SCHEMA = "capture_id long, url string, captured_at timestamp, payload string, number int, archive string"
PAYLOADS = [
    "<p>one</p>", "<p>one</p>", "", None, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "\n\nhttp://x.y 1.1.1.1 20200101000000 text/html 5\nabcde",
    "\r\n\r\r\n\r\n\r\n", "é🙂\x00", "line\n" * 50_000, "\r\n\r\n", "\n", "<p>one</p>",
]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(spark, rows, parts=3):
    rows = [(i, url, None, payload, 5, "x") for i, url, payload in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def converted(spark, folder, frame, least=0):
    write_arc(frame, f"{folder}/arc")
    convert_arcs(spark, f"{folder}/arc", f"{folder}/warc", least)
    return read_warc(spark, f"{folder}/warc")


def plain(rows, least=0):
    same = defaultdict(list)
    for i, _, payload in rows:
        data = (payload or "").encode()
        if len(data) >= least:
            same[data].append(i)
    first = {data: max(ids, key=lambda i: (i is not None, i or 0)) for data, ids in same.items()}
    found, used = [], set()
    for i, _, payload in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        data = (payload or "").encode()
        again = data in used and data in first
        used.add(data)
        found.append((i, len(data), digest(data), "revisit" if again else "response", first[data] if again else None))
    return sorted(found, key=repr)


def result(records):
    names = ["capture_id", "payload_bytes", "payload_digest", "record_type", "refers_to_capture"]
    return sorted(map(tuple, records.where("record_type IN ('response', 'revisit')").select(*names).collect()), key=repr)


ROWS = [(i, f"http://a.example/{i}", p) for i, p in enumerate(PAYLOADS)]
ODD = [(5, None, "x"), (5, "", "x"), (None, "has blank\tand\nbreak", "x"), (-3, "no-colon", "y" * 300_000), (7, "http://é.example/ü", "x")]


@pytest.mark.parametrize("rows", [ROWS, ODD, [(i, "http://a.example/", "same") for i in range(300)]])
def test_round_trip(spark, tmp_path, rows):
    records = converted(spark, tmp_path, captures(spark, rows))
    assert result(records) == plain(rows)
    assert records.where("record_type = 'response' AND NOT coalesce(sound, false)").count() == 0


def test_small_payloads_stay_whole(spark, tmp_path):
    assert result(converted(spark, tmp_path, captures(spark, ROWS), least=5)) == plain(ROWS, 5)


def test_revisits_refer_to_records(spark, tmp_path):
    rows = converted(spark, tmp_path, captures(spark, ROWS)).collect()
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows)
    for r in rows:
        if r.record_type == "revisit":
            assert by_id[r.refers_to].record_type == "response"
            assert by_id[r.refers_to].payload_digest == r.payload_digest and by_id[r.refers_to].capture_id == r.refers_to_capture


def test_both_versions_are_written_and_read(spark, tmp_path):
    write_arc(captures(spark, ROWS, 4), f"{tmp_path}/arc")
    found = read_arc(spark, f"{tmp_path}/arc").collect()
    assert {r.version for r in found} == {1, 2} and not any(r.problem for r in found)
    assert sorted((r.payload for r in found if r.http), key=repr) == sorted(((p or "").encode() for p in PAYLOADS), key=repr)


def foreign(folder):
    """ARC files of other writers: members apart, a DNS answer, extra metadata, bad and cut records."""
    folder.mkdir()
    version = b"1 1 Other Crawl\nURL IP-address Archive-date Content-type Archive-length\n<arcmetadata/>\n"
    first = b"filedesc://other.arc 0.0.0.0 20080430204825 text/plain %d\n%s" % (len(version), version)
    dns = b"dns:www.example.org 10.0.0.1 20080430204826 text/dns 21\n20080430204826\n1.2.3."
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html/>"
    web = b"http://www.example.org/a b.html 10.0.0.2 200804302048 text/html %d\n%s" % (len(page), page)
    noise = b"this is no header\nneither is this 12\n"
    cut = b"http://www.example.org/c 10.0.0.2 20080430204827 text/html 500\nHTTP/1.1 200 OK\r\n\r\nshort"
    with open(folder / "other.arc.gz", "wb") as file:
        for part in (first, dns, web, noise + web, cut):
            file.write(gzip.compress(part + b"\n"))


def test_foreign_archives(spark, tmp_path):
    foreign(tmp_path / "arc")
    rows = read_arc(spark, str(tmp_path / "arc")).orderBy("number").collect()
    assert [r.problem for r in rows] == [None, None, None, "damaged", None, "truncated"]
    assert rows[2].url == "http://www.example.org/a b.html" and rows[2].payload == b"<html/>" and rows[3].payload_bytes == 37
    convert_arcs(spark, str(tmp_path / "arc"), f"{tmp_path}/warc")
    kinds = read_warc(spark, f"{tmp_path}/warc").orderBy("archived", "record_type").collect()
    assert [(r.record_type, r.archived) for r in kinds] == [
        ("response", "2008-04-30T20:48:00Z"), ("revisit", "2008-04-30T20:48:00Z"), ("warcinfo", "2008-04-30T20:48:25Z"),
        ("resource", "2008-04-30T20:48:26Z"), ("response", "2008-04-30T20:48:27Z"),
    ]
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz"))
    assert text.count(b"WARC-Truncated: unspecified") == 1 and text.count(b"WARC-Profile: ") == 1 and b"Content-Type: text/dns" in text


def test_header_lines_read_as_the_format_says(spark, tmp_path):
    converted(spark, tmp_path, captures(spark, ROWS[:1], 1))
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz"))
    head, _, rest = text.split(b"WARC/1.1\r\n")[2].partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
    block = rest[: int(fields[b"Content-Length"])]
    assert rest == block + b"\r\n\r\n" and block.endswith(b"<p>one</p>")
    assert fields[b"WARC-Block-Digest"].decode() == "sha1:" + digest(block)
    assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + digest(b"<p>one</p>")
    assert fields[b"WARC-Date"] == b"1970-01-01T00:00:00Z" and fields[b"WARC-Target-URI"] == b"http://a.example/0"


def test_uncompressed_archives_are_not_cut_silently(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "plain.arc").write_bytes(b"x\n" * 500_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        with pytest.raises(Exception, match="keep archives compressed"):
            read_arc(spark, str(tmp_path / "arc")).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_captures(spark, tmp_path):
    assert result(converted(spark, tmp_path, captures(spark, []))) == []


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op11(spark, sf), connect(sf), ORACLES["op11_web_archive"]) == []


def test_facts_of_the_archives_are_read_once(spark, tmp_path, monkeypatch):
    """Sizes and digests are a written table when equal payloads are looked for, so no archive is read twice for them."""
    import movara.llm.web_archive as archive

    rows = [(n, f"http://a.example/{n}", None, f"text {n % 3}") for n in range(9)]
    captures = spark.createDataFrame(rows, "capture_id long, url string, captured_at timestamp, payload string")
    seen, real = [], archive.repeated_payloads
    monkeypatch.setattr(archive, "repeated_payloads", lambda facts, least: seen.append(facts) or real(facts, least))
    archive.write_arc(captures, str(tmp_path / "arc"))
    archive.convert_arcs(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    read = archive.read_warc(spark, str(tmp_path / "warc")).where("capture_id IS NOT NULL")
    assert sorted((r.capture_id, r.record_type, r.refers_to_capture) for r in read.collect()) == [
        (n, "response" if n > 5 else "revisit", None if n > 5 else 6 + n % 3) for n in range(9)
    ]
