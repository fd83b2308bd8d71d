import hashlib

from pixelmill.llm import warc


def test_warc_reports_a_lost_first_segment(spark, tmp_path):
    body = b"z" * 3000
    parts = list(warc.records(7, "http://h", body, hashlib.sha1(body).hexdigest(), None, 1000))
    (tmp_path / "a.gz").write_bytes(b"".join(parts[1:]))
    got = warc.read_archives(spark, f"file://{tmp_path}/a.gz").collect()
    assert [(r.page_id, r.payload_bytes, r.payload, r.intact) for r in got] == [(7, None, None, False)]
