import base64
import hashlib

from tidemark.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a.org/x", "<p>ü\r\n\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "http://a.org/y z\r\n", ""), (4, "u", "same" * 9000), (7, "u", "same" * 9000), (5, "u", "same" * 9000), (None, "n", "same" * 9000), (9, "r", "twice"), (9, "r", "twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    got = warc.assemble(warc.read_archive(spark, path)).collect()
    assert len(got) == len(rows) and all(g.request and g.metadata for g in got)
    by = {}
    for g in got:
        by.setdefault(g.main.record_id.split(":")[2], []).append(g.main)
    for page, url, html in rows:
        mains = by[str(page).lower() if page is None else str(page)] if page is not None else by["null"]
        body = (html or "").encode()
        for m in mains:
            assert m.length == len(body) and m.digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            if m.type == "response":
                assert m.payload == body.decode()
    kinds = {k: sorted(m.type for m in v) for k, v in by.items()}
    assert kinds["7"] == ["response"] and kinds["4"] == kinds["5"] == kinds["null"] == ["revisit"] and kinds["9"] == ["response", "response"]
    assert by["4"][0].refers_to == by["7"][0].record_id and kinds["2"] == ["revisit"] and kinds["3"] == ["response"]
    ids = {g.main.record_id for g in got}
    assert len(ids) == len(got) and all(g.main.refers_to in ids for g in got if g.main.type == "revisit")
    small = str(tmp_path / "s")
    warc.write_archive(df, small, bytes_per_file=90_000)
    files = [p for p in (tmp_path / "s").iterdir() if p.name.endswith(".gz")]
    assert len(files) >= 4 and warc.read_archive(spark, small).count() == 3 * len(rows)
    warc.write_archive(df, str(tmp_path / "v"), min_bytes=1)
    assert {g.main.record_id.split(":")[2]: g.main.type for g in warc.assemble(warc.read_archive(spark, str(tmp_path / "v"))).collect()}["2"] == "response"


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.assemble(warc.read_archive(spark, str(tmp_path / "e"))).count() == 0
