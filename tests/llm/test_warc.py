import io

import zstandard

from geofuse.llm import warc
from geofuse.llm.files import reading
from geofuse.llm.shared import new_dir


def test_pages_round_trip(spark, sf):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i, h in pages.items():
        first[h] = max(i, first.get(h, i))
    out = warc.op6_warc(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        body = pages[r["page_id"]]
        top = first[body]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body.encode()), warc.sha1_base32(body.encode()))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == r["page_id"] else ("revisit", top))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a/\r\nx é", "<p>é</p>"), (4, None, "<p>é</p>"), (None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (6, "l", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' digest", "'y' salt", "'z' payload")
    out = warc.read_archive(warc.write_archive(pages, new_dir(spark, "w"))).collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in out)
    R, V = "response", "revisit"
    assert got == sorted([(1, V, 2), (2, R, None), (3, V, 4), (4, R, None), (-1, V, 5), (5, R, None), (5, R, None), (6, R, None)])
    files = warc.write_archive(pages, new_dir(spark, "w"), least_bytes=2, file_bytes=1)
    out = warc.read_archive(files).collect()
    assert len(out) == len(rows) and sum(r["record_type"] == V for r in out) == 1
    assert files.count() == len(rows)  # a file is left once it is large enough
    assert warc.read_archive(warc.write_archive(pages.limit(0), new_dir(spark, "w"))).count() == 0


def test_format(tmp_path):
    records = [warc.make_record(i, f"http://x/{i}", f"<html>{i} common words of all pages</html>".encode() * 9, None, False) for i in range(300)]
    dictionary = warc.train(records)
    path = tmp_path / "a.warc.zst"
    with open(path, "wb") as out:
        w = warc.Writer(out, dictionary)
        places = [w.add(r) for r in records]
    data = path.read_bytes()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    n = int.from_bytes(data[4:8], "little")
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + n], max_output_size=1 << 20) == dictionary
    found = list(warc.read_records(io.BytesIO(data)))
    assert found[0][0]["WARC-Type"] == "warcinfo"
    assert [b for _, b in found[1:]] == [warc.parse_record(r)[1] for r in records]
    fields, block = warc.read_one(str(path), places[123][0])
    assert fields["WARC-Record-ID"] == "<urn:page:123>" and block in records[123]
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at, size = places[7]
    assert alone.decompress(data[at : at + size], max_output_size=1 << 20) == records[7]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(s for _, s in places) < plain
    with reading(str(path)) as f:
        assert f.read(4) == data[:4]
