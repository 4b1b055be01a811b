from __future__ import annotations

import gzip
import hashlib
import os

import pytest

from ledgerloom.llm import common, warc


def pages(spark):
    long, other = "<p>é" + "x" * 1200, "<p>" + "y" * 3000 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"
    html = [long, "short", None, "", long, other, "short", long, other, "a\n\nfiledesc://x 0 0 0 3\n"]
    urls = ["http://a.b/c d\te", None, "", "http://é.x/\n", *["http://h/p"] * 6]
    return spark.createDataFrame([(i * 10, u, h, "z") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, payload string")


def want(rows):
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        keep = max(x["page_id"] for x in rows if x["html"] == r["html"]) if len(data) >= 1000 else r["page_id"]
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "response" if keep == r["page_id"] else "revisit", None if keep == r["page_id"] else keep))
    return sorted(out)


@pytest.mark.parametrize("records", [1000, 2])
def test_round_trip(spark, records):
    df = pages(spark).repartition(3)
    assert sorted(map(tuple, warc.archived(df, records).collect())) == want(df.collect())


def test_large_payloads_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_BYTES", 2000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, "http://h/", ("é" * 4500 if i % 5 == 0 else f"x{i}" * 300), "z") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    assert sorted(map(tuple, warc.archived(df).collect())) == want(df.collect())
    warc.write_arc(df, f"file://{tmp_path}/arc")
    sizes = [len(warc._content(p.read_bytes())) for p in (tmp_path / "arc").glob("*/part-*")]
    assert len(sizes) > 5 and max(sizes) < 25_000


def test_repeated_rows_are_one_record_each(spark):
    df = pages(spark).where("page_id in (10, 20)")
    assert sorted(map(tuple, warc.archived(df.union(df)).collect())) == sorted(want(df.collect()) * 2)


def test_empty_table(spark):
    assert not warc.archived(pages(spark).where("false")).collect()


def test_files_are_plain_archives(spark, tmp_path):
    df = pages(spark).repartition(2)
    warc.write_arc(df, f"file://{tmp_path}/arc")
    seen = [warc._content(p.read_bytes()) for p in sorted((tmp_path / "arc").glob("*/part-*"))]
    assert {d.split(b"\n")[1][:1] for d in seen} == {b"1", b"2"}  # both versions are written and read
    assert sum(len(list(warc.arc_records(d))) for d in seen) == 10
    warc.write_warc(warc.converted(spark, f"file://{tmp_path}/arc"), f"file://{tmp_path}/warc")
    found = [x for p in (tmp_path / "warc").glob("*/part-*") for x in warc.warc_records(gzip.decompress(p.read_bytes()))]
    kinds = [f["WARC-Type"] for f, _ in found]
    assert kinds.count("response") == 7 and kinds.count("revisit") == 3 and "warcinfo" in kinds
    for f, block in found:
        assert int(f["Content-Length"]) == len(block)
        if f["WARC-Type"] != "warcinfo":
            assert f["WARC-Date"] == "2020-01-01T00:00:00Z" and not set(f["WARC-Target-URI"]) & set(" \t\n")
    got = warc.read_warc(spark, f"file://{tmp_path}/warc").where("page_id = 0").first()
    assert got["uri"] == "http://a.b/c%20d%09e"


def test_broken_archives():
    block = warc.version_block(1)
    good = (block + "\n" + warc.arc_record(1, 5, "http://a/", "<p>") + "\n").encode()
    assert [r[0] for r in warc.arc_records(good)] == ["http://a/"]
    with pytest.raises(ValueError, match="declared length"):
        list(warc.arc_records(good.replace(b"<p>", b"<p>>")))
    with pytest.raises(ValueError, match="header line of version 1"):
        list(warc.arc_records(good.replace(b"http://a/ ", b"http://a/ x ")))
    with pytest.raises(ValueError, match="not a version block"):
        list(warc.arc_records(good.replace(b"filedesc:", b"file:")))
    with pytest.raises(ValueError, match="cut gzip"):
        warc._content(gzip.compress(good)[:-4])


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert os.path.isdir(common.shared_dir(spark).removeprefix("file://"))
