import gzip
import hashlib
import io
import zlib

import pytest

from tagloom.llm import warc
from tagloom.session import ensure_checkpoint_dir

BIG = "<p>é" + "x" * 1200


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (9, "http://c/\r\nX: y", BIG), (3, "u", "small"), (4, "u", "small"),
        (5, "", None), (6, "u", ""), (None, "u", "no id"), (None, "u", BIG + "!"), (7, "u", "WARC/1.1\r\n\r\n" * 500), (8, "u", "y" * 3_000_000),
        (10, "u", BIG + "中")]


def test_round_trip(spark, monkeypatch):
    files, folder = warc.archive(spark, pages(spark, ROWS))
    got = warc.read_archives(files, folder, with_payload=True).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r["page"] is not None, r["page"] or "", r["record_type"])
    kinds = sorted(((r["page"], r["record_type"], r["refers_to"]) for r in got if r["page"] in ("1", "2", "9")), key=str)
    assert kinds == [("1", "revisit", "9"), ("2", "revisit", "9"), ("9", "response", None), ("9", "response", None)]
    want = {}
    for i, _, h in ROWS:
        data = (h or "").encode()
        want.setdefault(None if i is None else str(i), set()).add((len(data), hashlib.sha1(data).hexdigest()))
    for r in sorted(got, key=key):
        assert (r["payload_bytes"], r["payload_digest"]) in want[r["page"]]
        assert (r["record_type"] == "revisit") == (len(r["payload"]) < r["payload_bytes"])
    assert {r["url"] for r in got if r["page"] == "9"} == {"", "http://c/%0D%0AX: y"}
    assert sum(r["records"] for r in files.collect()) == len(ROWS)


def test_one_member_per_record_and_foreign_readers(spark):
    two = warc.record("1", "u", b"abc", "response", "") + warc.record("2", "u", b"abc", "revisit", "1")
    plain = gzip.decompress(two)
    assert plain.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1>" in plain
    assert len([b"".join(m) for m in warc.members(io.BytesIO(two))]) == 2


def test_files_are_plain_gzip_members(spark):
    files, _ = warc.archive(spark, pages(spark, ROWS))
    starts = 0
    for f in files.collect():
        with open(f["path"], "rb") as raw:
            data = raw.read()
        assert len(data) == f["bytes"]
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n")
            starts, data = starts + 1, one.unused_data
    assert starts == len(ROWS)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_pieces_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(warc, "_CHUNK", chunk)
    data = b"".join(warc.record(str(i), "u", b"z" * i * 50, "response", "") for i in range(5))
    assert [len(warc.parse(m)["payload"]) for m in warc.members(io.BytesIO(data))] == [0, 50, 100, 150, 200]


def test_damage_is_noticed():
    good = gzip.decompress(warc.record("1", "u", b"abcdef", "response", ""))
    for bad in (good.replace(b"abcdef", b"abcdeX"), good[:-5] + b"\r\n\r\n", good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(iter([bad]))
    with pytest.raises(ValueError):
        for m in warc.members(io.BytesIO(warc.record("1", "u", b"abc" * 99, "response", "")[:-9])):
            warc.parse(m)


def archive_of(spark, folder, *members):
    path = f"{folder}/one.warc.gz"
    with open(path, "wb") as f:
        f.write(b"".join(members))
    return spark.createDataFrame([(path, len(members), 0)], "path string, records long, bytes long")


def test_revisits_have_to_match_their_response(spark, tmp_path):
    page = BIG.encode()
    response, revisit = warc.record("9", "u", page, "response", ""), warc.record("1", "u", page, "revisit", "9")
    assert warc.read_archives(archive_of(spark, tmp_path, revisit, response), str(tmp_path)).count() == 2
    digest = hashlib.sha1(page).hexdigest().encode()
    plain = gzip.decompress(revisit)
    forged = [plain.replace(digest, digest[::-1]), plain.replace(b"Length: %d" % len(page), b"Length: %d" % (len(page) + 10)),
              plain.replace(b"page:9", b"page:8")]
    for bad in forged:
        assert bad != plain and len(bad) == len(plain)
        with pytest.raises(ValueError, match="revisit"):
            warc.read_archives(archive_of(spark, tmp_path, response, gzip.compress(bad)), str(tmp_path))


def test_text_ids(spark):
    ids = ["a\r\nX: y", "b>c", "100%", "é 中", "", None, "%20"]
    rows = spark.createDataFrame([(k, "u", BIG) for k in ids], "page_id string, url string, html string")
    got = warc.read_archives(*warc.archive(spark, rows)).collect()
    assert sorted(r["page"] or "" for r in got) == sorted(k or "" for k in ids)
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {max(k for k in ids if k)}


def test_files_that_were_not_reported_are_not_read(spark):
    files, folder = warc.archive(spark, pages(spark, ROWS[:2]))
    path = files.first()["path"].rpartition("/")[0]
    with open(f"{path}/stray.warc.gz", "wb") as f:
        f.write(b"half a record of a lost task")
    assert warc.read_archives(files, folder).count() == 2 and folder.startswith(ensure_checkpoint_dir(spark))


def test_empty(spark):
    files, folder = warc.archive(spark, pages(spark, []))
    assert warc.read_archives(files, folder).count() == 0
