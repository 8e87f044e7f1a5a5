import hashlib
import io
import struct
import zipfile

import pytest

from skarn.llm import warc
from skarn.llm.queries import op7_warc_zip


def brute(rows):
    data = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for p, x in data:
        if len(x) >= 100 and p is not None:
            first[x] = min(p, first.get(x, p))
    out = []
    for p, x in data:
        again = len(x) >= 100 and first.get(x) is not None and p != first[x]
        out.append((p, len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", first[x] if again else None))
    return sorted(out, key=repr)


def test_query(spark, sf01):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf01}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op7_warc_zip(spark, sf01).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip_of_odd_rows(spark, zip64):
    big = "é" * 60
    rows = [(1, "http://a/\r\nb c", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100)]
    rows += [(8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (9, "u", "\r\n\r\n" * 40), (10, "u", "z" * 300_000), (10, "u", "z" * 300_000), (None, None, None)]
    pages = spark.createDataFrame([(*r, "digest", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    got = warc.round_trip(pages, package_bytes=400, zip64=zip64).select("page", "payload_bytes", "payload_digest", "kind", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r[0], r[2]) for r in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0


def packed(zip64, members):
    out = io.BytesIO()
    packer = warc.Packer(out, zip64)
    for name, parts in members:
        packer.begin(name)
        for x in parts:
            packer.write(x)
        packer.end()
    packer.close()
    return out


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    out = packed(zip64, [("a/é.bin", [b"one", b"two"]), ("empty", [])])
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("a/é.bin") == b"onetwo" and z.read("empty") == b""
    found = warc.directory(out, len(out.getvalue()))
    start, length = warc.member(out, found["a/é.bin"])
    assert out.getvalue()[start : start + length] == b"onetwo"


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):  # more than 16 bits count
            z.writestr(zipfile.ZipInfo(f"m{k}"), str(k))
        z.comment = b"PK\x05\x06 a comment"
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"wide data")
    found = warc.directory(out, len(out.getvalue()))
    assert len(found) == 66_001
    for name, want in (("m65999", b"65999"), ("wide", b"wide data")):
        start, length = warc.member(out, found[name])
        assert out.getvalue()[start : start + length] == want
    packed_out = io.BytesIO()
    with zipfile.ZipFile(packed_out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("deflated", "x" * 1000)
    with pytest.raises(ValueError, match="stored"):
        warc.member(packed_out, warc.directory(packed_out, len(packed_out.getvalue()))["deflated"])
    with pytest.raises((ValueError, struct.error)):
        warc.directory(io.BytesIO(b"no zip at all"), 13)
