import base64
import hashlib
import os
import random
import zlib

import pytest

from metricloom.llm import warc


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    bodies = ["<p>same</p>", "", None] + [f"<p>{'ü' * rng.randrange(200)} {i}</p>" for i in range(40)]
    rows = [(i * 2, f"http://h{i % 5}/{i}", rng.choice(bodies)) for i in range(n)]
    return rows + [(None, None, "<p>same</p>"), (None, "http://x/", "only here"), (1001, "http://a/\r\nb", "x"), (1002, None, "x" * 300_000)]


def expected(rows, least=0):
    last = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            last[payload] = max(page, last.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = last.get(payload, page)
        revisit = first is not None and first != page and len(payload) >= least
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, tmp_path, least):
    rows = corpus()
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")
    path = str(tmp_path / "a")
    warc.write(pages, path, shard_bytes=4000, file_bytes=1500, least=least)
    records = warc.read(spark, path, payloads=True)
    assert found(records) == expected(rows, least)
    html = {(r.page_id, r.payload) for r in records.collect() if r.record_type == "response"}
    assert html <= {(p, (h or "").encode()) for p, _, h in rows}
    names = [n for n in os.listdir(path) if n.endswith(".gz")]
    assert len(names) > 5 and "_temporary" not in os.listdir(path)
    for name in names:
        with open(f"{path}/{name}", "rb") as f:
            assert zlib.decompress(f.read(), 31).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_same_files_whatever_the_partitions(spark, tmp_path):
    pages = spark.createDataFrame(corpus(), "page_id long, url string, html string")
    files = []
    for name, frame in (("a", pages.repartition(2)), ("b", pages.repartition(9))):
        path = str(tmp_path / name)
        warc.write(frame, path, shard_bytes=5000, file_bytes=2000)
        files.append({n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path) if n.endswith(".gz")})
    assert files[0] == files[1]


def test_commit_can_be_repeated_and_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(corpus(), "page_id long, url string, html string"), path, shard_bytes=5000)
    stray = tmp_path / "a" / "part-999999-00000.warc.gz"
    stray.write_bytes(b"left over")
    assert len(found(warc.read(spark, path))) == len(corpus())  # only what the manifest lists
    name = min(n for n in os.listdir(path) if n.endswith(".gz"))
    data = (tmp_path / "a" / name).read_bytes()
    (tmp_path / "a" / name).write_bytes(data[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, path).collect()


def test_no_manifest_no_archive(spark, tmp_path):
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path / "none")).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
