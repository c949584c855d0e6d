import hashlib
import zlib

from quirewise.llm import warc
from tests.llm.test_contract import same

TYPES = "page_id long, url string, html string, digest string, offset string"


def brute(rows):
    full = [(p, u, (h or "").encode()) for p, u, h, *_ in rows]
    first = {}
    for p, _, h in full:
        if len(h) >= 1000 and p is not None:
            first[h] = max(p, first.get(h, p))
    out = []
    for p, u, h in full:
        again = h in first and p != first[h]
        out.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return out


def test_round_trip(spark):
    page = "<p>größe</p>" * 120
    rows = [(i, f"http://h{i % 3}/{i}", page if i % 4 == 0 else f"<p>{i}</p>" * (i % 7), "x", "y") for i in range(60)]
    rows += [(100, None, None, None, None), (101, "a\r\nb", "", "x", "y"), (None, "u", page, "x", "y"), (7, "dup", "<b>" * 500, "x", "y"), (7, "dup", "<b>" * 500, "x", "y"), (6, "old", "<b>" * 500, "x", "y"), (102, "long", "z" * 3_000_000, None, None)]
    df = spark.createDataFrame(rows, TYPES)
    got = warc.round_trip(df).collect()
    same([tuple(r)[:5] for r in got], brute(rows))
    same([(r.page_id, r.url) for r in got], [r[:2] for r in rows])
    assert warc.round_trip(spark.createDataFrame([], TYPES)).collect() == []


def test_files_hold_gzip_members_at_indexed_offsets(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "é" * 600 + str(i % 2), None, None) for i in range(10)]
    index = warc.write_archives(spark.createDataFrame(rows, TYPES).coalesce(1), f"file://{tmp_path}/w").collect()
    data = (tmp_path / "w" / index[0].path.rpartition("/")[2]).read_bytes()
    info = min(r.offset for r in index)
    assert info + sum(r.length for r in index) == len(data)
    assert b"WARC-Type: warcinfo" in zlib.decompress(data[:info], 31)
    heads = {r.page_id: dict(x.split(": ", 1) for x in zlib.decompress(data[r.offset : r.offset + r.length], 31).partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in index}
    assert len({h["WARC-Record-ID"] for h in heads.values()}) == 10
    for i, h in heads.items():
        if i < 8:  # the response to which a revisit refers, by id and URL
            assert h["WARC-Refers-To"] == heads[8 + i % 2]["WARC-Record-ID"] and h["WARC-Refers-To-Target-URI"] == f"http://h/{8 + i % 2}"
    for r in index:
        assert zlib.decompress(data[r.offset : r.offset + r.length], 31).startswith(b"WARC/1.1\r\n")
    chosen = warc.read_records(spark.createDataFrame(index).where("page_id IN (3, 8)")).collect()
    assert {(r.page_id, r.url) for r in chosen} == {(3, "http://h/3"), (8, "http://h/8")}
    kinds = {r.page_id: r.record_type for r in index}
    assert {r.page_id: r.record_type for r in chosen} == {k: kinds[k] for k in (3, 8)}
    for r in chosen:
        assert r.payload_bytes == 1201 and (r.record_type == "revisit" or r.payload.decode() == "é" * 600 + str(r.page_id % 2))


def test_string_ids_and_shared_payloads(spark):
    """Ids of any text, and payloads of which one has most of the rows."""
    hot, cold = "<p>" * 400, [f"<b>{i}</b>" * 150 for i in range(1100)]
    rows = [(f"p{i}", f"u{i}", hot, None, None) for i in range(50)] + [(f"q {i % 2}:{i // 2}", "a\nb", cold[i // 2], None, None) for i in range(2200)] + [("", "", hot, None, None), (None, None, hot, None, None), ("é\r\n%0A", "x", "", None, None)]
    df = spark.createDataFrame(rows, TYPES.replace("page_id long", "page_id string"))
    got = warc.round_trip(df).collect()
    same([tuple(r)[:5] for r in got], brute(rows))
    same([(r.page_id, r.url) for r in got], [r[:2] for r in rows])


def test_names_of_file_systems():
    assert warc._files("file:///tmp/x")[1] == "/tmp/x"
    assert warc.SCHEMES["s3a"] == "s3"
