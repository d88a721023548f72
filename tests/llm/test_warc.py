"""WARC archives: round trips, revisits, and files damaged in every way the reader claims to survive."""

import glob
import gzip
import hashlib
import random
from collections import Counter

import duckdb
import pytest

from contourlake.llm import queries, warc
from contourlake.llm.oracles import ORACLE_SQL

SCHEMA = "page_id long, url string, html string, id string, digest string, keeper string, size int"
DATE = b"2000-01-01T00:00:00Z"


def pages(rng):
    long = ["p%d " % k + "".join(rng.choice("abc <>é漢\r\n") for _ in range(1500)) for k in range(4)]
    htmls = [None, "", "short", "short", "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "x" * 1000, *long, long[0], long[0], long[1], "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 1200, "\x1f\x8b\x08\x00" * 400]
    rows = [(k * 7 % 31, f"http://h.example/{k}" if k % 4 else None, h, "a", "b", "c", k) for k, h in enumerate(htmls)]
    rows += [rows[7], rows[7], (None, "http://h.example/ä b\r\nc", long[2], None, None, None, None), (None, None, "z" * 1100, None, None, None, 0), (None, "", "z" * 1100, "", "", "", 1), (rows[9][0], "other", long[3], "", "", "", 2)]
    return rows + [(100 + k, f"u{k}", long[3], "", "", "", 0) for k in range(120)]


@pytest.fixture(scope="module")
def rows():
    return pages(random.Random(2))


def expected(rows):
    low = lambda i: -(1 << 63) if i is None else i
    keeper = {}
    for r in rows:
        if len((r[2] or "").encode()) >= 1000:
            keeper[r[2]] = max(low(r[0]), keeper.get(r[2], -(1 << 63)))
    out = Counter()
    for r in rows:
        body = (r[2] or "").encode()
        again = r[2] in keeper and low(r[0]) != keeper[r[2]]
        out[r[0], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper[r[2]] if again else None] += 1
    return out


def test_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = warc.archived(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == expected(rows)
    assert warc.archived(df.limit(0)).count() == 0
    warc.write(df, f"{tmp_path}/w", archive_bytes=3000)
    found = warc.read(spark, f"{tmp_path}/w").collect()
    assert not any(r["gap"] for r in found)
    assert len({r["path"] for r in found}) > 5 and sum(r["type"] == "warcinfo" for r in found) == len({r["path"] for r in found})
    want = Counter(((r[2] or "").encode() if t == "response" else None, t) for r in rows for t in [kind(r, rows)])
    assert Counter((None if r["payload"] is None else bytes(r["payload"]), r["type"]) for r in found if r["type"] != "warcinfo") == want
    assert {r["target_uri"] for r in found if r["type"] != "warcinfo"} == {None if r[1] is None else r[1].replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A") for r in rows}
    for path in glob.glob(f"{tmp_path}/w/part-*"):
        whole = gzip.open(path).read()  # any gzip reader takes the file
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.endswith(warc.END)


def kind(r, rows):
    (key,) = {k[3] for k in expected(rows) if k[0] == r[0] and k[2] == hashlib.sha1((r[2] or "").encode()).hexdigest()}
    return kind_of_null(r, rows) if r[0] is None else key


def kind_of_null(r, rows):
    return "revisit" if any(q[2] == r[2] and q[0] is not None for q in rows) else "response"


def bodies(n=12):
    return [f"<p>{k}</p>".encode() * (40 + k) for k in range(n)]


def archive(packed):
    parts = [warc.response(k, f"http://h/{k}", b, DATE) for k, b in enumerate(bodies())]
    return [warc.gzipped(p) if packed else p for p in parts]


def salvaged(data):
    """Numbers of the records found, and the gaps; both together cover the bytes exactly once."""
    found = list(warc.walk(data))
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    assert at == len(data)
    good = [int(x.fields[b"warc-record-id"].strip(b"<>").rpartition(b":")[2]) for x in found if x.fields]
    for x in found:
        if x.fields:
            assert x.block.partition(warc.END)[2] == bodies()[int(x.fields[b"warc-record-id"].strip(b"<>").rpartition(b":")[2])]
    return good, [(x.offset, x.length, x.reason) for x in found if not x.fields]


@pytest.mark.parametrize("packed", (True, False))
def test_salvage(packed):
    parts = archive(packed)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    every = list(range(12))
    assert salvaged(b"".join(parts)) == (every, [])
    junk = b"junk \x1f\x8b\x08\x00 more WARC/1.1\r\nnot a header\r\n\r\n"
    assert salvaged(b"".join(parts[:3]) + junk + b"".join(parts[3:])) == (every, [(starts[3], len(junk), "version line")])
    assert salvaged(junk + b"".join(parts))[0] == every
    assert salvaged(b"".join(parts) + junk)[0] == every
    cut = b"".join(parts[:5]) + parts[5][: len(parts[5]) // 2] + b"".join(parts[6:])
    good, gaps = salvaged(cut)
    assert good == [k for k in every if k != 5] and [g[:2] for g in gaps] == [(starts[5], len(parts[5]) // 2)]
    assert salvaged(b"".join(parts)[: starts[11] + 9])[0] == every[:11]
    assert salvaged(b"") == ([], [])


@pytest.mark.parametrize("packed", (True, False))
def test_any_flipped_byte_costs_one_record_at_most(packed):
    rng, parts = random.Random(4), archive(packed)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    reasons = Counter()
    for at in [*rng.sample(range(len(whole)), 400), *range(starts[4], starts[5], 3 if packed else 29)]:
        bad = whole[:at] + bytes([whole[at] ^ rng.randrange(1, 256)]) + whole[at + 1 :]
        found = list(warc.walk(bad))
        hurt = max(k for k in range(12) if starts[k] <= at)
        whole_ones = {x.fields[b"warc-record-id"] for x in found if x.fields and b"warc-record-id" in x.fields}
        assert {f"<urn:page:{k}>".encode() for k in range(12) if k != hurt} <= whole_ones, at
        for x in found:
            if x.reason:
                assert (x.offset, x.offset + x.length) == (starts[hurt], starts[hurt + 1])
                reasons[x.reason] += 1
    assert len(reasons) > 2


def test_members_of_many_records_and_foreign_fields():
    parts = archive(False)
    both = warc.gzipped(parts[0] + parts[1]) + warc.gzipped(b"") + warc.gzipped(parts[2] + b"junk\r\n" + parts[3]) + parts[4]
    found = list(warc.walk(both))
    assert [x.fields and x.fields[b"warc-record-id"] for x in found] == [b"<urn:page:0>", b"<urn:page:1>", b"<urn:page:2>", None, b"<urn:page:3>", b"<urn:page:4>"]
    old = b"WARC/0.18\r\nwarc-type:resource\r\nContent-Type: text/plain\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (x,) = warc.walk(old)
    assert x.block == b"abc" and x.fields[b"x-folded"] == b"a b"
    assert warc._row("p", x, True)[4:] == ("resource", None, None, None, hashlib.sha1(b"abc").hexdigest(), 3, b"abc")
    assert next(warc.walk(old.replace(b"gth: 3", b"gth: x"))).reason == "content length"
    assert next(warc.walk(old.replace(b"abc", b"abcd"))).reason == "record end"


def test_damaged_files_through_spark(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    warc.write(df, f"{tmp_path}/w")
    (path,) = glob.glob(f"{tmp_path}/w/part-*")
    data = bytearray(open(path, "rb").read())
    before = warc.read(spark, f"{tmp_path}/w").orderBy("offset").collect()
    hurt = before[10]
    data[hurt["offset"] + 15] ^= 0x55
    (tmp_path / "hurt").mkdir()
    (tmp_path / "hurt" / "x.warc.gz").write_bytes(data)
    found = warc.read(spark, f"{tmp_path}/hurt")
    key = lambda r: (r["offset"], r["length"], r["record_id"], r["payload"])
    assert sorted(map(key, found.where("gap is null").collect())) == sorted(key(r) for r in before if r != hurt)
    (gap,) = warc.gaps(found).collect()
    assert (gap["offset"], gap["length"]) == (hurt["offset"], hurt["length"]) and gap["path"].endswith("x.warc.gz")


def test_query(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = Counter(con.execute(ORACLE_SQL["op13_warc"]).fetchall())
    assert Counter(map(tuple, queries.op13_warc(spark, data).collect())) == want
