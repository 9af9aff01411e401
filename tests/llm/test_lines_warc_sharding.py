"""Line dedup, WARC and sharding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from cellweave.llm import lines, sharding, warc

TRIM = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), TRIM.sub("", line))


def cleaned(rows, least):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and found[key(x)] >= least)]
        out.append((-1 if i is None else i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect())


def corpus():
    rng = random.Random(4)
    common = ["Share this!", "  share THIS!\t", "É é", "é é", "©", "   ", "", "\x0bx", "A b\r"]
    rows = [(i, "\n".join(rng.choice([*common, f"own {rng.randrange(150)}", f"only {i}"]) for _ in range(rng.randrange(8)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, "Share this!\nnull id"), (3, "Share this!"), (3, "other\nA B"), (203, "long " * 50_000 + "\nshare this!"), rows[5], rows[5]]


def test_clean(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, kept string").repartition(5)
    assert got(lines.dedup_lines(df, 10)) == cleaned(rows, 10)
    assert got(lines.dedup_lines(df, 1)) == cleaned(rows, 1)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_insert_delete_is_reversible(spark, monkeypatch):
    rows = corpus()
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    first, second = rows[:100], rows[100:]
    store = lines.LineStore(spark, min_docs=10, shards=4).insert(df(first))
    before = sorted(tuple(r) for r in store.refs.collect())
    assert got(store.clean(df(first))) == cleaned(first, 10)
    store.insert(df(second))
    assert got(store.clean(df(rows))) == cleaned(rows, 10)
    store.delete(df(second))
    assert sorted(tuple(r) for r in store.refs.collect()) == before
    assert got(store.clean(df(first))) == cleaned(first, 10)
    store.delete(df(first))
    assert store.refs.count() == 0


def test_delete_before_insert(spark):
    df = spark.createDataFrame(corpus()[:40], "doc_id long, text string")
    store = lines.LineStore(spark, min_docs=2).delete(df)
    assert {r.refs < 0 for r in store.refs.collect()} == {True} and got(store.clean(df)) == cleaned([(a, b) for a, b in corpus()[:40]], 1000)
    store.insert(df)
    assert store.refs.count() == 0 and store.filters.count() in (0, len({r.shard for r in store.filters.collect()}))
    store.insert(df)
    assert got(store.clean(df)) == cleaned(corpus()[:40], 2)


def test_store_opens_again(spark):
    rows = corpus()
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    store = lines.LineStore(spark, min_docs=3, shards=8).insert(df(rows[:80]))
    again = lines.LineStore.open(spark, store.path)
    assert (again.version, again.min_docs, again.least, again.shards) == (1, 3, 8, 8)
    assert got(again.insert(df(rows[80:])).clean(df(rows))) == cleaned(rows, 3)
    assert lines.LineStore.open(spark, store.path).version == 2


def test_filters_grow_and_stay_in_their_shards(spark, monkeypatch):
    """More shards than asked for, filters too large to broadcast, and the key of many documents decided by name: the same lines go."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "FILTER_BYTES", 1)
    for share in (0.0, 0.25, 100.0):
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        store = lines.LineStore(spark, min_docs=3, shards=1).insert(df)
        hot = store.refs.where("refs >= 3").count()
        assert 2 < store.shards < hot <= 2 * store.shards and store.filters.count() > 2
        assert got(store.clean(df)) == cleaned(rows, 3)
    monkeypatch.setattr(lines, "FILTER_BYTES", 8 << 20)
    assert got(store.clean(df)) == cleaned(rows, 3)


def test_filters_use_all_their_buckets():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, (2, 60_000)).astype(np.uint64)
    hi &= ~np.uint64(63)  # keys of one shard
    f = lines.CuckooFilter.sized(len(hi))
    assert f.insert(hi, lo) and (f.table > 0).mean() > 0.4


def first_kept(rows, least):
    """Lines that stay when each common line stays once, in the smallest (doc_id, digest of the text, position) that holds it."""
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    place = {}
    at = lambda i, t, n: (-1 if i is None else i, hashlib.md5(t.encode()).digest(), n)
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if key(x) and found[key(x)] >= least:
                place[key(x)] = min(place.get(key(x), at(i, t, n)), at(i, t, n))
    out = []
    for i, t in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if not (key(x) and found[key(x)] >= least) or place[key(x)] == at(i, t, n)]
        if len(kept) == (t or "").count("\n") + 1:
            out.append((-1 if i is None else i, t))
        elif TRIM.sub("", "\n".join(kept)):
            out.append((-1 if i is None else i, "\n".join(kept)))
    return Counter(out)


def test_clean_rows_keeps_the_first(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x", -1) for a, b in rows], "doc_id long, text string, lang string, n_chars long").repartition(4)
    out = lines.LineStore(spark, min_docs=10).insert(df).clean_rows(df, keep_first=True)
    assert out.columns == df.columns
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect()) == first_kept(rows, 10)
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    f = lines.CuckooFilter.sized(len(hi))
    assert f.insert(hi, lo) and f.contains(hi, lo).all()
    other = rng.integers(0, 1 << 63, (2, 100_000)).astype(np.uint64)
    assert f.contains(*other).mean() < 0.001
    f.delete(hi[:10_000], lo[:10_000])
    f = lines.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(hi[10_000:], lo[10_000:]).all() and f.contains(hi[:10_000], lo[:10_000]).mean() < 0.01
    f.delete(hi[10_000:], lo[10_000:])
    assert not f.table.any()
    tiny = lines.CuckooFilter(1)
    assert not tiny.insert(hi[:30], lo[:30])


def pages():
    same, big = "<p>" + "x" * 120, "y" * 100
    rows = [(i, f"http://e/{i}", rnd) for i, rnd in enumerate([same, "short", same, None, "", big, "é" * 50, big, "short", "y" * 99, "y" * 99, same])]
    rows += [(None, "u", same), (None, None, "z" * 200), (40, "http://a b\r\nX: y", "WARC/1.0\r\nContent-Length: 3\r\n\r\n\x1f\x8b\x08" + "q" * 90), (41, "l", "long " * 300_000), (0, "again", same)]
    return rows


def test_warc_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(a, b, c, "e") for a, b, c in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder, manifest = warc.write_warc(df, archive_bytes=2000)
    assert manifest.count() > 2
    back = warc.read_warc(spark, folder, manifest).collect()
    assert all(r.gap_start is None for r in back)
    body = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if len(body(h)) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = sorted((-1 if i is None else i, len(body(h)), hashlib.sha256(body(h)).hexdigest(), *(("revisit", first[h]) if len(body(h)) >= 100 and h in first and i != first[h] else ("response", -1))) for i, _, h in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in back) == want
    assert {bytes(r.payload) for r in back if r.record_type == "response"} == {body(h) for _, _, h in rows}
    with open(f"{folder.removeprefix('file://')}/archives/half-written.warc.gz", "wb") as f:
        f.write(b"\x1f\x8b\x08 cut off")
    assert warc.read_warc(spark, folder, manifest).count() == len(rows)
    assert [r.gap_end for r in warc.read_warc(spark, folder).where("gap_end is not null").collect()] == [11]
    folder, manifest = warc.write_warc(df.limit(0))
    assert manifest.count() == 0 and warc.read_warc(spark, folder, manifest).count() == 0


def test_warc_hot_payloads(spark, monkeypatch):
    """Payloads of many rows get their response by name; the result is the same, and no task of the join gets all copies."""
    rows = [(i, "u", "hot " * 50 if i % 3 else f"own {i % 40} " * 20) for i in range(600)] + [(1000 + i, None, "") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for share in (0.0, 0.25, 1000.0):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        back = warc.read_warc(spark, *warc.write_warc(df)).collect()
        want[share] = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or -1) for r in back)
    assert want[0.0] == want[0.25] == want[1000.0] and len(back) == 800
    assert sum(r.record_type == "response" for r in back) == 200 + 1 + len({i % 40 for i in range(0, 600, 3)})


def test_salvage():
    records = [warc.build_record(i, "u", b"payload %d " % i * 40, hashlib.sha256(b"payload %d " % i * 40).hexdigest()) for i in range(8)]
    for parts in (records, [warc.gzip_member(r) for r in records], [r if i % 2 else warc.gzip_member(r) for i, r in enumerate(records)]):
        data = b"".join(parts)
        found = warc.Salvage()
        assert [r.headers["x-page-id"] for r in warc.read_archive(data, found)] == list("01234567") and not found.gaps
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        bad = bytearray(data)
        bad[starts[2] + len(parts[2]) // 2] ^= 0x55  # within record 2
        bad = bytes(bad[: starts[5]]) + b"junk WARC/9 \x1f\x8b\x08 junk" + bytes(bad[starts[5] :])
        bad = bad[:-7]  # the last record is cut
        found = warc.Salvage()
        # the cut takes the end of the plain record, but of the compressed one only the checksum: its block digest still holds
        assert [r.headers["x-page-id"] for r in warc.read_archive(bad, found)] == list("0134567" if parts[7][:2] == b"\x1f\x8b" else "013456")
        assert [(a, b) for a, b, _ in found.gaps] == [(starts[2], starts[3]), (starts[5], starts[5] + 20), (starts[7] + 20, len(bad))]
    def ids(data):
        found = warc.Salvage()
        return "".join(r.headers["x-page-id"] for r in warc.read_archive(data, found)), [(a, b) for a, b, _ in found.gaps]

    # many records in a member: one that fails leaves those before and after it
    spoilt = bytearray(b"".join(records))
    spoilt[len(records[0]) + len(records[1]) // 2] ^= 0x55
    many = warc.gzip_member(bytes(spoilt))
    assert ids(many + warc.gzip_member(records[3])) == ("0234567" + "3", [(0, len(many))])
    # a member that breaks off leaves the records before the damage
    loose = warc.gzip_member(b"".join(records), 0)
    cut = loose[: len(loose) * 2 // 3]
    assert ids(cut + warc.gzip_member(records[7])) == ("01234" + "7", [(0, len(cut))])
    found = warc.Salvage()
    assert list(warc.read_archive(b"nothing here", found)) == [] and found.gaps[0][:2] == (0, 12)
    assert list(warc.read_archive(b"")) == []


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, "t" * rng.choice([1, 10, 500, 3000]) + str(i % 1500)) for i in range(3000)] + [(9000 + i, "hot " * 200) for i in range(900)] + [(9990, None), (9991, ""), (None, "null id"), (8000, "again"), (8000, "again")]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, shard string")
    out = sharding.shard_documents(df, 24).collect()
    assert len(out) == len(rows)
    body = {a: b for a, b in rows}
    by_text, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        t = body[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    (hot,) = by_text["hot " * 200]
    others = [load[s] for s in range(24) if s != hot]
    assert max(others) - min(others) <= 0.05 * max(others)
    assert sharding.shard_documents(df.limit(0), 24).count() == 0


def test_lpt():
    assert sharding.lpt([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
