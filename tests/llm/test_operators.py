"""The ten operators against brute force, on small fixtures with awkward rows."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionforge.llm import common, decontaminate, exact_dedup, license_scan, near_dedup, packing, pii, quality, sharding, toxicity, warc
from ionforge.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, kept string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "y", "z") for i, t in rows], DOCS).repartition(3)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(1)
    base = [prose(rng, 40) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "One\ttwo"), (105, base[0].replace(" ", "  \n")), (106, base[0] + " more words here"), (107, "É " * 3), (107, "É " * 3), (108, "x " * 30000), (109, base[1]), (None, base[1])]
    return rows


# ---------------------------------------------------------------------- kernel


def test_words_equal_regular_expressions():
    rng = random.Random(3)
    alphabet = "aB zé\t\n\x0b\x1c ,.9'"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", " "]
    for table, pattern in ((common.SPACED, rb"[^\x20\x09-\x0D]+"), (common.LETTERS, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = common.Words(table)
        ids = {}
        for first, at, data in w.chunks(pa.array(texts)):
            h, start, end, row = w.split(at, data)
            got = defaultdict(list)
            for k in range(len(h)):
                raw = bytes(data[start[k] : end[k]])
                got[first + row[k]].append(raw)
                assert ids.setdefault(int(h[k]), raw.lower()) == raw.lower()
            for i in range(len(at) - 1):
                assert got[first + i] == re.findall(pattern, (texts[first + i] or "").encode())
        assert len(set(ids.values())) == len(ids)


def test_kernel_chunks_and_slices(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    w = common.Words(common.SPACED)
    a = pa.array(["skip", "ab cd", "", "a" * 50, "ef"])[1:]
    words = [bytes(d[s:e]) for _, at, d in w.chunks(a) for _, s, e, _ in zip(*w.split(at, d), strict=True)]
    assert words == [b"ab", b"cd", b"a" * 50, b"ef"]


def test_shingles_of_short_rows():
    h = np.arange(1, 8, dtype=np.uint64)
    s, row = common.shingles(h, np.array([0, 0, 1, 1, 1, 1, 2]), 4, 3)
    assert Counter(row.tolist()) == {0: 1, 1: 2, 2: 1}
    assert len(set(s.tolist())) == 4


def test_key_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k long, v string")
    keys = common.written(spark.createDataFrame([(2,), (None,)], "k long"), "test-keys")
    assert sorted(r.v for r in common.rows_without_keys(df, keys, ["k"]).collect()) == ["a"]
    assert sorted(r.v for r in common.rows_with_keys(df, keys, ["k"]).collect()) == ["b", "d"]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 260)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ----------------------------------------------------------------- exact dedup


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for n, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_groups(spark, awkward):
    got = exact_dedup.exact_groups(frame(spark, awkward))
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact(awkward)


def test_exact_keeps_columns(spark, awkward):
    df = frame(spark, awkward)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    want = Counter(i for i, _, _, k, _ in exact(awkward) if k)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_exact_of_nothing(spark, awkward):
    assert exact_dedup.exact_groups(frame(spark, awkward).limit(0)).count() == 0


def test_exact_keeps_same_id_with_other_text(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (2, "b")])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_first(df).collect()) == [(1, "a"), (2, "b")]


# ------------------------------------------------------------------ near dedup


def near(rows, n=4, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split())


@pytest.mark.parametrize("n", [4, 5])
def test_near_groups(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(8):
        t = prose(rng, rng.choice([5, 30, 120]), 10**6)
        rows += [(len(rows) + k, edited(rng, t, s)) for k, s in enumerate([0, 0.01, 0.02, 0.03, 0.05, 0.08, 0])]
    # a chain whose ends are not similar, and a passage that many share
    w = prose(rng, 60, 10**6).split()
    rows += [(1000 + k, " ".join(w[2 * k :] + [f"c{j}" for j in range(2 * k)])) for k in range(8)]
    passage = prose(rng, 30, 10**6)
    rows += [(2000 + k, prose(rng, rng.randrange(2, 25), 10**6) + " " + passage) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, "a b"), (3003, "A  B"), (3004, "a")]
    rng.shuffle(rows)
    got = near_dedup.near_groups(frame(spark, rows), n=n).collect()
    want = near(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_near_awkward(spark, awkward):
    got = near_dedup.near_groups(frame(spark, awkward), n=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in awkward)
    want = near([r for r in awkward if r[0] is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert near_dedup.near_groups(frame(spark, awkward).limit(0)).count() == 0


def test_minmax_agrees_with_probability_j():
    rng = np.random.default_rng(5)
    common_, a, b = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (800, 100, 100))
    x, y = np.concatenate([common_, a]), np.concatenate([common_, b])
    bands = near_dedup.signatures(np.concatenate([x, y]), np.repeat([0, 1], 900), 2, 600, 1)
    assert abs((bands[0] == bands[1]).mean() - 0.8) < 0.06


# -------------------------------------------------------------------- sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_obey_the_law(spark, awkward, shards):
    rows = awkward + [(5000 + k, f"t{k % 5}") for k in range(300)]
    got = sharding.shard_rows(frame(spark, rows), shards=shards).collect()
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(k, f"t{k}") for k in range(200)]
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(frame(spark, x)).collect()) for x in (rows, rows[::-1]))
    assert a == b


def test_shards_of_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    got = sharding.shard_rows(frame(spark, [(k, "x") for k in range(500)]), shards=3, vnodes=2).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [166, 167, 167]
    assert len({(r.shard, r.slot) for r in got}) == 500


def test_walk_stays_clockwise_and_moves_little():
    points = sharding.ring_points(5, 8)
    counts = [random.Random(1).randrange(20) for _ in points]
    plan = sharding.walk(points, counts, 5)
    assert sum(e - f for _, f, e, _, _ in plan) == sum(counts)
    home = sum(e - f for a, f, e, s, _ in plan if points[a][1] == s)
    assert home > 0.6 * sum(counts)


def test_no_rows_to_shard(spark):
    assert sharding.shard_rows(frame(spark, [(1, "x")]).limit(0)).count() == 0


# --------------------------------------------------------------------- packing


def check_bins(rows, lengths, got):
    by = defaultdict(list)
    for r in got:
        if r.bin_id is not None:
            by[r.bin_id].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in rs:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_length for r in rs} == {next(c for c in sorted(lengths) if c >= at)}
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert sum(r.length for r in pieces[i] if r.bin_id is not None) == n * sum(1 for j, _ in rows if j == i)
        assert all(r.n_tokens == n for r in pieces[i])
    return by


@pytest.mark.parametrize("lengths", [(8,), (8, 16, 32)])
def test_packing(spark, lengths):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.choice([0, 1, 3, 7, 8, 9, 31, 32, 33, 100]))) for k in range(200)] + [(900, None), (901, "")]
    got = packing.pack(frame(spark, rows), lengths=lengths, bin_cost=1).collect()
    by = check_bins(rows, lengths, got)
    tokens = sum(r.length for rs in by.values() for r in rs)
    assert tokens / sum(rs[0].bin_length for rs in by.values()) > 0.95


def test_packing_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 5)
    rows = [(k, prose(random.Random(k), 3 + k % 2)) for k in range(120)]
    got = packing.pack(frame(spark, rows), lengths=(4, 16)).collect()
    check_bins(rows, (4, 16), got)


def test_packing_plan_is_close_to_the_bound():
    rng = random.Random(6)
    hist = Counter(min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20000))
    _, sized, segments = packing.plan(dict(hist))
    tokens = sum(k * n for k, n in hist.items())
    assert sum(n * c for _, n, c, _ in sized) < 1.01 * tokens
    assert len(segments) < 4 * len(hist)


def test_joint_lengths_beat_one_length():
    hist = {600: 100, 1024: 50}
    cost = lambda lengths: sum(n * (c + 32) for _, n, c, _ in packing.plan(hist, lengths)[1])
    assert cost((1024, 2048, 4096)) <= min(cost((4096,)), cost((2048,)))


def test_nothing_to_pack(spark):
    assert packing.pack(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert packing.pack(frame(spark, [(1, None)])).collect()[0].bin_id is None


# ------------------------------------------------------------------------ WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, n int").repartition(3)


def test_archives_round_trip(spark):
    rng = random.Random(4)
    big = "<p>" + prose(rng, 400) + "é</p>"
    rows = [(k, f"https://h{k % 3}.example/{k}\r\nX: y", f"<html>{prose(rng, 50)}</html>") for k in range(40)]
    rows += [(100, "u", big), (101, "u", big), (107, None, big), (102, "u", "x" * 999), (103, "u", "x" * 999), (104, "u", None), (105, "u", ""), (106, "u", "é" * 500), (108, "u", "é" * 500)]
    path = warc.write_archives(pages(spark, rows), archive_bytes=20_000)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[i]
        same = [j for j, _, x in rows if (x or "") == (h or "")]
        top = max(same) if len(raw) >= 1000 and len(same) > 1 else i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if top == i else ("revisit", top))
        assert r.html == ((h or "") if top == i else None)


def test_repeated_page_ids(spark):
    big = "y" * 2000
    path = warc.write_archives(pages(spark, [(1, "a", big), (2, "b", big), (2, "c", big), (2, "d", "z")]))
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.url) for r in warc.read_archives(spark, path).collect())
    assert got == [(1, "revisit", 2, "a"), (2, "response", 0, "b"), (2, "response", 0, "d"), (2, "revisit", 2, "c")]


def test_hot_payloads_null_ids_and_empty_urls(spark, monkeypatch):
    """Large and small groups go different ways; the result is that of a plain loop."""
    monkeypatch.setattr(warc, "HOT_GROUPS", 4)
    hot, few, lone = "h" * 1500, "f" * 1500, "l" * 1500
    rows = [(k, f"u{k}", hot) for k in range(60)] + [(k, f"u{k}", few) for k in range(60, 63)] + [(70, "", lone), (71, None, "s"), (72, "", None)]
    rows += [(None, None, "n" * 1500), (None, "v", "n" * 1500), (None, "w", few), (62, None, few), (62, "z", few)] + [(k, "e", "") for k in range(80, 90)]
    got = warc.read_archives(spark, warc.write_archives(pages(spark, rows))).collect()
    tops = {}
    for i, _, h in rows:
        if h and len(h) >= 1000 and i is not None:
            tops[h] = max(i, tops.get(h, i))
    want, seen = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        top = tops.get(h)
        first = top is None or (i == top and h not in seen)
        if first and top is not None:
            seen.add(h)
        want.append((i, u, len(h or ""), "response" if first else "revisit", None if first else top, (h or "") if first else None))
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.html) for r in got), key=key) == sorted(want, key=key)


def test_no_pages(spark):
    path = warc.write_archives(pages(spark, [(1, "a", "x")]).limit(0))
    assert warc.read_archives(spark, path).count() == 0


def test_archive_is_standard_frames():
    import struct

    import zstandard

    recs = [warc.record(k, "u", b"<html>same words in each %d</html>" % k, hashlib.sha1(b"").hexdigest(), 3, "response", None) for k in range(200)]
    data = warc.archive(recs)
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and list(warc.records(data)) == recs
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert len(data) - n < plain
    assert list(warc.records(warc.archive([b"x"]))) == [b"x"]


# --------------------------------------------------------------------- licences


def test_licence_scan(spark, awkward):
    texts = ["CC BY cc by", "cc-by 4.0", "Licensed under the Apache License, Version 2.0.", "All Rights  Reserved; all rights", "GNU General Public License version 3 general public license", "ccé by", "Keep cc by", "rights reserved all rights reserved", "This work is licensed under the GNU General Public License, version 3."]
    rows = awkward + [(500 + k, t) for k, t in enumerate(texts)] + [(600, "all rights " * 5000 + "reserved"), (500, texts[0])]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(frame(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert got == want


def test_licence_labels(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "apache license version 2 0"), (4, "permission is hereby granted"), (5, "")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert (got[1].labels, got[1].score) == ("cc-by,cc-by-nc-4.0", 1.0)
    assert got[2].labels == "gpl,gpl-3.0" and got[3].labels == "apache-2.0" and 0 < got[3].score < 1
    assert got[4].labels == "" and got[4].score == 0 and got[5].n_words == 0
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = license_scan.scan(frame(spark, [(1, "cc by")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -------------------------------------------------------------------------- PII


def test_pseudonyms_keep_formats(spark):
    text = "card 4111 1111 1111 1111, +1 (456) 555-2186, 74.42.69.78, 1999-02-28, 31/12/2020, 123-45-6789, GB82 WEST 1234 5698 7654 32, joe.29@mail5.example.com, token = \"97ffa88d7c5f5655e365004e29bd123cdabd722a\" end"
    rows = [(1, text), (2, "again 4111 1111 1111 1111"), (3, "not 4111 1111 1111 1112, 999.1.1.1, 2020-02-30, 000-12-3456, v1.2.3.4.5"), (4, None), (5, ""), (6, "x" * 100000 + " 74.42.69.78")]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows), "key").collect()}
    spans = {s.kind: s.pseudonym for s in got[1].pii_spans}
    assert set(spans) == {"card", "phone", "ip", "date", "ssn", "iban", "email", "secret"}
    for s in got[1].pii_spans:
        assert s.pseudonym in got[1].text and text[s.start : s.end] not in got[1].text
    assert pii.luhn(spans["card"].replace(" ", "")) and re.fullmatch(r"\d{4}( \d{4}){3}", spans["card"])
    assert pii._mod97(spans["iban"].replace(" ", "")) == 1
    assert all(0 <= int(x) < 256 for x in spans["ip"].split("."))
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", spans["phone"])
    datetime.datetime.strptime(next(s.pseudonym for s in got[1].pii_spans if "-" in s.pseudonym and s.kind == "date"), "%Y-%m-%d")
    assert got[2].pii_spans[0].pseudonym == spans["card"]
    assert got[3].pii_spans == [] and got[3].text == rows[2][1]
    assert got[4].text is None and got[5].text == ""
    assert got[6].pii_spans[0].pseudonym == spans["ip"]
    other = pii.pseudonymise(frame(spark, rows[1:2]), "another key").first()
    assert other.pii_spans[0].pseudonym != spans["card"]


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k")
    assert sorted(f.permute(x, n, b"t") for x in range(n)) == list(range(n))


def test_pseudonyms_of_dates_are_one_to_one():
    f = pii.Feistel(b"k")
    days = [str(datetime.date(2000, 1, 1) + datetime.timedelta(k)) for k in range(400)]
    assert len({pii.pseudonym("date", x, f) for x in days}) == 400


# ---------------------------------------------------------------------- quality


def quality_rows(rng, n):
    rows = []
    for k in range(n):
        good = rng.random() < 0.7
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80)))
        rows.append((k, t.capitalize() + "." if good else " ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in t.split()), int(good)))
    return rows


def test_quality(spark):
    rng = random.Random(9)
    rows = quality_rows(rng, 400)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", 1) for i, t, _ in rows] + [(900, None, None, None, 1), (901, "", "en", "s0", 1), (0, rows[0][1], "en", "s0", 1)], "doc_id long, text string, lang string, source string, path int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(1, rows[1][2], 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 403
    held = [(r.accepted, rows[r.doc_id][2]) for r in got if r.doc_id < 400 and r.doc_id % 2 == 0]
    assert sum(bool(a) == bool(q) for a, q in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    none = quality.score(docs, None).collect()
    assert len(none) == 403
    assert quality.score(docs.limit(0), labels).count() == 0


def test_posteriors_by_hand(spark):
    """Each level's posterior is its rows' sum with the level above as a prior, without the row itself."""
    rng = random.Random(10)
    rows = quality_rows(rng, 120)
    docs = spark.createDataFrame([(i, t, "ab"[i % 2], f"s{i % 3}") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    p = {r.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in got}
    top = (sum(p.values()) + 1) / (len(p) + 2)
    host, path = defaultdict(list), defaultdict(list)
    for r in got:
        host[r.host].append(r.doc_id)
        path[r.host, r.path].append(r.doc_id)
    # two rows of one host give its prior's strength; every other row must agree
    def strength(mine):
        r = mine[0]
        n, s = len(host[r.host]) - 1, sum(p[i] for i in host[r.host]) - p[r.doc_id]
        return (s - n * r.host_posterior) / (r.host_posterior - top)
    k = strength([r for r in got if r.host == "s0"])
    for r in got:
        n, s = len(host[r.host]) - 1, sum(p[i] for i in host[r.host]) - p[r.doc_id]
        assert r.host_posterior == pytest.approx((k * top + s) / (k + n), rel=1e-4)


def test_sparse_sites_follow_the_prior(spark):
    good = "some plain words that read well enough for a text of this kind."
    rows = [(k, good, "en", "big") for k in range(50)] + [(100, good, "en", "small")]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), None).collect()}
    assert abs(got[100].host_posterior - got[0].host_posterior) < 0.05


# --------------------------------------------------------------------- toxicity


def toxic_rows(rng, n):
    rows = []
    for k in range(n):
        w = [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abdeghlnrst") for _ in range(5)) for _ in range(rng.randrange(30, 150))]
        bad = rng.random() < 0.4
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilk", "grom", "zuxen", "zuxor", "zuxal"]))
        rows.append((k, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rng = random.Random(12)
    rows = toxic_rows(rng, 500)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "zuxim " * 3 + "a " * 40000), (None, "vilk")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 504
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert {got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows} == {True}
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert got[900].score == got[901].score == 0 and got[900].predicted == 0
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    none = toxicity.score(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    x = rng.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    x[-1] = 0
    windows = np.array([[0, 1, 2, 3], [4, 2, 5, 5]], np.int32)
    y = np.array([1.0, 0.0], np.float32)
    loss, grads, gx = net.train_step(x, windows, y)

    def at(name, index, step):
        old = getattr(net, name)
        new = old.copy()
        new[index] += step
        setattr(net, name, new)
        v = net.train_step(x, windows, y)[0]
        setattr(net, name, old)
        return v

    for name, index in (("w", (3, 5)), ("w", (2, 45)), ("u", (1, 4)), ("u", (10, 12)), ("u", (9, 40)), ("b", (20,)), ("v", (3, 0)), ("v", (11, 1)), ("c", (0,))):
        want = (at(name, index, 1e-2) - at(name, index, -1e-2)) / 2e-2
        assert grads[name][index] == pytest.approx(want, abs=2e-3), name
    z = x.copy()
    z[2, 1] += 1e-2
    up = net.train_step(z, windows, y)[0]
    z[2, 1] -= 2e-2
    assert gx[2, 1] == pytest.approx((up - net.train_step(z, windows, y)[0]) / 2e-2, abs=2e-3)


def test_windows_cover_every_word():
    words = [" ".join(f"w{k}" for k in range(n)) for n in (1, 15, 16, 17, 32, 33, 48, 49, 200)]
    for text in words:
        t = toxicity.Texts(*toxicity._joined([text]))
        seen = set(t.windows.ravel().tolist()) - {len(t.words)}
        assert seen == set(range(len(t.words)))


# -------------------------------------------------------------- decontamination


def test_toxicity_learns_from_texts_of_bounded_bytes(spark):
    """Whole texts in the order of the hash, of repeated ids the first text; what doesn't fit is left out."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 5 + i)) for i in range(40)] + [(3, "a"), (50, "x " * 50_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 50]], "doc_id long, toxic int")
    least = {}
    for i, t in rows:
        least[i] = min(t, least.get(i, t))
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in least], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for most in (10**9, 2000, 0):
        left, want = most, {}
        for i in order:
            if len(least[i].encode()) <= left:
                left -= len(least[i].encode())
                want[i] = (least[i], i % 2)
        got = toxicity.fit_sample(docs, labels, F.lit(False), fit_bytes=most)
        assert {r.doc_id: (r.text, r.toxic) for r in got} == want and (most < 10**9 or len(got) == 41)


def test_decontamination(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, rng.choice([8, 15, 40, 60, 150]), 5000)) for k in range(25)] + [(90, None), (91, ""), (92, "too short")]
    clean = [(k, prose(rng, rng.randrange(5, 400), 5000)) for k in range(150)]
    full, loose = [], []
    for k, (i, t) in enumerate(items[:25]):
        full.append((1000 + k, prose(rng, rng.randrange(100), 5000) + " " + t.upper().replace(" ", ", ") + " " + prose(rng, rng.randrange(100), 5000), i))
        w = t.split()
        if len(w) >= 40:
            loose.append((2000 + k, prose(rng, 70, 5000) + " " + " ".join(x for j, x in enumerate(w) if j % 6) + " " + prose(rng, 70, 5000), i))
    docs = frame(spark, clean + [(i, t) for i, t, _ in full + loose] + [(5000, None), (5001, ""), (5002, items[3][1] + " x" * 50000)])
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(not got[i] for i, _ in clean) and not got[5000] and not got[5001]
    assert [i for i, _, k in full + loose if k not in got[i]] == []
    assert 3 in got[5002]
    kept = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == [*docs.columns, "leaks"]
    assert decontaminate.matches(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert all(not r.leaks for r in none)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_items_that_many_documents_hold(spark, every):
    rng = random.Random(18)
    items = spark.createDataFrame([(k, prose(rng, n, 5000)) for k, n in enumerate([20, 20, 40])], "item_id long, text string")
    texts = [r.text for r in items.orderBy("item_id").collect()]
    rows = [(k, " ".join([prose(rng, 90, 5000), *(texts if k % every == 0 else []), prose(rng, 90, 5000)])) for k in range(60)]
    for some in (rows, rows[:1]):
        got = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.matches(frame(spark, some), items).collect()}
        assert got == {k: {0, 1, 2} if k % every == 0 else set() for k, _ in some}


def test_rare_pairs_find_what_the_cosine_does_not():
    """Each copy that lacks or replaces as many words as may be missing holds one of the item's rare pairs."""
    rng = random.Random(19)
    for n in (5, 9, 20, 33):
        words = np.array([rng.randrange(1, 12) for _ in range(n)], np.uint64)
        held = set(decontaminate.rare_pairs(words, np.array([rng.random() for _ in words]), 0.7).tolist())
        for _ in range(200):
            copy, missing = words.copy(), rng.sample(range(n), n - -(-7 * n // 10))
            copy[missing] = 99
            for w in (copy, np.delete(words, missing)):
                assert held & set(decontaminate.pairs(w).tolist())
    # no cosine reaches 2, so the pairs alone find the items, the short and the long one
    items = [prose(rng, n, 400) for n in (20, 60)]
    searcher = decontaminate.Searcher([7, 8], decontaminate.hashed(items), np.ones(64, np.float32), np.eye(64, dtype=np.float32), 64, 2.0, 0.7, 0.5)
    found = searcher.search(pa.array([prose(rng, 100), *(prose(rng, k) + " " + " ".join(items) for k in range(0, 90, 7))]))
    assert [[x[0] for x in row] for row in found] == [[]] + [[7, 8]] * 13


def test_repetitive_item_is_confirmed_by_its_words_in_order():
    """14 of 20 words in order that are only 3 of 9 distinct ones."""
    item = decontaminate.hashed(["a " * 12 + "b c d e f g h i"])[0]
    searcher = decontaminate.Searcher([1], [item], np.ones(64, np.float32), np.eye(64, dtype=np.float32), 64, 0.5, 0.7, 0.2)
    assert searcher.confirm(decontaminate.hashed(["a " * 12 + "b c"])[0], 0) is None
    item = decontaminate.hashed(["b c d e f g h " + "a " * 12 + "i"])[0]
    searcher = decontaminate.Searcher([1], [item], np.ones(64, np.float32), np.eye(64, dtype=np.float32), 64, 0.5, 0.7, 0.5)
    assert searcher.confirm(decontaminate.hashed(["h " + "a " * 12 + "i"])[0], 0) == (0.7, 1.0)
    assert searcher.confirm(decontaminate.hashed(["h " + "a " * 12])[0], 0) is None


def test_tiles_of_passages_and_items_change_nothing(monkeypatch):
    """Small tiles find what one large tile finds, by the cosine and by word pairs."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (6, 9, 20, 30, 50, 64, 150, 12, 25, 40)]
    texts = [f"{prose(rng, 70)} {x} {prose(rng, 30)}" for x in items] + [prose(rng, 500), "", " ".join(items)]
    texts += [" ".join(w for k, w in enumerate(x.split()) if k % 6 != 5) for x in items]
    space = np.random.default_rng(3).standard_normal((512, 24)).astype(np.float32)

    def found():
        searcher = decontaminate.Searcher(list(range(10)), decontaminate.hashed(items), np.ones(512, np.float32), space, 64, 0.3, 0.7, 0.5)
        return [[(i, part, answer, at) for i, _, part, answer, at in row] for row in searcher.search(pa.array(texts))]

    whole = found()
    assert all(k in {i for i, *_ in whole[k]} for k in range(10)) and {i for i, *_ in whole[12]} == set(range(10))
    for tile in (1, 3, 7):
        monkeypatch.setattr(decontaminate, "TILE", tile)
        assert found() == whole


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(14)
    items = [(k, prose(rng, 30, 5000)) for k in range(12)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    docs = frame(spark, [(k, prose(rng, 50, 5000) + " " + t) for k, t in items])
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: [k] for k, _ in items}


def test_lcs_equals_the_table():
    rng = random.Random(15)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_svd_spans_what_a_full_one_spans(spark):
    rng = np.random.default_rng(16)
    parts = [rng.integers(0, 40, 20) + 40 * (k % 3) for k in range(60)]
    idf = np.ones(128, np.float32)
    a = np.zeros((60, 128))
    for i, p in enumerate(parts):
        np.add.at(a[i], p, 1)
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    sample = spark.createDataFrame([(p.astype(np.int32).tobytes(),) for p in parts], "data binary")
    space = decontaminate.latent_space(sample, [], idf, rank=3, window=64)
    want = np.linalg.svd(a)[2][:3]
    assert np.linalg.svd(want @ space)[1].min() > 0.95
