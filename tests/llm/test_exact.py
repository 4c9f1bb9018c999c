"""Operators with an exact definition, against brute force and SQL."""

import hashlib
import json
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, hard_rows, table
from wavecrest.llm import lines, neardup, queries, spans, substrings, topk, warc

ROWS = hard_rows()


def sql_rows(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == sql_rows(queries.oracle_sql()[name])


# operator 1


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "http://c/", "y" * 200_000), (6, "http://d/", "café"), (6, "http://d/", "café"), (None, "http://e/", "z"), (None, None, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = f"file://{tmp_path}/w"
    warc.write_archive(df, folder, filebytes="1000")
    back = warc.read_archive(spark, folder)
    rows = back.collect()
    assert len(rows) == len(pages)
    full = {r.record_id: bytes(r.payload) for r in rows if r.record_type == "response"}
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in rows)
    assert kinds["<urn:page:1>", "revisit", "<urn:page:2>"] == 1 and kinds["<urn:page:2>", "response", None] == 1
    assert kinds["<urn:page:3>", "revisit", "<urn:page:4>"] == 1 and kinds["<urn:page:6>", "response", None] == 2
    assert kinds["<urn:page:>", "revisit", "<urn:page:2>"] == 1 and kinds["<urn:page:>", "response", None] == 1
    assert full["<urn:page:5>"] == b"y" * 200_000 and full["<urn:page:6>"] == "café".encode()
    assert {r.payload_bytes for r in rows if r.record_id == "<urn:page:1>"} == {1}


def test_warc_pushdown_skips_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame([(i, f"http://{i % 3}/", f"text {i // 2}") for i in range(20)], "page_id long, url string, html string"), folder)
    found = warc.read_archive(spark, folder).where("record_type = 'revisit' AND target_uri LIKE 'http://1%' AND payload_digest IS NOT NULL")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan
    assert found.count() == sum(1 for i in range(0, 20, 2) if i % 3 == 1)
    reader = warc.WarcReader({"path": folder, "payload": "bytes"})
    reader.tests = [("record_type", "is", "revisit")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10


def test_warc_plain_files_and_bad_digest(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record + record)
    rows = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "response", "response"] and bytes(rows[1].payload) == b"hello" and rows[1].payload_bytes == 5
    assert warc.read_archive(spark, f"file://{tmp_path}/a.warc", payload="skip").where("payload IS NULL").count() == 3
    wrong = record.replace(b"Content-Type", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Type", 1)
    (tmp_path / "a.warc").write_bytes(wrong)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"file://{tmp_path}").count()


def test_warc_length_is_not_pushed_down(tmp_path):
    """Archives from elsewhere state no payload length, so Spark itself tests it, after the payload is read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    length = [IsNotNull(("payload_bytes",)), GreaterThan(("payload_bytes",), 0), EqualTo(("payload_bytes",), 5)]
    assert list(reader.pushFilters([*length, EqualTo(("record_type",), "resource")])) == length
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["payload_bytes"], r["payload"]) for r in found] == [(5, b"hello")]


def test_warc_gzip_members_with_several_records(tmp_path):
    import gzip

    import pyarrow.fs as pafs

    record = lambda i, size: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, size, bytes([65 + i]) * size)
    sizes = [5, 0, 90_000, 7, 1]
    records = [record(i, n) for i, n in enumerate(sizes)]
    whole = gzip.compress(b"".join(records))
    for data in (whole, b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))):
        (tmp_path / "a.warc.gz").write_bytes(data)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as file:
            assert [body() for _, body in warc.records_gz(file)] == [bytes([65 + i]) * n for i, n in enumerate(sizes)]
    (tmp_path / "a.warc.gz").write_bytes(whole[:-40])
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as file, pytest.raises(ValueError, match="cut off"):
        list(warc.records_gz(file))


def test_warc_hard_pages_against_sql(spark, tmp_path):
    """A very long payload, ties, null and repeated ids, and extra columns with the names of the archive's own."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    long = "é<p>" + "abcdefghij" * 1_500_000
    pages = [(1, "x"), (2, "x"), (2, "x"), (3, None), (4, ""), (5, long), (6, long), (None, "x"), (None, "only"), (None, "only"), (7, "y\r\n\r\nWARC/1.0\r\n")]
    n = len(pages)
    clash = {c: [str(i) for i in range(n)] for c in ("record_type", "payload_digest", "payload", "refers_to")} | {"payload_bytes": list(range(n))}
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [f"http://{i}/" for i in range(n)], "html": [p[1] for p in pages], **clash}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    got = con.execute(warc.OP1_SQL)
    names = [d[0] for d in got.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()), key=repr)
    rows = warc.op1_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((tuple(r[c] for c in sorted(names)) for r in rows), key=repr) == want and len(want) == n


def test_warc_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    made = json.loads(next((tmp_path / "e").glob("_files-*.json")).read_text())
    assert made == []


# operator 2


def brute_substrings(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (doc_id, *_), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [3000, 1])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = substrings.remove_substrings(table(spark, ROWS, extra=True), length=256)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_substrings(ROWS, 256)


def test_substrings_long_text(spark):
    long = next(r[1] for r in ROWS if r[0] == 306)
    rows = [*ROWS, (900, long + long[:3000], None, None, None)]
    got = substrings.remove_substrings(table(spark, rows), length=300, with_text=True, piece=1000)
    assert sorted(map(tuple, got.drop("kept_bytes").collect()), key=repr) == brute_substrings(rows, 300)
    assert all(r.kept_bytes is None or hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == r.kept_sha256 for r in got.collect())


# operator 5


def brute_components(rows, width, percent):
    sets = defaultdict(set)
    per_row = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        s = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        per_row.append((doc_id, s))
        if doc_id is not None:
            sets[doc_id].add(frozenset(s))
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in per_row), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    got = neardup.near_duplicates(table(spark, ROWS, extra=True), width=width)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(ROWS, width, 80)


def test_near_duplicate_chains_and_blocks(spark, monkeypatch):
    """A chain whose ends aren't alike is one group; buckets in several blocks give the same."""
    import random

    from tests.llm.helpers import words

    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(5)
    w, rows = words(rng, 120).split(), []
    for i in range(30):
        rows.append((1000 - i, " ".join(w), None, None, None))
        for _ in range(2):
            w[rng.randrange(len(w))] = words(rng, 1)
    got = neardup.near_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 5, 80)


def exact_links(docs, width):
    """All linked pairs of different texts, by prefix filtering: sets at 0.8 share one of their rarest fifth of shingles."""
    sets = {d: frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)]) for d, t in docs if (w := (t or "").encode().lower().split())}
    count = Counter(x for s in sets.values() for x in s)
    holders, found = defaultdict(list), set()
    for d, s in sorted(sets.items(), key=lambda x: len(x[1])):
        order = sorted(s, key=lambda x: (count[x], x))
        seen = set()
        for x in order[: len(s) - -(-80 * len(s) // 100) + 1]:
            for other in holders[x]:
                if other not in seen:
                    seen.add(other)
                    shared = len(s & sets[other])
                    if 100 * shared >= 80 * (len(s) + len(sets[other]) - shared):
                        found.add((min(d, other), max(d, other)))
            holders[x].append(d)
    return found


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_lose_no_link(spark, width):
    """Components of the exact links of 3,000 documents of the largest table, found one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    links = exact_links(rows, width)
    label = {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=width).collect()}
    assert len(links) > 100 and got == {d: root(d) for d, _ in rows}


def test_near_duplicates_of_repeated_ids(spark):
    """A doc_id with two texts of equally many shingles links what each of them is linked with."""
    import random

    from tests.llm.helpers import words

    rng = random.Random(3)
    one, two = words(rng, 60), words(rng, 60)
    rows = [(d, t, None, None, None) for d, t in ((9, one), (9, two), (4, one + " more"), (7, two + " more"), (8, words(rng, 60)), (8, words(rng, 60)))]
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, rows)).collect()))
    assert got == brute_components(rows, 5, 80)
    assert {c for d, _, c, _ in got if d in (4, 7, 9)} == {4}


def test_near_duplicate_rows_are_linear(spark, monkeypatch):
    """Classes that share a band without being linked reach the last stage as one row each, however many blocks there are."""
    import random

    from tests.llm.helpers import words
    from wavecrest.llm._scratch import Scratch

    monkeypatch.setattr(neardup, "BLOCK", 4)
    counted, cut = {}, Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name: counted.__setitem__(name, (out := cut(self, df, name)).count()) or out)
    rng = random.Random(11)
    base = words(rng, 100).split()
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.sample(range(100), 4):
            w[k] = words(rng, 1) + str(i)
        rows.append((i, " ".join(w), None, None, None))
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows, 5, 80)
    assert 0 < counted["blocked"] <= counted["members"]


# operator 6


def brute_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        k = line.strip(b" \t\n\x0b\x0c\r")
        return k.lower() if len(k.decode()) >= min_chars else None

    split = [(d, (t or "").encode().split(b"\n")) for d, t, *_ in rows]
    holders = defaultdict(set)
    for d, ls in split:
        for line in ls:
            if d is not None and key(line) is not None:
                holders[key(line)].add(d)
    out = []
    for d, ls in split:
        stay = [x for x in ls if d is None or key(x) is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(ls), len(ls) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 27, None])
def test_lines(spark, bits):
    """A filter that is much too small lets more through and changes nothing."""
    got = lines.dedup_lines(table(spark, ROWS, extra=True), bits=bits, digest_only=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(ROWS)


def test_lines_keep_columns(spark):
    df = table(spark, ROWS, extra=True)
    out = lines.dedup_lines(df)
    assert set(out.columns) == set(df.columns) | {"n_lines", "n_dropped", "kept_text"}
    assert out.where("n_dropped = 0 AND kept_text <> coalesce(text, '')").count() == 0


# operator 7


def test_top_k_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [((i * 7 + d * 3) % 11 - 5) / 8 for d in range(6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)]
    vectors += [(2000, None), (2100, [nan] * 6), (2200, [None, 1.0, 0.0]), (2300, [inf] * 6), (2400, []), (2500, [1.0, 2.0]), (None, [1.0] * 6), (100, [0.25] * 6), (2600, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k=5).collect()))
    import math

    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = defaultdict(list)
    for q, a in [(q, tuple(a)) for q, a in fine if q % 100 == 0]:
        want[q] += [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b)]
    expected = sorted((q, r + 1, i, -s) for q, found in want.items() for r, (s, i) in enumerate(sorted(found)[:5]))
    assert got == expected


def test_top_k_repeated_rows_against_sql(spark, tmp_path, monkeypatch):
    """Equal rows, rows that share an id, one vector that many ids hold, in several blocks of queries."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.75]) for _ in range(8)]) for i in range(0, 420, 7)]
    rows += [(100, [0.5] * 8)] * 3 + [(100, [0.25] * 8), (200, [0.5] * 8), (0, rows[0][1])] + [(1000 + i, [0.5] * 8) for i in range(60)] + [(700, None), (800, [0.1, None])]
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(topk.OP7_SQL)
    names = [d[0] for d in got.description]
    want = sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in got.fetchall())
    assert sorted(map(tuple, topk.op7_top_k(spark, f"file://{tmp_path}").collect())) == want and want


def test_top_k_large_values(spark):
    vectors = [(i, [(-1.0) ** i * 2.0**13 * (i + d) for d in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, k=3).collect()))
    q = [int(1024 * x) for x in vectors[0][1]]
    found = sorted((-sum(a * int(1024 * b) for a, b in zip(q, v, strict=True)), i) for i, v in vectors[1:])[:3]
    assert got == [(0, r + 1, i, -s) for r, (s, i) in enumerate(found)]


# operator 9


def brute_parts(text):
    """(end offset, words) of each part, cut word by word."""
    import re

    import xxhash

    found = list(re.finditer(rb"[^\x20\x09-\x0d]+", text))
    stops = [re.search(rb"[.!?][\"')\]]*$", m[0]) is not None for m in found]
    hashes = [xxhash.xxh3_64_intdigest(m[0].lower()) & ~1 | s for m, s in zip(found, stops, strict=True)]
    ends = [m.end() for m in found]
    for k, m in enumerate(found):
        gap = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        if b"\n" in gap:
            stops[k], ends[k] = True, m.end() + gap.rindex(b"\n") + 1
    if found:
        stops[-1], ends[-1] = True, len(text)
    cuts, first = [], 0
    for k, stop in enumerate(stops):
        if stop:
            begins = {max(range(i, i + 9), key=lambda j: (-(hashes[j] >> 32), j)) for i in range(first + 1, k - 7)}
            cuts += [j for j in range(first + 1, k + 1) if j in begins] + [k + 1]
            first = k + 1
    return [(ends[b - 1], b - a) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []


def brute_spans(rows):
    """Repeated runs by their normalised texts."""
    cut = []
    for d, t, *_ in rows:
        text = (t or "").encode()
        parts = brute_parts(text)
        ends, n = [e for e, _ in parts], [w for _, w in parts]
        starts = [0, *ends[:-1]][: len(ends)]
        cut.append((d, text, [text[a:b] for a, b in zip(starts, ends, strict=True)], n))
    places = defaultdict(list)
    for number, (d, _, parts, n) in enumerate(cut):
        if d is None:
            continue
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                total = sum(n[a : b + 1])
                shortest = b - a == 1 or total - n[a] < 15 or total - n[b] < 15
                if total >= 15 and shortest:
                    places[tuple(b" ".join(p.lower().split()) for p in parts[a : b + 1])].append((d, a, b, number))
    gone = defaultdict(set)
    for found in places.values():
        first = min((d, a) for d, a, _, _ in found)
        if len({(d, a) for d, a, _, _ in found}) > 1:
            for d, a, b, number in found:
                if (d, a) != first:
                    gone[number].update(range(a, b + 1))
    out = []
    for number, (d, text, parts, _) in enumerate(cut):
        kept = b"".join(p for k, p in enumerate(parts) if k not in gone[number]) if parts else text
        out.append((d, len(parts), len(gone[number]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sentence_rows():
    import random

    from tests.llm.helpers import words

    rng = random.Random(9)
    passage = " ".join(words(rng, rng.randint(3, 9)).capitalize() + "." for _ in range(9))
    rows = list(ROWS)
    for i in range(5):
        rows.append((500 + i, f"{words(rng, 4)} {words(rng, 9)}. {words(rng, 7)}. {passage} {words(rng, 12)}. End{i}.", "en", "s0", 1))
    rows.append((600, passage + " " + passage, "en", "s0", 1))
    return rows


def test_sentence_spans(spark):
    rows = sentence_rows()
    got = spans.remove_repeats(table(spark, rows, extra=True), digest_only=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_spans(rows)
    assert {r.doc_id for r in got.where("n_removed > 4").collect()} >= {501, 502, 503, 504, 600}
    assert got.where("doc_id = 500 AND n_removed > 0").count() == 0


def test_sentence_spans_inside_sentences(spark):
    """Every repeated passage of 48 words is found that begins and ends inside a sentence, with any stops or none."""
    import random

    rng = random.Random(48)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, places = [], {}
    for i in range(120):
        passage = [word() + ("." if rng.random() < 0.12 * (i % 3) else "") for _ in range(48)]
        for d in (i, 1000 + i):
            before = [word() for _ in range(rng.randint(0, 30))]
            rows.append((d, " ".join([*before, *passage, *(word() for _ in range(rng.randint(0, 30)))]), "en", "s0", 1))
            places[d] = passage
    got = {r.doc_id: r for r in spans.remove_repeats(table(spark, rows)).collect()}
    assert all(got[i].n_removed == 0 and got[1000 + i].n_removed > 0 for i in range(120))
    for i in range(120):
        left = set(got[1000 + i].kept_text.split()) & set(places[1000 + i])
        assert len(left) <= 16 + 17


def test_sentence_parts():
    text = b"\n\n One two.  \n \n" + b" ".join(b"%d" % k for k in range(100)) + b" (end!\") x x x x x x x x x x x x x x x x x x x x \n"
    ends, n, _ = spans.sentences(text)
    parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert b"".join(parts) == text and [len(p.split()) for p in parts] == n.tolist() and n.max() <= spans.PART
    assert parts[0] == b"\n\n One two.  \n \n" and any(p.endswith(b'(end!")') for p in parts)


# all of them on an empty table


def test_empty_tables(spark):
    empty = table(spark, [])
    assert substrings.remove_substrings(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert spans.remove_repeats(empty).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
