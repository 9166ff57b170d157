"""Centroid clusters, page archives and periodic runs against plain versions of themselves."""

import base64
import gzip
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from ridgelog.llm import warc
from ridgelog.llm.centroids import cluster_vectors, clustered
from ridgelog.llm.ntt import squared_differences
from ridgelog.llm.periods import collapsed, periodic_runs, run_report
from ridgelog.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


# centroid clusters


def plain_clusters(rows, clusters, rounds, dim, scale=1024, salt="3:"):
    kept = [(i, [math.floor(scale * c) for c in x]) for i, x in rows if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, x in kept:
            own[near(x)[1]].append(x)
        centroids = [[sum(col) // len(o) for col in zip(*o)] if o else c for o, c in zip(own, centroids)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = [sum(d for _, d, k in found if k == c) for c in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), marks[k]) for i, d, k in found), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_clusters_odd_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.5, -0.001, 0.0, 0.25, 3.0]) for _ in range(3)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5]), (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 0.0]), (105, [1.0, float("inf"), 0.0]), (106, [1.0] * 4)]
    frame = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<double>, cluster string")
    for clusters, rounds in ((8, 10), (3, 0), (1, 2), (100, 4)):
        assert got(clustered(frame, clusters=clusters, rounds=rounds, dim=3)) == plain_clusters(rows, clusters, rounds, 3)


def test_clusters_empty_and_far(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustered(empty).collect() == []
    rows = [(1, [1e300, 0.0]), (2, [131072.0, -131072.0]), (3, [-131072.0, 131072.0]), (4, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(clustered(frame, clusters=2, dim=2)) == plain_clusters(rows[1:], 2, 10, 2)  # exact to the end of the range


def test_clusters_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert got(QUERIES["op11_centroid_clusters"](spark, SF)) == plain_clusters(rows, 8, 10, 64)


def test_clusters_keep_two_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ridgelog.llm.centroids.scratch_path", lambda s, label: str(tmp_path / f"{label}-{len(os.listdir(tmp_path))}-{random.random()}"))
    found = cluster_vectors(table(spark, SF, "embeddings"), rounds=5)
    assert len(os.listdir(tmp_path)) == 1 and sum(found.rows) == found.state.count()
    # the stored products are those of the final centroids
    for r in found.state.limit(20).collect():
        assert r["dots"] == [sum(int(a) * b for a, b in zip(np.frombuffer(r["x"], "<i4"), c)) for c in found.centroids]


# page archives


def plain_archive(rows, least=0):
    first = {}
    for page_id, url, html in rows:
        body = (html or "").encode()
        key = (page_id is None, page_id or 0, url is None, url or "")
        if len(body) >= least:
            first[body] = min(first.get(body, key), key)
    out, used = [], set()
    for page_id, url, html in rows:
        body = (html or "").encode()
        key = (page_id is None, page_id or 0, url is None, url or "")
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) < least or first[body] == key and body not in used:
            used.add(body)
            out.append((page_id, len(body), digest, "response", None))
        else:
            out.append((page_id, len(body), digest, "revisit", None if first[body][0] else first[body][1]))
    return sorted(out, key=repr)


ODD_PAGES = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://a.example/?q=a b\r\nX: y", "<p>one</p>"),
    (2, "http://a.example/?q=a b\r\nX: y", "<p>one</p>"),
    (3, None, None),
    (4, "", ""),
    (None, "http://b.example/", "only here"),
    (None, None, "<p>one</p>"),
    (5, "http://ä.example/ü", "ä\r\n\r\nWARC/1.1\r\n\0" * 20),
    (5, "http://other.example/", "another"),
    (6, "http://c.example/", "x" * 3_000_000),
    (7, "http://c.example/", "random " + "".join(map(str, range(200_000)))),
]
PAGE = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize("least", [0, 1, 11])
def test_archive_odd_pages(spark, tmp_path, least):
    rows = ODD_PAGES + [(50 + i, "http://h.example/", "same") for i in range(9)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], PAGE)
    path = str(tmp_path / "a")
    manifest = warc.write_archive(frame, path, least=least, roll_bytes=2000)
    assert manifest["records"] == len(rows) and len(manifest["files"]) > 2
    back = warc.read_archive(spark, path)
    assert got(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain_archive(rows, least)
    bodies = {(r["page_id"], r["payload"].decode()) for r in back.where("record_type = 'response'").collect()}
    assert {(p, h or "") for p, _, h in rows} >= bodies and {b for _, b in bodies} == {h or "" for _, _, h in rows}
    ids = {r["record_id"] for r in back.where("record_type = 'response'").collect()}
    assert all(r["refers_to_record"] in ids for r in back.where("record_type = 'revisit'").collect())
    assert back.select("record_id").distinct().count() == len(rows)
    assert sorted(os.listdir(path)) == sorted(n for n in os.listdir(path) if n.endswith((".warc.gz", ".crc")) or n == warc.MANIFEST)


def test_archive_files_are_plain_gzip_and_equal(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "x") for r in ODD_PAGES], PAGE)
    seen = []
    for name in ("a", "b"):
        manifest = warc.write_archive(frame, str(tmp_path / name), roll_bytes=500)
        files = {f["name"]: (tmp_path / name / f["name"]).read_bytes() for f in manifest["files"]}
        for f in manifest["files"]:
            whole = gzip.decompress(files[f["name"]])
            assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"\r\nWARC-Record-ID: ") == len(list(warc.records(files[f["name"]])))
        seen.append(files)
    assert seen[0] == seen[1]
    order = [r["page_id"] for r in warc.read_archive(spark, str(tmp_path / "a")).orderBy("record_id").collect()]
    assert len(order) == len(ODD_PAGES)


def test_archive_long_record_ends_in_zero():
    for n in (1, 1 << 24, (1 << 24) + 5):
        data = warc._member(b"a" * n, 1) + b"\0"
        assert gzip.decompress(data) == b"a" * n
        assert data[-1] == 0


def test_archive_hot_payload_is_shuffled_once(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", "copy" if i % 3 else f"page {i}") for i in range(3000)] + [(9000, "u", "whole row")] * 500
    frame = spark.createDataFrame([(*r, "x") for r in rows], PAGE)
    path = str(tmp_path / "a")
    warc.write_archive(frame, path)
    assert got(warc.read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain_archive(rows)
    sorted_rows, total = warc._sorted_rows(frame.select("page_id", "url", "html"), 0, "page_id", "url", "html")
    assert total == 3500 and sorted_rows.where("kind = 1 AND digest = sha1('copy')").count() == 1 and sorted_rows.where("kind = 1 AND digest = sha1('whole row')").count() == 1


def test_archive_commit_is_finished_later(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(*r, "x") for r in ODD_PAGES], PAGE)
    path, finish = str(tmp_path / "a"), warc._finish
    with monkeypatch.context() as m:  # the driver dies before the files are moved
        m.setattr(warc, "_finish", lambda *a: None)
        warc.write_archive(frame, path, roll_bytes=500)
    with pytest.raises(FileNotFoundError):
        warc.read_archive(spark, path)
    with pytest.raises(FileExistsError):
        warc.write_archive(frame, path)
    staged = next((tmp_path / "a" / warc._STAGING).glob("file=*/part-*"))
    os.rename(staged, tmp_path / "a" / f"pages-{staged.parent.name.partition('=')[2]}.warc.gz")  # or in the middle of it
    assert finish and warc.recover(spark, path) and not warc.recover(spark, path)
    assert warc.read_archive(spark, path).count() == len(ODD_PAGES)
    victim = next((tmp_path / "a").glob("*.warc.gz"))
    victim.write_bytes(victim.read_bytes()[:-1])
    with pytest.raises(FileNotFoundError):
        warc.read_archive(spark, path)


def test_archive_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGE), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).collect() == []


# periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text, plant):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_against_every_period():
    rnd = random.Random(11)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(1, 12)):
            n, letters = rnd.randint(0, rnd.choice([1, 6, 9, 40, 200])), rnd.choice([1, 2, 3, 40])
            w = [rnd.randrange(letters) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 6 else 0):
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 3))
                for i in range(a, rnd.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        assert periodic_runs([np.array(w, np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_correlation_is_exact():
    rng = np.random.default_rng(3)
    for block in (1, 2, 8, 64):
        for most in (2, 1 << 20, 1 << 23):
            text = rng.integers(0, most, (5, 2 * block))
            pattern = np.stack([text[j, j % block : j % block + block] if j % 2 else rng.integers(0, most, block) for j in range(5)])
            zero = squared_differences(pattern, text)
            assert zero.tolist() == [[(pattern[j] == text[j, t : t + block]).all() for t in range(block)] for j in range(5)]


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "x y " * 7), (4, "x y " * 7), (5, "A a A a A a A a"), (6, "to be or " * 5 + "not not not not not not"), (7, "\x0ba\x0cb\ta\nb\ra b a b"), (8, "z" * 100_000)]
    rows += [(i, " ".join(f"w{j % 7}" for j in range(60))) for i in range(100, 140)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    for plant in (False, True):
        assert got(run_report(frame, plant=plant)) == sorted((plain_report(*r, plant) for r in rows), key=repr)
    assert run_report(frame.limit(0)).collect() == []
    back = {r["doc_id"]: r["text"] for r in collapsed(frame).collect()}
    assert back[6] == "to be or not" and back[1] is None and back[3] == " \t\n" and back[None] == "a" and collapsed(frame).columns == frame.columns


def test_runs_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    expected = {plain_report(*r, True) for r in short}
    assert expected <= set(got(QUERIES["op13_periodic_runs"](spark, SF))) and any(r[1] for r in expected)


def test_runs_take_time_in_proportion():
    import time

    spent = []
    for n in (40_000, 160_000):
        fib, other = [0], [0, 1]
        while len(other) < n:
            fib, other = other, other + fib
        begun = time.process_time()
        assert periodic_runs([np.array(other[:n]), np.zeros(n, np.int64)])[1] == [(0, n, 1)]
        spent.append(time.process_time() - begun)
    assert spent[1] < 12 * spent[0]
