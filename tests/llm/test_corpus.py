"""Near-duplicates, decontamination, licenses, shards, conversations: whole tables against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelog.llm.bktree import BKTree
from ridgelog.llm.chat import as_mails, format_conversations
from ridgelog.llm.components import components
from ridgelog.llm.decontam import WINDOW, build_index, clean_documents, contamination, proximity_matches, read_benchmark
from ridgelog.llm.licenses import CONTAINED, SHINGLE, TEMPLATES, band_settings, scan_licenses, template_table
from ridgelog.llm.shards import minimax_starts, shard_documents
from ridgelog.llm.simhash import fingerprint, near_duplicates, one_of_each

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# -- near-duplicates


def brute_components(prints):
    label = list(range(len(prints)))
    prints = np.array(prints, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            near = np.nonzero(np.bitwise_count(prints ^ prints[i]) <= 2)[0]
            least = min(label[j] for j in near)
            for j in near:
                changed |= label[j] != least
                label[j] = least
    return label


@pytest.mark.parametrize("n", [1, 2, 400])
def test_tree_finds_all_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(n)]
    values = np.unique(base[rng.integers(len(base), size=n)] ^ np.array(flips))
    found = {(int(i), int(j)) for a, b in BKTree(values).links(2) for i, j in zip(a, b)}
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(distance <= 2)) if i < j}


def test_fingerprints_by_definition():
    import xxhash

    for text in ("A b", "a b c", "A  b\tc d a b c", "é x y z z z z"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text.encode()) == bits
    assert fingerprint(None) == fingerprint(b" \n") == 0


@pytest.mark.parametrize("bucket_most", [1, 8, 512])
def test_groups_equal_brute_force(spark, bucket_most):
    """Chains, copies, texts without words; small buckets send everything the way of hot buckets."""
    rng = random.Random(bucket_most)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    rows, text = [(None, None, "x"), (900, "", "x"), (901, None, "x")], [word() for _ in range(300)]
    for k in range(150):
        if k % 10 == 0:
            text = [word() for _ in range(rng.randrange(1, 300))]
        rows.append((k, " ".join(text), "x"))
        text = list(text)
        text[rng.randrange(len(text))] = word()
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    prints = [fingerprint(t.encode() if t else None) for _, t, _ in rows]
    label = brute_components(prints)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    expected = sorted(((r[0] if r[0] is not None else -1), format(p, "016x"), least[c]) for r, p, c in zip(rows, prints, label))
    found = near_duplicates(docs, bucket_most=bucket_most, shard_rows=16).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in found) == expected
    assert 10 < len(set(label)) < 140
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_groups_without_rows_and_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "p q r s t u v")], "doc_id long, text string")
    assert near_duplicates(docs.where("false")).count() == 0 and one_of_each(docs.where("false")).count() == 0
    assert [r["component_id"] for r in near_duplicates(docs).collect()] == [None] * 3
    assert sorted(r["text"] for r in one_of_each(docs).collect()) == ["a b c d", "p q r s t u v"]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (0, 1)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in found} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert len(found) == 63


# -- decontamination


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + WINDOW]), set()).add(item)
    for doc, text in docs:
        w, hit, held = words_of(text), set(), set()
        for z in {len(x) for x in windows}:
            for k in range(len(w) - z + 1):
                if found := windows.get(tuple(w[k : k + z])):
                    hit |= set(range(k, k + z))
                    held |= found
        ids = sorted(str(i) for i in held if i is not None)
        yield doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "the", "B", "é", "c1", "zz", "of", "x-y"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 10, 11, 14])))) for k in range(12)] + [(None, "zz zz zz"), (50, None), (51, "..."), (3, "of of")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 60))), "x") for k in range(80)]
    docs += [(200 + k, f"lead {items[k % 12][1].upper()}, tail " * rng.randrange(1, 4), "x") for k in range(30)] + [(None, "zz zz zz", "x"), (None, None, "x"), (7, "", "x")]
    docs += docs[:30]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = list(brute_contamination([d[:2] for d in docs], items))
    assert _sorted(contamination(frame, bench).collect()) == _sorted(expected)
    clean = clean_documents(frame, bench)
    assert clean.columns == frame.columns and _sorted(clean.collect()) == _sorted(d for d, e in zip(docs, expected) if not e[5])


def test_contamination_on_tables(spark, documents):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    expected = list(brute_contamination([(r["doc_id"], r["text"]) for r in documents.collect()], [tuple(r) for r in bench.collect()]))
    assert _sorted(contamination(documents, bench).collect()) == _sorted(expected) and any(e[5] for e in expected)


def test_contamination_without_rows(spark, documents):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert contamination(documents.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in contamination(documents, bench.where("false")).collect()} == {0}
    assert clean_documents(documents, bench.where("false")).count() == documents.count()


def brute_near(docs, items, slop):
    """Per document the items with a window of which every word stands within ``slop`` of its place, for one start of all."""
    windows = [(i, w[k : k + WINDOW]) for i, t in items for w in [words_of(t)] if w for k in range(max(1, len(w) - WINDOW + 1))]
    for _, text in docs:
        words, near = words_of(text), set()
        for item, window in windows:
            for low in range(-slop, len(words)):
                if all(w in words[max(0, low + at) : max(0, low + at + slop + 1)] for at, w in enumerate(window)):
                    near.add(item)
        yield len(near - {None})


def test_proximity_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "the", "B", "é", "c1", "zz", "of"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 10, 12])))) for k in range(14)] + [(None, "zz of a"), (60, "only here"), (61, "")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 40)))) for k in range(40)] + [(None, None), (None, "a of zz"), (2, ""), (90, "here the only")]
    for k in range(24):
        moved = items[k % 14][1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(moved))
            moved[at : at + 2] = rng.choice([moved[at : at + 2][::-1], [moved[at], "between", *moved[at + 1 : at + 2]], moved[at + 1 : at + 2] or ["x"]])
        docs.append((100 + k, "before " * rng.randrange(3) + " ".join(moved)))
    docs += docs[:4]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        found = contamination(frame, bench, slop=slop)
        expected = [(*d[:1], n) for d, n in zip(docs, brute_near(docs, items, slop))]
        assert _sorted(found.select("doc_id", "n_near").collect()) == _sorted(expected)
        exact = found.where("n_near <> n_items").count()
        assert exact == 0 if slop == 0 else exact > 0
    assert found.drop("n_near").columns == contamination(frame, bench).columns


def test_proximity_by_examples(spark):
    """Other words between, words in another order, and a missing word, for a window of three."""
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    texts = ["red green blue", "red x green blue", "red x x green blue", "red x x x green blue", "green red blue", "green blue", "blue red green", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {slop: {r["doc_id"] for r in contamination(docs, bench, slop=slop).where("n_near = 1").collect()} for slop in (0, 1, 2, 3)}
    assert near == {0: {0}, 1: {0, 1}, 2: {0, 1, 2, 4}, 3: {0, 1, 2, 3, 4, 6}}
    assert contamination(docs, bench.where("false"), slop=2).where("n_near = 0").count() == len(texts)
    read = read_benchmark(bench)
    lows = proximity_matches(build_index(docs, read), read, 2)
    assert lows.columns == ["id_key", "text_key", "window", "low"] and {(r["id_key"], r["low"]) for r in lows.collect()} == {(0, -2), (0, -1), (0, 0), (1, -1), (1, 0), (2, 0), (4, -1)}


def test_decontamination_stays_native(spark, documents):
    rows = contamination(documents, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# -- licenses


def brute_licenses(docs, templates=TEMPLATES):
    grams = lambda w: {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    for doc, text in set(docs):
        w, best = words_of(text), {}
        for license_, template in templates:
            t = words_of(template)
            wide = max(8, 1 << (len(t) - 1).bit_length())
            for k in range(0, max(1, len(w)), wide):
                share = len(grams(t) & grams(w[k : k + 2 * wide])) / len(grams(t))
                if share >= CONTAINED:
                    best[license_] = max(best.get(license_, (0, 0)), (share, -k))
        for license_, (share, k) in best.items():
            yield doc, license_, share, -k


def test_licenses_equal_brute_force(spark, documents):
    rng = random.Random(2)
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(None, None), (1000, ""), (1001, "MIT"), (None, "x Released under the mit license")]
    for k in range(60):
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((2000 + k, " ".join(["pad"] * rng.randrange(50) + words + ["end"] * rng.randrange(5))))
    docs += docs[:5]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    expected = list(brute_licenses(docs))
    assert _sorted(scan_licenses(frame, template_table(spark)).collect()) == _sorted(expected) and len(expected) > 20


def test_licenses_without_rows(spark, documents):
    assert scan_licenses(documents.where("false"), template_table(spark)).count() == 0
    assert scan_licenses(documents, template_table(spark, [])).count() == 0
    assert scan_licenses(documents, template_table(spark, [("short", "four words only here"), (None, "a b c d e f"), ("x", None)])).count() == 0


def test_bands_guarantee_retrieval():
    for words in (8, 16, 64):
        s = band_settings(words)
        template, window = words // 2 - 3, 2 * words - 4
        shared = max(1, CONTAINED * template)
        assert (1 - shared / (template + window - shared)) ** s.bands <= 1e-6


def test_one_shingle_notices_are_not_missed(spark):
    """At a miss rate of 1e-6 a window, 20,000 different windows lose none but for a chance of 0.02."""
    word = lambda k: F.hex(F.xxhash64("doc_id", F.lit(k)))
    text = F.concat_ws(" ", *[word(k) for k in range(6)], F.lit(TEMPLATES[0][1]), *[word(k) for k in range(6, 19)])  # whole in one window only
    docs = spark.range(0, 20000, numPartitions=4).select(F.col("id").alias("doc_id")).withColumn("text", text)
    assert scan_licenses(docs, template_table(spark, TEMPLATES[:1])).count() == 20000


# -- shards


def brute_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, used, free = (low + high) // 2, 1, None
        free = middle
        for s in sizes:
            if s > free:
                used, free = used + 1, middle
            free -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("stretches", [4, 64, 8192])
@pytest.mark.parametrize("shards", [1, 3, 16])
def test_minimax_equals_brute_force(spark, stretches, shards):
    rng = random.Random(shards * stretches)
    for sizes in ([1], [5, 1, 1, 1], [rng.randrange(1, 2000) for _ in range(500)], [10] * 100 + [5000] + [1] * 300):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
        groups = spark.createDataFrame([(int(s),) for s in starts], "start long")
        capacity, cuts = minimax_starts(groups, sum(sizes), max(sizes), shards, stretches)
        assert capacity == brute_capacity(sizes, shards)
        assert set(cuts) <= set(starts) | {sum(sizes)} and len(cuts) == shards
        assert max(b - a for a, b in zip(cuts, [*cuts[1:], sum(sizes)])) == capacity


def test_shards_of_documents(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["é" * rng.randrange(200), "copy of a text", f"t{k}"]), k) for k in range(400)] + [(None, "lost", 1), (None, None, 2), (5, None, 3), (5, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    found = shard_documents(docs, 16).collect()
    assert len(found) == len(rows) and {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    size = lambda t: len((t or "").encode()) + 1
    expected = sorted(((i if i is not None else -1), size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in found) == expected
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append((i, size(t)))
    key = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    ids = lambda g: [i for i, _ in g if i is not None]
    order = sorted(groups, key=lambda t: (min(ids(groups[t]), default=-1), key(t)))
    sums = {}
    for r in found:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) == brute_capacity([sum(s for _, s in groups[t]) for t in order], 16) and set(sums) <= set(range(16))
    for shard in sums:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert shard_documents(docs.where("false")).count() == 0
    assert [r["shard"] for r in shard_documents(docs.where("doc_id = 7")).collect()] == [0]


# -- conversations


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there\n\nSecond  line"), (1, 1, "assistant", "> hello   THERE\n\nYes"), (1, 2, "user", ">> Hello there\n> Yes\nthanks"),
        (1, 3, "user", "> Second line\r\n> unknown\nmore"), (1, 4, "user", "no quote"), (1, None, "user", "> Hello there"), (None, 0, "user", "> Hello there"),
        (2, 0, "user", "> Hello there"), (2, 1, "user", None), (2, 2, "user", ""), (3, 0, "user", "same"), (3, 1, "user", "same"), (3, 2, "user", "> same\nx"),
    ]
    rows += [rows[1]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, own string")
    found = {(r["conv_id"], r["turn"]): tuple(r)[3:9] for r in format_conversations(frame).collect()}
    assert format_conversations(frame).count() == len(rows)
    assert found[1, 0] == ("Hello there\n\nSecond  line", None, 0, 0, 0, 0)
    assert found[1, 1] == ("Yes", 0, 0, 1, 1, 2)  # the row is there twice
    assert found[1, 2] == ("thanks", 1, 0, 2, 2, 2)
    assert found[1, 3] == ("more", 0, 0, 1, 2, 1)
    assert found[1, 4] == ("no quote", None, 4, 0, 0, 0)
    assert found[1, None] == ("", None, None, 0, 1, 0) and found[None, 0] == ("", None, 0, 0, 1, 0)
    assert found[2, 0] == ("", None, 0, 0, 1, 0) and found[2, 1] == ("", None, 1, 0, 0, 0)
    assert found[3, 2] == ("x", 1, 1, 1, 1, 1)
    assert format_conversations(frame.where("false")).count() == 0


def test_long_conversation_takes_the_latest_original(spark):
    """A line that returns in far blocks of a conversation."""
    from ridgelog.llm.chat import line_hashes, link_quotes, quoted_lines

    rows = [(1, t, "user", "yes" if t in (0, 7, 40) else "> yes" if t in (3, 7, 9, 39, 41, 90) else f"t{t}") for t in range(100)]
    rows[7] = (1, 7, "user", "> yes\nyes")
    parsed = quoted_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for block in (4, 1024):
        assert {r["turn"]: r["quoted_turn"] for r in link_quotes(line_hashes(parsed), block).collect()} == {3: 0, 7: 0, 9: 7, 39: 7, 41: 40, 90: 40}


def test_mails_are_taken_apart_as_they_were_written(spark):
    """Lone carriage returns, own lines that look like quotes or escapes, gaps, nulls and repeated rows."""
    texts = ["one\rtwo", "> mine\n\\> and this\n  >> too", "x\r\n\r\ny\n", " \t", "", None, "\\\\> three\r> four", "tail\n\n", "last"]
    rows = [(1, t, "user", x) for t, x in enumerate(texts)] + [(1, 20, "user", "after a gap"), (2, 0, "user", "a"), (2, 1, "user", "b"), (None, 3, "user", "> n"), (2, None, "user", "t")]
    rows += [(3, t, "user", f"copy {t}") for t in range(3) for _ in range(3)]
    mails = as_mails(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = format_conversations(mails).collect()
    assert len(found) == len(rows) == mails.count()
    expected = sorted((c, t, (x or "").strip(" \t\r\n")) for c, t, _, x in rows if c and t is not None)
    assert sorted((r["conv_id"], r["turn"], r["own"]) for r in found if r["conv_id"] and r["turn"] is not None) == expected
    at = {(r["conv_id"], r["turn"]): r for r in found}
    assert [at[1, t]["reply_to"] for t in range(9)] == [None, 0, 1, 2, 2, None, None, 6, 7] and at[1, 20]["reply_to"] is None
    assert [(at[3, t]["root"], at[3, t]["position"], at[3, t]["depth"]) for t in range(3)] == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert at[1, 2]["n_quoted"] == 3 + 2 and at[1, 2]["n_linked"] == 5


def test_a_common_line_in_a_known_quote_links_nothing(spark):
    rows = [(1, 0, "u", "yes\nI will come on Monday"), (1, 1, "u", "yes"), (1, 2, "u", "> yes\n> I will come on Monday\ngood"), (1, 3, "u", "> yes\n> unknown\nwell")]
    found = {r["turn"]: r for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[2]["reply_to"], found[2]["n_linked"], found[3]["reply_to"], found[3]["n_linked"]) == (0, 2, 1, 1)
    assert {t: (r["root"], r["position"]) for t, r in found.items()} == {0: (0, 0), 2: (0, 1), 1: (1, 0), 3: (1, 1)}


def test_mails_of_conversations(spark):
    from ridgelog.llm.queries import ORACLES, QUERIES
    from tools.check import compare, connect

    assert compare(QUERIES["op10_quotation_links"](spark, SF_DIR), connect(SF_DIR), ORACLES["op10_quotation_links"]) == ""
    assert as_mails(spark.read.parquet(f"{SF_DIR}/conversations.parquet")).count() == spark.read.parquet(f"{SF_DIR}/conversations.parquet").count()


# -- the pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as p
    from ridgelog.llm.pii import redact_text
    from ridgelog.llm.quality import accepted, fit_rules

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = [r for r in accepted(docs, fit_rules(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))).collect()]
    good.sort(key=lambda r: r["doc_id"])
    label, single, seen = brute_components([fingerprint(r["text"].encode()) for r in good]), [], set()
    for r, c in zip(good, label):
        if c not in seen:
            seen.add(c)
            single.append((r["doc_id"], r["text"]))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {d: redact_text(t) for (d, t), e in zip(single, brute_contamination(single, bench)) if not e[5]}
    found = p.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in found} == set(clean) and len(found) == len(clean) and 0 < len(clean) < docs.count()
    from ridgelog.llm.sptok import decode, read_model

    rows = spark.createDataFrame([(r["doc_id"], r["ids"]) for r in found], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(rows, read_model(p.MODEL_PATH)).collect()} == clean
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


@pytest.mark.parametrize("name", ["op3_url_rules", "op4_benchmark_windows", "op6_license_notices", "op10_quotation_links"])
def test_native_queries_run_no_python(spark, name):
    from ridgelog.llm.queries import QUERIES

    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert word not in plan, word
