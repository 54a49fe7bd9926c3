"""Near-duplicates, embeddings and decontamination against brute force; archives by round trips."""

import hashlib
import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest

from textquarry.llm import decontamination, embedding_dup, near_dup, setsketch, warc
from textquarry.llm.components import connected_components


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n", "one", "ONE", "one two", "one two three"]
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([20, 80, 200]))]
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        texts += [edited(base, rng, rng.choice([0, 1, 2, 4, 8])) for _ in range(rng.choice([2, 6, 25]))]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(40)) for _ in range(30)]
    texts.append("long " * 100_000)
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, 7, "r") for i, t in zip(ids, texts)], "doc_id long, text string, component_id int, registers string")
    for k in (4, 5):
        sets = {i: shingles(t, k) for i, t in zip(ids, texts)}
        links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = least_reachable(ids, links)
        out = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, k).collect()}
        assert {i: out[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}
        assert {i: out[i]["component_id"] for i in ids} == want
        assert all(out[i]["kept"] == (want[i] == i) for i in ids)


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """A group much larger than a unit, in which the first round can't link all."""
    rng = random.Random(5)
    monkeypatch.setattr(near_dup, "CHUNK_ROWS", 8)
    base = [f"w{i}" for i in range(60)]
    texts = [edited(base, rng, rng.randrange(9)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 4).collect()}
    assert out == least_reachable(range(120), links)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "A B C D E F"), (2, None)]
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(out, key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (3, 1, False), (2, 2, True)], key=str)


def test_near_duplicates_move_no_texts(spark):
    """Where no join may broadcast: shuffles move hashes and registers, and sets of what shares a bucket."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.randrange(16**8):08x}" for _ in range(1500)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:2], edited(texts[2].split(" "), rng, 9)])), "doc_id long, text string")
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {k: v for k, v in out.items() if k != v} == {120: 0, 121: 1, 122: 2}
    assert sum(v for k, v in moved().items() if k not in before) < 0.6 * sum(map(len, texts))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, size=1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[500:])
    assert (setsketch.merged(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.union1d(a, b))).all()
    e = setsketch.similarity(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(e - 1 / 3) < 0.15
    assert not setsketch.registers(a[:0]).any()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    random.Random(0).shuffle(edges)
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def cosine_links(rows, t):
    ok = [(i, np.array(v, dtype=float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    return [(a, b) for (a, x, la), (b, y, lb) in itertools.combinations(ok, 2) if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t]


@pytest.mark.parametrize("chunk", [2000, 16])
def test_embedding_links_match_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 30))):
                rows.append((n, (centre + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.25])).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(20)] + [(n + 20, [0.0] * 16, 0), (n + 21, None, 0), (n + 22, [1.0, None] + [0.0] * 14, 0), (n + 23, [float("nan")] * 16, 1), (n + 24, [1.0] * 16, None), (n + 25, rows[0][1][:8], 0), (n + 26, [], 1), (n + 27, [x * 3 for x in rows[5][1]], 0)]
    table = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links int")
    links = cosine_links(rows, 0.93)
    want = least_reachable([r[0] for r in rows], links)
    out = {r["vec_id"]: r for r in embedding_dup.embedding_duplicates(table, chunk=chunk).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == want
    counts = {r[0]: 0 for r in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert {i: r["n_links"] for i, r in out.items()} == counts
    assert embedding_dup.embedding_duplicates(table.where("false")).count() == 0


def test_cover_tree_opens_nodes():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(8, 12)), 60, axis=0) + rng.normal(size=(480, 12)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embedding_dup.cover_tree(x)
    assert tree.children and sorted(i for c in tree.children for i in c.points) == list(range(480))
    links = embedding_dup.Links(480, np.ones(480, dtype=np.int64))
    embedding_dup.dual_traversal(x, tree, tree, 0.93, links)
    assert (links.count == (x @ x.T >= 0.93).sum(axis=1) - 1).all()


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 40))) for _ in range(12)]
    docs = [None, "", " ", items[0], items[0].upper().replace(" ", "\n \t")]
    for i in range(60):
        item = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 3, 8, 14])):
            at = rng.randrange(len(item))
            item[at] = rng.choice(["", "x", item[at] + "y"])
        docs.append(" ".join(rng.choice(words) for _ in range(20)) + " " + "".join(item) + " " + " ".join(rng.choice(words) for _ in range(20)))
    docs.append("pad " * 60_000 + items[3])
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "  ")], "item_id long, text string")
    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            item, body = decontamination.normal(item), decontamination.normal(text or "")
            if len(body) < 100_000 and decontamination.best_match(item, body)[0] <= decontamination.budget(len(item)) or (len(body) > 100_000 and item in body):
                want.add((d, i))
    for block in (10_000_000, 200):
        out = decontamination.benchmark_matches(table, bench, block_chars=block)
        assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want
    kept = {r["doc_id"] for r in decontamination.without_contaminated(table, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want}
    assert decontamination.benchmark_matches(table, bench.where("false")).count() == 0
    assert decontamination.benchmark_matches(table.where("false"), bench).count() == 0


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row)


def test_bit_vectors_give_edit_distances():
    rng = random.Random(0)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontamination.best_match(item, text)[0] == edit_distance_in(item, text)


def test_pieces_cover_the_item():
    for n in range(1, 200):
        item = "x" * n
        parts = decontamination.split_pieces(item, decontamination.budget(n))
        assert "".join(p for _, p in parts) == item and len(parts) == decontamination.budget(n) + 1


def pages(spark):
    big = "é" * 700
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "http://c", big), (2, "http://d", "small"), (4, "http://e", "small"), (6, "http://f", None), (7, "http://g", ""), (8, "http://h\r\nX: y", "x" * 200_000), (None, "http://i", big)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, records int")


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_round_trip(spark, zip64):
    rows, table = pages(spark)
    archives = warc.write_archives(table, archive_bytes=2000, zip64=zip64)
    assert archives.count() >= 1
    out = {r["page_id"]: r for r in warc.read_archives(archives, with_payload=True).collect()}
    assert len(out) == len(rows)
    for page, _, html in rows:
        r, payload = out[page], (html or "").encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        revisit = page in (1, 3, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
    for a in archives.collect():
        raw = open(a["path"].removeprefix("file://"), "rb").read()
        with zipfile.ZipFile(io.BytesIO(raw)) as z:  # other readers can open it too
            assert z.testzip() is None and warc.DATA in z.namelist()
        assert (b"PK\x06\x06" in raw) == zip64
    assert warc.read_archives(warc.write_archives(table.where("false"))).count() == 0


def test_damaged_archives_are_refused():
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    w.add(b"WARC/1.1\r\n\r\n", {"id": 1})
    w.close()
    raw = out.getvalue()
    read = lambda data: lambda at, n: data[at : at + n]
    assert len(warc.index_of(read(raw), len(raw))) == 1
    with pytest.raises(ValueError):
        warc.read_directory(read(raw[:-30]), len(raw) - 30)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, "x" * 1000)
        z.writestr(warc.INDEX, "")
    data = packed.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc.index_of(read(data), len(data))
    record = warc.make_record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_embedding_rows_that_repeat_and_many_labels(spark):
    same, other = [1.0, 2.0, 0.5], [-1.0, 0.0, 3.0]
    rows = [(1, same, 0), (1, same, 0), (2, same, 0), (3, other, 0), (4, None, 0), (5, same, None), (6, same, 1), (None, same, 0), (7, [0.0] * 3, 0), (8, same, 2), (8, other, 2), (9, other, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.embedding_duplicates(table).collect())
    want = [(-1, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert out == sorted([*want, (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False)])  # 8 has a vector like 9's, and one of its own
    many = spark.range(40_000).selectExpr("id as vec_id", "array(cast(id div 20000 + 1 as float), cast(1 as float)) as embedding", "cast(id % 20000 as int) as label")
    found = embedding_dup.embedding_duplicates(many, cosine=0.9)
    assert found.where("n_links = 1 and component_id = vec_id % 20000").count() == 40_000


@pytest.mark.parametrize("most_centres", [1, 6, 40])
def test_top_tree_loses_no_link(spark, most_centres):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(7, 8))
    rows = [(i, [float(x) for x in centres[i % 7] + rng.normal(size=8) * (0.05 if i % 3 else 0.6)], 0 if i % 5 else 1) for i in range(420)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = cosine_links(rows, 0.93)
    out = {r["vec_id"]: r for r in embedding_dup.embedding_duplicates(table, chunk=25, most_centres=most_centres).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == least_reachable([r[0] for r in rows], links)
    counts = dict.fromkeys(range(420), 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert {i: r["n_links"] for i, r in out.items()} == counts
