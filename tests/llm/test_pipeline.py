"""The pipeline on a small corpus, against its stages done plainly; and what each query returns on a test table."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from textquarry.llm import decontamination, line_dedup, packing, quality
from textquarry.llm.queries import QUERIES, tokenizer_path

from .test_pair_operators import least_reachable
from .test_text_operators import best_fit_decreasing


def corpus(folder):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "to", "ri", "se", "mo", "lu"]) for _ in range(rng.randint(2, 4)))
    rows, labels, items = [], [], []
    for i in range(6):
        items.append((i, " ".join(word() for _ in range(25))))
    for i in range(240):
        words = [word() for _ in range(rng.choice([15, 60, 150]))]
        good = i % 4 != 0
        text = " ".join(words) if good else " | ".join(words)
        if i % 4 == 1 and i % 3 == 0:
            text = f"shared menu line\n{text}"
        if i % 23 == 1:
            text += "\n" + items[i % 6][1].upper()
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(240, 300):
        source = rows[rng.randrange(1, 60, 2)]
        words = source[1].split(" ")
        for _ in range(rng.choice([0, 1, 3])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words), source[2], source[3], 0))
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0)]
    tables = {"documents": (rows, ["doc_id", "text", "lang", "source", "n_chars"]), "labels": (labels, ["doc_id", "quality", "toxic"]), "benchmark": (items, ["item_id", "text"])}
    for name, (data, columns) in tables.items():
        pq.write_table(pa.table({c: [r[k] for r in data] for k, c in enumerate(columns)}), f"{folder}/{name}.parquet")
    return rows, items


def without_menus(docs):
    hosts: dict = {}
    for d in docs.values():
        hosts.setdefault(d[1], []).append({x.strip() for x in (d[0] or "").split("\n") if x.strip()})
    out = {}
    for key, (text, host) in docs.items():
        pages = hosts[host]
        bad = {x for x in set().union(*pages) if sum(x in p for p in pages) >= line_dedup.MIN_PAGES and sum(x in p for p in pages) > line_dedup.MAX_RATIO * len(pages)}
        out[key] = (None if text is None else "\n".join(x for x in text.split("\n") if x.strip() not in bad), host)
    return out


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_pipeline_matches_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus(tmp_path)
    read = {r[0]: (r[1], r[3]) for r in rows}
    scored = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    kept = {r["doc_id"] for r in scored.collect()}
    assert all((i in kept) == (i % 4 != 0) for i in range(240))  # the classes are far apart
    docs = without_menus({k: v for k, v in read.items() if k in kept})
    sets = {k: shingles(t) for k, (t, _) in docs.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = least_reachable(sorted(sets), links)
    docs = {k: v for k, v in docs.items() if component[k] == k}
    tests = [decontamination.normal(t) for _, t in items]
    docs = {k: v for k, v in docs.items() if not any(decontamination.best_match(t, decontamination.normal(v[0] or ""))[0] <= decontamination.budget(len(t)) for t in tests)}

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {}
    for k, (text, _) in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[k] = zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["ids_crc32"], r["length"]) for r in out} == want  # all texts here fit in one sequence
    assert len({r["sequence_id"] for r in out}) == best_fit_decreasing([r["length"] for r in out], 1024)
    assert len(links) > 10 and len(want) < len(kept) - 10


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_queries_have_a_number_each():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))


def test_stages_take_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "to", "ri", "se", "mo", "lu"]) for _ in range(3))
    long = " ".join(word() for _ in range(150_000))
    same = " ".join(word() for _ in range(40))
    rows = [(1, long), (2, None), (3, ""), (None, same), (4, same), (4, same), (5, same), (6, " | ".join(word() for _ in range(30))), (7, "x"), (7, "y"), (8, "  \n ")]
    rows += [(i, " ".join(word() for _ in range(30)) if i % 2 else " | ".join(word() for _ in range(30))) for i in range(20, 80)]
    data = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [None] * len(rows), "source": [None if i % 2 else "s" for i in range(len(rows))], "n_chars": [None] * len(rows)}
    data |= {name: [f"{name}{i}" for i in range(len(rows))] for name in ("gone", "host", "text_", "predicted", "score_", "id_", "component_id", "hit", "__hit")}
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in list(data)[5:]]])
    pq.write_table(pa.table(data, kinds), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(20, 80)), "quality": [i % 2 for i in range(20, 80)], "toxic": [0] * 60}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3], pa.int64()), "text": [None, "", " ".join(long.split(" ")[70_000:70_030])]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert out.columns == docs.columns and {r["gone"] for r in found} <= set(data["gone"])
        kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in found)
        if name == "lines":
            assert len(found) == len(rows)
        elif name == "near_duplicates":  # one document of equal ones stays, with its repeated rows; the row without id stays
            assert kept.count(4) == 2 and 5 not in kept and kept.count(-1) == 1 and kept.count(7) == 2 and {1, 2, 3, 8} <= set(kept)
        else:
            assert 1 not in kept and len(found) == len(rows) - 1
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sum(r["start"] == 0 and r["doc_id"] == 4 for r in packed.collect()) == 2 and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert all((i in kept) == bool(i % 2) for i in range(20, 80)) and corpus_pipeline.STAGES[0][1](spark, docs.where("false"), str(tmp_path)).count() == 0


def test_scratch_is_shared_and_goes(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from textquarry.llm import scratch

    with scratch.temporary_tables(spark):
        path = scratch.new_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not scratch._made.get()
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path).count()
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        unset = SimpleNamespace(get=lambda key, default=None: default)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(SimpleNamespace(conf=unset, sparkContext=context))


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """The sample and the fit's arrays stay with a worker."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b c d" if i % 2 else "A | B | C", i % 2) for i in range(40)], "doc_id long, text string, quality int")
    monkeypatch.setattr(quality, "fit_quality", lambda *a: 1 / 0)
    weights, square, a, b = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), F.lit(True))
    assert len(weights) == len(square) == quality.WIDTH and weights.any() and a > 0 and np.isfinite(b)


def test_packing_releases_each_superstep(spark, monkeypatch):
    calls, stored = [], packing.stored
    monkeypatch.setattr(packing, "release", lambda spark: calls.append("release"))
    monkeypatch.setattr(packing, "stored", lambda df, name, *by: calls.append(name) or stored(df, name, *by))
    pieces = stored(spark.createDataFrame([(i, 0, 0, 1 + i % 4, 0) for i in range(60)], packing._PIECES), "pieces")
    packing.pack(pieces, 16)
    steps = [c for c in calls if c in ("release", "superstep")]
    assert len(steps) >= 4 and steps == ["superstep", "release"] * (len(steps) // 2)
