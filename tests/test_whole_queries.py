"""Queries over whole rows, against plain Python."""

import math
import random
from datetime import datetime, timedelta

from textquarry import queries


def test_score_functions_whole_sees_all_components(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-999, 1000) / 1000 for _ in range(64)]) for i in range(20)]
    rows[0][1][63] = 3.0
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["vec_id"]: r for r in queries.QUERIES["score_functions"](spark, str(tmp_path)).collect()}
    assert found[0]["best"] == 63
    for i, v in rows:
        total, r = sum(map(math.exp, v)), found[i]
        smoothed = v[0]
        for x in v[1:]:
            smoothed = smoothed * 0.8 + x * 0.2
        assert r["best"] == v.index(max(v))
        expected = math.exp(max(v)) / total, sum(k * math.exp(x) for k, x in enumerate(v)) / total, sum(x * x for x in v), smoothed
        assert all(abs(a - b) < 2e-6 for a, b in zip((r["top"], r["level"], r["norm2"], r["smoothed"]), expected, strict=True))


def test_text_prepare_whole_reaches_the_end(spark, tmp_path):
    rows = [(1, " ".join(f"Word{i}" for i in range(30))), (2, "Ends Already! " * 9 + "So?"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.QUERIES["text_prepare"](spark, str(tmp_path)).collect()}
    assert found[1]["model_words"].split(" ") == [f"word{i}" for i in range(30)] + ["."]
    assert found[2]["model_words"] == "ends already ! " * 9 + "so ?"
    assert [found[i]["n_words"] for i in (1, 2, 3, 4)] == [31, 29, 1, 1]
    assert found[3]["model_words"] == found[4]["model_words"] == "."


def test_interval_mean_whole_averages_the_last_events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(u * 100 + i, u, start + timedelta(minutes=i), float(i)) for u, n in ((1, 2), (2, 5), (3, 8)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = {(r["user_id"], r["first_ix"]): r["mean"] for r in queries.QUERIES["interval_mean"](spark, str(tmp_path)).collect()}
    assert found == {(1, 0): 50.0, (2, 0): 200.0, (3, 0): 200.0, (3, 5): 600.0}
