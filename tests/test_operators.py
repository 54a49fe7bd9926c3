import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import api
from textquarry.functions import scores, text
from textquarry.operators import choices, classify, entities, longdoc, pool, records, relations, spans
from textquarry.schema import AttributeGroup, Cardinality, ChunkOptions, ClassificationSpec, EntitySpec, ExtractOptions, RegexValidator, Schema
from textquarry.scorers.lexical import LexicalScorer
from textquarry.scorers.rule import RuleScorer

SPAN = "doc_id long, label string, start int, end int, score float, text string"


def resolve(spark, items, policy, greedy=False):
    rows = [(1, "x", a, b, float(s), f"{a}-{b}") for s, a, b in items]
    out = spans.resolve_overlaps(spark.createDataFrame(rows, SPAN), entities.KEYS, policy, greedy).collect()
    return sorted((round(-r["score"], 5), r["start"], r["end"]) for r in out)


def test_overlap_literals(spark):
    assert resolve(spark, [(0.9, 0, 3), (0.6, 0, 1), (0.6, 2, 3)], "flat") == [(-0.6, 0, 1), (-0.6, 2, 3)]
    assert resolve(spark, [(0.9, 0, 3), (0.3, 0, 1), (0.3, 2, 3)], "flat") == [(-0.9, 0, 3)]
    assert resolve(spark, [(0.9, 0, 4), (0.8, 1, 2), (0.7, 3, 6)], "nested") == [(-0.9, 0, 4), (-0.8, 1, 2)]
    assert resolve(spark, [(0.5, 0, 4), (0.9, 1, 2), (0.7, 5, 6)], "longest") == [(-0.7, 5, 6), (-0.5, 0, 4)]
    assert resolve(spark, [(0.5, 0, 4), (0.7, 0, 4)], "allow") == [(-0.7, 0, 4)]


def brute_flat(items):
    best = {}
    for s, a, b in items:
        best[a, b] = max(s, best.get((a, b), 0))
    items = [(-s, a, b) for (a, b), s in best.items()]
    found = None
    for n in range(len(items) + 1):
        for chosen in itertools.combinations(items, n):
            if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(chosen, 2)):
                key = (sum(c[0] for c in chosen), -n, sorted(chosen))
                found = key if found is None or key < found else found
    return found[2]


def test_flat_and_greedy_match_brute_force(spark):
    rng = random.Random(0)
    groups = [[(rng.randrange(1, 16) / 16, a, a + rng.randrange(1, 5)) for a in (rng.randrange(12) for _ in range(rng.randrange(1, 8)))] for _ in range(60)]
    rows = [(g, "x", a, b, s, "t") for g, items in enumerate(groups) for s, a, b in items]
    df = spark.createDataFrame(rows, SPAN)
    flat, greedy = {}, {}
    for out, kept in ((flat, spans.resolve_overlaps(df, entities.KEYS)), (greedy, spans.resolve_overlaps(df, entities.KEYS, greedy=True))):
        for r in kept.collect():
            out.setdefault(r["doc_id"], []).append((-r["score"], r["start"], r["end"]))
    for g, items in enumerate(groups):
        assert sorted(flat[g]) == brute_flat(items)
        kept = []
        for s, a, b in sorted({(-s, a, b) for s, a, b in items}):
            if all(b <= y[1] or y[2] <= a for y in kept):
                kept.append((s, a, b))
        assert sorted(greedy[g]) == sorted(kept)


def test_words(spark):
    df = spark.createDataFrame([(1, "Email me at Bob.Smith@example.com, see https://x.io/a?b ok-ish"), (2, "héllo wörld"), (3, ""), (4, None), (5, "a b 😀c")], "doc_id long, text string")
    rows = text.word_table(df).orderBy("id", "ix").collect()
    words = {i: [(r["word"], r["start"], r["end"]) for r in rows if r["id"] == i] for i in range(1, 6)}
    assert [w.lower() for w, *_ in words[1]] == ["email", "me", "at", "bob.smith@example.com", ",", "see", "https://x.io/a?b", "ok-ish"]
    assert words[2][1] == ("wörld", 6, 11) and not words[3] and not words[4]
    assert words[5] == [("a", 0, 1), ("b", 2, 3), ("😀", 4, 5), ("c", 5, 6)]
    cjk = spark.createDataFrame([(1, "北京 GLi2")], "doc_id long, text string")
    assert [r["word"] for r in text.word_table(cjk, splitter="char").orderBy("ix").collect()] == ["北", "京", "GLi2"]


@pytest.mark.parametrize("size, overlap", [(3, 1), (4, 0), (50, 10)])
def test_chunks_match_the_loop(spark, size, overlap):
    texts = ["", "one", " ".join(f"w{i}" for i in range(17)), "a b c", "a, b! c? d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["id"], r["chunk_ix"]): (r["start"], r["text"]) for r in text.chunks(df, ChunkOptions(size, overlap)).collect()}
    want = {}
    rows = text.word_table(df).orderBy("id", "ix").collect()
    for i, t in enumerate(texts):
        words = [(r["start"], r["end"]) for r in rows if r["id"] == i]
        if not words:
            want[i, 0] = (0, t)
        at = k = 0
        while at < len(words):
            end = min(at + size, len(words))
            want[i, k] = (words[at][0], t[words[at][0] : words[end - 1][1]])
            if end == len(words):
                break
            at, k = at + size - overlap, k + 1
    assert got == want


def test_text_functions(spark):
    df = spark.createDataFrame([("a",), ("a!",), ("",), ("ab\n",), ("a. ",)], "t string")
    assert [r[0] for r in df.select(text.with_end_mark(F.col("t"))).collect()] == ["a.", "a!", ".", "ab\n.", "a. ."]
    one = spark.createDataFrame([("Books and e-books, BOOKS; notebooks", "ab\n", "a\rb")], "t string, n string, r string")
    assert [(s["start"], s["end"]) for s in one.select(text.literal_mentions(F.col("t"), "books").alias("x")).first()["x"]] == [(0, 5), (12, 17), (19, 24)]
    check = lambda c, **k: one.select(text.matches(F.col(c), RegexValidator(**k)).alias("x")).first()["x"]
    assert not check("n", pattern="ab") and check("n", pattern="AB", mode="partial") and check("r", pattern="a.b")
    assert not check("t", pattern="(") and check("t", pattern="(", exclude=True)
    assert not check("t", pattern="books", mode="partial", case_insensitive=False, exclude=True)


def test_redaction_and_segments(spark):
    df = spark.createDataFrame([("😀 ab cd", [(2, 4, "mail"), (3, 6, "x"), (5, 7, "zip"), (7, 99, "far")])], "t string, s array<struct<start:int,end:int,label:string>>")
    r = df.select(spans.redacted(F.col("t"), F.col("s")).alias("x"), spans.highlight_segments(F.col("t"), F.col("s")).alias("y")).first()
    assert r["x"] == "😀 [MAIL] [ZIP]"
    assert [(p["text"], p["label"]) for p in r["y"]] == [("😀 ", None), ("ab", "mail"), (" ", None), ("cd", "zip")]


def test_score_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    r = df.select(scores.first_argmax(F.col("v")).alias("a"), scores.descending_order(F.col("v")).alias("o"), scores.softmax(F.col("v")).alias("p"), scores.smoothed(F.col("v")).alias("s")).first()
    assert r["a"] == 1 and r["o"] == [1, 2, 0] and abs(sum(r["p"]) - 1) < 1e-12 and abs(r["s"] - (0.8 * 1.4 + 0.2 * 3)) < 1e-12
    far = spark.createDataFrame([(r,) for r in [*range(-128, 129), 511, -511, 2000]], "r int").select("r", scores.log_bucket(F.col("r"), 256, 512).alias("b")).collect()
    assert all(x["b"] == x["r"] for x in far if abs(x["r"]) <= 128)
    assert {x["r"]: x["b"] for x in far}[511] == 255 and {x["r"]: x["b"] for x in far}[-511] == -255 and {x["r"]: x["b"] for x in far}[2000] > 255
    seven = spark.createDataFrame([(0.7,)], "x double").select(scores.at_least(F.col("x").cast("float"), 0.7).alias("y")).first()["y"]
    assert seven is True


def test_classification_decisions(spark):
    rows = spark.createDataFrame([(1, "t", "a", 0, 0.4), (1, "t", "b", 1, 0.4), (2, "t", "a", 0, 0.6), (2, "t", "b", 1, 0.9)], "doc_id long, task string, label string, ix int, score double")
    pick = lambda df: sorted((r["doc_id"], r["label"]) for r in df.collect())
    assert pick(classify.decide(rows, False)) == [(1, "a"), (2, "b")]
    assert pick(classify.decide(rows, True, 0.5)) == [(1, "a"), (2, "a"), (2, "b")]
    single = {r["doc_id"]: r["label"] for r in classify.as_result(classify.decide(rows, False), False).collect()}
    assert single == {1: "a", 2: "b"}


def test_relation_edges_prefer_complete_mentions(spark):
    edge = "doc_id long, relation string, h_start int, h_end int, h_text string, t_start int, t_end int, t_text string, score float, place int"
    rows = [(1, "r", 0, 5, "Alice", 16, 20, "Acme", 0.9, 1), (1, "r", 0, 5, "Alice", 16, 25, "Acme Corp", 0.8, 2), (2, "r", 0, 1, "a b", 5, 6, "c", 0.9, 1), (2, "r", 9, 10, "a", 20, 21, "c", 0.9, 2), (2, "r", 30, 33, "A  B", 34, 35, "C", 0.7, 3)]
    out = relations.relation_edges(spark.createDataFrame(rows, edge), 0.5).collect()
    assert sorted((r["doc_id"], r["h_text"], r["t_text"]) for r in out) == [(1, "Alice", "Acme Corp"), (2, "A  B", "C")]


def test_choices_bind_to_anchors(spark):
    df = spark.createDataFrame([(1, "Amazon sells books. Walmart sells groceries and books.")], "doc_id long, text string")
    anchors = spark.createDataFrame([(1, 0, 0, 6), (1, 1, 20, 27)], "doc_id long, owner int, a_start int, a_end int")
    mentions = choices.choice_mentions(df, ["books", "groceries"])
    bound = choices.bind_to_anchors(mentions, anchors)
    owned = [(r["owner"], r["choice"]) for r in bound.orderBy("owner", "start").collect()]
    assert owned == [(0, "books"), (1, "groceries"), (1, "books")]
    assert {r["owner"]: r["choice"] for r in choices.nearest_to_anchor(bound, anchors).collect()} == {0: "books", 1: "groceries"}


def test_assignment_literals_and_brute_force():
    assert records.linear_sum_assignment(np.array([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0]])).tolist() == [1, 0]
    assert records.linear_sum_assignment(np.array([[1.0, 2.0], [1.0, 10.0]])).tolist() == [1, 0]
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(1, 5)
        m = rng.integers(n, 7)
        cost = rng.integers(0, 8, size=(n, m)).astype(float)
        got = records.linear_sum_assignment(cost)
        assert len(set(got.tolist())) == n
        assert cost[range(n), got].sum() == min(cost[range(n), list(p)].sum() for p in itertools.permutations(range(m), int(n)))


def test_exclusive_single_values(spark):
    objects = spark.createDataFrame([(1, "s", 1, 3.0), (1, "s", 2, 2.0), (1, "s", 3, -5.0)], "doc_id long, structure string, inst int, logit double")
    cells = [(1, "s", i, "f", c, v) for i, row in {1: [0, 4, 3], 2: [0, 4, -4], 3: [0, 9, 9]}.items() for c, v in zip((-1, 1, 2), map(float, row))]
    assign = spark.createDataFrame(cells, "doc_id long, structure string, inst int, field string, cand int, logit double")
    out = records.decode_records(objects, assign, [records.RecordField("f", Cardinality.REQUIRED_ONE, True)])
    assert sorted((r["inst"], r["cand"]) for r in out.collect()) == [(1, 2), (2, 1)]
    out = records.decode_records(objects, assign, [records.RecordField("f", Cardinality.OPTIONAL_ONE, True)])
    assert sorted((r["inst"], r["cand"]) for r in out.collect()) == [(2, 1)]  # the first one's best left is below the threshold


def test_pool_keeps_the_best_occurrence(spark):
    rows = spark.createDataFrame([(1, 5, 6, 1.0), (1, 3, 4, 2.0), (1, 5, 6, 3.0)], "d long, start int, end int, score double")
    assert [(r["start"]) for r in pool.pooled(rows, ["d"], 10).orderBy("slot").collect()] == [5, 3]
    assert [(r["start"]) for r in pool.pooled(rows, ["d"], 1).collect()] == [5]
    ties = spark.createDataFrame([(1, k, k + 1, 1.0) for k in (9, 2, 4)], "d long, start int, end int, score double")
    assert [r["start"] for r in pool.pooled(ties, ["d"], 10).orderBy("slot").collect()] == [2, 4, 9]


def test_one_chunk_is_no_chunking(spark):
    df = spark.createDataFrame([(1, "Write to a.b@c.example.com or 10.0.0.1 now"), (2, "no")], "doc_id long, text string")
    schema = Schema().with_entities("email", "ip_address")
    found, _ = api.extract_long(df, schema, RuleScorer(), options=ExtractOptions(0.3), chunk=ChunkOptions(500, 0))
    whole = entities.extract_entities(RuleScorer().spans(df, ["email", "ip_address"]), list(schema.entities), ExtractOptions(0.3, include_spans=True))
    key = lambda df: sorted((r["doc_id"], r["label"], r["start"], r["end"]) for r in df.collect())
    assert key(found) == key(whole) and len(key(found)) == 2


def test_extract_gives_one_row_a_document(spark):
    df = spark.createDataFrame([(1, "Alice wrote to a.b@c.example.com about the"), (2, None), (3, "")], "doc_id long, text string")
    tone = ClassificationSpec("tone", ("the", "zzz"))
    schema = Schema().with_entity(EntitySpec("email", dtype="str")).with_entities("name").with_classification(tone).with_relations("mails")
    out = api.extract(df, schema, RuleScorer(), LexicalScorer.of(tone), ExtractOptions(0.3), {"mails": ("name", "email")})
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1]["entities"]["email"]["text"] == "a.b@c.example.com" and rows[1]["tone"]["label"] == "the"
    assert rows[2]["entities"]["email"] is None and rows[2]["entities"]["name"] == []
    assert rows[1]["relation_extraction"]["mails"]
    cut = api.extract(df, Schema().with_entities("email"), RuleScorer(), options=ExtractOptions(0.3, max_words=3)).collect()
    assert all(not r["entities"]["email"] for r in cut)


def test_table_function(spark):
    api.register_sql(spark)
    spark.createDataFrame([(1, "a@b.example.com and 10.0.0.1")], "doc_id long, text string").createOrReplaceTempView("udtf_docs")
    out = spark.sql("SELECT doc_id, label, start FROM udtf_docs, LATERAL extract_spans(text, 'email,ip_address') ORDER BY start").collect()
    assert [(r["label"], r["start"]) for r in out] == [("email", 0), ("ip_address", 20)]


def test_merging_of_chunks(spark):
    rows = spark.createDataFrame([(1, 0, "t", "a", 0.5), (1, 1, "t", "b", 0.5), (1, 2, "t", "a", 0.2)], "doc_id long, chunk_ix int, task string, label string, score double")
    assert longdoc.merge_single_label(rows).first()["label"] == "b"
    assert longdoc.merge_by_vote(rows, ["doc_id", "task"]).first()["label"] == "a"
    assert {r["label"]: r["score"] for r in longdoc.merge_multi_label(rows).collect()} == {"a": 0.5, "b": 0.5}
    late = spark.createDataFrame([(1, "x", 5, 9, 3)], "doc_id long, label string, start int, end int, length int")
    assert longdoc.clipped(late, "length").count() == 0


def test_attribute_groups(spark):
    from textquarry.operators import attributes

    found = spark.createDataFrame([(1, "person", 0, 3, "Ann"), (1, "city", 0, 3, "Ann")], "doc_id long, label string, start int, end int, text string")
    group = AttributeGroup(("low", "high"), applies_to=("person",))
    pairs = attributes.attribute_pairs(found, "risk", group)
    assert pairs.count() == 2
    out = attributes.decide_attributes(pairs.withColumn("logit", F.col("ix") * 2.0), group).collect()
    assert [(r["label"], r["attribute"]) for r in out] == [("person", "high")]
