"""Whole requests: attributes, records, choices, relations, long documents, and what is shown of them."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry import api
from textquarry.functions import text
from textquarry.operators import guardrails, records
from textquarry.schema import STR, AttributeGroup, Cardinality, ChunkOptions, EntitySpec, ExtractOptions, FieldSpec, RegexValidator, RelationSpec, Schema, SchemaError, StructureMode, StructureSpec
from textquarry.scorers.base import RecordScores
from textquarry.scorers.rule import RuleScorer
from textquarry.sources import sinks

DOCS = "doc_id long, text string"


class Stub(RuleScorer):
    """Records from given tables: candidates (cand, start, end, text), field scores, objects and assignments of document 1."""

    def __init__(self, spark, candidates, fields, objects, assign, choices=()):
        super().__init__()
        doc = lambda rows: [(1, *r) for r in rows]
        frame = spark.createDataFrame
        self.given = RecordScores(
            frame(doc(candidates), "doc_id long, cand int, start int, end int, text string"),
            frame(doc(fields), "doc_id long, field string, cand int, score float"),
            frame([(1, "s", i, x) for i, x in objects], "doc_id long, structure string, inst int, logit double"),
            frame([(1, "s", *r) for r in assign], "doc_id long, structure string, inst int, field string, cand int, logit double"),
            frame(doc(choices), "doc_id long, field string, choice string, ix int, score float"),
        )
        self.runs = 0

    def validate(self, schema):
        pass

    def records(self, docs, spec):
        return self.given


TEXT = "Ann has red tea. Bob has tea and blue cups."
CANDIDATES = [(0, 0, 3, "Ann"), (1, 12, 15, "tea"), (2, 17, 20, "Bob"), (3, 25, 28, "tea"), (4, 38, 42, "cups"), (5, 33, 42, "blue cups")]


def decoded(spark, fields, options=None, mode=StructureMode.AUTO, choices=(), scores=None, objects=((0, 3.0), (2, 2.0), (4, -5.0)), cells=None, name_scores=0.9):
    names = [f.name for f in fields]
    scores = scores or [(n, c, 0.9) for n in names for c, *_ in CANDIDATES]
    cells = cells or [(i, n, c, v) for i in (0, 2, 4) for n in names for c, v in [(-1, 0.0), *((c, 4.0 if c - i in (1, 2, 3) and c not in (0, 2) and (i == 2) == (c > 2) else -6.0) for c, *_ in CANDIDATES)]]
    stub = Stub(spark, CANDIDATES, scores, list(objects), cells, choices)
    docs = spark.createDataFrame([(1, TEXT), (2, None)], DOCS)
    out = api.extract(docs, Schema().with_structure(StructureSpec("s", tuple(fields), mode)), stub, options=options)
    rows = {r["doc_id"]: r["s"] for r in out.collect()}
    assert rows[2] == []
    return rows[1]


def texts(value):
    return [m["text"] for m in value] if isinstance(value, list) else value["text"] if value else None


def test_natural_records_stand_in_the_order_of_their_anchors(spark):
    out = decoded(spark, [FieldSpec("who", STR), FieldSpec("what")], objects=((0, 2.0), (2, 3.0), (4, -5.0)))
    assert [(texts(r["who"]), texts(r["what"])) for r in out] == [("Ann", ["tea"]), ("Bob", ["tea", "blue cups"])]
    assert [r["who"]["start"] for r in out] == [0, 17]
    assert all(0 < m["confidence"] <= 0.9000001 for r in out for m in r["what"])


def test_a_field_s_value_needs_to_be_a_likely_candidate(spark):
    fields = [FieldSpec("who", STR), FieldSpec("what", threshold=0.8)]
    weak = [("who", c, 0.9) for c in range(6)] + [("what", 1, 0.3), ("what", 3, 0.7), ("what", 4, 0.95), ("what", 5, 0.1)]
    out = decoded(spark, fields, scores=weak)
    # tea of Ann is no likely candidate, tea of Bob is below the field's own threshold; a required anchor stays though unlikely
    assert [texts(r["what"]) for r in out] == [[], ["cups"]]
    out = decoded(spark, fields, scores=[("who", 0, 0.1), *weak[6:]])
    assert [texts(r["who"]) for r in out] == ["Ann", "Bob"] and out[0]["who"]["confidence"] == pytest.approx(0.1) and out[1]["who"]["confidence"] == 0.0


def test_validators_and_repeated_texts_of_a_field(spark):
    out = decoded(spark, [FieldSpec("who", STR), FieldSpec("what", validators=(RegexValidator("t.*"),))])
    assert [texts(r["what"]) for r in out] == [["tea"], ["tea"]]
    cells = [(0, "what", c, 5.0) for c in (1, 3)] + [(0, n, -1, 0.0) for n in ("who", "what")]
    twice = decoded(spark, [FieldSpec("who", STR), FieldSpec("what")], cells=cells, objects=((0, 1.0),))
    assert texts(twice[0]["what"]) == ["tea"]  # equal texts are shown once, unless offsets are asked for
    twice = decoded(spark, [FieldSpec("who", STR), FieldSpec("what")], ExtractOptions(include_spans=True), cells=cells, objects=((0, 1.0),))
    assert texts(twice[0]["what"]) == ["tea", "tea"]


def test_latent_and_anchorless_records_are_merged_if_equal(spark):
    cells = [(i, "what", c, 4.0 if c == 1 else -6.0) for i in (0, 2) for c in range(6)] + [(4, "what", c, 4.0 if c == 4 else -6.0) for c in range(6)]
    for mode in (StructureMode.LATENT, StructureMode.ANCHORLESS):
        out = decoded(spark, [FieldSpec("what")], mode=mode, cells=cells, objects=((0, 1.0), (2, 3.0), (4, 2.0)))
        assert [texts(r["what"]) for r in out] == [["tea"], ["cups"]]


def test_choices_by_mention_surface_or_score(spark):
    color = lambda *choices, **k: [FieldSpec("who", STR), FieldSpec("color", STR, choices, **k)]
    scored = lambda *pairs: [("color", c, i, s) for i, (c, s) in enumerate(pairs)]
    near = decoded(spark, color("red", "blue"), choices=scored(("red", 0.2), ("blue", 0.3)))
    assert [(texts(r["color"]), r["color"]["start"]) for r in near] == [("red", 8), ("blue", 33)]  # a mention counts whatever its score
    only = decoded(spark, color("blue", "green"), choices=scored(("blue", 0.3), ("green", 0.9)))
    assert [texts(r["color"]) for r in only] == [None, "blue"]  # the document has a literal mention, though not Ann's
    guess = decoded(spark, color("green", "grey"), choices=scored(("green", 0.6), ("grey", 0.9)))
    assert [(texts(r["color"]), r["color"]["start"]) for r in guess] == [("grey", None)] * 2
    assert [r["color"] for r in decoded(spark, color("green", threshold=0.95), choices=scored(("green", 0.9)))] == [None, None]
    cells = [(0, "color", c, 5.0 if c == 1 else -6.0) for c in range(6)] + [(0, "color", -1, 0.0)]
    same = decoded(spark, [FieldSpec("color", STR, ("TEA", "wine"))], mode=StructureMode.ANCHORLESS, cells=cells, objects=((0, 2.0),), choices=scored(("TEA", 0.1), ("wine", 0.9)))
    assert [texts(r["color"]) for r in same] == ["TEA"]  # without anchors a surface that equals a choice comes first


def test_single_values_of_a_required_field_have_no_threshold(spark):
    cells = [(0, "what", -1, 3.0), (0, "what", 1, 1.0), (0, "what", 3, 0.5)]
    required = decoded(spark, [FieldSpec("who", STR), FieldSpec("what", STR, cardinality=Cardinality.REQUIRED_ONE)], cells=cells, objects=((0, 1.0),))
    assert texts(required[0]["what"]) == "tea"
    optional = decoded(spark, [FieldSpec("who", STR), FieldSpec("what", STR)], cells=cells, objects=((0, 1.0),))
    assert optional[0]["what"] is None


def test_attributes_through_a_request(spark):
    docs = spark.createDataFrame([(1, "Write to ab@c.example.com or 10.0.0.1"), (2, ""), (3, None)], DOCS)
    groups = {"risk": AttributeGroup(("low", "high"), applies_to=("email",)), "flags": AttributeGroup(("x", "y"), True, 0.0)}
    schema = Schema().with_entities("email", "ip_address").with_attributes(**groups)
    rows = {r["doc_id"]: r["entities"] for r in api.extract(docs, schema, RuleScorer(), options=ExtractOptions(0.3)).collect()}
    mail, ip = rows[1]["email"][0], rows[1]["ip_address"][0]
    assert mail["attributes"]["risk"]["label"] in ("low", "high") and ip["attributes"]["risk"] is None
    assert {x["label"] for x in ip["attributes"]["flags"]} == {"x", "y"} and rows[2]["email"] == rows[3]["email"] == []
    assert "low" not in rows[1].asDict()  # labels of attributes are hidden


def test_what_a_scorer_cannot_score_is_refused_first(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    with pytest.raises(SchemaError, match="no pattern"):
        api.extract(docs, Schema().with_entities("colour"), RuleScorer())
    with pytest.raises(SchemaError, match="no pattern"):
        api.extract(docs, Schema().with_structure(StructureSpec("s", (FieldSpec("colour"),))), RuleScorer())


def test_relations_keep_their_own_threshold(spark):
    docs = spark.createDataFrame([(1, "Alice wrote to a.b@c.example.com today")], DOCS)
    for limit, found in ((0.0, True), (0.99, False)):
        schema = Schema().with_relations(RelationSpec("mails", threshold=limit))
        row = api.extract(docs, schema, RuleScorer(), options=ExtractOptions(0.3), roles={"mails": ("name", "email")}).first()
        assert bool(row["relation_extraction"]) is found


class Counting(RuleScorer):
    runs: int = 0

    def spans(self, docs, labels):
        Counting.runs += 1
        seen = docs.select("*").mapInPandas(_seen(docs.sparkSession), docs.schema)
        return super().spans(seen, labels)


def _seen(spark):
    def passed(parts):
        for part in parts:
            tally.add(len(part))
            yield part

    tally = Counting.tally
    return passed


def test_the_scorer_runs_once(spark):
    Counting.tally = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"Alice wrote to a{i}@c.example.com today") for i in range(50)], DOCS)
    schema = Schema().with_entities("email", "name").with_relations("mails")
    api.extract(docs, schema, Counting(), options=ExtractOptions(0.3), roles={"mails": ("name", "email")}).collect()
    assert Counting.tally.value == 50


def test_long_documents_yield_every_kind(spark):
    part = "Ann Smith wrote to ab{i}@c.example.com and called 555-123-456{i} today . "
    docs = spark.createDataFrame([(1, "".join(part.format(i=i) for i in range(8))), (2, None)], DOCS)
    contact = StructureSpec("contact", (FieldSpec("email", STR), FieldSpec("phone_number")))
    schema = Schema().with_entities("email").with_relations("mails").with_structure(contact).with_attributes(risk=AttributeGroup(("low", "high")))
    options = ExtractOptions(0.3)
    out = api.extract_long_result(docs, schema, RuleScorer(), options=options, chunk=ChunkOptions(30, 15), roles={"mails": ("name", "email")})
    whole = docs.where("doc_id = 1").first()["text"]
    mails = out.entities.collect()
    assert len(mails) == 8 and all(whole[r["start"] : r["end"]] == r["text"] for r in mails)
    assert {(r["start"], r["end"]) for r in out.attributes.collect()} == {(r["start"], r["end"]) for r in mails} and out.attributes.count() == 8
    edges = out.relations.collect()
    assert edges and all(whole[r["h_start"] : r["h_end"]].strip() == r["h_text"] and whole[r["t_start"] : r["t_end"]] == r["t_text"] for r in edges)
    assert len({(r["h_start"], r["h_end"], r["t_start"], r["t_end"], r["relation"]) for r in edges}) == len(edges)
    found = [r["record"] for r in out.structures["contact"].collect()]
    assert all(whole[r["email"]["start"] : r["email"]["end"]] == r["email"]["text"] for r in found)
    assert len({json.dumps([r["email"]["start"], [p["start"] for p in r["phone_number"]]]) for r in found}) == len(found)
    assert {r["email"]["text"] for r in found} == {r["text"] for r in mails}


def test_results_are_shown_without_what_was_not_asked_for(spark):
    docs = spark.createDataFrame([(1, "ab@c.example.com and 10.0.0.1")], DOCS)
    contact = StructureSpec("contact", (FieldSpec("email", STR), FieldSpec("ip_address")))
    schema = Schema().with_entity(EntitySpec("email", dtype=STR)).with_entities("ip_address").with_structure(contact)
    out = api.extract(docs, schema, RuleScorer(), options=ExtractOptions(0.2))
    bare = sinks.shown(out, False, False).first()
    assert bare["entities"]["email"] == "ab@c.example.com" and bare["entities"]["ip_address"] == ["10.0.0.1"] and bare["contact"][0]["email"] == "ab@c.example.com"
    full = sinks.shown(out, True, True).first()
    assert full["entities"]["ip_address"][0].asDict().keys() == {"text", "confidence", "start", "end"}
    marked = api.extract(docs, Schema().with_entities("email").with_attributes(risk=AttributeGroup(("a", "b"))), RuleScorer(), options=ExtractOptions(0.2))
    row = sinks.shown(marked, False, False).first()["entities"]["email"][0]
    assert row["text"] == "ab@c.example.com" and row["attributes"]["risk"] in ("a", "b")


def test_tasks_in_the_session_s_order_and_ranked_probabilities(spark):
    docs = spark.createDataFrame([(1, "t")], DOCS)
    scored = spark.createDataFrame([(1, "z", "a", 0, 0.25), (1, "z", "b", 1, 0.75), (1, "y", "c", 0, 1.0)], "doc_id long, task string, label string, ix int, score double")
    assert sinks.classification_lines(docs, scored, False, 0.5, tasks=["z", "y"]).first()["line"] == "t\tz: a (0.250), *b (0.750) | y: *c (1.000)"
    ranked = sinks.ranked_probabilities(scored).where("task = 'z'").withColumns({"label": F.lit("b"), "confidence": F.lit(0.75)})
    shown = ranked.select(sinks.classification_json(ranked, False, "probabilities").alias("x")).first()["x"]
    assert list(json.loads(shown)["probabilities"].items()) == [("b", 0.75), ("a", 0.25)]
    assert len(sinks.ranked_probabilities(scored, 1).where("task = 'z'").first()["probabilities"]) == 1


@pytest.mark.parametrize("token", ["a-", "a_", "ab-cd_", "é-"])
def test_long_words_end_no_executor(spark, token):
    long = token * (1_000_000 // len(token)) + "a"
    docs = spark.createDataFrame([(1, f"see {long} end"), (2, "x")], DOCS)
    assert text.word_table(docs).where("id = 1").select("ix", "start", "end").collect() == [(0, 0, 3), (1, 4, 4 + len(long)), (2, 5 + len(long), 8 + len(long))]
    assert text.chunks(docs, ChunkOptions(2, 1)).count() == 3
    shown = docs.select(text.matches(F.col("text"), RegexValidator(r"see (\w|-)+ end")).alias("x")).collect()
    assert [r["x"] for r in shown] == [True, False]


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 16, 17, 300, 5000)]
    out = spark.createDataFrame(rows, "x array<int>").select("x", text.running_sums(F.col("x")).alias("y")).collect()
    assert all(r["y"] == [i * (i + 1) // 2 for i in r["x"]] for r in out)


def test_first_words_and_merged_lists(spark):
    one = spark.createDataFrame([("a-b, c  d",)], "t string")
    assert [one.select(text.first_words(F.col("t"), n)).first()[0] for n in (1, 2, 3, 9)] == ["a-b", "a-b,", "a-b, c", "a-b, c  d"]
    assert records.is_single(FieldSpec("x", STR), False) and not records.is_single(FieldSpec("x"), False)


def test_both_sides_of_a_conversation():
    both = [t.task for t in guardrails.tasks("both")]
    assert both == ["prompt_safety", "prompt_toxicity", "jailbreak_detection", "response_safety", "response_toxicity", "response_refusal"]
    assert [t.task for t in guardrails.tasks("response", toxicity=False)] == ["response_safety", "response_refusal"]
    with pytest.raises(SchemaError):
        guardrails.tasks("system")
