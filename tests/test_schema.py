import pytest

from textquarry import schema as S


def test_compact_fields():
    f = S.FieldSpec.parse("status::[shipped|pending]::Order status")
    assert (f.name, f.dtype, f.choices, f.description) == ("status", S.STR, ("shipped", "pending"), "Order status")
    assert f.cardinality is S.Cardinality.REQUIRED_ONE and f.exclusive
    assert S.FieldSpec.parse("tags::list::[a|b]").dtype == S.LIST
    assert S.FieldSpec.parse("name").dtype == S.LIST and S.FieldSpec.parse("name").cardinality is S.Cardinality.ZERO_OR_MORE


def test_default_cardinalities():
    assert S.FieldSpec("a", S.STR).cardinality_as(False) is S.Cardinality.OPTIONAL_ONE
    assert S.FieldSpec("a").cardinality_as(False) is S.Cardinality.ZERO_OR_MORE
    assert S.FieldSpec("a").cardinality_as(True) is S.Cardinality.REQUIRED_ONE
    assert S.Cardinality.ONE_OR_MORE.allows_absent is False and S.Cardinality.ONE_OR_MORE.is_scalar is False


def test_flags():
    s = S.schema_from_flags(["person:a human", "city"], ["works_at"], ["order=id::str,items", "x=a;b,c"], ["+mood=sad,glad", "kind=a:b,c"])
    assert [(e.name, e.description) for e in s.entities] == [("person", "a human"), ("city", None)]
    assert [f.name for f in s.structures[1].fields] == ["a", "b,c"]
    assert s.classifications[0].multi_label and s.classifications[1].labels == ("a:b", "c")
    assert S.schema_from_flags(classify=["kind=a:b,c"], describe_labels=True).classifications[0].label_descriptions == (("a", "b"),)
    assert S.schema_from_flags(structures=["o=a"], legacy=True).structures[0].mode is S.StructureMode.LEGACY
    for bad in ({"structures": ["oops"]}, {"classify": ["oops"]}, {}):
        with pytest.raises(S.SchemaError):
            S.schema_from_flags(**bad)


def test_parsers():
    assert S.parse_example("a => b => c") == ("a => b", "c")
    with pytest.raises(S.SchemaError):
        S.parse_example("=> c")
    with pytest.raises(S.SchemaError):
        S.parse_task("=a,b")
    assert S.OverlapPolicy.parse(" Keep-Longest ") is S.OverlapPolicy.LONGEST
    assert S.OverlapPolicy.parse("no_overlap") is S.OverlapPolicy.FLAT and S.OverlapPolicy.parse("none") is S.OverlapPolicy.ALLOW
    with pytest.raises(S.SchemaError):
        S.OverlapPolicy.parse("sideways")


def test_prompt_layout():
    tokens = S.prompt_tokens("entities", ["person", "company"], S.ENTITY, None, [("person", "a human"), ("other", "x")])
    assert list(tokens) == ["(", "[P]", "entities [DESCRIPTION] person: a human", "(", "[E]", "person", "[E]", "company", ")", ")"]
    c = S.ClassificationSpec("mood", ("sad", "glad"), prompt="how", examples=(("hi", "glad"), ("x", "y")))
    group = S.prompt_groups(S.Schema().with_classification(c))[0]
    assert group.tokens[2] == "mood: how [EXAMPLE] hi [OUTPUT] glad"
    s = S.Schema().with_relations("r", "r").with_structure(S.StructureSpec.parse("o", ["a::[x|y]", "b"]))
    assert [g.kind for g in S.prompt_groups(s)] == ["structure", "relation"]
    assert S.choice_prefix(s) == ("(", "o:", "a", "(", "x", "|", "y", ")", ")")


def test_attributes_become_hidden_entities():
    s = S.Schema().with_entities("person", "b").with_attributes(tone=S.AttributeGroup(("c", "b"), qualify_labels=False), age=S.AttributeGroup(("old",), qualify_labels=True))
    assert [(e.name, e.is_attribute) for e in s.entities] == [("person", False), ("b", False), ("age: old", True), ("c", True)]


def test_entity_is_declared_again():
    v = (S.RegexValidator("x"),)
    s = S.Schema().with_entity(S.EntitySpec("a", "d", 0.3, S.STR, v)).with_entity(S.EntitySpec("a", None, 0.7))
    assert s.entities == (S.EntitySpec("a", "d", 0.7, S.LIST, v),)


@pytest.mark.parametrize(
    "schema",
    [
        S.Schema(),
        S.Schema().with_relations("r", "r"),
        S.Schema().with_classification(S.ClassificationSpec("entities", ("a", "b"))),
        S.Schema().with_classification(S.ClassificationSpec("t", ("a",))),
        S.Schema().with_structure(S.StructureSpec("s", ())),
        S.Schema().with_structure(S.StructureSpec("s", (S.FieldSpec("a"),), anchor="b")),
    ],
)
def test_impossible_schemas(schema):
    with pytest.raises(S.SchemaError):
        schema.validate()


def test_sessions_and_questions():
    session = S.Session(prompt="p", examples=[("x", "a"), ("y", "z")], threshold=0.3).add("t=a,b:desc")
    spec = session.specs()[0]
    assert (spec.prompt, spec.examples, spec.threshold, spec.label_descriptions) == ("p", (("x", "a"),), 0.3, (("b", "desc"),))
    for bad in (S.Session(), S.Session().add("t=a")):
        with pytest.raises(S.SchemaError):
            bad.specs()
    assert S.question_task("q,1", "score", "how", {"2": "high", "1": "low: ok"}).labels == ("1", "2")
    assert S.question_task("q", "noul").labels == (S.YES, S.NO)
    with pytest.raises(S.SchemaError):
        S.question_task("q", "other")


def test_chunk_options():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(S.SchemaError):
            S.ChunkOptions(size, overlap)
