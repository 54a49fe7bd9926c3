"""Registered queries: each applies an operator family to a whole test table. ``oracle`` has the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions import scores as S
from .functions import text as T
from .operators import attributes, choices, classify, entities, guardrails, longdoc, pool, questions, records, relations, spans
from .plans.extraction import extract
from .schema import STR, AttributeGroup, Cardinality, ChunkOptions, EntitySpec, ExtractOptions, FieldSpec, OverlapPolicy, RegexValidator, Schema, StructureSpec
from .scorers.lexical import LexicalScorer
from .scorers.rule import RuleScorer
from .scorers.vector import VectorScorer
from .sources import readers
from .sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PII = ["email", "ip_address", "phone_number", "api_key", "password"]
CUES = oracle.CUES
CHUNKS = ChunkOptions(200, 40)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def found(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    return RuleScorer().spans(documents(spark, sf_dir), labels)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "label", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("score").cast("double").alias("score"), "text")


# ---- text -------------------------------------------------------------------------------------------------------


def _digest(docs: DataFrame, splitter: str = "whitespace") -> DataFrame:
    """Counts, offsets and words of a text as one row, made inside the row by one fold over its words."""

    def digest(led: Column) -> Column:
        pairs = F.transform(led, lambda w, i: F.struct((i % 1000 + 1).alias("k"), F.length(w).alias("n"), F.length(T.unled(w)).alias("m")))
        add = lambda s, w: F.struct((s["at"] + w["n"]).alias("at"), (s["sum"] + (s["at"] + w["n"] - w["m"]) * w["k"] + s["at"] + w["n"]).alias("sum"))
        zero = F.lit(0).cast("long")
        offsets = F.aggregate(pairs, F.struct(zero.alias("at"), zero.alias("sum")), add, lambda s: s["sum"])
        return F.struct(F.size(led).cast("long").alias("n_words"), offsets.alias("offsets"), F.md5(F.array_join(F.transform(led, T.unled), "\x1f").cast("binary")).alias("words_md5"))

    made = F.explode_outer(F.array(T.let(T.led_words(F.col("text"), splitter), digest)))  # so that no filter is pushed below it
    return docs.where("text is not null").select("doc_id", made.alias("x")).select("doc_id", "x.*").where("n_words > 0")


@query
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir))


@query
def tokenize_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(documents(spark, sf_dir), "char")


@query
def text_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased words of whole texts, with the end mark."""
    words = T.words(T.with_end_mark(F.coalesce("text", F.lit(""))))
    rows = documents(spark, sf_dir).select("doc_id", words.alias("words"))
    return rows.select("doc_id", F.array_join(F.transform("words", F.lower), " ").alias("model_words"), F.size("words").cast("long").alias("n_words"))


@query
def text_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word cap of a request: where the twelfth word of each text ends, if it has as many."""
    rows = documents(spark, sf_dir).where("text is not null").select("doc_id", T.first_words(F.col("text"), 12).alias("cut"))
    return rows.select("doc_id", F.length("cut").alias("n_chars"), F.md5(F.col("cut").cast("binary")).alias("cut_md5"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.chunks(documents(spark, sf_dir), CHUNKS)
    return out.select(F.col("id").alias("doc_id"), "chunk_ix", F.col("start").alias("start_char"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def span_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = documents(spark, sf_dir).select("doc_id", F.size(T.words(F.col("text"))).alias("n"))
    return pool.all_spans(lengths, ["doc_id"], "n", 8).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("start").cast("long") * 41 + F.col("end")).alias("checksum"))


# ---- entities ---------------------------------------------------------------------------------------------------


@query
def entities_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [EntitySpec("email", threshold=0.4), EntitySpec("ip_address"), EntitySpec("phone_number", threshold=0.7), EntitySpec("api_key"), EntitySpec("password")]
    return shown(entities.extract_entities(found(spark, sf_dir, PII), specs, ExtractOptions(include_spans=True)))


@query
def entities_abstained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstention, from the number of characters, and the count gate, from the number of matches in pairs, for want of a model."""
    rows = found(spark, sf_dir, PII)
    nulls = documents(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(x) for x in PII])).alias("label"), (F.length("text") % 7 - 3).cast("double").alias("null_logit"))
    counts = rows.groupBy("doc_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("count_class"))
    return shown(entities.where_counted(entities.without_abstained(rows, nulls, 0.75), counts))


@query
def entities_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        EntitySpec("email", validators=(RegexValidator(r"[a-z0-9.]+@mail[0-9]\.example\.(com|net|org)"),)),
        EntitySpec("ip_address", validators=(RegexValidator(r"^10\.", "partial", exclude=True), RegexValidator(r"[0-9.]+"))),
        EntitySpec("phone_number", validators=(RegexValidator(r"555", "partial"),)),
        EntitySpec("password", validators=(RegexValidator(r"(", exclude=True),)),
    ]
    return shown(entities.extract_entities(found(spark, sf_dir, PII), specs, ExtractOptions(threshold=0.3, include_spans=True)))


def _overlap(policy: OverlapPolicy, greedy: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(spans.resolve_overlaps(found(spark, sf_dir, ["name"]), entities.KEYS, policy, greedy))

    return run


QUERIES |= {f"overlap_{p.value}": _overlap(p) for p in OverlapPolicy} | {"overlap_greedy": _overlap(OverlapPolicy.FLAT, True)}


@query
def overlap_longest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spans.longest_by_join(found(spark, sf_dir, ["name"]), entities.KEYS))


@query
def entities_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [EntitySpec("name", dtype="str"), EntitySpec("email", dtype="str")]
    return shown(entities.extract_entities(found(spark, sf_dir, ["name", "email"]), specs))


@query
def entities_dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(entities.distinct_values(found(spark, sf_dir, ["name"]), False))


def _pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.resolve_overlaps(found(spark, sf_dir, PII), ["doc_id", "label"])
    order = F.array(*[F.lit(x) for x in PII])
    item = F.struct(F.array_position(order, F.col("label")).alias("ix"), "start", "end", "label")
    lists = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    return documents(spark, sf_dir).join(lists, "doc_id", "left")


@query
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(spans.redacted(F.col("text"), F.col("spans")))
    return _pii_spans(spark, sf_dir).select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), clean.alias("redacted"))


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.explode(spans.highlight_segments(F.col("text"), F.col("spans")))
    out = _pii_spans(spark, sf_dir).where("spans is not null").select("doc_id", parts.alias("x"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.count("x.label").alias("marked"), F.sum(F.length("x.text")).alias("chars"))


# ---- classification ---------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    return LexicalScorer(CUES[task]).labels(documents(spark, sf_dir), task, list(CUES[task]))


def _as_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "task", "label", F.round(F.col("score").cast("double"), 6).alias("score"))


@query
def classify_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_rows(classify.decide(_labels(spark, sf_dir, "language"), False))


@query
def classify_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_rows(classify.decide(_labels(spark, sf_dir, "topic"), True, 0.25))


@query
def classify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.top_labels(_labels(spark, sf_dir, "topic"), 2).select("doc_id", "label", F.col("rank").cast("long").alias("rank"))


@query
def classify_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over dot products with a unit vector for each label."""
    scorer = VectorScorer({f"axis{i}": [4.0 if j == i else 0.0 for j in range(64)] for i in range(4)})
    from .schema import ClassificationSpec

    logits = scorer.labels(table(spark, sf_dir, "embeddings"), "axis", list(scorer.vectors)).withColumnRenamed("score", "logit")
    return _as_rows(classify.probabilities(logits, ClassificationSpec("axis", tuple(scorer.vectors)), 0.5))


@query
def classify_sharded_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vector's own label stands among ten labels that are scored in shards of four."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("label"))
    out = None
    for shard in classify.sharded([str(i) for i in range(10)], 4):
        scored = rows.select("doc_id", F.lit("nearest").alias("task"), F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.round(F.get("embedding", F.lit(int(x))).cast("double"), 9).alias("score")) for x in shard])).alias("x")).select("doc_id", "task", "x.*")
        out = scored if out is None else out.union(scored)
    return classify.rank_of(out, rows).select("doc_id", "label", F.col("rank").cast("long").alias("rank"), F.col("labels").cast("long").alias("labels"))


@query
def classify_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold sweep of the junk task against the labels."""
    scored = _labels(spark, sf_dir, "topic").where("label = 'number'").join(table(spark, sf_dir, "labels"), "doc_id")
    steps = scored.select("quality", "score", F.explode(F.array(*[F.lit(i) for i in range(1, 8)])).alias("step"))
    hit = F.col("score") >= (F.col("step") / 8).cast("float")
    return steps.groupBy("step").agg(F.count_if(hit & (F.col("quality") == 1)).alias("good_above"), F.count_if(hit & (F.col("quality") == 0)).alias("bad_above"), F.count(F.lit(1)).alias("n"))


def _guard(side: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = guardrails.turns(table(spark, sf_dir, "conversations"), side).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
        out = None
        for spec in guardrails.tasks(side):
            scored = LexicalScorer({x: oracle.guard_cues(x) for x in spec.labels}).labels(rows, spec.task, list(spec.labels))
            kept = classify.decide(scored, spec.multi_label, 0.2)
            out = kept if out is None else out.union(kept)
        return _as_rows(out)

    return run


QUERIES |= {"guardrails_prompt": _guard("prompt"), "guardrails_response": _guard("response")}


@query
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected level, choice and yes-or-no of the three kinds of questions, from shares of cue words."""
    rows = _labels(spark, sf_dir, "topic")
    total = F.sum("score").over(Window.partitionBy("doc_id"))
    shares = rows.withColumn("score", F.col("score").cast("double") / total)
    level = questions.answers(shares, "score").select("doc_id", F.round("level", 6).alias("level"), F.round("confidence", 6).alias("level_confidence"))
    choice = questions.answers(shares, "choice").select("doc_id", F.col("answer").alias("choice"))
    yes = questions.answers(shares.withColumn("label", F.when(F.col("ix") == 0, "true").otherwise("false")), "noul").select("doc_id", F.round("probability", 6).alias("yes"))
    return level.join(choice, "doc_id").join(yes, "doc_id")


# ---- relations, attributes, choices, records ---------------------------------------------------------------------

ROLES = [("contact_mail", "head", "name"), ("contact_mail", "tail", "email"), ("contact_phone", "head", "name"), ("contact_phone", "tail", "phone_number"), ("beside", "head", "name"), ("beside", "tail", "name")]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame(ROLES, "relation string, role string, label string")
    return relations.propose_pairs(entities.above_threshold(found(spark, sf_dir, ["name", "email", "phone_number"]), [], ExtractOptions(threshold=0.0)), roles, threshold=0.6)


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "relation", "h_start", "h_end", "h_text", "t_start", "t_end", "t_text", F.col("score").cast("double").alias("score"))


@query
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_pairs(spark, sf_dir))


@query
def relation_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(relations.canonical_edges(_pairs(spark, sf_dir)))


@query
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(relations.relation_edges(_pairs(spark, sf_dir), 0.5))


def _attribute_logit(ix: Column, text: Column) -> Column:
    return ((F.length(text) * (ix + 3)) % 17 - 8) / 4


def _attributes(group: AttributeGroup) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = attributes.attribute_pairs(found(spark, sf_dir, PII), "risk", group)
        out = attributes.decide_attributes(pairs.withColumn("logit", _attribute_logit(F.col("ix"), F.col("text"))), group)
        return out.select("doc_id", "label", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "attribute", F.round("score", 6).alias("score"))

    return run


QUERIES |= {
    "attributes_single": _attributes(AttributeGroup(("low", "middle", "high"), applies_to=("email", "phone_number"))),
    "attributes_multi": _attributes(AttributeGroup(("low", "middle", "high"), True, 0.6)),
}


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = found(spark, sf_dir, ["amount"]).where("length(text) >= 3")
    owner = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return mails.select("doc_id", owner.alias("owner"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))


@query
def choice_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.choice_mentions(documents(spark, sf_dir), oracle.CHOICES).select("doc_id", "choice", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def choice_bind_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = choices.bind_to_anchors(choices.choice_mentions(documents(spark, sf_dir), oracle.CHOICES), _anchors(spark, sf_dir))
    return bound.select("doc_id", "owner", "choice", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query
def choice_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir)
    bound = choices.bind_to_anchors(choices.choice_mentions(documents(spark, sf_dir), oracle.CHOICES), anchors)
    return choices.nearest_to_anchor(bound, anchors).select("doc_id", "owner", "choice", F.col("start").alias("span_start"))


@query
def legacy_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [EntitySpec("email", dtype="str"), EntitySpec("phone_number"), EntitySpec("ip_address")]
    kept = entities.extract_entities(found(spark, sf_dir, PII), specs, ExtractOptions(threshold=0.4))
    out = records.legacy_structure(kept, [("email", True), ("phone_number", False), ("ip_address", False)])
    return out.select("doc_id", "email", F.array_join("phone_number", "|").alias("phone_numbers"), F.array_join("ip_address", "|").alias("ip_addresses"))


def _record_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents: their lines are candidates, and seeds of instances; logits are eighths."""
    # a line number can stand twice in an order: the pair is made unique
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    lines = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit("item").alias("structure"), F.col("l_linenumber").alias("cand"), "l_partkey", "l_suppkey")
    objects = lines.select("doc_id", "structure", F.col("cand").alias("inst"), ((F.col("l_partkey") % 17 - 6) / 8.0).alias("logit"))
    seeds = lines.select("doc_id", "structure", F.col("cand").alias("inst"), F.col("l_suppkey").alias("a"))
    cells = seeds.join(lines.select("doc_id", "structure", "cand", F.col("l_partkey").alias("b")), ["doc_id", "structure"]).unionByName(seeds.select("*", F.lit(records.ABSENT).alias("cand"), F.lit(5).cast("long").alias("b")))
    logit = lambda k: ((F.col("a") * k + F.col("b") * 3 + F.col("inst") * F.col("cand")) % 33 - 16) / 8.0
    fields = [("shared", 5), ("owned", 7), ("single", 11)]
    assign = cells.select("doc_id", "structure", "inst", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), logit(k).alias("logit")) for n, k in fields])).alias("x"), "cand").select("doc_id", "structure", "inst", "x.field", "cand", "x.logit")
    return objects, assign


RECORD_FIELDS = [records.RecordField("key", is_anchor=True), records.RecordField("shared", Cardinality.ZERO_OR_MORE), records.RecordField("owned", Cardinality.ZERO_OR_MORE, True), records.RecordField("single", Cardinality.OPTIONAL_ONE)]


def _record_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "inst", F.round("record_score", 6).alias("record_score"), "field", "cand", F.round("score", 6).alias("score"))


@query
def records_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_rows(records.decode_records(*_record_tables(spark, sf_dir), RECORD_FIELDS))


@query
def records_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_rows(records.without_repeated(records.decode_records(*_record_tables(spark, sf_dir), RECORD_FIELDS[1:])))


@query
def record_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint assignment of an exclusive single value."""
    objects, assign = _record_tables(spark, sf_dir)
    return _record_rows(records.decode_records(objects, assign, [records.RecordField("single", Cardinality.REQUIRED_ONE, True)]))


# ---- whole requests -----------------------------------------------------------------------------------------------


@query
def extract_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with two groups of attributes, through a request."""
    groups = {"risk": AttributeGroup(("low", "middle", "high"), applies_to=("email", "phone_number")), "flags": AttributeGroup(("old", "odd", "public"), True, 0.6, qualify_labels=True)}
    schema = Schema().with_entities("email", "phone_number", "ip_address").with_attributes(**groups)
    out = extract(documents(spark, sf_dir), schema, RuleScorer(), options=ExtractOptions(threshold=0.4, include_spans=True))
    mention = lambda x: F.concat_ws("|", x["text"], x["start"].cast("string"), x["attributes"]["risk"]["label"], F.format_string("%.6f", x["attributes"]["risk"]["confidence"].cast("double")), F.array_join(F.transform(x["attributes"]["flags"], lambda f: f["label"]), "+"))
    rows = [F.array_join(F.transform(F.array_sort(F.transform(f"entities.{x}", lambda m: F.struct(m["start"].alias("s"), m.alias("m")))), lambda m: mention(m["m"])), "\n").alias(x) for x in ("email", "phone_number")]
    return out.select("doc_id", *rows, F.size("entities.ip_address").cast("long").alias("ip_addresses"))


@query
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural records through a request: contacts around mail addresses, with the phone numbers and the address near each."""
    spec = StructureSpec("contact", (FieldSpec("email", STR), FieldSpec("phone_number", threshold=0.6), FieldSpec("ip_address", STR)))
    out = extract(documents(spark, sf_dir), Schema().with_structure(spec), RuleScorer(), options=ExtractOptions(threshold=0.4))
    rows = out.select("doc_id", F.posexplode("contact").alias("record_ix", "x"))
    one = lambda c: F.concat_ws("|", F.col(f"x.{c}.text"), F.format_string("%.6f", F.col(f"x.{c}.confidence").cast("double")))
    phones = F.array_join(F.transform("x.phone_number", lambda m: F.concat_ws("|", m["text"], F.format_string("%.6f", m["confidence"].cast("double")))), ";")
    return rows.select("doc_id", "record_ix", one("email").alias("email"), phones.alias("phone_numbers"), F.when(F.col("x.ip_address").isNotNull(), one("ip_address")).alias("ip_address"))


@query
def choice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field with choices: literal mentions near the record's anchor, else surfaces that equal a choice, else the choices' own scores."""
    words = ("the", "der", "le", "none")
    spec = StructureSpec("line", (FieldSpec("amount", STR), FieldSpec("word", STR, words, threshold=0.4)))
    out = extract(documents(spark, sf_dir), Schema().with_structure(spec), RuleScorer(), options=ExtractOptions(threshold=0.5))
    rows = out.select("doc_id", F.posexplode("line").alias("record_ix", "x"))
    return rows.select("doc_id", "record_ix", F.col("x.amount.text").alias("amount"), F.col("x.word.text").alias("word"), F.col("x.word.start").alias("word_start"), F.round(F.col("x.word.confidence").cast("double"), 5).alias("confidence"))


# ---- long documents -----------------------------------------------------------------------------------------------


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(documents(spark, sf_dir), CHUNKS).withColumnsRenamed({"id": "doc_id", "start": "chunk_start"}).withColumn("chunk", F.struct("doc_id", "chunk_ix", "chunk_start"))


@query
def long_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = RuleScorer(id_col="chunk").spans(_chunked(spark, sf_dir), PII)
    placed = longdoc.remapped(rows.select("doc_id.doc_id", "doc_id.chunk_ix", "doc_id.chunk_start", "label", "start", "end", "score", "text"))
    return shown(longdoc.merge_spans(placed, entities.KEYS, OverlapPolicy.FLAT, ["api_key"]))


@query
def long_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LexicalScorer(CUES["topic"], id_col="chunk").labels(_chunked(spark, sf_dir), "topic", list(CUES["topic"]))
    single = classify.decide(rows, False).select("doc_id.doc_id", "doc_id.chunk_ix", "task", "label", "score")
    multi = classify.decide(rows, True, 0.15).select("doc_id.doc_id", "doc_id.chunk_ix", "task", "label", "score")
    kinds = [("single", longdoc.merge_single_label(single)), ("multi", longdoc.merge_multi_label(multi)), ("vote", longdoc.merge_by_vote(single, ["doc_id", "task"]).withColumn("score", F.lit(0.0).cast("float")))]
    out = None
    for kind, merged in kinds:
        part = _as_rows(merged).withColumn("task", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query
def long_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = RuleScorer(id_col="chunk").spans(_chunked(spark, sf_dir), ["email", "phone_number"])
    ends = [rows.where(F.col("label") == x).select("doc_id", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("text").alias(f"{p}_text"), F.col("score").alias(f"_{p}")) for x, p in (("email", "h"), ("phone_number", "t"))]
    edges = ends[0].join(ends[1], "doc_id").select("doc_id.doc_id", "doc_id.chunk_ix", F.lit("mail_phone").alias("relation"), *[(F.col(c) + F.col("doc_id.chunk_start")).alias(c) for c in ("h_start", "h_end", "t_start", "t_end")], "h_text", "t_text", (F.col("_h") * F.col("_t")).alias("score"))
    return _edges(longdoc.merge_relations(edges))


# ---- pools and intervals -----------------------------------------------------------------------------------------


def _boundaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of vectors as boundary scores, rounded; two queries."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "x"))
    starts = rows.select("vec_id", "position", F.round(F.col("x").cast("double"), 4).alias("score"))
    ends = starts.select("vec_id", "position", F.round(-F.col("score"), 4).alias("score"))
    own = rows.select("vec_id", (F.col("position") % 2).alias("q"), F.col("position").alias("start"), (F.col("position") + F.col("position") % 4 + 1).alias("end"), F.round(F.abs("x").cast("double"), 4).alias("score"))
    return starts, ends, own


@query
def pool_topk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, ends, _ = _boundaries(spark, sf_dir)
    pairs = pool.boundary_pairs(pool.best_boundaries(pool.union_max(starts, ["vec_id"]), ["vec_id"], 6), pool.best_boundaries(ends, ["vec_id"], 6), ["vec_id"])
    return pool.pooled(pairs, ["vec_id"], 10).select("vec_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("score", 4).alias("score"), F.col("slot").cast("long").alias("slot"))


@query
def pool_quota_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pool.candidate_pool(*_boundaries(spark, sf_dir), ["vec_id"], "q", 6, 3, 12)
    return out.select("vec_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("score", 4).alias("score"), F.col("slot").cast("long").alias("slot"))


@query
def interval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over runs of five events of a user, the last run to the user's last event, from running sums of whole numbers."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ix = F.row_number().over(by_time) - 1
    rows = table(spark, sf_dir, "events").select("user_id", ix.alias("ix"), F.round(F.col("value") * 100).alias("cents"), F.lead(F.lit(1)).over(by_time).isNull().alias("last"))
    intervals = rows.where("ix % 5 = 4 or last").select("user_id", (F.col("ix") - F.col("ix") % 5).alias("start"), (F.col("ix") + 1).alias("end"))
    return S.interval_mean(rows.drop("last"), ["user_id"], "ix", "cents", intervals).select("user_id", F.col("start").cast("long").alias("first_ix"), F.round("mean", 4).alias("mean"))


@query
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over whole vectors: softmax, argmax, dot products, length features, buckets, smoothing."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("v"))
    p = S.softmax(F.col("v"))
    n = (F.col("vec_id") % 50 + 1).cast("double")
    f = S.length_features(n, F.lit(50.0))
    return rows.select(
        "vec_id", F.round(F.array_max(p), 6).alias("top"), S.first_argmax(F.col("v")).alias("best"), F.round(S.expected_level(p), 6).alias("level"), F.round(S.dot(F.col("v"), F.col("v")), 6).alias("norm2"),
        F.round(f["log_length"], 6).alias("log_length"), F.round(f["inverse_root"], 6).alias("inverse_root"), S.log_bucket((F.col("vec_id") % 200 - 100).cast("int"), 32, 128).alias("bucket"), F.round(S.smoothed(F.col("v")), 6).alias("smoothed"),
    )


# ---- events, sources, sinks --------------------------------------------------------------------------------------


@query
def events_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a six-place ring buffer after each user's last event."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).where("r <= 6")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "event_type"))), lambda x: x["event_type"]), ",").alias("last"))


@query
def events_action_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value"))


@query
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-hour windows, as the stream computes them (an extension)."""
    from .streaming.windows import hourly_counts

    return hourly_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("hour"), "event_type", "n")


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.md5(F.array_join(links, "\n").cast("binary")).alias("links_md5"))


@query
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a line file would give them: a row a line, blank ones dropped, the rest untouched."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ix", "value"))
    return readers.non_blank(lines).select("doc_id", "ix", F.md5(F.col("value").cast("binary")).alias("line_md5"))


@query
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from documents, each with one of ``oracle.REQUESTS``' changes, and the first thing that is wrong with it."""
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    text, body, kind = quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (template, content_type, _) in enumerate(oracle.REQUESTS):
        mine = F.col("doc_id") % len(oracle.REQUESTS) == i
        head, found, tail = template.partition("TEXT")
        body = F.when(mine, F.concat(F.lit(head), text, F.lit(tail)) if found else F.lit(head)).otherwise(body)
        kind = F.when(mine, F.lit(content_type).cast("string")).otherwise(kind)
    made = documents(spark, sf_dir).select("doc_id", body.alias("body"), kind.alias("content_type"))
    checked = readers.validated_requests(made, models=["multi"], supports=["entities", "classify"])
    return checked.select("doc_id", "status", F.col("error.param").alias("param"))


@query
def render_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated rows and text lines of a classification."""
    return sinks.classification_lines(documents(spark, sf_dir), _labels(spark, sf_dir, "topic"), True, 0.25)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_redact(spark, sf_dir)


ORACLE_SQL = oracle.ORACLE_SQL
