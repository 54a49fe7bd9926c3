"""The network on small random weights: shapes, masks, and agreement with plain loops. Nothing here says how well a model does."""

import json
import math

import numpy as np
import pytest

from textquarry.schema import ClassificationSpec, Schema, SchemaError
from textquarry.scorers import network as N
from textquarry.scorers.checkpoint import CheckpointScorer, Model
from textquarry.scorers.weights import Checkpoint, check_config, open_checkpoint, read_tensors, write_tensors

H, D, P, C = 8, 4, 4, 6
DEBERTA = {"hidden_size": H, "num_attention_heads": 2, "num_hidden_layers": 2, "intermediate_size": 12, "layer_norm_eps": 1e-7, "max_position_embeddings": 32, "position_buckets": 4, "vocab_size": 60, "relative_attention": True, "share_att_key": True, "pos_att_type": ["p2c", "c2p"], "position_biased_input": False, "norm_rel_ebd": "layer_norm", "hidden_act": "gelu"}
MODERN = {"model_type": "modernbert", "hidden_size": H, "num_attention_heads": 2, "num_hidden_layers": 2, "intermediate_size": 12, "norm_eps": 1e-5, "local_attention": 2, "layer_types": ["full_attention", "sliding_attention"], "vocab_size": 60, "rope_parameters": {"full_attention": {"rope_theta": 1e4}, "sliding_attention": {"rope_theta": 1e3}}}
HEAD = {"boundary_dim": D, "boundary_attention_heads": 2, "boundary_attention_layers": 1, "boundary_attention_window": 2, "boundary_refinement_layers": 1, "boundary_ffn_multiplier": 2.0, "pair_dim": P, "content_dim": C, "content_soft_max_pool": False, "enable_span_content": True, "use_inside_evidence": True, "candidate_pool": "shared", "candidate_attention_layers": 0, "query_attention_layers": 0, "pool_boundary_top_k": 6, "pool_size": 12, "min_pool_per_query": 2, "enable_abstention": True, "abstention_threshold": 0.99, "adaptive_threshold": False, "pair_temperature": 1.0, "classification_temperature": 2.0, "relation_biaffine_content": True, "enable_rotary_endpoints": True, "rotary_base": 100.0, "multihead_pair_compat_heads": 2, "query_conditioned_inside_weight": True, "endpoint_difference_features": True, "reranker_endpoint_compat": True}


def random_tensors(shapes, seed=0):
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(size=s) * 0.5).astype(np.float32) for k, s in shapes.items()}


def lin(name, out, given):
    return {f"{name}.weight": (out, given), f"{name}.bias": (out,)}


def norm(name, n):
    return {f"{name}.weight": (n,), f"{name}.bias": (n,)}


def deberta_shapes():
    s = {"encoder.embeddings.word_embeddings.weight": (60, H), "encoder.encoder.rel_embeddings.weight": (8, H)} | norm("encoder.embeddings.LayerNorm", H) | norm("encoder.encoder.LayerNorm", H)
    for i in range(2):
        p = f"encoder.encoder.layer.{i}"
        for n in ("query", "key", "value"):
            s |= lin(f"{p}.attention.self.{n}_proj", H, H)
        s |= lin(f"{p}.attention.output.dense", H, H) | norm(f"{p}.attention.output.LayerNorm", H) | lin(f"{p}.intermediate.dense", 12, H) | lin(f"{p}.output.dense", H, 12) | norm(f"{p}.output.LayerNorm", H)
    return s


def modern_shapes():
    s = {"encoder.embeddings.tok_embeddings.weight": (60, H), "encoder.embeddings.norm.weight": (H,), "encoder.final_norm.weight": (H,)}
    for i in range(2):
        p = f"encoder.layers.{i}"
        s |= {f"{p}.attn.Wqkv.weight": (3 * H, H), f"{p}.attn.Wo.weight": (H, H), f"{p}.mlp_norm.weight": (H,), f"{p}.attn_norm.weight": (H,), f"{p}.mlp.Wi.weight": (24, H), f"{p}.mlp.Wo.weight": (H, 12)}
    return s


def head_shapes():
    b = "boundary_head."
    s = {f"{b}boundary_encoder.bos_state": (H,), f"{b}boundary_encoder.eos_state": (H,)}
    for name, out, given in [
        ("boundary_encoder.left_projection", D, H), ("boundary_encoder.right_projection", D, H), ("boundary_encoder.output_projection", D, 2 * D), ("boundary_encoder.attention_blocks.0.qkv_projection", 3 * D, D), ("boundary_encoder.attention_blocks.0.output_projection", D, D),
        ("boundary_encoder.refinement_blocks.0.input_projection", 16, D), ("boundary_encoder.refinement_blocks.0.output_projection", D, 8), ("boundary_query_head.start_boundary_projection", D, D), ("boundary_query_head.start_query_projection", D, H), ("boundary_query_head.end_boundary_projection", D, D),
        ("boundary_query_head.end_query_projection", D, H), ("boundary_query_head.inside_text_projection", D, H), ("boundary_query_head.inside_query_projection", D, H), ("shared_pool_builder.start_projection", D, D), ("shared_pool_builder.end_projection", D, D), ("shared_pool_scorer.start_projection", P, D),
        ("shared_pool_scorer.end_projection", P, D), ("shared_pool_scorer.length_projection", P, 3), ("shared_pool_scorer.prior_projection", P, 1), ("shared_pool_scorer.content_pooler.value_projection", C, H), ("shared_pool_scorer.content_projection", P, C), ("shared_pool_scorer.query_projection", P, H),
        ("shared_pool_scorer.film", 2 * P, P), ("shared_pool_scorer.film_output.0", 64, P), ("shared_pool_scorer.film_output.3", 1, 64), ("null_projection", 1, H), ("candidate_encoder", H, 2 * D), ("boundary_proposer.start_pair_projection", D, D), ("boundary_proposer.end_key_projection", D, D),
        ("boundary_proposer.start_query_projection", D // 2, H), ("pair_scorer.start_endpoint_projection", P, D), ("pair_scorer.end_endpoint_projection", P, D), ("pair_scorer.query_gate", P // 2, H), ("pair_scorer.length_query_projection", 3, H), ("pair_scorer.inside_weight", 1, H),
        ("pair_scorer.endpoint_difference_projection", 1, 2 * P), ("pair_scorer.content_pooler.value_projection", C, H), ("pair_scorer.content_query_projection", C, H), ("pair_scorer.content_bias", 1, C), ("pair_scorer.compat_mix", 1, 2),
    ]:
        s |= lin(b + name, out, given)
    for name, n in [("boundary_encoder.layer_norm", D), ("boundary_encoder.attention_blocks.0.norm", D), ("boundary_encoder.refinement_blocks.0.norm", D), ("shared_pool_scorer.content_pooler.layer_norm", C), ("shared_pool_scorer.candidate_norm", P), ("pair_scorer.content_pooler.layer_norm", C)]:
        s |= norm(b + name, n)
    return s | lin("classifier.0", 2 * H, H) | lin("classifier.3", 1, 2 * H)


def boundary_checkpoint():
    return Checkpoint({"architecture": "boundary", "boundary_head": HEAD}, DEBERTA, "", random_tensors(deberta_shapes() | head_shapes()))


def test_erf():
    x = np.linspace(-4, 4, 101)
    assert np.abs(N.erf(x) - [math.erf(v) for v in x]).max() < 2e-7


def test_relative_attention_matches_plain_loops():
    c = boundary_checkpoint()
    ids = np.array([3, 1, 4, 1, 5, 9, 2])
    p, heads, t = N.Parameters(c.tensors, "encoder."), 2, len(ids)
    x = p.at("embeddings").norm("LayerNorm", p.get("embeddings.word_embeddings.weight")[ids], 1e-7)
    rel = p.at("encoder").norm("LayerNorm", p.get("encoder.rel_embeddings.weight"), 1e-7)
    bucket = N.bucketed_distances(t, 4, 32)
    for i in range(2):
        layer = p.at(f"encoder.layer.{i}")
        s = layer.at("attention.self")
        q, k, v, pq, pk = s.linear("query_proj", x), s.linear("key_proj", x), s.linear("value_proj", x), s.linear("query_proj", rel), s.linear("key_proj", rel)
        out, w = np.zeros_like(x), H // heads
        for h in range(heads):
            a = slice(h * w, (h + 1) * w)
            for i1 in range(t):
                row = []
                for j in range(t):
                    c2p, p2c = np.clip(bucket[i1, j] + 4, 0, 7), np.clip(-bucket[j, i1] + 4, 0, 7)
                    row.append((q[i1, a] @ k[j, a] + q[i1, a] @ pk[c2p, a] + k[j, a] @ pq[p2c, a]) / math.sqrt(3 * w))
                out[i1, a] = N.softmax(np.array(row)) @ v[:, a]
        o = layer.at("attention.output")
        x = o.norm("LayerNorm", o.linear("dense", out) + x, 1e-7)
        x = layer.at("output").norm("LayerNorm", layer.linear("output.dense", N.gelu(layer.linear("intermediate.dense", x))) + x, 1e-7)
    assert np.abs(N.encode(c, ids.tolist()) - x).max() < 1e-4


def test_distances_are_bucketed():
    far = N.bucketed_distances(600, 256, 512)
    near = np.abs(np.subtract.outer(np.arange(600), np.arange(600))) <= 128
    assert (far[near] == np.subtract.outer(np.arange(600), np.arange(600))[near]).all()
    assert far[511, 0] == 255 and far[0, 511] == -255


def test_rotary_encoder_slides_and_ignores_order_of_batches():
    c = Checkpoint({"counting_layer": "count_lstm", "max_width": 3}, MODERN, "", random_tensors(modern_shapes()))
    check_config(c)
    texts = [[1, 2, 3], [4, 5, 6, 7, 8], [9]]
    for one, many in zip(texts, N.encode_batch(c, texts), strict=True):
        assert np.allclose(N.encode(c, one), many, atol=1e-6) and many.shape == (len(one), H)
    only_local = Checkpoint(c.config, MODERN | {"layer_types": ["sliding_attention"] * 2}, "", c.tensors)
    a, b = N.encode(only_local, [1, 2, 3, 4, 5, 6]), N.encode(only_local, [1, 2, 3, 4, 5, 7])
    assert np.allclose(a[:3], b[:3], atol=1e-5) and not np.allclose(a[4], b[4], atol=1e-3)  # two layers reach two words


def test_candidates_and_explicit_spans():
    c = boundary_checkpoint()
    p, rng = N.Parameters(c.tensors).at("boundary_head"), np.random.default_rng(1)
    text, query = rng.normal(size=(9, H)), rng.normal(size=(3, H))
    found = N.score_candidates(p, HEAD, text, query)
    assert found.logits.shape == (3, len(found.spans)) and 0 < len(found.spans) <= HEAD["pool_size"]
    assert (found.spans[:, 0] < found.spans[:, 1]).all() and len({tuple(s) for s in found.spans.tolist()}) == len(found.spans)
    for q in range(3):  # intervals by running sums are those by plain sums
        m = N.Parameters(c.tensors).at("boundary_head.boundary_query_head")
        inside = (m.linear("inside_query_projection", query) @ m.linear("inside_text_projection", text).T / 2)[q]
        want = [inside[a:b].sum() / math.sqrt(b - a) for a, b in found.spans]
        assert np.allclose(N.inside_terms(found, found.spans, q), want, atol=1e-5)
    one = N.score_spans(p, HEAD, found, text, query, 1, np.array([[0, 2], [3, 9]]))
    two = N.score_spans(p, HEAD, found, text, query, 1, np.array([[3, 9]]))
    assert np.allclose(one[1], two[0]) and N.score_spans(p, HEAD, found, text, query, 0, np.zeros((0, 2), dtype=int)).shape == (0,)
    assert N.candidate_states(p, found).shape == (len(found.spans), H)


def test_pool_prefers_each_query_s_own():
    rng = np.random.default_rng(0)
    start, end = rng.normal(size=(2, 7)), rng.normal(size=(2, 7))
    start[1] -= 50
    end[1] -= 50
    cfg = {"pool_boundary_top_k": 7, "pool_size": 100, "min_pool_per_query": 1}
    spans = N.pool_spans(cfg, start, end, np.zeros((7, 7)))
    own = max(((start[1][a] + end[1][b], -a, -b) for a in range(7) for b in range(a + 1, 7)))
    assert (-own[1], -own[2]) in [tuple(s) for s in spans[:2].tolist()] and len(spans) == 21


def test_relations_records_and_counts():
    rng = np.random.default_rng(2)
    shapes = lin("r.mlp.0", H, 4 * H + 2 * H + 2) | lin("r.mlp.3", 1, H) | lin("r.head_content_projection", H, H) | lin("r.tail_content_projection", H, H) | lin("r.relation_content_gate", H, 2 * H) | lin("r.content_linear", 1, 4 * H)
    shapes |= {"d.null_embed": (5,), "d.instance_embed": (3, H)} | lin("d.inst_proj", 5, H) | lin("d.field_proj", 5, H) | lin("d.cand_proj", 5, H) | lin("d.object_head", 1, H) | lin("d.latent_seed_head", 1, H) | lin("d.q_proj", 5, H) | lin("d.k_proj", 5, H) | lin("d.v_proj", H, H)
    shapes |= lin("n.0", 2 * H, H) | lin("n.2", 20, 2 * H) | {"e.pos_embedding.weight": (20, H), "e.gru.weight_ih_l0": (3 * H, H), "e.gru.weight_hh_l0": (3 * H, H), "e.gru.bias_ih_l0": (3 * H,), "e.gru.bias_hh_l0": (3 * H,)} | lin("e.projector.0", 4 * H, 2 * H) | lin("e.projector.2", H, 4 * H)
    for n, given in (("project_start", H), ("project_end", H), ("out_project", 2 * H)):
        shapes |= lin(f"s.span_rep_layer.{n}.0", 4 * H, given) | lin(f"s.span_rep_layer.{n}.3", H, 4 * H)
    p = N.Parameters(random_tensors(shapes))
    text = rng.normal(size=(6, H))
    rel = N.relation_states(text[:2], text[2:4], True)
    pairs = np.array([[0, 0, 2, 3, 6], [1, 5, 6, 0, 1]])
    both = N.relation_logits(p.at("r"), {"relation_biaffine_content": True}, text, rel, pairs)
    assert np.allclose(both[1], N.relation_logits(p.at("r"), {"relation_biaffine_content": True}, text, rel, pairs[1:])[0])
    head = N.RecordHead(p.at("d"), 5)
    states, logits = head.anchorless(text)
    assert states.shape == (3, H) and logits.shape == (3,) and head.latent_seeds(text).shape == (6,)
    assert head.assign(states, text, text[:2]).shape == (2, 3, 7)
    assert 0 <= N.count_class(p.at("n"), text[0]) < 20 and N.counted_fields(p.at("e"), text).shape == text.shape
    spans, shown = N.span_states(p.at("s"), text, 3)
    assert len(spans) == len(shown) == 15 and (spans[:, 1] - spans[:, 0]).max() == 3


def save(folder, c):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["[UNK]", "(", ")", "[P]", "[E]", "[L]", "[SEP_STRUCT]", "[SEP_TEXT]", "entities", "name", "city", "mood", "sad", "glad", "ann", "went", "to", "rome", ".", "and", "was"]
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, "[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    (folder / "encoder_config").mkdir(parents=True)
    t.save(str(folder / "tokenizer.json"))
    (folder / "config.json").write_text(json.dumps(c.config))
    (folder / "encoder_config/config.json").write_text(json.dumps(c.encoder))
    write_tensors(folder / "model.safetensors", c.tensors)


def test_scorer_runs_on_a_saved_checkpoint(spark, tmp_path):
    c = boundary_checkpoint()
    save(tmp_path / "m", c)
    opened = open_checkpoint(str(tmp_path / "m"))
    assert all((opened.tensors[k] == v).all() for k, v in c.tensors.items())
    docs = spark.createDataFrame([(1, "Ann went to Rome"), (2, None), (3, "")], "doc_id long, text string")
    scorer = CheckpointScorer(str(tmp_path / "m"))
    rows = scorer.spans(docs, ["name", "city"]).collect()
    assert rows and all("Ann went to Rome"[r["start"] : r["end"]].strip() == r["text"] and 0 <= r["score"] <= 1 for r in rows if r["doc_id"] == 1)
    assert {r["doc_id"] for r in rows} == {1}  # a text that is only its added mark has no span
    labels = scorer.labels(docs, "mood", ["sad", "glad"]).collect()
    assert len(labels) == 6 and all(abs(sum(r["score"] for r in labels if r["doc_id"] == i) - 1) < 1e-5 for i in (1, 2, 3))


def test_prompt_markers_are_found(tmp_path):
    save(tmp_path / "m", boundary_checkpoint())
    model = Model(open_checkpoint(str(tmp_path / "m")))
    schema = Schema().with_entities("name", "city").with_classification(ClassificationSpec("mood", ("sad", "glad")))
    given = model.prepare("Ann went", schema)
    tokens = [model.tokenizer.id_to_token(i) for i in given.ids]
    assert [tokens[i] for i in given.prompt_at] == ["[P]", "[P]"]
    assert [[tokens[i] for i in m] for m in given.fields_at] == [["[E]", "[E]"], ["[L]", "[L]"]]
    assert [tokens[i] for i in given.word_at] == ["ann", "went", "."]


def test_bad_files_are_refused(tmp_path):
    with pytest.raises(SchemaError):
        read_tensors(np.zeros(4, dtype=np.uint8))
    head = json.dumps({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 4]}}).encode()
    data = np.frombuffer(len(head).to_bytes(8, "little") + head + b"\0" * 8, dtype=np.uint8)
    with pytest.raises(SchemaError, match="fit"):
        read_tensors(data)
    with pytest.raises(SchemaError, match="lacks"):
        open_checkpoint(str(tmp_path))
    for change in ({"candidate_pool": "own"}, {"adaptive_threshold": True}, {"enable_span_content": False}, {"pair_dim": 5}):
        with pytest.raises(SchemaError):
            check_config(Checkpoint({"architecture": "boundary", "boundary_head": HEAD | change}, DEBERTA, ""))
    with pytest.raises(SchemaError):
        check_config(Checkpoint({"architecture": "boundary", "boundary_head": HEAD}, DEBERTA | {"pos_att_type": ["c2p"]}, ""))
    with pytest.raises(SchemaError):
        _ = Checkpoint({}, DEBERTA, "").architecture


def test_a_request_s_every_kind_runs_on_a_checkpoint(spark, tmp_path):
    from textquarry import api
    from textquarry.schema import STR, AttributeGroup, ExtractOptions, FieldSpec, StructureMode, StructureSpec
    from textquarry.scorers.weights import FILES, checkpoint_from_bytes

    c = boundary_checkpoint()
    more = {"record_dim": 5, "record_temperature": 1.0, "relation_temperature": 1.0, "directional_relation_states": True, "relation_heads_per_type": 4, "relation_tails_per_type": 4, "relation_pair_cap": 8, "relation_argument_proposal_threshold": 0.0}
    c.config["boundary_head"] = c.config["boundary_head"] | more
    r, d = "relation_scorer", "record_decoder"
    shapes = lin(f"{r}.mlp.0", H, 4 * H + 2 * H + 2) | lin(f"{r}.mlp.3", 1, H) | lin(f"{r}.head_content_projection", H, H) | lin(f"{r}.tail_content_projection", H, H) | lin(f"{r}.relation_content_gate", H, 2 * H) | lin(f"{r}.content_linear", 1, 4 * H)
    shapes |= {f"{d}.null_embed": (5,), f"{d}.instance_embed": (3, H)} | lin(f"{d}.inst_proj", 5, H) | lin(f"{d}.field_proj", 5, H) | lin(f"{d}.cand_proj", 5, H) | lin(f"{d}.object_head", 1, H) | lin(f"{d}.latent_seed_head", 1, H) | lin(f"{d}.q_proj", 5, H) | lin(f"{d}.k_proj", 5, H) | lin(f"{d}.v_proj", H, H)
    c.tensors = c.tensors | random_tensors(shapes, 3)
    save(tmp_path / "m", c)
    text = "Ann went to Rome and was glad"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    schema = Schema().with_entities("name", "city").with_attributes(mood=AttributeGroup(("sad", "glad"))).with_relations("went")
    for name, mode in (("a", StructureMode.AUTO), ("b", StructureMode.LATENT), ("c", StructureMode.ANCHORLESS)):
        schema = schema.with_structure(StructureSpec(name, (FieldSpec("name", STR), FieldSpec("city"), FieldSpec("mood", STR, ("sad", "glad"))), mode))
    scorer = CheckpointScorer(str(tmp_path / "m"))
    rows = {x["doc_id"]: x for x in api.extract(docs, schema, scorer, options=ExtractOptions(0.01)).collect()}
    assert set(rows) == {1, 2} and rows[2]["entities"]["name"] == [] and rows[2]["a"] == []
    found = [m for x in ("name", "city") for m in rows[1]["entities"][x]]
    assert found and all(m["attributes"]["mood"]["label"] in ("sad", "glad") and text[m["start"] : m["end"]].strip() == m["text"] for m in found)
    assert rows[1]["relation_extraction"] and all(text[e["h_start"] : e["h_end"]].strip() == e["h_text"] for e in rows[1]["relation_extraction"]["went"])
    shown = [m for s in "abc" for record in rows[1][s] for m in [record["name"], *record["city"]] if m]
    assert shown and all(text[m["start"] : m["end"]].strip() == m["text"] and 0 <= m["confidence"] <= 1 for m in shown)
    assert all(record["mood"] is None or record["mood"]["text"] in ("sad", "glad") for s in "abc" for record in rows[1][s])
    held = checkpoint_from_bytes({f: (tmp_path / "m" / f).read_bytes() for f in FILES})
    assert Model(held).span_scores(text, ["name"]) == Model(open_checkpoint(str(tmp_path / "m"))).span_scores(text, ["name"])
    with pytest.raises(SchemaError, match="lacks"):
        checkpoint_from_bytes({})
