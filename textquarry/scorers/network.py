"""The network of a checkpoint in numpy: encoders, and the heads that turn states into logits.

Everything works on one text's states (tokens x hidden). Names of parameters are those of the checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .weights import Checkpoint

LOW = -1.0e4
"""The logit of what is masked out of a pool."""


def erf(x: np.ndarray) -> np.ndarray:
    """To about 1e-7, by a rational polynomial."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2.0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def normed(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | float, eps: float) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + eps) * weight + bias


class Parameters:
    """Access to parameters below a prefix."""

    def __init__(self, tensors: dict[str, np.ndarray], prefix: str = "") -> None:
        self.tensors, self.prefix = tensors, prefix

    def at(self, name: str) -> Parameters:
        return Parameters(self.tensors, f"{self.prefix}{name}.")

    def get(self, name: str) -> np.ndarray:
        return np.asarray(self.tensors[self.prefix + name], dtype=np.float32)

    def has(self, name: str) -> bool:
        return self.prefix + name in self.tensors

    def linear(self, name: str, x: np.ndarray) -> np.ndarray:
        y = x @ self.get(f"{name}.weight").T
        return y + self.get(f"{name}.bias") if self.has(f"{name}.bias") else y

    def norm(self, name: str, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        return normed(x, self.get(f"{name}.weight"), self.get(f"{name}.bias") if self.has(f"{name}.bias") else 0.0, eps)

    def mlp(self, first: str, second: str, x: np.ndarray) -> np.ndarray:
        return self.linear(second, np.maximum(self.linear(first, x), 0))


# ---- encoders ---------------------------------------------------------------------------------------------------


def bucketed_distances(n: int, buckets: int, most: int) -> np.ndarray:
    """Relative positions i - j, exact near zero and logarithmic beyond half the buckets."""
    rel = np.subtract.outer(np.arange(n), np.arange(n))
    if buckets <= 0 or most <= 0:
        return rel
    middle = buckets // 2
    size = np.maximum(np.abs(rel), 1).astype(np.float32)
    far = np.ceil(np.log(size / np.float32(middle)) / np.log(np.float32((most - 1) / middle)) * np.float32(middle - 1)) + middle
    return np.where(np.abs(rel) <= middle, rel, (far * np.sign(rel)).astype(np.int64))


def _heads(x: np.ndarray, heads: int) -> np.ndarray:
    return x.reshape(len(x), heads, -1).swapaxes(0, 1)


def relative_encoder(p: Parameters, cfg: dict, ids: np.ndarray) -> np.ndarray:
    """Disentangled attention: content to content, content to position and position to content; positions share the content's projections."""
    eps, heads = cfg["layer_norm_eps"], cfg["num_attention_heads"]
    x = p.at("embeddings").norm("LayerNorm", p.get("embeddings.word_embeddings.weight")[ids], eps)
    most = cfg.get("max_relative_positions", -1)
    most = cfg["max_position_embeddings"] if most < 1 else most
    buckets = cfg.get("position_buckets", -1)
    span = buckets if buckets > 0 else most
    rel = bucketed_distances(len(ids), buckets, most)
    to_key = np.clip(rel + span, 0, 2 * span - 1)[None]
    to_query = np.clip(-rel + span, 0, 2 * span - 1)[None]
    enc = p.at("encoder")
    positions = enc.norm("LayerNorm", enc.get("rel_embeddings.weight"), eps)
    scale = np.sqrt(3.0 * cfg["hidden_size"] / heads)
    for i in range(cfg["num_hidden_layers"]):
        layer = enc.at(f"layer.{i}")
        own = layer.at("attention.self")
        q, k, v = (_heads(own.linear(f"{n}_proj", x), heads) for n in ("query", "key", "value"))
        pos_q, pos_k = (_heads(own.linear(f"{n}_proj", positions), heads) for n in ("query", "key"))
        scores = q @ k.swapaxes(1, 2)
        scores = scores + np.take_along_axis(q @ pos_k.swapaxes(1, 2), np.broadcast_to(to_key, scores.shape), 2)
        scores = scores + np.take_along_axis(k @ pos_q.swapaxes(1, 2), np.broadcast_to(to_query, scores.shape), 2).swapaxes(1, 2)
        mixed = (softmax(scores / scale) @ v).swapaxes(0, 1).reshape(x.shape)
        a = layer.at("attention.output")
        x = a.norm("LayerNorm", a.linear("dense", mixed) + x, eps)
        x = layer.at("output").norm("LayerNorm", layer.linear("output.dense", gelu(layer.linear("intermediate.dense", x))) + x, eps)
    return x


def _turned(x: np.ndarray, theta: float) -> np.ndarray:
    """Rotary positions over halves of the head's dimensions."""
    n, d = x.shape[-2:]
    angle = np.arange(n)[:, None] / theta ** (2 * np.arange(d // 2) / d)
    cos, sin = np.tile(np.cos(angle), 2), np.tile(np.sin(angle), 2)
    back = np.concatenate([-x[..., d // 2 :], x[..., : d // 2]], axis=-1)
    return x * cos + back * sin


def rotary_encoder(p: Parameters, cfg: dict, ids: np.ndarray) -> np.ndarray:
    """Pre-normalized layers with rotary positions, global or sliding attention, and gated feed-forward parts."""
    eps, heads = cfg["norm_eps"], cfg["num_attention_heads"]
    x = p.at("embeddings").norm("norm", p.get("embeddings.tok_embeddings.weight")[ids], eps)
    distance = np.abs(np.subtract.outer(np.arange(len(ids)), np.arange(len(ids))))
    near = np.where(distance > cfg["local_attention"] // 2, np.float32(-6.0e4), np.float32(0))
    for i, kind in enumerate(cfg["layer_types"][: cfg["num_hidden_layers"]]):
        layer = p.at(f"layers.{i}")
        theta = cfg["rope_parameters"][kind]["rope_theta"]
        given = layer.norm("attn_norm", x, eps) if i else x
        qkv = layer.linear("attn.Wqkv", given).reshape(len(ids), 3, heads, -1).transpose(1, 2, 0, 3)
        q, k, v = _turned(qkv[0], theta), _turned(qkv[1], theta), qkv[2]
        scores = q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])
        weights = softmax(scores if kind == "full_attention" else scores + near)
        x = x + layer.linear("attn.Wo", (weights @ v).swapaxes(0, 1).reshape(x.shape))
        both = layer.linear("mlp.Wi", layer.norm("mlp_norm", x, eps))
        gate, up = np.split(both, 2, axis=-1)
        x = x + layer.linear("mlp.Wo", gelu(gate) * up)
    return p.norm("final_norm", x, eps)


def encode(c: Checkpoint, ids: list[int]) -> np.ndarray:
    run = rotary_encoder if c.encoder.get("model_type") == "modernbert" else relative_encoder
    return run(Parameters(c.tensors, "encoder."), c.encoder, np.asarray(ids, dtype=np.int64))


def encode_batch(c: Checkpoint, texts: list[list[int]]) -> list[np.ndarray]:
    """Texts one by one, the longest first: without padding, so the result is that of each alone."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list[np.ndarray | None] = [None] * len(texts)
    for i in order:
        out[i] = encode(c, texts[i])
    return out


# ---- the boundary head ------------------------------------------------------------------------------------------


@dataclass
class Candidates:
    spans: np.ndarray  # pool x 2
    logits: np.ndarray  # queries x pool
    nulls: np.ndarray | None  # queries
    boundary: np.ndarray
    start: np.ndarray  # queries x boundaries
    end: np.ndarray
    inside: np.ndarray  # queries x boundaries: centred running sums
    inside_mean: np.ndarray


def boundary_states(p: Parameters, cfg: dict, text: np.ndarray) -> np.ndarray:
    """A state for each place between words, from the words left and right of it."""
    left = np.vstack([p.get("bos_state")[None], text])
    right = np.vstack([text, p.get("eos_state")[None]])
    x = p.norm("layer_norm", p.linear("output_projection", np.hstack([p.linear("left_projection", left), p.linear("right_projection", right)])))
    window = cfg["boundary_attention_window"]
    distance = np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x))))
    far = np.where((window > 0) & (distance > window), -np.inf, 0.0)
    for i in range(cfg["boundary_attention_layers"]):
        block, heads = p.at(f"attention_blocks.{i}"), cfg["boundary_attention_heads"]
        q, k, v = block.linear("qkv_projection", block.norm("norm", x)).reshape(len(x), 3, heads, -1).transpose(1, 2, 0, 3)
        mixed = softmax(q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1]) + far) @ v
        x = x + block.linear("output_projection", mixed.swapaxes(0, 1).reshape(x.shape))
    for i in range(cfg["boundary_refinement_layers"]):
        block = p.at(f"refinement_blocks.{i}")
        value, gate = np.split(block.linear("input_projection", block.norm("norm", x)), 2, axis=-1)
        x = x + block.linear("output_projection", value * gate * sigmoid(gate))
    return x


def _means(p: Parameters, name: str, norm: str, text: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Normalized means of projected words over spans, from running sums."""
    values = p.linear(name, text)
    sums = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return p.norm(norm, (sums[spans[:, 1]] - sums[spans[:, 0]]) / np.maximum(spans[:, 1] - spans[:, 0], 1)[:, None])


def _lengths(spans: np.ndarray, words: int) -> np.ndarray:
    n = np.maximum(spans[:, 1] - spans[:, 0], 1).astype(np.float64)
    return np.stack([np.log1p(n), n / max(words, 1), 1 / np.sqrt(n)], axis=1)


def pool_spans(cfg: dict, start: np.ndarray, end: np.ndarray, compat: np.ndarray) -> np.ndarray:
    """The spans worth scoring: pairs of the best starts and ends of any query, each query's own best ones first; capped."""
    n = compat.shape[0]
    k = min(cfg["pool_boundary_top_k"], n)
    best = lambda rows: np.argsort(-np.maximum(rows.max(axis=0), LOW), kind="stable")[:k]
    s, e = (x.ravel() for x in np.meshgrid(best(start), best(end), indexing="ij"))
    valid = e > s
    score = compat[s, e] + start.max(axis=0)[s] + end.max(axis=0)[e]
    keys, scores = [s * n + e], [score]
    oks = [valid]
    quota = min(cfg["min_pool_per_query"], len(s))
    for q in range(len(start) if quota else 0):
        own = np.where(valid, start[q][s] + end[q][e] + compat[s, e], LOW)
        first = np.argsort(-own, kind="stable")[:quota]
        keys.append(s[first] * n + e[first])
        scores.append(-LOW * 0.5 + quota - np.arange(quota))
        oks.append(valid[first])
    key, score, ok = np.concatenate(keys), np.concatenate(scores), np.concatenate(oks)
    key, score = key[ok], score[ok]
    order = np.lexsort((key, -score))
    _, first = np.unique(key[order], return_index=True)
    kept = key[order][np.sort(first)][: cfg["pool_size"]]
    return np.stack([kept // n, kept % n], axis=1)


def inside_terms(c: Candidates, spans: np.ndarray, query: int | slice = slice(None)) -> np.ndarray:
    n = spans[:, 1] - spans[:, 0]
    total = c.inside[query][..., spans[:, 1]] - c.inside[query][..., spans[:, 0]] + c.inside_mean[query][..., None] * n
    return total / np.sqrt(np.maximum(n, 1))


def score_candidates(p: Parameters, cfg: dict, text: np.ndarray, query: np.ndarray) -> Candidates:
    """``p`` is the boundary head; text: words x hidden; query: queries x hidden."""
    b = boundary_states(p.at("boundary_encoder"), cfg, text)
    m = p.at("boundary_query_head")
    meet = lambda q, k, keys: m.linear(q, query) @ m.linear(k, keys).T / np.sqrt(cfg["boundary_dim"])
    start = meet("start_query_projection", "start_boundary_projection", b)
    end = meet("end_query_projection", "end_boundary_projection", b)
    inside = meet("inside_query_projection", "inside_text_projection", text)
    mean = inside.mean(axis=1)
    sums = np.hstack([np.zeros((len(query), 1)), np.cumsum(inside - mean[:, None], axis=1)])
    builder = p.at("shared_pool_builder")
    compat = builder.linear("start_projection", b) @ builder.linear("end_projection", b).T / np.sqrt(cfg["boundary_dim"])
    spans = pool_spans(cfg, start, end, compat)
    nulls = p.linear("null_projection", query)[:, 0] if cfg["enable_abstention"] else None
    out = Candidates(spans, np.zeros((len(query), 0)), nulls, b, start, end, sums, mean)
    if not len(spans):
        return out
    s = p.at("shared_pool_scorer")
    x = s.linear("start_projection", b)[spans[:, 0]] + s.linear("end_projection", b)[spans[:, 1]] + s.linear("length_projection", _lengths(spans, len(text)))
    x = x + s.linear("prior_projection", compat[spans[:, 0], spans[:, 1]][:, None])
    if cfg["enable_span_content"]:
        x = x + s.linear("content_projection", _means(s.at("content_pooler"), "value_projection", "layer_norm", text, spans))
    x = s.norm("candidate_norm", x)
    q = s.linear("query_projection", query)
    gamma, beta = np.split(s.linear("film", q), 2, axis=1)
    shaped = x[:, None, :] * (1 + gamma) + beta
    learnt = x @ q.T / np.sqrt(cfg["pair_dim"]) + s.linear("film_output.3", gelu(s.linear("film_output.0", shaped)))[..., 0]
    out.logits = learnt.T + start[:, spans[:, 0]] + end[:, spans[:, 1]] + (inside_terms(out, spans) if cfg["use_inside_evidence"] else 0)
    return out


def _placed(x: np.ndarray, at: np.ndarray, base: float) -> np.ndarray:
    """Rotary positions over neighbouring pairs of dimensions."""
    angle = at[:, None] / base ** (2 * np.arange(x.shape[1] // 2) / x.shape[1])
    even, odd, out = x[:, 0::2], x[:, 1::2], np.empty_like(x)
    out[:, 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[:, 1::2] = even * np.sin(angle) + odd * np.cos(angle)
    return out


def score_spans(p: Parameters, cfg: dict, c: Candidates, text: np.ndarray, query: np.ndarray, ix: int, spans: np.ndarray) -> np.ndarray:
    """Logits of one query for given spans, whether the pool holds them or not."""
    spans = np.minimum(np.asarray(spans).reshape(-1, 2), len(c.boundary) - 1)
    if not len(spans):
        return np.zeros(0)
    row, a, b = query[ix : ix + 1], spans[:, 0], spans[:, 1]
    ends = lambda part, name, at: _placed(part.linear(name, c.boundary[at]), at, cfg["rotary_base"])
    wide = lambda logits: np.repeat(sigmoid(logits), 2, axis=1)
    prop, s = p.at("boundary_proposer"), p.at("pair_scorer")
    prior = (ends(prop, "start_pair_projection", a) * wide(prop.linear("start_query_projection", row)) * ends(prop, "end_key_projection", b)).sum(axis=1) / np.sqrt(cfg["boundary_dim"])
    first, last = ends(s, "start_endpoint_projection", a), ends(s, "end_endpoint_projection", b)
    per_head = (first * wide(s.linear("query_gate", row)) * last).reshape(len(spans), cfg["multihead_pair_compat_heads"], -1).sum(axis=2)
    score = s.linear("compat_mix", per_head)[:, 0] / np.sqrt(cfg["pair_dim"]) + prior + c.start[ix][a] + c.end[ix][b]
    score = score + s.linear("endpoint_difference_projection", np.hstack([first - last, np.abs(first - last)]))[:, 0]
    content = _means(Parameters(s.tensors, s.prefix), "content_pooler.value_projection", "content_pooler.layer_norm", text, spans)
    coefficient = s.linear("content_query_projection", row)[0]
    score = score + content @ coefficient / np.sqrt(len(coefficient)) + s.linear("content_bias", content)[:, 0]
    if cfg["use_inside_evidence"]:
        score = score + s.linear("inside_weight", row)[0, 0] * inside_terms(c, spans, ix)
    return score + _lengths(spans, len(text)) @ s.linear("length_query_projection", row)[0]


def candidate_states(p: Parameters, c: Candidates) -> np.ndarray:
    return p.linear("candidate_encoder", np.hstack([c.boundary[c.spans[:, 0]], c.boundary[c.spans[:, 1]]]))


def class_logits(p: Parameters, states: np.ndarray) -> np.ndarray:
    """From the states of label markers; the second layer's number depends on the checkpoint's kind."""
    return p.mlp("0", "3" if p.has("3.weight") else "2", states)[:, 0]


# ---- relations, records, spans ----------------------------------------------------------------------------------


def relation_logits(p: Parameters, cfg: dict, text: np.ndarray, relations: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``pairs``: (relation, head start, head end, tail start, tail end) rows."""
    if not len(pairs):
        return np.zeros(0)
    n, hidden = text.shape
    rel, (hs, he, ts, te) = relations[pairs[:, 0]], pairs[:, 1:].T
    word = lambda at: text[np.clip(at, 0, n - 1)]
    gap = ts - hs
    features = np.hstack([word(hs), word(he - 1), word(ts), word(te - 1), rel, np.stack([np.sign(gap), np.abs(gap) / max(n, 1)], axis=1)])
    score = p.linear("mlp.3", gelu(p.linear("mlp.0", features)))[:, 0]
    if cfg["relation_biaffine_content"]:
        sums = np.vstack([np.zeros((1, hidden)), np.cumsum(text, axis=0)])
        mean = lambda a, b: (sums[np.minimum(b, n)] - sums[np.minimum(a, n)]) / np.maximum(b - a, 1)[:, None]
        head, tail = p.linear("head_content_projection", mean(hs, he)), p.linear("tail_content_projection", mean(ts, te))
        score = score + (head * sigmoid(p.linear("relation_content_gate", rel)) * tail).sum(axis=1) / np.sqrt(hidden)
        score = score + p.linear("content_linear", np.hstack([head, tail, rel]))[:, 0]
    return score


def relation_states(head: np.ndarray, tail: np.ndarray, directional: bool) -> np.ndarray:
    return np.hstack([head, tail]) if directional else (head + tail) * 0.5


class RecordHead:
    """Seeds of records, and logits of assigning candidates (column 0: absent) to their fields."""

    def __init__(self, p: Parameters, dim: int) -> None:
        self.p, self.dim = p, dim

    def latent_seeds(self, candidates: np.ndarray) -> np.ndarray:
        return self.p.linear("latent_seed_head", candidates)[:, 0]

    def anchorless(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learnt instances that look at the candidates: (states, logits)."""
        own = self.p.get("instance_embed")
        if len(candidates):
            weights = softmax(self.p.linear("q_proj", own) @ self.p.linear("k_proj", candidates).T / np.sqrt(self.dim))
            own = own + weights @ self.p.linear("v_proj", candidates)
        return own, self.p.linear("object_head", own)[:, 0]

    def assign(self, instances: np.ndarray, candidates: np.ndarray, fields: np.ndarray) -> np.ndarray:
        """fields x instances x (1 + candidates)."""
        asked = self.p.linear("inst_proj", instances)[None] + self.p.linear("field_proj", fields)[:, None]
        return np.concatenate([(asked @ self.p.get("null_embed"))[..., None], asked @ self.p.linear("cand_proj", candidates).T], axis=2)


def count_class(p: Parameters, prompt: np.ndarray) -> int:
    """How many instances there are, of 20 classes; 0 means that there is nothing."""
    return int(p.mlp("0", "2", prompt[None])[0].argmax())


def counted_fields(p: Parameters, fields: np.ndarray) -> np.ndarray:
    """Field states after the first step of the counting network: one gated recurrent step from the first position's embedding."""
    gru = p.at("gru")
    given = gru.get("weight_ih_l0") @ p.get("pos_embedding.weight")[0] + gru.get("bias_ih_l0")
    held = fields @ gru.get("weight_hh_l0").T + gru.get("bias_hh_l0")
    (gr, gz, gn), (hr, hz, hn) = np.split(given, 3), np.split(held, 3, axis=1)
    update = sigmoid(gz + hz)
    state = (1 - update) * np.tanh(gn + sigmoid(gr + hr) * hn) + update * fields
    return p.at("projector").mlp("0", "2", np.hstack([state, fields]))


def span_states(p: Parameters, words: np.ndarray, max_width: int) -> tuple[np.ndarray, np.ndarray]:
    """((start, end) with ends exclusive, states) of every span of up to ``max_width`` words."""
    p, n = p.at("span_rep_layer"), len(words)
    start, width = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(max_width), indexing="ij"))
    keep = start + width < n
    first, last = start[keep], (start + width)[keep]
    both = np.hstack([p.at("project_start").mlp("0", "3", words)[first], p.at("project_end").mlp("0", "3", words)[last]])
    return np.stack([first, last + 1], axis=1), p.at("out_project").mlp("0", "3", np.maximum(both, 0))
