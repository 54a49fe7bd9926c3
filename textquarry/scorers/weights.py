"""Checkpoint files: weights by memory map, and configurations that are checked before anything is scored."""

from __future__ import annotations

import json
import pathlib
from dataclasses import dataclass, field

import numpy as np

from ..schema import SchemaError

# Element types of the weight format.
DTYPES = {"U8": "<u1", "BOOL": "<u1", "U32": "<u4", "I16": "<i2", "I32": "<i4", "I64": "<i8", "F16": "<f2", "F32": "<f4", "F64": "<f8", "BF16": "<u2"}
FILES = ["config.json", "encoder_config/config.json", "tokenizer.json", "model.safetensors"]


def read_tensors(data: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays by name from the bytes of a file: a length, a JSON header with types, shapes and places, then the data.

    Views of ``data``, but for 16-bit brain floats, which are widened.
    """
    if len(data) < 8:
        raise SchemaError("the weight file is too short for a header")
    n = int.from_bytes(data[:8].tobytes(), "little")
    if 8 + n > len(data):
        raise SchemaError("the header runs past the end of the weight file")
    header, body, out = json.loads(data[8 : 8 + n].tobytes()), data[8 + n :], {}
    for name, about in header.items():
        if name == "__metadata__":
            continue
        if about["dtype"] not in DTYPES:
            raise SchemaError(f"tensor {name!r} has the unknown type {about['dtype']}")
        kind, (start, end) = np.dtype(DTYPES[about["dtype"]]), about["data_offsets"]
        elements = 1
        for d in about["shape"]:
            elements *= d
        if not 0 <= start <= end <= len(body) or end - start != elements * kind.itemsize:
            raise SchemaError(f"tensor {name!r} doesn't fit its place in the file")
        value = body[start:end].view(kind) if start % kind.itemsize == 0 and (8 + n) % kind.itemsize == 0 else np.frombuffer(body[start:end].tobytes(), kind)
        if about["dtype"] == "BF16":
            value = (value.astype(np.uint32) << 16).view(np.float32)
        out[name] = value.reshape(about["shape"])
    return out


def write_tensors(path: str | pathlib.Path, tensors: dict[str, np.ndarray]) -> None:
    """The same format, in single precision."""
    header, parts, at = {}, [], 0
    for name, value in tensors.items():
        raw = np.ascontiguousarray(value, dtype="<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(value.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    pathlib.Path(path).write_bytes(len(head).to_bytes(8, "little") + head + b"".join(parts))


@dataclass
class Checkpoint:
    """The four files of a model; ``tokenizer`` is its file's path, or its content."""

    config: dict
    encoder: dict
    tokenizer: str
    tensors: dict[str, np.ndarray] = field(repr=False, default_factory=dict)

    @property
    def architecture(self) -> str:
        if "boundary_head" in self.config:
            return "boundary"
        if "counting_layer" in self.config:
            return "span"
        raise SchemaError("the configuration names neither a boundary head nor a counting layer")

    @property
    def hidden(self) -> int:
        return self.encoder["hidden_size"]


def open_checkpoint(folder: str) -> Checkpoint:
    root = pathlib.Path(folder)
    missing = [f for f in FILES if not (root / f).is_file()]
    if missing:
        raise SchemaError(f"the checkpoint lacks {', '.join(missing)}")
    read = lambda name: json.loads((root / name).read_text(encoding="utf-8"))
    out = Checkpoint(read(FILES[0]), read(FILES[1]), str(root / FILES[2]))
    check_config(out)
    out.tensors = read_tensors(np.memmap(root / FILES[3], dtype=np.uint8, mode="r"))
    return out


def checkpoint_from_bytes(files: dict[str, bytes]) -> Checkpoint:
    """A checkpoint from the contents of its four files, by the names in ``FILES``; the tokenizer's is held as text."""
    missing = [f for f in FILES if f not in files]
    if missing:
        raise SchemaError(f"the checkpoint lacks {', '.join(missing)}")
    out = Checkpoint(json.loads(files[FILES[0]]), json.loads(files[FILES[1]]), files[FILES[2]].decode("utf-8"))
    check_config(out)
    out.tensors = read_tensors(np.frombuffer(files[FILES[3]], dtype=np.uint8))
    return out


def check_config(c: Checkpoint) -> None:
    """Raises for settings that the network here doesn't have."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise SchemaError(f"unsupported checkpoint: {what}")

    need(c.config.get("token_pooling", "first") == "first", "token_pooling must be 'first'")
    e = c.encoder
    if e.get("model_type", "deberta-v2") != "modernbert":
        need(bool(e.get("relative_attention")) and bool(e.get("share_att_key")), "relative attention with shared keys is expected")
        need(not e.get("position_biased_input", True) and not e.get("conv_kernel_size") and not e.get("type_vocab_size"), "no absolute positions, convolution or token types are expected")
        need(sorted(e.get("pos_att_type", [])) == ["c2p", "p2c"], "pos_att_type must be c2p and p2c")
        need("layer_norm" in e.get("norm_rel_ebd", "") and e.get("hidden_act") == "gelu", "normalized relative embeddings and gelu are expected")
    if c.architecture == "boundary":
        h = c.config["boundary_head"]
        need(c.config.get("architecture") == "boundary", "architecture must be 'boundary'")
        need(h["candidate_pool"] == "shared", "candidate_pool must be 'shared'")
        need(not h["candidate_attention_layers"] and not h["query_attention_layers"], "attention among candidates or queries")
        need(not h["content_soft_max_pool"] and not h["adaptive_threshold"], "soft maximum pooling or adaptive thresholds")
        wanted = ("enable_rotary_endpoints", "query_conditioned_inside_weight", "endpoint_difference_features", "reranker_endpoint_compat", "enable_span_content")
        need(all(h[k] for k in wanted), "the pair scorer must have all of " + ", ".join(wanted))
        need(h["pair_dim"] % h["multihead_pair_compat_heads"] == 0 and h["boundary_dim"] % 2 == 0 and h["pair_dim"] % 2 == 0, "dimensions don't divide")
