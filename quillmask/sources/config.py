"""Settings from a TOML file, with other settings laid over them before anything is checked."""

from __future__ import annotations

import os
import tomllib
from typing import Any

from quillmask.functions.entities import CHUNK_CHARS, OVERLAP_CHARS, Policy, Settings

DEFAULTS: dict[str, Any] = {
    "types": None, "min_confidence": 0.5, "use_ner": False, "ner_model": "en_core_web_sm", "use_entropy": True, "load_plugins": True,
    "mode": "replace", "replacement": "[REDACTED]", "replacements": {}, "mask_keep_last": 4, "mask_char": "*", "hmac_key": None,
    "custom_words": (), "custom_patterns": (), "extra_detectors": (), "chunk_size": CHUNK_CHARS, "overlap": OVERLAP_CHARS,
}
_POLICY = ("mode", "replacement", "replacements", "mask_keep_last", "mask_char", "hmac_key")


def load_toml(path: str | os.PathLike[str]) -> dict[str, Any]:
    with open(path, "rb") as file:
        return tomllib.load(file)


def flattened(document: dict[str, Any]) -> dict[str, Any]:
    """Options of the sections detection, redaction, custom and streaming; others are ignored."""
    known = {
        "detection": {k: k for k in ("types", "min_confidence", "use_ner", "ner_model", "use_entropy", "entropy_min_length", "entropy_base64", "entropy_hex", "entropy_confidence", "load_plugins")},
        "redaction": {k: k for k in _POLICY},
        "custom": {"words": "custom_words", "patterns": "custom_patterns"},
        "streaming": {"chunk_size": "chunk_size", "overlap": "overlap"},
    }
    return {option: document.get(section, {})[key] for section, keys in known.items() for key, option in keys.items() if key in document.get(section, {})}


def build(*layers: dict[str, Any]) -> Settings:
    """Settings of the layers, later ones first; replacements, words and patterns add up."""
    merged = dict(DEFAULTS)
    for layer in layers:
        for option, value in layer.items():
            if option == "replacements":
                merged[option] = {**merged[option], **value}
            elif option in ("custom_words", "custom_patterns"):
                merged[option] = (*value, *merged[option])
            else:
                merged[option] = value
    key = merged["hmac_key"]
    merged["hmac_key"] = key.encode() if isinstance(key, str) else key
    policy = Policy(**{k: merged.pop(k) for k in _POLICY})
    types = merged.pop("types")
    return Settings(types=None if types is None else tuple(types), policy=policy, **merged)


def from_toml(path: str | os.PathLike[str], **over: Any) -> Settings:
    return build(flattened(load_toml(path)), over)
