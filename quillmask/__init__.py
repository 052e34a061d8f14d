"""quillmask: Spark-first detection and rewriting of personal data and credentials in text."""

from importlib import import_module

__version__ = "0.1.0"

#: Where the names of the top level live; loaded at first use, so Python workers import what they need only.
_PLACES = {
    "Masker": "quillmask.operators.engine",
    "Policy": "quillmask.functions.entities",
    "Settings": "quillmask.functions.entities",
    "LocalEngine": "quillmask.functions.local",
    "Span": "quillmask.functions.local",
    "detect_stream": "quillmask.sources.files",
    "redact_stream": "quillmask.sources.files",
    "redact_file": "quillmask.sources.files",
}
__all__ = [*_PLACES, "__version__"]


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(_PLACES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
