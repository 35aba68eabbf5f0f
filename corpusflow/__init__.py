"""Spark-native engine that keeps a corpus of documents current and ready for retrieval.

The public names below are imported from their modules when they are first used.
"""

from importlib import import_module

__version__ = "0.2.0"

_PUBLIC = {
    "sync": "plans.runs",
    "prepare": "plans.runs",
    "export": "plans.runs",
    "RunResult": "plans.runs",
    "PrepareResult": "plans.runs",
    "Source": "sources.config",
    "load_source": "sources.config",
    "source_from_dict": "sources.config",
    "Store": "sources.store",
    "extract": "operators.html",
    "extract_pages": "operators.html",
    "CHUNKERS": "operators.chunks",
    "register_chunker": "operators.chunks",
    "python_chunker": "operators.chunks",
    "chunk": "operators.chunks",
    "chunk_records": "operators.chunks",
    "glossary_frame": "operators.glossary",
    "mentions": "operators.glossary",
    "annotate_html": "operators.glossary",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
