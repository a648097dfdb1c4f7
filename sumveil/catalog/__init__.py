"""All registered queries."""

from importlib import import_module

_MODULES = ["encoding_queries", "application_queries", "window_queries", "private_queries", "io_queries", "report_queries", "stream_queries"]


def all_entries():
    from sumveil.catalog.registry import REGISTRY

    for m in _MODULES:
        import_module(f"sumveil.catalog.{m}")
    return dict(REGISTRY)
