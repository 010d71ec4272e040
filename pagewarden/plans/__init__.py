"""Named queries over the engine's tables."""


def all_queries() -> None:
    """Registers every query."""
    from . import extract_queries, graph_queries, page_queries, session_queries, site_cases  # noqa: F401
