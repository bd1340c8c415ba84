"""lorekeep: a Spark-native document retrieval and text-processing engine."""

__all__ = ["Engine", "Settings", "get_session"]


def __getattr__(name: str):
    """Loads the engine when it is asked for, so that Spark's Python workers need not."""
    if name == "get_session":
        from .session import get_session

        return get_session
    if name in ("Engine", "Settings"):
        from . import engine

        return getattr(engine, name)
    raise AttributeError(name)
