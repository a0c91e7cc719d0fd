"""Memory of Python workers, which live on between tasks and share a node's."""

from offerlake.session import ship_by_value

ship_by_value(__name__)


def give_back() -> None:
    """At the end of a task: free memory goes back to the system, since workers live on and share a node's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
