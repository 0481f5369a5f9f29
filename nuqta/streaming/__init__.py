from .live import debounce, search_stream

__all__ = ["debounce", "search_stream"]
