from .normalize import clean_field_query, clean_query, contains_all_tokens, normalize_arabic, remove_tashkeel, strip_word, tokenize
from .sql import register

__all__ = ["clean_field_query", "clean_query", "contains_all_tokens", "normalize_arabic", "register", "remove_tashkeel", "strip_word", "tokenize"]
