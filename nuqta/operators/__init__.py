from .corpus import Corpus
from .fuzzy import FuzzyOptions
from .highlight import highlight, parts, word_ranges
from .layers import simple_search

__all__ = ["Corpus", "FuzzyOptions", "highlight", "parts", "simple_search", "word_ranges"]
