from .readers import SourceError, clean_morphology, empty_morphology, empty_word_map, first_entries, from_parquet, load_morphology, load_verses, load_word_map, with_position

__all__ = ["SourceError", "clean_morphology", "empty_morphology", "empty_word_map", "first_entries", "from_parquet", "load_morphology", "load_verses", "load_word_map", "with_position"]
