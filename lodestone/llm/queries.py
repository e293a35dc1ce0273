"""Importing this module registers the queries of the numbered operators."""

from lodestone.llm import alignment, decontaminate, fingerprints, katz, licenses, near_duplicates, neighbours, quality, revisits, sentence_pieces, spellings, substrings, tokens  # noqa: F401
