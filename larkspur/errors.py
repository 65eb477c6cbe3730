"""Errors with stable numeric codes."""

from __future__ import annotations


class EngineError(ValueError):
    def __init__(self, message: str, code: int):
        super().__init__(f"{message} [{code}]")
        self.code = code


# Codes that callers test for.
CODEC_LEGACY, CODEC_LENGTH, LEGACY_JSON, LEGACY_SHAPE, LEGACY_NUMBER = 1700004001, 1700004002, 1700004003, 1700004004, 1700004005
ORPHANS_EMPTY = 1700006001
WEIGHT_NEGATIVE, WEIGHTS_ZERO = 1700007001, 1700007002
WINDOW_SIZE, WINDOW_OVERLAP, PARAGRAPH_SIZES, PARAGRAPH_ORDER, HISTORY_ROLE, DIMENSIONS = 1700009001, 1700009002, 1700009003, 1700009004, 1700009005, 1700009006
STREAM_STATUS = 1700003001
GENERATE_STATUS = 1700000003  # the same number as EMBED_TOO_LONG
EMBED_STATUS, EMBED_SHAPE, EMBED_TOO_LONG, GENERATE_SHAPE = 1700000001, 1700000002, 1700000003, 1700000004
OLLAMA_EMBED_STATUS, OLLAMA_EMBED_SHAPE, OPENAI_EMBED_KEY, OPENAI_EMBED_STATUS, OPENAI_EMBED_SHAPE = 1700008001, 1700008002, 1700008003, 1700008004, 1700008005
OPENAI_GENERATE_KEY, OPENAI_GENERATE_STATUS, OPENAI_GENERATE_SHAPE, OLLAMA_GENERATE_STATUS, OLLAMA_GENERATE_SHAPE = 1700008006, 1700008007, 1700008008, 1700008009, 1700008010
