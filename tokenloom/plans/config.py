"""Settings of the trainable operators."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class BpeConfig:
    """Pair-merge tokenizer.  ``weighting``: "type" counts a pair once per distinct word, "token" once per occurrence."""

    merge_ops: int = 600
    word_limit: int = 25_000
    lowercase: bool = True
    split_on_punctuation: bool = True
    keep_punctuation: bool = True
    split_camel_case: bool = True
    preserve_unknown: bool = True
    unknown_token: str = "<unk>"
    weighting: str = "type"

    def with_merge_ops(self, n: int) -> BpeConfig:
        """A single setting below its minimum is ignored."""
        return replace(self, merge_ops=n) if n >= 1 else self

    def with_word_limit(self, n: int) -> BpeConfig:
        return replace(self, word_limit=n) if n >= 1 else self

    def with_unknown_token(self, token: str) -> BpeConfig:
        """Normalized like any token; ignored if nothing is left."""
        bare = token.translate({ord(c): None for c in "\r\n\t\0"})
        bare = (ascii_lower(bare) if self.lowercase else bare).strip(" ")
        return replace(self, unknown_token=bare) if bare else self

    def with_training(self, merge_ops: int, word_limit: int) -> BpeConfig:
        """Whole training settings are clamped to 1 instead."""
        return replace(self, merge_ops=max(1, merge_ops), word_limit=max(1, word_limit))


@dataclass(frozen=True)
class SpConfig:
    """Unigram tokenizer."""

    target_vocab: int = 8000
    max_piece_chars: int = 8
    row_limit: int = 50_000
    lowercase: bool = True
    split_camel_case: bool = True

    def with_target_vocab(self, n: int) -> SpConfig:
        return replace(self, target_vocab=n) if n >= 64 else self

    def with_max_piece_chars(self, n: int) -> SpConfig:
        return replace(self, max_piece_chars=n) if n >= 2 else self

    def with_row_limit(self, n: int) -> SpConfig:
        return replace(self, row_limit=n) if n >= 1 else self

    def with_training(self, target_vocab: int, max_piece_chars: int, row_limit: int) -> SpConfig:
        return replace(self, target_vocab=max(64, target_vocab), max_piece_chars=max(2, max_piece_chars), row_limit=max(1, row_limit))


@dataclass(frozen=True)
class CodecConfig:
    """Byte codec; parallelism is that of the partitions."""

    chunk_size: int = 512 * 1024
    lazy: bool = True


APP_BPE = BpeConfig()
APP_SP = SpConfig(target_vocab=2000, max_piece_chars=8, row_limit=25_000)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
