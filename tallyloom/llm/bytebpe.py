"""Byte-level BPE from its JSON file: a fast encoder over the same vocabulary, and the file's own one where that gives up."""

from __future__ import annotations

import os

_encoders: dict[str, "ByteBPE"] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBPE:
    """Encodes whole texts; ``entries`` has the bytes of every id.

    Merges of such a vocabulary have rising ids, so the ids are the ranks that the fast encoder needs.  Its regular
    expression engine has a bounded stack and refuses some long runs, such as a million spaces; those texts go to the
    tokenizer of the file, which takes four times as long and gives the same ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.path = path
        slow = tokenizers.Tokenizer.from_file(path)
        byte = byte_level()
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in slow.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.slow: dict[bool, tokenizers.Tokenizer] = {}
        texts = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.entries = [texts.get(i, b"") for i in range(max(texts) + 1)]

    def whole(self, special: bool):
        """The tokenizer of the file."""
        if special not in self.slow:
            import tokenizers

            self.slow[special] = tokenizers.Tokenizer.from_file(self.path)
            self.slow[special].encode_special_tokens = not special
        return self.slow[special]

    def __call__(self, text: str, special: bool) -> list[int]:
        """Ids of a text; with ``special`` the strings of special tokens are one id, else they are plain text."""
        try:
            return self.fast.encode(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            return self.whole(special).encode(text, add_special_tokens=False).ids


def byte_bpe(path: str) -> ByteBPE:
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]
