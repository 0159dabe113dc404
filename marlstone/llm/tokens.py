"""Public tokenizers inside tasks. Their files aren't part of the library: a file is named, or given by its whole path."""

from __future__ import annotations

import os
import re
from functools import lru_cache

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"

#: Characters whose class (letter, digit, space, other) is the same in every version of Unicode that a library may have.
_SETTLED = re.compile(r"[\t\n\r -~¡-ſЀ-џ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*")
_WIDE = 100_000


def file_of(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of ``tokenizers`` for a byte-level file. With ``plain``, special tokens' strings inside a text are ordinary text.

    Texts of settled characters are encoded by ``tiktoken`` from the same vocabulary as ranks, several times as fast and with the same ids; all others, those with
    very long runs of white space and, without ``plain``, those that hold a special token, by ``tokenizers`` itself.
    """

    def __init__(self, name: str = BYTE_BPE, ranks: str | None = BYTE_RANKS, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file_of(name))
        self.whole.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = _ranked(file_of(ranks)) if ranks else None

    def _settled(self, text: str) -> bool:
        if self.fast is None or not _SETTLED.fullmatch(text) or any(s in text for s in self.special):
            return False
        return len(text) < _WIDE or not re.search(rf"\s{{{_WIDE}}}", text)

    def ids(self, text: str) -> list[int]:
        if self._settled(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; a special token's are those of its string."""
        byte = byte_alphabet()
        special = set(self.whole.get_added_tokens_decoder())
        name = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        return [t.encode() if i in special else bytes(byte[c] for c in t) for i, t in enumerate(name)]


class PieceBpe:
    """Ids of a ``sentencepiece`` model."""

    def __init__(self, name: str = PIECE_BPE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        m = self.model
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, m.id_to_piece(i)) for i in range(m.get_piece_size()))]


def _ranked(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def byte_bpe(name: str = BYTE_BPE, ranks: str | None = BYTE_RANKS, plain: bool = False) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(name, ranks, plain)


@lru_cache(maxsize=4)
def piece_bpe(name: str = PIECE_BPE) -> PieceBpe:
    return PieceBpe(name)
