"""Byte-level BPE over a published rank file, batch at a time."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import gather, no_null, split_chunks

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space or line feed next to another white space: there a cut before it can change the tokens, so the text is encoded whole.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\pZ][ \n]|[ \n][\s\x0b\x1c-\x1f\x{85}\pZ]"
_ENDS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]$"


class ByteBpe:
    """The tokens of ``encode_ordinary``, each distinct piece of a batch once.

    No token of the pattern spans a white space that follows anything else, so encoding the pieces between such places
    is exact.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = max(ranks.values()) + 1
        self.dtype = np.dtype(np.uint16 if self.vocab < 65_536 else np.uint32)
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(self.vocab, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def _one(self, piece: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(piece), dtype=self.dtype)

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the distinct pieces, end to end, and their bounds.

        Pieces that begin with a white space and don't end with one are encoded as one text; the tokens' widths tell
        where each piece ends.
        """
        alone = pc.or_(
            pc.invert(pc.match_substring_regex(pieces, r"^[ \n]")), pc.match_substring_regex(pieces, _ENDS)
        ).to_numpy(zero_copy_only=False)
        words = pieces.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        together = words[order[: len(order) - alone.sum()]]
        ids = self._one("".join(together))
        ends = np.cumsum(pc.binary_length(pieces.take(pa.array(order[: len(together)]))).to_numpy(zero_copy_only=False))
        at = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right") if len(together) else np.zeros(0, np.int64)
        rest = [self._one(w) for w in words[alone]]
        sizes = np.empty(len(words), np.int64)
        sizes[order] = np.concatenate([np.diff(at, prepend=0), [len(r) for r in rest]])
        flat, offsets = np.concatenate([ids, *rest]), np.concatenate([[0], np.cumsum(sizes[order])])
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return gather(flat, offsets, back)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens and the bounds of each text; a null text has none."""
        texts = no_null(texts)
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            codes, bounds, pieces = split_chunks(texts)
            flat, offsets = self._table(pieces)
            tokens, ends = gather(flat, offsets, codes)
            return tokens, ends[bounds]
        easy, easy_at = self.encode(texts.filter(pa.array(~unsafe)))
        parts, k = [], 0
        for text, hard in zip(texts.to_pylist() if unsafe.all() else pc.if_else(pa.array(unsafe), texts, None).to_pylist(), unsafe):
            if hard:
                parts.append(self._one(text))
            else:
                parts.append(easy[easy_at[k] : easy_at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.encode(texts)[1])


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per process and path."""
    return ByteBpe(path)
