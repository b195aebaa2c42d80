"""Byte-level BPE ids of whole columns of texts.

The splitting pattern always starts a new token at a space that a visible
character follows.  Texts are therefore cut at these spaces, each different
piece of a slice is encoded once, and the ids are put together with numpy.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm._text import byte_class, piece_hashes, slices

#: First bytes of characters that are certainly neither white space nor control characters.
_VISIBLE = byte_class((0x21, 0x7E), (0xC3, 0xDF), (0xE0, 0xE0), (0xE4, 0xF4))
#: Pieces whose ids a worker remembers, in a younger and an older half, and the longest of them in bytes.
_REMEMBERED, _LONGEST = 500_000, 48

_LOADED: dict[str, tuple] = {}


def _encoder(ranks_file: str, pattern: str):
    if ranks_file not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        _LOADED[ranks_file] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [{}, {}]
    return _LOADED[ranks_file]


def encoded(column: pa.Array, ranks_file: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text as 16-bit numbers; null has none.  Strings of special tokens are ordinary text."""
    encoder, known = _encoder(ranks_file, pattern)
    for first, last, data, offsets in slices(column):
        n = len(data)
        begins = np.zeros(n + 1, dtype=bool)
        if n > 1:
            begins[: n - 1] = (data[:-1] == 32) & _VISIBLE[data[1:]]
        begins[offsets[offsets > 0] - 1] = False  # the next byte is another text's
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[:n])
        ends = np.append(starts[1:], n)
        _, where, which = np.unique(piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw, ids = data.tobytes(), []
        for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            piece = raw[a:b]
            got = known[0].get(piece)
            if got is None:
                got = known[1].get(piece)
                if got is None:
                    got = array("H", encoder.encode_ordinary(piece.decode())).tobytes()
                if b - a <= _LONGEST:
                    # What is asked for again moves to the younger half; the older one goes when that is full.
                    if len(known[0]) >= _REMEMBERED // 2:
                        known[:] = {}, known[0]
                    known[0][piece] = got
            ids.append(got)
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // 2
        pool, at = np.frombuffer(b"".join(ids), dtype=np.uint16), np.cumsum(sizes) - sizes
        sizes, at = sizes[which], at[which]
        total = np.cumsum(sizes)
        out = pool[np.repeat(at - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.append(0, total)[np.searchsorted(starts, offsets)]
        for k in range(last - first):
            yield out[bounds[k] : bounds[k + 1]]
