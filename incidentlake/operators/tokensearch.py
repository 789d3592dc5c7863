"""Which of many tokens occur in a text, for one batch of texts at a time.

Per chunk of texts every token waits at the piece of three characters that is rarest there; windows around the
places of that piece are compared by rolling hashes, and what is found is read once more in the text itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

GRAM = 3
CHUNK = 1 << 20  # characters looked at together
BETWEEN = 0x110000  # no character: ends every text
_BITS = np.uint64(21)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(chars: np.ndarray, n: int) -> np.ndarray:
    """The pieces of ``n`` characters as numbers."""
    last = max(len(chars) - n + 1, 0)
    out = chars[:last].copy()
    for k in range(1, n):
        out |= chars[k : k + last] << (_BITS * np.uint64(k))
    return out


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count n, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Tokens:
    """The search for a list of distinct tokens; the empty one occurs in every text."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.always = [i for i, t in enumerate(tokens) if t == ""]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        powers = np.cumprod(np.full(max([1, *self.lengths]), _BASE))
        self.hashes = np.array([(_chars(t) * powers[: len(t)]).sum(dtype=np.uint64) for t in tokens], dtype=np.uint64)
        self.groups = []  # per piece length: its length, the distinct pieces, and (token, place, piece) of all
        for n in range(1, GRAM + 1):
            own = [i for i, t in enumerate(tokens) if t and min(len(t), GRAM) == n]
            if own:
                pieces = [_codes(_chars(tokens[i]), n) for i in own]
                sizes = np.array([len(p) for p in pieces])
                known, piece = np.unique(np.concatenate(pieces), return_inverse=True)
                self.groups.append((n, known, np.repeat(np.array(own), sizes), _ranges(sizes), piece))

    def found(self, texts: list[str]) -> list[list[int]]:
        """Per text the numbers of the tokens in it."""
        out: list[list[int]] = [list(self.always) for _ in texts]
        chars = np.concatenate([_chars(t + " ") for t in texts])
        ends = np.cumsum([len(t) + 1 for t in texts])
        chars[ends - 1] = BETWEEN
        powers = np.cumprod(np.full(len(chars), _BASE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * powers, dtype=np.uint64)])
        for n, known, token, place, piece in self.groups:
            codes = _codes(chars, n)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = np.flatnonzero(known[at] == codes)
            by = hit[np.argsort(at[hit], kind="stable")]  # places of each piece, one piece after another
            counts = np.bincount(at[hit], minlength=len(known))
            starts = np.cumsum(counts) - counts
            order = np.lexsort((counts[piece], token))
            _, first = np.unique(token[order], return_index=True)
            rarest = order[first]
            rarest = rarest[counts[piece[rarest]] > 0]
            for some in np.array_split(rarest, max(1, int(counts[piece[rarest]].sum()) // (4 * CHUNK))):
                times = counts[piece[some]]
                which, where = np.repeat(token[some], times), by[np.repeat(starts[piece[some]], times) + _ranges(times)]
                begin = where - np.repeat(place[some], times)
                fits = (begin >= 0) & (begin + self.lengths[which] <= len(chars))
                which, begin = which[fits], begin[fits]
                # the sum of a window is that of the token, moved on by as many powers as characters lie before it
                moved = self.hashes[which] * np.where(begin > 0, powers[begin - 1], np.uint64(1))
                same = sums[begin + self.lengths[which]] - sums[begin] == moved
                which, begin = which[same], begin[same]
                pairs = np.unique(np.searchsorted(ends, begin, side="right") * len(self.tokens) + which)
                for text, i in zip(*(x.tolist() for x in divmod(pairs, len(self.tokens)))):
                    if self.tokens[i] in texts[text]:
                        out[text].append(i)
        return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if size:
        yield begin, len(texts)


def search(tokens: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, _text) to (_key, places): the places in ``tokens`` of those in each text."""
    of = Tokens(tokens)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [row for a, b in _chunks(texts) for row in of.found(texts[a:b])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["_key", "places"])
