"""Lists of where grams stand, as bytes: differences in groups of seven bits.

A place is a document (its number within a block) and, within it, twice the
position, plus one in the second text column. A gram's list has two streams: for
each document its distance from the one before and how many places it has; and
for each place its distance from the one before in the same document.
"""

from __future__ import annotations

import numpy as np

PLACE_BITS = 40
#: Code points of a gram.
GRAM = 3


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value) of whole numbers from 0 on."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        more = x >> np.uint64(7 * k) > 0
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = (x.astype(np.uint8) & 127) | ((size > 1).astype(np.uint8) << 7)
    for k in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        low = (x[on] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[on] + k] = low | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out, size


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, out = ends - starts + 1, (raw[starts] & 127).astype(np.uint64)
    for k in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[on] |= (raw[starts[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _running(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of steps that begin anew in each of the segments of these sizes."""
    total = np.cumsum(steps)
    some = sizes[sizes > 0]
    first = np.cumsum(some) - some
    return total - np.repeat(total[first] - steps[first], some)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, position) of every three consecutive code points of a text; a gram is their numbers in 21 bits each."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(size - GRAM + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    position = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = position + np.repeat(np.cumsum(size) - size, n)
    return of, code[at] << 42 | code[at + 1] << 21 | code[at + 2] if len(at) else np.zeros(0, np.int64), position


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket, of a power of two of them, in which a gram's lists are kept."""
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


_CODE = (1 << 21) - 1


def in_order(first: list[np.ndarray], gram: np.ndarray, last: list[np.ndarray]) -> list[np.ndarray]:
    """The columns (first, gram, last) in ascending order of all of them.

    Where it fits, a row is one number of 63 bits, with a gram's code points by
    their rank among those that occur: sorting these takes a fraction of the time.
    """
    codes = [gram >> 42, gram >> 21 & _CODE, gram & _CODE]
    seen = np.zeros(1 + max(int(c.max(initial=0)) for c in codes), bool)
    for c in codes:
        seen[c] = True
    alphabet, rank = np.flatnonzero(seen), np.cumsum(seen) - 1
    columns = [*first, *(rank[c] for c in codes), *last]
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        by = np.lexsort((*last[::-1], gram, *first[::-1]))
        return [c[by] for c in (*first, gram, *last)]
    key = np.zeros(len(gram), np.int64)
    for c, b in zip(columns, bits, strict=True):
        key = key << b | c
    key.sort()
    out = []
    for b in bits[::-1]:
        out.append(key & ((1 << b) - 1))
        key >>= b
    out, k = out[::-1], len(first)
    a, b, c = (alphabet[x] if len(alphabet) else x for x in out[k : k + 3])
    return [*out[:k], a << 42 | b << 21 | c, *out[k + 3 :]]


class Lists:
    """Lists of several grams, ascending: ``grams``, ``n_docs`` of each, and the streams of all with each one's bytes. Places may be in order already."""

    def __init__(self, gram: np.ndarray, doc: np.ndarray, place: np.ndarray, ordered: bool = False):
        if not ordered:
            gram, doc, place = in_order([], gram, [doc, place])
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_doc = new_gram.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        docs_at = np.flatnonzero(new_doc)
        step = np.diff(place, prepend=0)
        step[docs_at] = place[docs_at]
        own, first = doc[docs_at], new_gram[docs_at]
        away = np.diff(own, prepend=0)
        away[first] = own[first]
        pairs = np.stack([away, np.diff(np.append(docs_at, len(gram)))], 1).ravel()
        self.grams = gram[new_gram]
        starts = np.flatnonzero(first)
        self.n_docs = np.diff(np.append(starts, len(own)))
        self.docs, size = varints(pairs)
        self.docs_at = np.append(np.concatenate([[0], np.cumsum(size)])[2 * starts], len(self.docs))
        self.places, size = varints(step)
        self.places_at = np.append(np.concatenate([[0], np.cumsum(size)])[np.flatnonzero(new_gram)], len(self.places))

    def each(self):
        """(gram, n_docs, docs, places) of each gram, the streams as bytes."""
        docs, places = self.docs.tobytes(), self.places.tobytes()
        for k, g in enumerate(self.grams.tolist()):
            yield g, int(self.n_docs[k]), docs[self.docs_at[k] : self.docs_at[k + 1]], places[self.places_at[k] : self.places_at[k + 1]]


def decode(n_docs: np.ndarray, docs: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, document, place) of each place of lists whose streams stand one after the other."""
    pairs = unvarints(docs)
    doc, count = _running(pairs[0::2], n_docs), pairs[1::2]
    of = np.repeat(np.arange(len(n_docs)), n_docs)
    return np.repeat(of, count), np.repeat(doc, count), _running(unvarints(places), count)


def cover(term: str) -> list[tuple[int, int]]:
    """(gram, offset) of grams that hold every code point of a term, with the fewest of them."""
    code = [ord(c) for c in term]
    offsets = sorted({*range(0, len(code) - GRAM + 1, GRAM), len(code) - GRAM})
    return [(code[k] << 42 | code[k + 1] << 21 | code[k + 2], k) for k in offsets]
