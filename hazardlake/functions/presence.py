"""Which words of a fixed vocabulary occur in a text: one vectorised scan in place of a search for each word."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a word that are looked up at once, and bytes of text scanned at a time (its arrays stay in the cache).
HEAD, BLOCK = 4, 1 << 17


def words_found(text: Column, words: Sequence[str]) -> Column:
    """Those of the literal words that occur in ``text`` as substrings, a line each; null for null.

    The result may stand for the text in every test whether one of the words occurs: each found word is in its line, and
    what is in a line is in the text.  Words are compared by bytes, as ``contains`` does, so none may hold a line feed.
    """
    return F.arrow_udf(word_finder(words), "string")(text)


def word_finder(words: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    coded = {w: w.encode() for w in words}
    if any(not c or b"\n" in c for c in coded.values()):
        raise ValueError("words may not be empty nor hold a line feed")
    # Two tables settle most places: do the first and the second two bytes here occur in the head of one group of words?
    first, second = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    heads: dict[int, dict[int, list[tuple[str, bytes]]]] = {}
    after = np.arange(256) << 8
    for word, code in sorted(coded.items()):
        group = 1 << (code[0] * 5 + (code[1] if len(code) > 1 else 0)) % 8
        first[code[0] | (code[1] << 8 if len(code) > 1 else after)] |= group
        second[slice(None) if len(code) < 3 else code[2] | (code[3] << 8 if len(code) > 3 else after)] |= group
        heads.setdefault(min(len(code), HEAD), {}).setdefault(int.from_bytes(code[:HEAD], "little"), []).append((word, code))
    keys = {n: np.array(sorted(of), np.uint32) for n, of in heads.items()}

    def places(data: np.ndarray, start: int, end: int):
        """(place, words) of each place from ``start`` on where a word's head stands."""
        here = data[start:end + HEAD - 1]
        short = end - start + HEAD - 1 - len(here)
        wide = (np.append(here, np.zeros(short, np.uint8)) if short else here).astype(np.uint16)
        pairs = wide[:-1] | wide[1:] << 8
        likely = np.flatnonzero(first[pairs[:-2]] & second[pairs[2:]])
        code = pairs[likely] | pairs[likely + 2].astype(np.uint32) << 16
        for n, known in keys.items():
            head = code & np.uint32((1 << 8 * n) - 1)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, head), len(known) - 1)] == head)
            for place, key in zip((likely[at] + start).tolist(), head[at].tolist()):
                yield place, heads[n][key]

    def run(texts: pa.Array) -> pa.Array:
        flat = texts.cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        held = flat.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        ends = offsets - offsets[0]
        found: list[set[str]] = [set() for _ in range(len(flat))]
        for start in range(0, len(data), BLOCK):
            hits = list(places(data, start, min(start + BLOCK, len(data))))
            rows = np.searchsorted(ends, [place for place, _ in hits], side="right") - 1
            for (place, listed), row, end in zip(hits, rows.tolist(), ends[rows + 1].tolist()):
                for word, code in listed:
                    if word not in found[row] and place + len(code) <= end and data[place:place + len(code)].tobytes() == code:
                        found[row].add(word)
        missing = np.asarray(flat.is_null())
        return pa.array(["\n".join(sorted(words)) for words in found], pa.string(), mask=missing)

    return run
