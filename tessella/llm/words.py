"""Texts cut into words, each distinct word looked up once for a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa


def by_parts(parts: pa.ListArray, known: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each list's words' codes, joined. ``known`` gives the code of each distinct word."""
    coded = parts.flatten().dictionary_encode()
    taken = pa.array(known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
    # What is taken lies end to end.
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    joined = taken.buffers()[2].to_pybytes() if len(taken) else b""
    begin = parts.offsets.to_numpy()
    cuts = ends[begin - begin[:1]].tolist()
    return [joined[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def in_batches(texts: pa.Array, encode: Callable[[list[str]], list[bytes]], step: int = 8 << 20):
    """Each text's code, ``step`` characters of texts at a time; a null text is an empty one."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= step:
            yield from encode(held)
            held, size = [], 0
    if held:
        yield from encode(held)


class Remembered:
    """Codes of words, computed for those not seen lately. Two generations of at most ``limit`` words (and one batch) bound the memory;
    words still in use move to the younger one. Words above ``longest`` characters, which seldom come again, are computed each time."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], limit: int = 300_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        """``words`` are distinct."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        at = [k for k, code in enumerate(out) if code is None]
        if at:
            new = []
            for k in at:
                code = old.get(words[k])
                if code is None:
                    new.append(k)
                else:
                    out[k] = code
            for k, code in zip(new, self.compute([words[k] for k in new])):
                out[k] = code
            longest = self.longest
            young.update((words[k], out[k]) for k in at if len(words[k]) <= longest)
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass
