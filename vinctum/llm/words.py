"""Words of many texts as arrays: runs of anything but ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .setsketch import mix

#: Texts are turned to words in slices of about this many bytes.
SLICE_BYTES = 256 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class Words:
    """Words of many texts at once: 64-bit hashes by prefix sums over the bytes, without a Python object per word. fold: A-Z count as a-z."""

    def __init__(self, fold: bool = True):
        self.code = _LOWER if fold else np.arange(256, dtype=np.uint8)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full((2, size + 1), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = _P, _P_INVERSE
            self.up, self.down = np.cumprod(steps, axis=1)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: hash, number of its text, number of its line in the text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._powers(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.code[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * self.down[begin])
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        text = np.searchsorted(starts, begin, side="right") - 1
        ends_before = np.concatenate([[0], np.cumsum(data == 10)])
        return h, text, ends_before[begin] - ends_before[starts[text]]


def byte_slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with their texts' bytes, about `most` of them, or one text; only these are copied at a time."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().cumsum()
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in part.column(text).cast(pa.large_binary()).to_pylist()]
            at = end
