"""Union of links within a task, in numpy."""

from __future__ import annotations

import numpy as np


class Unions:
    """Joins rows 0 to n - 1 of a task; remembers one edge for each join that mattered."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self._edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
        while len(i):
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            hooked = np.full(len(label), len(label), np.int64)
            np.minimum.at(hooked, high, low)
            roots = np.flatnonzero(hooked < len(label))
            self._edges.append((roots, hooked[roots]))
            label[roots] = hooked[roots]
            while (label != label[label]).any():
                label[:] = label[label]
            keep = label[i] != label[j]
            i, j = i[keep], j[keep]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of edges that span the components: fewer than there are rows."""
        if not self._edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in self._edges]), np.concatenate([b for _, b in self._edges])
