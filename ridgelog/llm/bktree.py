"""BK-trees over 64-bit fingerprints: children hang on the integer Hamming distance to the parent."""

import numpy as np


class BKTree:
    """A tree over distinct fingerprints, built level by level and searched for many queries at once.

    Every node stands for one fingerprint; the subtrees below it hold those at
    distance 1, 2, ... 64 from it. By the triangle inequality, all fingerprints
    within ``radius`` of a query lie below edges whose number is within ``radius`` of
    the query's distance to the node, so a search follows only these.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.first = np.zeros(n, np.int64)  # the node's children are order[first : first + count]
        self.count = np.zeros(n, np.int64)
        self.edge = np.zeros(n, np.int64)
        order, rest, parent, edge = [], np.arange(n), np.full(n, -1), np.zeros(n, np.int64)
        placed = 0
        while len(rest):
            by = np.lexsort((rest, edge, parent))
            rest, parent, edge = rest[by], parent[by], edge[by]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (edge[1:] != edge[:-1])]
            heads, group = rest[new], np.cumsum(new) - 1
            order.append(heads)
            self.edge[heads] = edge[new]
            owners, starts, counts = np.unique(parent[new], return_index=True, return_counts=True)
            if owners[0] >= 0:
                self.first[owners], self.count[owners] = placed + starts, counts
            placed += len(heads)
            parent = heads[group][~new]
            rest = rest[~new]
            edge = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    def links(self, radius: int, block: int = 512):
        """Blocks of pairs ``(query, node)`` of places in ``values``, ``node > query``, within ``radius``."""
        for start in range(0, len(self.values), block):
            query = np.arange(start, min(start + block, len(self.values)))
            node = np.full(len(query), self.order[0])
            while len(query):
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                near = (distance <= radius) & (node > query)
                if near.any():
                    yield query[near], node[near]
                counts = self.count[node]
                at = np.repeat(np.arange(len(node)), counts)
                place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[node], counts)
                child = self.order[place]
                follow = np.abs(self.edge[child] - distance[at]) <= radius
                query, node = query[at[follow]], child[follow]


def least_linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the sorted distinct ``values``, the place of the smallest one it is linked to, directly or not."""
    label = np.arange(len(values))
    if len(values) < 2:
        return label
    for a, b in BKTree(values).links(radius):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label
