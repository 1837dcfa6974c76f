"""PartEnum signatures of sets: equal signatures for every pair that is similar enough.

Set sizes are cut into bands whose ends grow by 1/threshold, so sets that reach
the threshold lie in the same band or in neighbouring ones. An instance serves
one band and the one below it. Within an instance, a set and a linked one differ
in at most ``k`` elements, a number that follows from the set's own size. The
feature domain is dealt into more cells than that; at most ``k`` cells can
differ, so a set with more than ``k`` cells in use shares the whole content of
one used cell with every partner. A signature is the digest of one used cell
(an enumeration of one-cell subsets).

Very frequent elements are first taken out of the domain (differences only get
fewer). A set that then uses too few cells also signs over the whole domain,
and one that uses too few cells even there signs by each element. Two linked
sets therefore always meet, whatever the set of frequent elements is.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np

from seriesloom.llm.arrays import mix, seeded

_SPREAD = seeded(1 << 12, 21)


class Bands:
    """Ends of the size bands and the number of differing elements and of cells for each."""

    def __init__(self, threshold: Fraction, largest: int):
        self.threshold = threshold
        ends, low = [], 1
        while True:
            ends.append(int(low / threshold))
            if ends[-1] >= largest:
                break
            low = ends[-1] + 1
        ends.append(int((ends[-1] + 1) / threshold))
        self.ends = np.array(ends, np.int64)
        # |r ^ s| <= (1 - t) / (1 + t) * (|r| + |s|)
        self.share = (1 - threshold) / (1 + threshold)
        self.cells = np.ceil(1.15 * (np.array([int(self.share * 2 * e) for e in ends], np.int64) + 1)).astype(np.int64) + 2

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, sizes, "left")

    def differ(self, sizes: np.ndarray, instance: np.ndarray) -> np.ndarray:
        """Most elements in which a set of each size differs from a set of its instance that it is linked with."""
        largest = np.minimum(sizes * self.threshold.denominator // self.threshold.numerator, self.ends[instance])
        return (sizes + largest) * self.share.numerator // self.share.denominator


class Signed(NamedTuple):
    """Signatures over one space of elements: value, owner and cell of each, and owner and cell of the elements."""

    ids: np.ndarray
    owner: np.ndarray
    cell: np.ndarray
    values: np.ndarray
    value_owner: np.ndarray
    value_cell: np.ndarray


def _cells(values: np.ndarray, owner: np.ndarray, instance: np.ndarray, bands: Bands, space: int) -> Signed:
    """Signatures of the used cells."""
    width = bands.cells[instance]
    base = np.cumsum(width) - width
    seeds = _SPREAD[(instance * 4 + space) % len(_SPREAD)]
    cell = base[owner] + (mix(values ^ seeds[owner]) % width[owner].astype(np.uint64)).astype(np.int64)
    total = int(width.sum())
    content = np.zeros(total, np.uint64)
    np.add.at(content, cell, mix(values + np.uint64(1)))
    used = np.flatnonzero(np.bincount(cell, minlength=total))
    at = np.searchsorted(base, used, "right") - 1
    tag = mix((used - base[at]).astype(np.uint64) + seeds[at])
    return Signed(mix(content[used] + tag), at, used - base[at], values, owner, cell - base[owner])


def signatures(sets: list[np.ndarray], bands: Bands, frequent: np.ndarray) -> list[tuple[Signed, Signed, Signed]]:
    """Signatures for the sets' own bands and for the next ones: over rare elements, over all, and by element.

    ``frequent`` is sorted. Sets are not empty. Only sets that use too few cells
    of the spaces before appear in the second and the third.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    rare = np.ones(len(values), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] != values
    out = []
    for step in (0, 1):
        instance = bands.of(sizes) + step
        need = bands.differ(sizes, instance) + 1
        signed, lacking = [], np.ones(len(sets), bool)
        for space, keep in ((0, rare), (1, np.full(len(values), len(frequent) > 0))):
            chosen = keep & lacking[owner]
            signed.append(_cells(values[chosen], owner[chosen], instance, bands, space))
            lacking &= np.bincount(signed[-1].owner, minlength=len(sets)) < need
        alone = lacking[owner]
        seeds = _SPREAD[(instance * 4 + 2) % len(_SPREAD)]
        none = np.zeros(int(alone.sum()), np.int64)
        signed.append(Signed(mix(values[alone] + seeds[owner[alone]]), owner[alone], none, values[alone], owner[alone], none))
        out.append(tuple(signed))
    return out
