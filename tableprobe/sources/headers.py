"""Column names from header cells."""

from __future__ import annotations

import itertools
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def header_names(cells: list[str | None], width: int | None = None) -> list[str]:
    """One usable, unique name per column.

    A blank cell becomes ``Unnamed: <position>``, a repeated name gets ``.1``, ``.2``, ...,
    never a name that the header itself carries.
    """
    width = len(cells) if width is None else width
    padded = list(cells[:width]) + [None] * (width - len(cells))
    wanted = [c if c is not None and c.strip() else f"Unnamed: {i}" for i, c in enumerate(padded)]
    return _unique(wanted, lambda name: name)


def case_unique_names(names: list[str]) -> list[str]:
    """Names that differ by more than case, as a spreadsheet table demands."""
    return _unique(names, str.lower)


def _unique(names: list[str], fold) -> list[str]:
    """Names as they are where they first occur; at later places with the lowest number that no other name has."""
    taken = {fold(name) for name in names}
    first = {fold(name): place for place, name in reversed(list(enumerate(names)))}
    numbered = {name: map(name.__add__, map(".{}".format, itertools.count(1))) for name in names}
    out = list(names)
    for place, name in enumerate(names):
        if place != first[fold(name)]:
            out[place] = next(new for new in numbered[name] if fold(new) not in taken)
            taken.add(fold(out[place]))
    return out
