"""Which kinds of findings a text can hold at all: one scan for the literals that their patterns need."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Letters that match an ASCII one where case is ignored in Java's Unicode mode, besides its own two forms.
FOLDS = str.maketrans({"ſ": "s", "K": "k", "ı": "i", "İ": "i"})

Needs = tuple[tuple[str, tuple[str, ...]], ...]


@lru_cache(maxsize=16)
def _automaton(needs: Needs) -> tuple[ahocorasick.Automaton | None, int]:
    """Automaton from literal to the bits of the kinds that it opens, and all bits."""
    bits: dict[str, int] = {}
    for k, (_, words) in enumerate(needs):
        for word in words:
            bits[word] = bits.get(word, 0) | 1 << k
    if not bits:
        return None, 0
    found = ahocorasick.Automaton()
    for word, mask in bits.items():
        found.add_word(word, mask)
    found.make_automaton()
    every = 0
    for mask in bits.values():
        every |= mask
    return found, every


def kinds_in(text: str, needs: Needs, fold: bool) -> int:
    """Bits of the kinds of which the text holds a literal; ``fold`` ignores case."""
    automaton, every = _automaton(needs)
    if automaton is None or not text:
        return 0
    if fold:
        text = (text if text.isascii() else text.translate(FOLDS)).lower()
    mask = 0
    for _, bits in automaton.iter(text):
        mask |= bits
        if mask == every:
            break
    return mask


def open_kinds(text: Column, folded: dict[str, tuple[str, ...]], exact: dict[str, tuple[str, ...]] | None = None) -> Column:
    """bigint with bit k set where the text holds one of the literals of the k-th kind: those of ``folded`` in any case, then those of ``exact`` as they are.

    An Aho-Corasick automaton reads each text once, whatever the number of kinds and literals; a null text opens nothing.
    """
    low, high = tuple(folded.items()), tuple((exact or {}).items())

    @pandas_udf("bigint")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else kinds_in(t, low, True) | kinds_in(t, high, False) << len(low) for t in texts], dtype="int64")

    return scan(text)


def is_open(mask: Column, kind: str, folded: dict[str, tuple[str, ...]], exact: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The bit of a kind in what open_kinds gave for the same literals."""
    place = [*folded, *(exact or {})].index(kind)
    return mask.bitwiseAND(1 << place) != 0
