"""Even ranges of an ordered key, without a global sort.

Cuts are taken from a bounded sample of the keys, so their number can follow the size of
the data. A key that takes up several ranges (a null, an id or a host that many rows
share) has one of its own, which a second, uniform column divides into pieces. The range
of a row is found by binary search in generated cuts; ranges are numbered in the order
of the keys, nulls first, pieces in the order of the second column.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys for each range, about; ranges differ in size by some tens of percent.
SAMPLES = 8
#: Pieces of one key at most: the low bits of a range's number.
_PIECES = 20


def _literal(values: list, kind: str) -> Column:
    """An array of values as one constant, however many they are."""
    plain = [base64.b64encode(v).decode() for v in values] if kind == "binary" else values
    return F.from_json(F.lit(json.dumps(plain)), f"array<{kind}>")


@dataclass
class Ranges:
    """Ascending cuts with the pieces of each (0: no range of its own), and the pieces of null."""

    cuts: list
    pieces: list[int]
    null_pieces: int
    kind: str

    def between(self, p: int) -> int:
        """The number of the range of keys after cut p - 1, up to cut p."""
        return (2 * p + 2) << _PIECES

    def on(self, p: int) -> list[int]:
        """The numbers of the ranges that hold the key of cut p alone."""
        return [((2 * p + 3) << _PIECES) + j for j in range(self.pieces[p])]

    def place(self, key: Column) -> Column:
        """How many cuts are smaller than the key."""
        if not self.cuts:
            return F.lit(0)
        cuts = _literal(self.cuts, self.kind)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(self.cuts).bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < key, at + step).otherwise(at))

    def numbered(self, df: DataFrame, key: str, by: str, name: str) -> DataFrame:
        """``df`` with the number of each row's range by the columns ``key`` and ``by`` (a uniform bigint)."""
        at = F.col(f"{name}_at")
        df = df.withColumn(f"{name}_at", self.place(F.col(key)))
        own = F.lit(0)
        if any(self.pieces):
            cuts, pieces = _literal(self.cuts, self.kind), _literal(self.pieces, "int")
            own = F.when(F.get(cuts, at) == F.col(key), F.get(pieces, at)).otherwise(0)
        piece = lambda n: F.least(n - 1, F.floor((F.col(by) / F.lit(2.0**64) + 0.5) * n)).cast("long")
        own = F.coalesce(own, F.lit(0))
        # ranges 2 p + 2 between cuts, 2 p + 3 on a cut of its own, and 0 for null
        inside = F.when(own > 0, F.shiftleft((2 * at + 3).cast("long"), _PIECES) + piece(own)).otherwise(F.shiftleft((2 * at + 2).cast("long"), _PIECES))
        null = piece(F.lit(max(1, self.null_pieces)))
        return df.withColumn(name, F.when(F.col(key).isNull(), null).otherwise(inside)).drop(f"{name}_at")


def even(keys: DataFrame, key: str, n: int, total: int | None = None) -> Ranges:
    """About ``n`` even ranges of the column ``key`` of ``keys``, which has ``total`` rows."""
    kind = keys.schema[key].dataType.simpleString()
    total = keys.count() if total is None else total
    share = 1.0 if total <= n * SAMPLES else n * SAMPLES / total
    sample = keys.select(key) if share == 1.0 else keys.select(key).sample(fraction=share, seed=7)
    seen = sample.toArrow().column(0).to_pylist()
    known = sorted((k for k in seen if k is not None), key=lambda k: k.encode("utf-8", "surrogatepass") if isinstance(k, str) else k)
    # a cut at every n-th part of the sample; one value at several cuts gets that many pieces
    step = max(1, len(seen) // max(1, n))
    cuts: dict = {}
    for k in known[step - 1 :: step]:
        cuts[k] = cuts.get(k, 0) + 1
    most = (1 << _PIECES) - 1
    return Ranges(list(cuts), [min(most, c) if c > 1 else 0 for c in cuts.values()], min(most, max(1, round((len(seen) - len(known)) / step))), kind)
