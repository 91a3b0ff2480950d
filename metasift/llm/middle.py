"""Fill-in-middle: texts cut at two ranks and written as prefix, suffix and middle.

The units of a text (code points, words or lines) stand in an indexable skip list.  A node is a short block of the
text; every lane's link carries how many units and how many code points it passes.  A cut descends from the widest
lane, adding up widths while the sum stays at or under its rank, and finds the unit inside the last block.  All texts of
a batch share one list, each with a head of full height, and all their cuts descend together.

Cases: a null text counts as empty and stays plain; a null id draws like the text ``null``; equal ids and texts give equal
rows; a very long text is held alone; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import chunks, mix, text_or_empty, tidy, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of a hundred of these so many put the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes of text in a node; a node rises to the next lane with one chance in ``FAN``.
BLOCK, FAN = 64, 4
UNITS = ("point", "word", "line")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte.  Words and lines take what follows them up to the next one; the first also takes what precedes it."""
    if unit == "point":
        return (data & 0xC0) != 0x80
    begins = np.zeros(len(data), bool)
    if unit == "word":
        begins[1:] = _SPACE[data[:-1]] & ~_SPACE[data[1:]]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        # A text that begins with white space has its first unit there, not at its first word.
        begins[heads] = True
        lead = np.flatnonzero(_SPACE[data[heads]])
        for k in lead.tolist():
            stop = heads[k + 1] if k + 1 < len(heads) else len(data)
            inside = np.flatnonzero(~_SPACE[data[heads[k]:stop]])
            if len(inside):
                begins[heads[k] + inside[0]] = False
        return begins
    begins[1:] = data[:-1] == 10
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return begins


class SkipList:
    """Express lanes over the blocks of many texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "point"):
        self.units, self.points = unit_starts(data, offsets, unit), unit_starts(data, offsets, "point")
        per = -(-np.diff(offsets) // BLOCK)
        self.heads = np.concatenate(([0], np.cumsum(per)))
        own = np.arange(self.heads[-1]) - np.repeat(self.heads[:-1], per)  # a node's place in its text
        self.begin = np.repeat(offsets[:-1], per) + own * BLOCK
        self.end = np.minimum(self.begin + BLOCK, np.repeat(offsets[1:], per))
        text = np.repeat(np.arange(len(per)), per)
        height = self._heights(own)
        #: Per lane: text of each entry, units and code points its link passes, and the entry of the same node one lane down.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        at, below = np.arange(len(own)), np.zeros(0, np.int64)
        if len(own):
            widths = [np.add.reduceat(m, self.begin, dtype=np.int64) for m in (self.units, self.points)]
            while True:
                self.lanes.append((text[at], *[np.add.reduceat(w, at) for w in widths], below))
                up = np.flatnonzero((height[at] >= len(self.lanes)) | (own[at] == 0))
                if len(up) == len(at) or (own[at[up]] == 0).all():
                    break
                at, below = at[up], up
        self.first = [np.searchsorted(lane[0], np.arange(len(per))) for lane in self.lanes[-1:]]

    @staticmethod
    def _heights(own: np.ndarray) -> np.ndarray:
        """Lanes above the lowest that a node reaches: geometric, drawn from its place, so a lost task draws the same."""
        draw = mix(own.astype(np.uint64) + np.uint64(1))
        height, chance = np.zeros(len(own), np.int64), np.uint64(FAN - 1)
        rising = np.ones(len(own), bool)
        for k in range(31):
            rising &= ((draw >> np.uint64(2 * k)) & chance) == 0
            if not rising.any():
                break
            height += rising
        return height

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Units and code points of every text."""
        n = len(self.heads) - 1
        if not self.lanes:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        text, units, points, _ = self.lanes[-1]
        return np.bincount(text, units, n).astype(np.int64), np.bincount(text, points, n).astype(np.int64)

    def seek(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before unit ``rank`` of each ``text``; all of them where the rank is the number of its units."""
        out = np.zeros(len(text), np.int64)
        some = np.flatnonzero(self.heads[text] < self.heads[text + 1])
        if not len(some):
            return out
        text, rank = text[some], rank[some].astype(np.int64)
        units, points = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        at = self.first[0][text]
        for depth in range(len(self.lanes) - 1, -1, -1):
            owner, wide, long, below = self.lanes[depth]
            moving = np.arange(len(some))
            while len(moving):
                here = at[moving]
                nxt = np.minimum(here + 1, len(owner) - 1)
                on = (nxt > here) & (owner[nxt] == text[moving]) & (units[moving] + wide[here] <= rank[moving])
                moving, here = moving[on], here[on]
                units[moving] += wide[here]
                points[moving] += long[here]
                at[moving] = here + 1
            if depth:
                at = below[at]
        spot = self.begin[at][:, None] + np.arange(BLOCK)
        inside = spot < self.end[at][:, None]
        spot = np.minimum(spot, len(self.units) - 1)
        before = np.cumsum(self.units[spot] & inside, axis=1) <= (rank - units)[:, None]
        out[some] = points + (self.points[spot] & inside & before).sum(axis=1)
        return out


_TYPE = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def _cutter(unit: str):
    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            data, offsets = utf8(texts)
            draws = [np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in (one, two)]
            parts = []
            for lo, hi in chunks(offsets):
                part = offsets[lo:hi + 1]
                lanes = SkipList(data[part[0]:part[-1]], part - part[0], unit)
                n, own = lanes.totals()[0], np.arange(hi - lo)
                ranks = [d[lo:hi] % (n + 1) for d in draws]
                cuts = [lanes.seek(own, r(*ranks)) for r in (np.minimum, np.maximum)]
                parts.append(pa.StructArray.from_arrays([pa.array(x) for x in (n, *cuts)], fields=list(_TYPE)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    return F.arrow_udf(cut, "n long, first long, second long").asNondeterministic()


def draw(ident: Column, seed: int, k: int) -> Column:
    """Group ``k`` (from 1) of eight hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "middle", unit: str = "point", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """``docs`` with a struct column ``name``: n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    Draws hang on ``seed`` and the id alone.  Texts that hold one of the three marks stay plain, so every output can be undone."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    t, h = text_or_empty(text), [draw(F.col(doc_id), seed, k) for k in (1, 2, 3, 4)]
    cut = F.col(name)
    out = docs.withColumn(name, _cutter(unit)(t, h[0], h[1]))
    plain = (t == "") | t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE) | (h[2] % 100 >= rearranged)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    one = F.lit(1).cast("long")
    pieces = {
        "p": F.substring(t, F.lit(1), cut["first"].cast("int")),
        "m": F.substring(t, (cut["first"] + one).cast("int"), (cut["second"] - cut["first"]).cast("int")),
        "s": F.substr(t, (cut["second"] + one).cast("int")),
    }
    rest = F.concat(F.lit(MIDDLE), pieces["m"])
    output = (F.when(form == "plain", t)
              .when(form == "psm", F.concat(F.lit(PREFIX), pieces["p"], F.lit(SUFFIX), pieces["s"], rest))
              .otherwise(F.concat(F.lit(SUFFIX), pieces["s"], F.lit(PREFIX), pieces["p"], rest)))
    known = form != "plain"
    return out.withColumn(name, F.struct(
        cut["n"].alias("n"), form.alias("form"), F.when(known, cut["first"]).alias("prefix_chars"),
        F.when(known, cut["second"] - cut["first"]).alias("middle_chars"), output.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "<[PSM]>")
    order = F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))
    return F.when(form == "plain", output).otherwise(order)
