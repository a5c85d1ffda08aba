"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from the vocabulary of a byte-pair model. Its parts are composed with each input:

* the normaliser: a dummy prefix, and spaces as ``▁``;
* the pieces: an arc for every piece of the vocabulary that merges can build;
* byte fallback: a character outside of the vocabulary is an arc of its own, written as the tokens of its bytes;
* the merge rules, as weights in the tropical semiring (minimum, plus): two neighbouring pieces cost 0 if merging their
  joint text gives just these two, else infinity. A segmentation is the one that merging produces exactly if all its
  neighbours are such pairs, so its cost is 0 and that of every other one is infinite.

The shortest path is found from left to right over arcs of cost 0. Between two characters that stand side by side in no piece
every path has a border, so the input falls into parts with shortest paths of their own: each ``▁`` run with what
follows, and control characters that are in no piece. Paths of frequent parts are remembered in a bounded table.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SPACE = "▁"
REMEMBERED = 400_000
#: What the unknown id stands for in decoded text.
UNKNOWN = " \u2047 "

#: One replacement character for every byte that is no part of a valid character.
codecs.register_error("each_byte", lambda error: ("\ufffd", error.start + 1))


class Transducer:
    """Compiled vocabulary: ``encode`` and ``decode``."""

    _compiled: dict[str, Transducer] = {}

    def __init__(self, path: str):
        import sentencepiece

        # The library reads the vocabulary file, nothing else.
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[str | int | None] = []
        self.unknown = -1
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(None)
                if model.is_unknown(i):
                    self.unknown = i
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.surface.append(piece)
        self.longest = max(map(len, self.ids))
        alphabet = set(chain.from_iterable(self.ids))
        side_by_side = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        if any(b == SPACE and a != SPACE for a, b in side_by_side):
            raise ValueError("pieces that go on after a space are not supported")
        alone = "".join(c for c in "\n\t\r" if c not in alphabet)
        self.part = re.compile(f"[{re.escape(alone)}]|{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+" if alone
                               else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # Arcs: pieces that their own merges build, with the two parts of their last merge. Others never come out.
        self.halves: dict[str, tuple[str, str]] = {}
        self.arcs = {p for p in self.ids if len(p) == 1 or self._compile(p)}
        #: Arcs by their characters; the arc itself is under the empty string.
        self.trie: dict = {}
        for arc in self.arcs:
            node = self.trie
            for character in arc:
                node = node.setdefault(character, {"": None})
            node[""] = arc
        self.pair_cost: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in cls._compiled:
            cls._compiled[path] = cls(path)
        return cls._compiled[path]

    def _compile(self, piece: str) -> bool:
        """Apply the merge rules to a piece's characters, the best pair first, the leftmost of equal ones."""
        parts = list(piece)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                return False
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return True

    def _fits(self, a: str, b: str) -> bool:
        """Whether the neighbours cost 0: no merge over their border would have come before the merges that made them.

        Merges are undone from the latest on. After each, the two symbols at the border must have no merge that ranks
        before the one undone; of equal rank, the one further left comes first.
        """
        left, right, before = a, b, float("inf")
        while True:
            if self.rank.get(left + right, before) < before:
                return False
            of_left = self.rank[left] if left in self.halves else -1.0
            of_right = self.rank[right] if right in self.halves else -1.0
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                before, left = of_left, self.halves[left][1]
            else:
                before, right = of_right + 0.5, self.halves[right][0]

    def shortest_path(self, part: str) -> list[str]:
        """Pieces on the path of cost 0, found by following arcs of cost 0, long ones first.

        Every prefix has at most one such path, so a place from which no arc goes on need not be reached again.
        """
        path: list[str] = []
        untried: list[list[str]] = []
        dead: set[int] = set()
        at, end, previous, costs = 0, len(part), None, self.pair_cost
        while at < end:
            # Arcs that the text allows here. A character that starts none is one of its own, for byte fallback.
            arcs, node = [], self.trie
            for character in part[at:at + self.longest]:
                node = node.get(character)
                if node is None:
                    break
                if node[""] is not None:
                    arcs.append(node[""])
            untried.append(arcs or [part[at]])
            while True:
                arcs = untried[-1]
                while arcs:
                    arc = arcs.pop()
                    if at + len(arc) not in dead and (previous is None or self._costs_nothing(previous, arc, costs)):
                        break
                else:
                    if not path:
                        raise RuntimeError(f"no path of cost 0 through {part!r}")
                    dead.add(at)
                    untried.pop()
                    at -= len(path.pop())
                    previous = path[-1] if path else None
                    continue
                break
            path.append(arc)
            previous = arc
            at += len(arc)
        return path

    def _costs_nothing(self, a: str, b: str, known: dict[tuple[str, str], bool]) -> bool:
        fits = known.get((a, b))
        if fits is None:
            if len(known) >= 4 * REMEMBERED:
                known.clear()
            fits = known[a, b] = self._fits(a, b)
        return fits

    def _emit(self, piece: str) -> tuple[int, ...]:
        own = self.ids.get(piece)
        return (own,) if own is not None else tuple(self.byte_ids[b] for b in piece.encode())

    def _found(self, part: str) -> tuple[int, ...]:
        ids = self.old.get(part)
        if ids is None:
            ids = tuple(chain.from_iterable(map(self._emit, self.shortest_path(part))))
        if len(part) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.part.findall(SPACE + text.replace(" ", SPACE)):
            out += self.young.get(part) or self._found(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: the transducer run backwards.

        Bytes that are no valid UTF-8 become one replacement character each, the unknown id ``UNKNOWN``, and control ids
        nothing. Only a space at the start of the first piece is the dummy prefix, which goes.
        """
        out: list[str] = []
        run = bytearray()
        at_start = True
        for i in ids:
            piece = self.surface[i]
            if isinstance(piece, int):
                run.append(piece)
                at_start = False
                continue
            if run:
                out.append(run.decode(errors="each_byte"))
                run.clear()
            if piece is not None:
                out.append((piece.removeprefix(SPACE) if at_start else piece).replace(SPACE, " "))
                at_start = False
            elif i == self.unknown:
                out.append(UNKNOWN)
                at_start = False
        out.append(run.decode(errors="each_byte"))
        return "".join(out)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [machine.encode(t.as_py() or "") for t in some.column(0)]
                counts = np.array([len(x) for x in ids], np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                exact = [machine.decode(x) == (t.as_py() or "").replace(SPACE, " ") for x, t in zip(ids, some.column(0))]
                yield pa.RecordBatch.from_arrays([
                    *[some.column(c) for c in range(1, some.num_columns)],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts), pa.array(exact)],
                    [*[some.schema.field(c).name for c in range(1, some.num_columns)], "ids", "n_ids", "round_trip"])

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``ids``, ``n_ids`` and ``round_trip`` of every row.

    ``path`` is a SentencePiece byte-pair model that every executor has. ``round_trip`` tells whether decoding gives the
    text back (the space symbol ``▁`` itself decodes as a space). A null text counts as empty, which has no ids. Whole
    texts are encoded; repeated rows are encoded each time, other columns are left out.
    """
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select(F.col(text).cast("string").alias("body"), *keep).mapInArrow(_encoder(path), schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of their ``ids`` in column ``out``; null ids have a null text, no ids an empty one.

    Repeated rows are decoded each time, an empty table stays empty, and other columns stay as they are.
    """
    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        machine = Transducer.at(path)
        return pd.Series([None if v is None else machine.decode(list(v)) for v in values], dtype=object)

    return rows.withColumn(out, decode(F.col(f"`{ids}`")))
