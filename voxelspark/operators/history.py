"""Undo and redo: what a log of commands leaves alive, and what it makes of the slices.

``do`` cuts the history at its depth and appends, ``undo`` steps back (not below 0),
``redo`` steps forward (not past the end). Live are the commands up to the depth.
A session is sorted in its partition and folded row by row, so a task holds a session's
live history and never its log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step(history: list[int], depth: int, op: str, command: int) -> int:
    """Apply one command; the new depth."""
    if op == "do":
        del history[depth:]
        history.append(command)
        return depth + 1
    if op == "undo":
        return max(0, depth - 1)
    return min(len(history), depth + 1) if op == "redo" else depth


def replay(log: DataFrame) -> DataFrame:
    """(session, position, event_id) of the live commands of a log (session, n, op, event_id)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, history, depth = None, [], 0

        def live() -> pd.DataFrame:
            return pd.DataFrame({"session": [session] * depth, "position": range(1, depth + 1), "event_id": history[:depth]})

        for pdf in batches:
            for s, op, e in zip(pdf["session"], pdf["op"], pdf["event_id"], strict=True):
                if s != session:
                    if depth:
                        yield live()
                    session, history, depth = s, [], 0
                depth = step(history, depth, op, e)
        if depth:
            yield live()

    rows = log.select("session", "n", "op", "event_id").where("session is not null").repartition("session").sortWithinPartitions("session", "n")
    return rows.mapInPandas(fold, "session long, position long, event_id long")


# What a slice holds: an overlay is [id, points, (label, color, layer)].
STATE = "session long, z long, selected long, overlays array<struct<id: long, label: string, color: string, layer: string>>, previews array<long>"


def _inside(x: int, y: int, points: list) -> bool:
    """Even-odd rule of ``scalars.point_in_polygon``."""
    odd = False
    for p, q in zip(points, [*points[1:], *points[:1]], strict=True):
        if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
            odd = not odd
    return odd and len(points) >= 3


class Session:
    """Overlays, previews and selection of each slice, and the commands done and undone.

    Adds, accepts, deletes and metadata are commands; previews, rejections and selecting by
    a hit are not, so undo does not touch them. A command takes what it needs (its place, the
    selection before it) when first done and uses the same when done again.
    """

    def __init__(self):
        self.overlays: dict[int, list] = {}
        self.previews: dict[int, list] = {}
        self.selected: dict[int, int] = {}
        self.done: list[tuple] = []
        self.undone: list[tuple] = []

    def run(self, kind: str, z: int, items: list, x: int, y: int, look: tuple) -> None:
        """One line of the log."""
        here, at = self.overlays.setdefault(z, []), self.selected.get(z, -1)
        inside = 0 <= at < len(here)
        command = None
        if kind == "undo" and self.done:
            self.undone.append(self.done.pop())
            self.revert(*self.undone[-1])
        elif kind == "redo" and self.undone:
            self.done.append(self.undone.pop())
            self.apply(*self.done[-1])
        elif kind == "preview":
            self.previews[z] = items
        elif kind == "reject":
            self.previews.pop(z, None)
        elif kind == "reject_all":
            self.previews.clear()
        elif kind == "hit":
            under = [k for k, (_, points, its) in enumerate(here) if look[2] in (None, its[2]) and _inside(x, y, points)]
            self.selected[z] = under[-1] if under else -1
        elif kind == "add":
            command = ("add", {z: items}, self._before([z]))
        elif kind == "accept" and self.previews.get(z):
            command = ("accept", {z: self.previews[z]}, self._before([z]))
        elif kind == "accept_all" and self.previews:
            command = ("accept_all", dict(self.previews), self._before(self.previews))
        elif kind == "delete" and here:
            at = at if inside else len(here) - 1
            command = ("delete", {z: (at, here[at])}, self._before([z]))
        elif kind == "meta" and inside:
            command = ("meta", {z: (at, here[at], [*here[at][:2], look])}, {})
        if command:
            self.undone.clear()
            self.done.append(command)
            self.apply(*command)

    def _before(self, slices) -> dict[int, int]:
        return {z: self.selected.get(z, -1) for z in slices}

    def apply(self, kind: str, what: dict, before: dict) -> None:
        for z, part in what.items():
            here = self.overlays.setdefault(z, [])
            if kind == "meta":
                here[part[0]] = part[2]
            elif kind == "delete":
                here.pop(part[0])
                self.selected[z] = min(part[0], len(here) - 1)
            else:
                here.extend(part)
                self.selected[z] = len(here) - 1
            if kind == "accept":
                self.previews.pop(z, None)
        if kind == "accept_all":
            self.previews.clear()

    def revert(self, kind: str, what: dict, before: dict) -> None:
        """Undo of one accept does not bring its preview back; of all accepts it does."""
        for z, part in what.items():
            here = self.overlays[z]
            if kind == "meta":
                here[part[0]] = part[1]
            elif kind == "delete":
                here.insert(*part)
            elif part:
                del here[-len(part) :]
            if kind == "accept_all":
                self.previews[z] = part
        self.selected.update(before)


def sessions(log: DataFrame) -> DataFrame:
    """What each session's log of actions leaves: a row for each slice it touched.

    ``log``: session, n, kind, z, items (array of struct of id and points: what is added or
    previewed), x, y (of a hit), label, color, layer (of added items and of ``meta``; of a
    hit the layer in view, null for all). Kinds: add, preview, accept, accept_all, reject,
    reject_all, delete, meta, hit, undo, redo; others do nothing, as do commands that find
    nothing to act on, which leave what was undone alone. The log streams through a task in
    order; held is the state of one session.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, Session()

        def left() -> pd.DataFrame:
            slices = sorted({*state.previews, *state.selected})
            rows = [(session, z, state.selected.get(z, -1), [dict(zip(("id", "label", "color", "layer"), (i, *look), strict=True)) for i, _, look in state.overlays.get(z, [])], [i for i, *_ in state.previews.get(z, [])]) for z in slices]
            return pd.DataFrame(rows, columns=["session", "z", "selected", "overlays", "previews"])

        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for s, kind, z, items, x, y, *look in zip(*[pdf[c] for c in ("session", "kind", "z", "items", "x", "y", "label", "color", "layer")], strict=True):
                if s != session:
                    if session is not None:
                        yield left()
                    session, state = s, Session()
                made = [[i["id"], list(i["points"]), tuple(look)] for i in (items if items is not None else [])]
                state.run(kind, z, made, x, y, tuple(look))
        if session is not None:
            yield left()

    rows = log.where("session is not null and z is not null").repartition("session").sortWithinPartitions("session", "n")
    return rows.select("session", "kind", "z", "items", "x", "y", "label", "color", "layer").mapInPandas(fold, STATE)


def overlay_state(log: DataFrame) -> DataFrame:
    """(session, z, idx, id, label, color, layer, selected): a row an overlay that ``sessions`` leaves."""
    rows = sessions(log).select("session", "z", F.col("selected").alias("_at"), F.posexplode("overlays").alias("idx", "o"))
    return rows.select("session", "z", "idx", "o.*", (F.col("idx") == F.col("_at")).alias("selected"))
