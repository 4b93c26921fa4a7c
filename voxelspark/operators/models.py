"""Plug-in models over slices and volumes.

A predictor is a picklable object; a task makes it ready once and feeds it row by row.
What goes wrong in a model becomes the row's message, never a failed task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import masks, propagate, rows, segment

#: Masks as runs: each of a model's masks, and all of them together.
RESULT = f"v long, z long, ok boolean, message string, masks array<{rows.ROWS}>, mask {rows.ROWS}"


class Predictor(Protocol):
    supports_volume: bool

    def predict(self, image: np.ndarray, prompt: str, request: dict) -> object: ...

    def predict_volume(self, volume: np.ndarray, prompt: str, request: dict) -> object: ...


def normalize(result: object, shape: tuple[int, ...]) -> list[np.ndarray]:
    """A model's output as 0/1 masks of ``shape``: an array of 2 dimensions is one mask,
    of 3 several, of one more than the volume's the first; lists and ``{"mask": ...}``
    work too, a trailing channel is dropped, masks of another shape are skipped."""
    if result is None:
        return []
    if isinstance(result, dict):
        result = result.get("masks", result.get("mask"))
        return normalize(result, shape)
    if isinstance(result, list | tuple):
        return [m for r in result for m in normalize(r, shape)]
    a = np.asarray(result)
    if a.ndim == len(shape) + 1 and a.shape[-1] == 1 and a.shape[:-1] == shape:
        a = a[..., 0]
    if a.ndim == len(shape):
        every = [a]
    elif a.ndim == len(shape) + 1:
        every = list(a) if len(shape) == 2 else [a[0]]
    else:
        raise ValueError(f"a mask of {a.ndim} dimensions")
    return [(m > 0).astype(np.int32) for m in every if m.shape == shape]


@dataclass(frozen=True)
class PercentilePredictor:
    """A slice against its 70th percentile and the prompt's bias."""

    needs_prompt: bool = False
    supports_volume: bool = False

    def predict(self, image: np.ndarray, prompt: str, request: dict) -> object:
        if self.needs_prompt and not (prompt or "").strip():
            return []
        p = (prompt or "").lower()
        bias = -5 if "tumor" in p or "lesion" in p else 5 if "organ" in p or "liver" in p else 0
        return image >= np.percentile(image, 70) + bias

    def predict_volume(self, volume: np.ndarray, prompt: str, request: dict) -> object:
        raise NotImplementedError("volumes are not supported")


@dataclass(frozen=True)
class RoiPredictor:
    """Each slice of a volume within its own seed mask, else the request's box, else as a whole."""

    supports_volume: bool = True

    @staticmethod
    def _slice(image: np.ndarray, roi: np.ndarray | None, box) -> np.ndarray:
        if roi is None or not roi.any():
            roi = np.zeros(image.shape, bool)
            if box is not None:
                x1, y1, x2, y2 = (int(b) for b in box)
                roi[max(0, y1) : y2 + 1, max(0, x1) : x2 + 1] = True
        if not roi.any():
            return image >= np.percentile(image, 70)
        return (image >= np.percentile(image[roi], 60)) & roi

    def predict(self, image: np.ndarray, prompt: str, request: dict) -> object:
        return self._slice(image, None, request.get("bbox"))

    def predict_volume(self, volume: np.ndarray, prompt: str, request: dict) -> object:
        seeds = request.get("seed_masks") or {}
        return np.stack([self._slice(s, seeds.get(z), request.get("bbox")) for z, s in enumerate(volume)])


def _packed(found: list[np.ndarray], shape: tuple[int, int]) -> tuple[list, list]:
    """Masks as runs, each and together."""
    lit = [m > 0 for m in found]
    return [rows.from_image(m) for m in lit], rows.from_image(np.logical_or.reduce(lit, axis=0)) if lit else []


def predict_slices(gray: DataFrame, predictor: Predictor) -> DataFrame:
    """Run a model on every slice row; no shuffle. Optional columns: prompt, bbox, seed_mode,
    refused (a message instead of a run) and prompt_rows (a mask as runs; null: none). What
    lies outside a prompt mask is shown to the model as 0, the mask's box is part of the
    request, and what the model finds is cut to the mask."""
    cols = [c for c in ("prompt", "bbox", "prompt_rows", "seed_mode", "refused") if c in gray.columns]

    def one(r) -> tuple:
        image = np.asarray(r.gray, np.int64).reshape(r.h, r.w)
        box, within, mode = (getattr(r, c, None) for c in ("bbox", "prompt_rows", "seed_mode"))
        request = {} if box is None else {"bbox": list(box)}
        if mode:
            request["seed_mode"] = mode
        roi = None
        if within is not None:
            roi = rows.to_image(within, image.shape)
            image = np.where(roi, image, 0)
            if roi.any():
                y, x = np.nonzero(roi)
                request["bbox"] = [int(x.min()), int(y.min()), int(x.max()), int(y.max())]
        found = normalize(predictor.predict(image, getattr(r, "prompt", None) or "", request), image.shape)
        return (r.v, r.z, True, "", *_packed(found if roi is None else [(m > 0) & roi for m in found], image.shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    if refused := getattr(r, "refused", None):
                        raise ValueError(refused)
                    out.append(one(r))
                except Exception as e:  # noqa: BLE001  a model's failure is data
                    out.append((r.v, r.z, False, str(e), [], []))
            yield pd.DataFrame(out, columns=["v", "z", "ok", "message", "masks", "mask"])

    return gray.select("v", "z", "h", "w", "gray", *cols).mapInPandas(run, RESULT)


def predict_volumes(gray: DataFrame, predictor: Predictor) -> DataFrame:
    """Run a model on whole volumes: a row a slice, its mask as runs. A volume is one
    task's work. Optional columns: prompt, bbox (of the volume), seed_rows (of the slice)."""
    cols = [c for c in ("prompt", "bbox", "seed_rows") if c in gray.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z", ignore_index=True)
        h, w = int(pdf["h"][0]), int(pdf["w"][0])
        get = lambda c: next((x for x in pdf[c] if x is not None), None) if c in pdf else None
        try:
            if not predictor.supports_volume:
                raise NotImplementedError("volumes are not supported")
            volume = np.stack([np.asarray(g, np.int64).reshape(h, w) for g in pdf["gray"]])
            seeds = {k: rows.to_image(r, (h, w)) for k, r in enumerate(pdf["seed_rows"]) if r is not None} if "seed_rows" in pdf else {}
            box = get("bbox")
            made = normalize(predictor.predict_volume(volume, get("prompt") or "", {"bbox": None if box is None else list(box), "seed_masks": seeds}), volume.shape)
            out = [_packed([m[k] for m in made[:1]], (h, w)) for k in range(len(pdf))]
            return pd.DataFrame({"v": pdf["v"], "z": pdf["z"], "ok": True, "message": "", "masks": [m for m, _ in out], "mask": [m for _, m in out]})
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame({"v": pdf["v"], "z": pdf["z"], "ok": False, "message": str(e), "masks": [[]] * len(pdf), "mask": [[]] * len(pdf)})

    return gray.select("v", "z", "h", "w", "gray", *cols).groupBy("v").applyInPandas(run, RESULT)


def text_seeds(gray: DataFrame, stride: int, predictor: Predictor) -> DataFrame:
    """(v, z, rows) of every ``stride``-th slice; slices are skipped before the model runs."""
    found = predict_slices(gray.where(F.col("z") % max(1, stride) == 0), predictor)
    return found.where(F.size("mask") > 0).select("v", "z", F.col("mask").alias("rows"))


def roi_request(gray: DataFrame, seeds: DataFrame, boxes: DataFrame) -> DataFrame:
    """Slices with the request columns of a volume run: each slice's seed (runs v, z, y, x0,
    x1, cut to its image), the volume's box (v, x1, y1, x2, y2)."""
    own = rows.gathered(seeds, gray).withColumnRenamed("rows", "seed_rows")
    return gray.join(own, ["v", "z"], "left").join(boxes.select("v", F.array("x1", "y1", "x2", "y2").alias("bbox")), "v", "left")


NEEDS_PROMPT = "this model needs a prompt mask or seeds"


def prompted_request(gray: DataFrame, seeds: DataFrame, drawn: DataFrame, promptable: bool) -> DataFrame:
    """Slices with the request columns of a run slice by slice.

    A volume with seeds (runs) is run in seed mode ``3d``: each slice's prompt is its own
    seed or the box that its neighbours' seeds give it. Other volumes are run in mode ``2d``
    with the one mask drawn (runs v, y, x0, x1) on all slices, or without. A promptable model
    refuses slices that have no prompt.
    """
    grid = gray.select("v", "z", "h", "w")
    exact = rows.gathered(seeds, grid)
    boxes = propagate.interpolate_seeds(masks.bbox(rows.exploded(exact)), grid.select("v", "z"))
    seeded = boxes.join(exact, ["v", "z"], "left").select("v", "z", F.coalesce("rows", rows.of_box(F.struct("x1", "y1", "x2", "y2"))).alias("_seed"))
    shared = rows.gathered(drawn.join(grid.select("v", "z"), "v"), grid).withColumnRenamed("rows", "_drawn")
    joined = gray.join(seeded, ["v", "z"], "left").join(shared, ["v", "z"], "left")
    asked = joined.withColumn("prompt_rows", F.coalesce("_seed", "_drawn")).withColumn("seed_mode", F.when(F.col("_seed").isNotNull(), "3d").otherwise("2d"))
    return asked.withColumn("refused", F.when(F.lit(promptable) & F.col("prompt_rows").isNull(), NEEDS_PROMPT)).drop("_seed", "_drawn")


__all__ = ["PercentilePredictor", "Predictor", "RoiPredictor", "normalize", "predict_slices", "predict_volumes", "prompted_request", "roi_request", "segment", "text_seeds"]
