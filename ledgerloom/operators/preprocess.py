"""Preprocessing: what is made of each input, gates before extraction, metrics of grey images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def plan(inputs: DataFrame) -> DataFrame:
    """inputs (input_id, kind) with output_type, method, risk, status, is_ready (null: depends on the variants)."""
    kind = F.col("kind")
    case = lambda pdf, scan, shot, photo, rest: F.when(kind == "real_pdf", pdf).when(kind.isin("scanned_pdf", "hybrid_pdf"), scan).when(kind == "screenshot", shot).when(kind == "camera_photo", photo).otherwise(rest)
    return inputs.withColumns({
        "output_type": case("native_pdf_reference", "multi_variant_rendered_pages", "multi_variant_full_image", "multi_variant_full_image", "none"),
        "method": case("native_pdf_text", "ocr_multi_variant", "ocr_multi_variant", "ocr_multi_variant", "manual_review"),
        "risk": case("low", "medium", "low", "medium", "high"), "status": case("completed", "completed", "completed", "completed", "skipped"),
        "is_ready": F.when(kind == "real_pdf", True).when(~kind.isin("scanned_pdf", "hybrid_pdf", "screenshot", "camera_photo"), False),
    })


def variants(pages: DataFrame) -> DataFrame:
    """pages (input_id, page, kind) by variant: ord, variant, purpose, is_candidate, operations; none for other kinds, at most MAX_VARIANTS a page."""
    made = lambda i, v: F.struct(F.lit(i).alias("ord"), F.lit(v[0]).alias("variant"), F.lit(v[1]).alias("purpose"), F.lit(v[2]).alias("is_candidate"), F.array(*(F.lit(x) for x in v[3])).alias("operations"))
    lists = {k: F.array(*(made(i, x) for i, x in enumerate(v[: fixed.MAX_VARIANTS]))) for k, v in fixed.VARIANTS.items()}
    picked = F.when(F.col("kind") == "screenshot", lists["screenshot"]).when(F.col("kind") == "camera_photo", lists["camera_photo"]).when(F.col("kind").isin("scanned_pdf", "hybrid_pdf"), lists["scanned_pdf"])
    return pages.withColumn("_v", F.explode(picked)).select(*pages.columns, "_v.*")


def preview_variants(pages: DataFrame) -> DataFrame:
    """pages (input_id, page, kind) of native PDFs with the variant made for looking at, never for OCR."""
    v = fixed.PREVIEW
    made = F.struct(F.lit(0).alias("ord"), F.lit(v[0]).alias("variant"), F.lit(v[1]).alias("purpose"), F.lit(v[2]).alias("is_candidate"), F.array(*(F.lit(x) for x in v[3])).alias("operations"))
    return pages.where("kind = 'real_pdf'").withColumn("_v", made).select(*pages.columns, "_v.*")


def results(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The record of preprocessing for inputs (input_id, kind, page_count): plan, preferred output, operations, mean readiness and whether extraction can start.

    outputs (input_id, page, ord, variant, is_candidate, operations, readiness): the variants made. Native PDFs are taken
    as they are; other kinds than those of plan() are skipped with a warning.
    """
    from .classify import preferred_output

    rows = plan(inputs).join(preferred_output(outputs).withColumnRenamed("is_ready", "ready_"), "input_id", "left").join(operations(outputs), "input_id", "left")
    native, known = F.col("kind") == "real_pdf", F.col("is_ready").isNull() | (F.col("kind") == "real_pdf")
    return rows.select(
        "input_id", "kind", F.when(native, "completed").when(F.coalesce("n_variants", F.lit(0)) > 0, "completed").otherwise("skipped").alias("status"), "output_type", "method", "risk", F.when(known, F.col("page_count")).otherwise(0).alias("page_count"),
        F.when(native, "original_pdf").otherwise(F.col("preferred")).alias("preferred"), F.when(native, F.array(*(F.lit(x) for x in fixed.NATIVE_OPERATIONS))).otherwise(F.coalesce("operations", F.array().cast("array<string>"))).alias("operations"),
        F.when(~native, F.col("mean_readiness")).alias("mean_readiness"), F.when(native, True).otherwise(F.coalesce(F.col("ready_"), F.lit(False))).alias("is_ready"),
        F.when(~known, F.array(F.lit("unsupported_source_kind_for_preprocessing"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def operations(rows: DataFrame) -> DataFrame:
    """Per document, all operations of its variants, distinct and sorted."""
    return rows.groupBy("input_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("operations")))).alias("operations"))


def extraction_gate(inputs: DataFrame, classified: DataFrame, prepared: DataFrame, native: bool = True) -> DataFrame:
    """inputs (input_id, storage_url) with path, or the reason why extraction can't start. prepared: the latest record of each input (method, is_ready, preferred_url)."""
    rows = inputs.join(classified.select("input_id", "kind"), "input_id", "left").join(prepared.select("input_id", "method", "is_ready", "preferred_url"), "input_id", "left")
    kinds = F.col("kind") == "real_pdf" if native else F.col("kind").isin(*fixed.NEEDS_OCR)
    want = "native_pdf_text" if native else "ocr_multi_variant"
    reason = F.when(F.col("kind").isNull(), "not_classified").when(~kinds, "wrong_kind").when(F.col("method").isNull(), "not_preprocessed").when(~F.coalesce("is_ready", F.lit(False)), "not_ready").when(F.col("method") != want, "wrong_method")
    return rows.select("input_id", "kind", reason.alias("refused"), F.when(reason.isNull(), F.coalesce("preferred_url", "storage_url")).alias("path"))


def input_status(prepared: DataFrame) -> DataFrame:
    """(input_id, status) after preprocessing: failed with an error, else by readiness."""
    return prepared.select("input_id", F.when(F.col("error").isNotNull(), "preprocessing_failed").when(F.col("is_ready"), "preprocessed").otherwise("preprocessing_needs_review").alias("status"))


def otsu(grey: np.ndarray) -> int:
    """The threshold of the largest variance between classes."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def components(ink: np.ndarray, least: int = 2, most: int = 5000) -> tuple[int, float]:
    """8-connected components of least to most pixels: how many, and their mean size. Labels spread by minima until none changes."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    big = ink.size + 1
    while True:
        p = np.pad(np.where(ink, label, big), 1, constant_values=big)
        near = np.minimum.reduce([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        new = np.where(ink, near, 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(ink, flat[new], 0)  # and from the pixel that names the label
        if (new == label).all():
            break
        label = new
    size = np.bincount(label[ink]) if ink.any() else np.zeros(0, int)
    size = size[(size >= least) & (size <= most)]
    return len(size), float(size.mean()) if len(size) else 0.0


def border_share(ink: np.ndarray) -> float:
    b = int(max(ink.shape) * 0.025)
    if b == 0:  # bands of no rows: what a negative start takes is the whole image
        sides = [ink[:0], ink, ink[:, :0], ink]
    else:
        sides = [ink[:b], ink[-b:], ink[:, :b], ink[:, -b:]]
    return float(sum(np.count_nonzero(x) for x in sides) / max(sum(x.size for x in sides), 1))


def metrics(grey: np.ndarray) -> dict[str, float]:
    g = grey.astype(float)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    ink = grey <= otsu(grey)
    count, area = components(ink)
    values = {"blur_score": laplacian.var(), "brightness": g.mean(), "contrast": g.std(), "foreground_density": ink.mean(), "component_count": count, "avg_component_area": area, "border_artifact_score": border_share(ink)}
    return {k: v if k == "component_count" else round(float(v), 4) for k, v in values.items()}


def edges(grey: np.ndarray, low: int = 80, high: int = 200) -> np.ndarray:
    """Edge pixels: gradients by 3 x 3 differences (sums of absolute values), thinned along their direction, those over `high` and what is joined to them over `low`."""
    p = np.pad(grey.astype(np.int64), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.pad(np.abs(gx) + np.abs(gy), 1)
    at = lambda i, j: size[1 + i : size.shape[0] - 1 + i, 1 + j : size.shape[1] - 1 + j]
    ax, ay, own = np.abs(gx), np.abs(gy), at(0, 0)
    flat, steep = ay * 1.0 < ax * np.tan(np.pi / 8), ay * 1.0 > ax * np.tan(3 * np.pi / 8)
    rising = (gx < 0) != (gy < 0)
    peak = np.where(flat, (own > at(0, -1)) & (own >= at(0, 1)), np.where(steep, (own > at(-1, 0)) & (own >= at(1, 0)), np.where(rising, (own > at(-1, 1)) & (own > at(1, -1)), (own > at(-1, -1)) & (own > at(1, 1)))))
    weak = peak & (own > low)
    found = weak & (own > high)
    while True:  # grows by a pixel a turn
        q = np.pad(found, 1)
        near = np.logical_or.reduce([q[1 + i : q.shape[0] - 1 + i, 1 + j : q.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        grown = weak & near
        if (grown == found).all():
            return found
        found = grown


def quality_metrics(images: DataFrame) -> DataFrame:
    """images (input_id, width, height, pixels: 8-bit grey samples) with the columns that classify.quality() reads. Pixels of the wrong number give nulls."""
    names = ["blur_score", "brightness", "contrast", "edge_density", "dark_pixel_ratio", "bright_pixel_ratio"]

    def one(g: np.ndarray) -> tuple:
        m = metrics(g)
        return (m["blur_score"], m["brightness"], m["contrast"], *(round(float(x.mean()), 4) for x in (edges(g), g < 30, g > 225)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, w, h, px in zip(b["input_id"], b["width"], b["height"], b["pixels"]):
                ok = px is not None and w * h == len(px) > 0
                rows.append((k, w, h, *(one(np.frombuffer(px, np.uint8).reshape(h, w)) if ok else [None] * 6)))
            yield pd.DataFrame(rows, columns=["input_id", "width", "height", *names])

    return images.select("input_id", "width", "height", "pixels").mapInPandas(run, "input_id string, width int, height int, " + ", ".join(f"{n} double" for n in names))


def image_metrics(images: DataFrame) -> DataFrame:
    """images (input_id, width, height, pixels: 8-bit grey samples) with the columns that classify.readiness() reads. Pixels of the wrong number give nulls."""
    names = ["blur_score", "brightness", "contrast", "foreground_density", "component_count", "avg_component_area", "border_artifact_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, w, h, px in zip(b["input_id"], b["width"], b["height"], b["pixels"]):
                ok = px is not None and w * h == len(px) > 0
                rows.append((k, *(metrics(np.frombuffer(px, np.uint8).reshape(h, w)).values() if ok else [None] * 7)))
            yield pd.DataFrame(rows, columns=["input_id", *names]).astype({"component_count": "Int32"})

    return images.select("input_id", "width", "height", "pixels").mapInPandas(run, "input_id string, " + ", ".join(f"{n} {'int' if n == 'component_count' else 'double'}" for n in names))
