"""Decision tables: kinds of PDF and image, routes, readiness and quality of page images, OCR variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def pdf_features(pages: DataFrame) -> DataFrame:
    """Per document from pages (input_id, page, char_count, word_count, image_area, page_area): averages and page shares. Areas are summed as decimals of ten places, so that a ratio of just 0.5 doesn't depend on the order of pages."""
    share = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1))
    ratio = F.when(F.col("page_area") > 0, F.col("image_area") / F.col("page_area")).otherwise(0.0)
    area = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double")
    return pages.groupBy("input_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.avg("char_count").alias("avg_text_chars"), F.avg("word_count").alias("avg_words"),
        share(F.col("char_count") >= 80).alias("text_page_ratio"), share(ratio >= 0.65).alias("large_image_page_ratio"),
        F.when(area("page_area") > 0, area("image_area") / area("page_area")).otherwise(0.0).alias("global_image_area_ratio"),
    )


def pdf_kind() -> Column:
    """struct(kind, confidence, warning) of the columns of pdf_features; the first rule that holds."""
    c, t, i, g = (F.col(x) for x in ("avg_text_chars", "text_page_ratio", "large_image_page_ratio", "global_image_area_ratio"))
    made = lambda kind, conf, warning=None: F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"), F.lit(warning).cast("string").alias("warning"))
    return (
        F.when((c >= 300) & (t >= 0.60), made("real_pdf", 0.94))
        .when((c < 80) & (i >= 0.60), made("scanned_pdf", 0.92))
        .when((t > 0.15) & (i > 0.15), made("hybrid_pdf", 0.78, "mixed_text_and_image_pdf"))
        .when((g > 0.50) & (c < 150), made("scanned_pdf", 0.74, "likely_scanned_pdf_but_low_confidence"))
        .otherwise(made("unknown", 0.50, "pdf_classification_uncertain"))
    )


def classified(inputs: DataFrame, pdfs: DataFrame, images: DataFrame) -> DataFrame:
    """(input_id, kind, confidence, needs_ocr, needs_preprocessing, routing_key, warnings) of inputs (input_id, mime, open_error).

    By type: PDFs by their page features (of pdf_features; unopened ones, and those without pages, are unknown with no
    confidence and the reason as warning), images by their votes (rows of image_kind), all else is unsupported.
    """
    from ..sources.tables import is_image, is_pdf

    p = pdfs.withColumn("_p", pdf_kind()).select("input_id", "_p", "page_count")
    i = images.select("input_id", F.struct("kind", "confidence", "warnings").alias("_i"))
    rows = inputs.join(p, "input_id", "left").join(i, "input_id", "left")
    said = lambda *codes: F.array_compact(F.array(*(F.lit(c) if isinstance(c, str) else c for c in codes)))
    made = lambda kind, conf, warnings: F.struct(kind.alias("kind"), conf.cast("double").alias("confidence"), warnings.alias("warnings"))
    reason = F.when(F.col("open_error").isNotNull(), F.concat(F.lit("Could not open PDF: "), "open_error")).when(F.coalesce("page_count", F.lit(0)) == 0, "PDF has zero pages")
    found = (
        F.when(is_pdf(F.col("mime")) & reason.isNotNull(), made(F.lit("unknown"), F.lit(0.0), said(reason)))
        .when(is_pdf(F.col("mime")), made(F.col("_p.kind"), F.col("_p.confidence"), said(F.col("_p.warning"))))
        .when(is_image(F.col("mime")) & F.col("_i").isNotNull(), made(F.col("_i.kind"), F.col("_i.confidence"), F.col("_i.warnings")))
        .when(is_image(F.col("mime")), made(F.lit("unknown"), F.lit(0.0), said("image_classification_failed", "low_confidence_image_classification")))
        .otherwise(made(F.lit("unsupported"), F.lit(0.0), said("unsupported_mime_type")))
    )
    kind = F.col("_f.kind")
    return rows.withColumn("_f", found).select("input_id", kind.alias("kind"), F.col("_f.confidence").alias("confidence"), needs_ocr(kind).alias("needs_ocr"), needs_preprocessing(kind).alias("needs_preprocessing"), route(kind).alias("routing_key"), F.col("_f.warnings").alias("warnings"))


def _points(*terms: tuple[Column, float]) -> Column:
    return sum((F.when(c, F.lit(x)).otherwise(F.lit(0.0)) for c, x in terms), F.lit(0.0))


def _band(*steps: tuple[Column, float], other: float = 0.0) -> Column:
    out = None
    for c, x in steps:
        out = F.when(c, F.lit(x)) if out is None else out.when(c, F.lit(x))
    return out.otherwise(F.lit(other))


def image_votes() -> tuple[Column, Column]:
    """Votes for a screenshot and for a camera photo, from mime, exif_present, camera_exif_tag_count, width, height, blur_score, edge_density, has_document_contour, max_contour_area_ratio, axis_aligned_line_score."""
    c = F.col
    aspect = F.round(c("width") / c("height"), 4)
    short, long = F.least("width", "height"), F.greatest("width", "height")
    camera_tags = c("camera_exif_tag_count") >= 2
    screenshot = (
        _points((c("mime").isin("image/png", "image/webp"), 1.5), (~camera_tags & c("exif_present") & (c("camera_exif_tag_count") == 0), 0.5), (~c("exif_present"), 0.7), (c("edge_density") >= 0.10, 0.7), ((short >= 720) & (short < 1300) & (long >= 1400) & (long < 3000), 0.8))
        + _band((c("blur_score") >= 1000, 2.0), (c("blur_score") >= 500, 1.2))
        + _band((c("axis_aligned_line_score") >= 0.20, 1.5), (c("axis_aligned_line_score") >= 0.08, 0.8))
        + _band((aspect.between(0.40, 0.60), 1.2), (aspect.between(1.7, 2.4), 1.0))
    )
    camera = _points((c("mime").isin("image/jpeg", "image/heic", "image/heif"), 0.8), (camera_tags, 3.0), (c("blur_score") < 150, 1.0), (c("has_document_contour"), 2.5), (c("max_contour_area_ratio") >= 0.35, 1.0))
    return screenshot, camera


def image_kind(df: DataFrame) -> DataFrame:
    """df with screenshot_score, camera_score, kind, confidence and warnings; a tie is a camera photo, no vote at all unknown."""
    s, k = image_votes()
    df = df.withColumn("screenshot_score", s).withColumn("camera_score", k)
    total = F.col("screenshot_score") + F.col("camera_score")
    df = df.withColumn("kind", F.when(total <= 0, "unknown").when(F.col("screenshot_score") > F.col("camera_score"), "screenshot").otherwise("camera_photo"))
    df = df.withColumn("confidence", F.when(total > 0, F.round(F.greatest("screenshot_score", "camera_score") / total, 4)).otherwise(0.0))
    exact = F.when(total > 0, F.greatest("screenshot_score", "camera_score") / total).otherwise(0.0)
    said = (F.when(total <= 0, "image_classification_failed"), F.when(exact < 0.65, "low_confidence_image_classification"), F.when((F.col("blur_score") < 80) & (F.col("kind") == "camera_photo"), "possible_blurry_camera_photo"))
    return df.withColumn("warnings", F.array_compact(F.array(*said)))


def route(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.ROUTES.items() for x in kv)), kind)


def needs_ocr(kind: Column) -> Column:
    return kind.isin(*fixed.NEEDS_OCR)


def needs_preprocessing(kind: Column) -> Column:
    return kind.isin(*fixed.NEEDS_PREPROCESSING)


def readiness() -> Column:
    """OCR readiness from blur_score, brightness, contrast, foreground_density, component_count, avg_component_area, border_artifact_score."""
    c = F.col
    score = (
        _band((c("blur_score") >= 500, 0.20), (c("blur_score") >= 180, 0.12), other=0.04)
        + _band((c("brightness").between(80, 235), 0.15), other=0.06)
        + _band((c("contrast").between(30, 95), 0.20), other=0.08)
        + _band((c("foreground_density").between(0.01, 0.22), 0.20), other=0.07)
        + _band((c("component_count") >= 80, 0.15), (c("component_count") >= 20, 0.08))
        + _band((c("avg_component_area").between(3, 400), 0.10), other=0.04)
        + _band((c("border_artifact_score") <= 0.08, 0.10), (c("border_artifact_score") <= 0.18, 0.04), other=-0.08)
    )
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def quality() -> Column:
    """Image quality from blur_score, brightness, contrast, edge_density, dark_pixel_ratio, bright_pixel_ratio."""
    c = F.col
    score = (
        _band((c("blur_score") >= 500, 0.25), (c("blur_score") >= 200, 0.15), other=0.05)
        + _band((c("brightness").between(70, 200), 0.20), other=0.08)
        + _band((c("contrast") >= 45, 0.25), (c("contrast") >= 25, 0.15), other=0.05)
        + _band((c("edge_density").between(0.02, 0.25), 0.20), other=0.08)
        + _band(((c("dark_pixel_ratio") < 0.35) & (c("bright_pixel_ratio") < 0.70), 0.10), other=0.04)
    )
    return F.least(score, F.lit(1.0))


def variant_priority(variant: Column) -> Column:
    low, out = F.lower(variant), None
    for key, p in fixed.VARIANT_PRIORITY.items():
        out = F.when(F.contains(low, F.lit(key)), p) if out is None else out.when(F.contains(low, F.lit(key)), p)
    return out.otherwise(60)


def best_variant(outputs: DataFrame) -> DataFrame:
    """One variant for each (input_id, page) of outputs (variant, psm, ord, ocr_score, is_preferred): highest final score at four decimals, on ties the first in order, and of one variant the first mode."""
    final = F.round(F.col("ocr_score") + variant_priority(F.col("variant")) / 100 + F.when(F.col("is_preferred"), 0.15).otherwise(0.0), 4)
    rows = outputs.withColumn("final_score", final)
    best = rows.groupBy("input_id", "page").agg(F.max_by(F.struct("variant", "psm", "final_score"), F.struct("final_score", -F.col("ord"), -mode_order(F.col("psm")))).alias("b"))
    return best.select("input_id", "page", "b.*")


def mode_order(psm: Column) -> Column:
    """Place of an OCR mode among those that are tried in turn; others come last."""
    return F.when(psm == 6, 0).when(psm == 11, 1).when(psm == 4, 2).otherwise(3 + F.coalesce(psm, F.lit(0)))


def preferred_output(variants: DataFrame) -> DataFrame:
    """Per document: the candidate of the highest readiness (any variant if none is a candidate; the first on ties), the mean readiness, and whether it is ready."""
    best = variants.groupBy("input_id").agg(
        F.max_by("variant", F.struct(F.col("is_candidate").cast("int"), "readiness", -F.col("ord"))).alias("preferred"), F.round(F.avg("readiness"), 4).alias("mean_readiness"), F.count(F.lit(1)).alias("n_variants")
    )
    return best.withColumn("is_ready", F.col("preferred").isNotNull() & (F.col("mean_readiness").isNull() | (F.col("mean_readiness") >= 0.35)))
