"""Records of images from columns: file names, captions, pixel statistics and findings. Decoding and models are providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import count_hits, strip

FINDING = "struct<finding_type:string,description:string,confidence:double,region:string,severity:string>"
MIN_BYTES, MIN_WIDTH, MIN_HEIGHT = 4096, 80, 80


def big_enough(n_bytes: Column, width: Column, height: Column) -> Column:
    return (n_bytes >= MIN_BYTES) & (width >= MIN_WIDTH) & (height >= MIN_HEIGHT)


def caption_below(words: Column, x0: Column, x1: Column, y1: Column, strip_points: float = 60.0) -> Column:
    """Text of words (array<struct<x0,x1,y0,text>>) in the strip below a box, over 5 characters, the first 300."""
    inside = F.filter(words, lambda w: (w["x0"] >= x0) & (w["x1"] <= x1) & (w["y0"] >= y1) & (w["y0"] <= y1 + strip_points))
    found = strip(F.array_join(F.transform(inside, lambda w: w["text"]), " "))
    return F.when(F.length(found) > 5, F.substring(found, 1, 300))


def near_text(page: Column, n: int = 500) -> Column:
    return strip(F.substring(page, 1, n))


def modality(text: Column, hint: Column | None = None, gray=None, mean=None, std=None, saturation=None, lexicon=L.MODALITIES) -> Column:
    """The hint; else the modality with most keywords in the text, the first of those that tie; else by pixels."""
    low = F.lower(text)
    best = F.array_max(F.array(*[F.struct(count_hits(low, ws).alias("n"), F.lit(-i).alias("o"), F.lit(m).alias("m")) for i, (m, ws) in enumerate(lexicon.items())]))
    by_pixels = pixel_modality(gray, mean, std, saturation) if gray is not None else F.lit("clinical")
    return F.coalesce(hint if hint is not None else F.lit(None).cast("string"), F.when(best["n"] > 0, best["m"]), by_pixels)


def pixel_modality(gray: Column, mean: Column, std: Column, saturation: Column) -> Column:
    scan = F.when((mean < 80) & (std > 40), "xray").when(std < 30, "mri").otherwise("ct")
    return F.when(gray > 0.92, scan).when((saturation > 0.3) & (mean > 100), "pathology").otherwise("clinical")


def pixel_findings(kind: Column, over180: Column, over200: Column, under30: Column, purple: Column, sharpness: Column, mean: Column, std: Column) -> Column:
    """array<finding> from percentages of pixels."""
    one = lambda c, d: F.format_string(f"%.{d}f", c)

    def finding(when: Column, type_: str, description: Column, confidence: float, region: str, severity: Column) -> Column:
        return F.when(when, F.struct(F.lit(type_).alias("finding_type"), description.alias("description"), F.lit(confidence).alias("confidence"), F.lit(region).alias("region"), severity.alias("severity")))

    scan = kind.isin("ct", "mri")
    return F.array_compact(F.array(
        finding((kind == "xray") & (over180 > 15), "opacity", F.concat(F.lit("Increased opacity detected in "), one(over180, 1), F.lit("% of image area")), 0.6, "detected_area", F.when(over180 > 40, "moderate").otherwise("low")),
        finding(scan & (over200 > 5), "hyperintense_region", F.concat(F.lit("Hyperintense regions detected: "), one(over200, 1), F.lit("% of scan area")), 0.55, "detected_area", F.lit("moderate")),
        finding(scan & (under30 > 30), "hypointense_region", F.concat(F.lit("Hypointense regions: "), one(under30, 1), F.lit("% — possible fluid or necrosis")), 0.5, "detected_area", F.lit("low")),
        finding((kind == "ultrasound") & (under30 > 15), "anechoic_region", F.concat(F.lit("Anechoic (fluid-filled) region: "), one(under30, 1), F.lit("% of image")), 0.65, "detected_area", F.lit("low")),
        finding((kind == "pathology") & (purple > 5), "hematoxylin_staining", F.concat(F.lit("Nuclear hematoxylin staining: "), one(purple, 1), F.lit("% coverage")), 0.7, "global", F.lit("info")),
        finding(F.lit(True), "image_quality", F.concat(F.lit("Image quality — sharpness: "), one(sharpness, 3), F.lit(" | mean intensity: "), one(mean, 1), F.lit(" | std: "), one(std, 1)), 1.0, "global", F.lit("info")),
    ))


def parse_findings(raw: Column) -> Column:
    """Findings from a model's JSON, code fences removed; those without a description drop out, gaps get defaults."""
    bare = strip(F.regexp_replace(strip(raw), r"(?s)^```(?:json)?(.*?)```.*$", "$1"))
    found = F.filter(F.from_json(bare, f"array<{FINDING}>"), lambda f: F.coalesce(f["description"], F.lit("")) != "")
    return F.transform(found, lambda f: F.struct(F.coalesce(f["finding_type"], F.lit("observation")).alias("finding_type"), f["description"].alias("description"), F.coalesce(f["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(f["region"], F.lit("unspecified")).alias("region"), F.coalesce(f["severity"], F.lit("info")).alias("severity")))


def _real(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["finding_type"] != "image_quality")


def caption(findings: Column, kind: Column, original: Column, ocr: Column) -> Column:
    first = F.get(_real(findings), 0)["description"]
    return F.coalesce(F.when(F.length(original) > 20, original), F.concat(F.upper(kind), F.lit(" image — "), first), F.when(F.length(ocr) > 20, F.substring(ocr, 1, 200)), F.concat(F.upper(kind), F.lit(" medical image")))


def report(findings: Column, kind: Column) -> Column:
    """struct<overall_severity, overall_confidence, impression, findings_summary, recommendations, critical_flags>."""
    has = lambda level: F.exists(findings, lambda f: f["severity"] == level)
    severity = F.when(has("critical"), "critical").when(has("high"), "high").when(has("moderate"), "moderate").otherwise("low")
    mean = F.when(F.size(findings) > 0, F.round(F.aggregate(findings, F.lit(0.0), lambda a, f: a + f["confidence"]) / F.size(findings), 3)).otherwise(0.0)
    real = _real(findings)
    lines = F.when(F.size(real) > 0, F.concat(F.array(F.concat(F.upper(kind), F.lit(" demonstrates:"))), F.transform(F.slice(real, 1, 5), lambda f: F.concat(F.lit("- "), f["description"])))).otherwise(F.array(F.concat(F.upper(kind), F.lit(" image — no significant automated findings."))))
    summary = F.array_join(F.transform(F.slice(real, 1, 3), lambda f: f["description"]), " | ")
    return F.struct(
        severity.alias("overall_severity"), mean.alias("overall_confidence"), F.array_join(F.concat(lines, F.array(F.lit("Note: Automated analysis only. Clinical correlation required."))), "\n").alias("impression"),
        F.when(summary != "", summary).otherwise("No findings.").alias("findings_summary"),
        F.array(F.when(severity.isin("critical", "high"), "Priority radiologist review recommended.").otherwise("Routine review recommended."), F.lit("Correlate with clinical history and other findings.")).alias("recommendations"),
        F.transform(F.filter(findings, lambda f: f["severity"] == "critical"), lambda f: f["description"]).alias("critical_flags"),
    )


def regions(kind: Column, table=L.REGIONS) -> Column:
    pairs = reduce(lambda a, b: a + b, [[F.lit(k), F.array(*map(F.lit, v))] for k, v in table.items()])
    return F.coalesce(F.create_map(*pairs)[kind], F.array().cast("array<string>"))


def ocr_text(raw: Column) -> Column:
    clean = strip(raw)
    return F.when(F.length(clean) < 10, "").otherwise(F.substring(clean, 1, 2000))


def as_text(filename: Column, page: Column, kind: Column, caption_: Column, width: Column, height: Column, ocr: Column, context: Column, findings: Column, made: Column) -> Column:
    """The record as the text that is embedded."""
    some = lambda pre, c, n: F.when(c != "", F.concat(F.lit(pre), F.substring(c, 1, n)))
    numbered = F.transform(findings, lambda f, i: F.when(f["finding_type"] != "image_quality", F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] ["), F.upper(f["severity"]), F.lit("] "), f["description"], F.lit(" (confidence: "), F.format_string("%.2f", f["confidence"]), F.lit(")"))))
    flags = made["critical_flags"]
    return F.concat_ws(
        "\n", F.concat(F.lit("[MEDICAL IMAGE] Source: "), filename, F.lit(" | Page: "), page.cast("string"), F.lit(" | Modality: "), F.upper(kind)), some("Caption: ", caption_, 1 << 30),
        F.concat(F.lit("Dimensions: "), width.cast("string"), F.lit("x"), height.cast("string")), some("OCR Text: ", ocr, 500), some("Context: ", context, 300), F.lit("\nFINDINGS:"), F.array_compact(numbered),
        F.concat(F.lit("\nIMPRESSION:\n"), made["impression"]), F.when(F.size(flags) > 0, F.lit("\n⚠ CRITICAL:")), F.transform(flags, lambda x: F.concat(F.lit("  !! "), x)),
    )
