"""Pictures to records: pixels go through Arrow batches twice (statistics, then preparation), all else is columns.

images: document_id, filename, page, image_index, width, height, channels, data (raw pixels), n_bytes (of the file),
caption and near_text. A picture that cannot be analysed has an `error` and nulls; the others are not touched by it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from . import images as I

COLOURS = "struct<grey:double,saturation:double,mean:double,std:double,error:string>"
PREPARED = "struct<over180:double,over200:double,under30:double,purple:double,sharpness:double,mean:double,std:double,width:int,height:int,channels:int,picture:binary,thumbnail:binary,ocr:string,found:string,error:string>"
THUMBNAIL = 256


def _names(schema: str) -> list[str]:
    return [f.split(":")[0] for f in schema[7:-1].split(",")]


def _frame(rows: list[dict], schema: str, index) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in _names(schema)] for r in rows], columns=_names(schema), index=index, dtype=object)


def colours(data: Column, width: Column, height: Column, channels: Column) -> Column:
    """Grey share, saturation, mean and deviation of brightness."""

    def one(d, w, h, c) -> dict:
        try:
            a = P.as_array(d, int(w), int(h), int(c))
            grey = P.luma(a)
            return {"grey": P.grey_share(a), "saturation": P.saturation(a), "mean": float(grey.mean()), "std": float(grey.std())}
        except (ValueError, TypeError) as e:
            return {"error": f"not an image: {e}"}

    @F.pandas_udf(COLOURS)
    def run(d: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.DataFrame:
        return _frame([one(*x) for x in zip(d, w, h, c, strict=True)], COLOURS, d.index)

    return run(data, width, height, channels)


def prepared(data: Column, width: Column, height: Column, channels: Column, kind: Column, context: Column, ocr=None, vision=None) -> Column:
    """The prepared picture, its statistics and thumbnail, and what the models read and see in it.

    A model that fails on a picture gives nothing for it."""

    def ask(model, *args):
        try:
            return model(*args) if model else None
        except Exception:  # whatever a model's client raises
            return None

    def one(read, see, d, w, h, c, k, about) -> dict:
        try:
            a = P.as_array(d, int(w), int(h), int(c))
            b = P.prepare(a, k)
            picture = P.png(b)
            text = ask(read, b)
            found = ask(see, picture, k, " ".join(x for x in (about, text) if x))
            return {**P.statistics(b), "width": b.shape[1], "height": b.shape[0], "channels": 1 if b.ndim == 2 else 3, "picture": picture, "thumbnail": P.png(P.fit(a, THUMBNAIL)), "ocr": text, "found": found}
        except (ValueError, TypeError) as e:
            return {"error": f"not an image: {e}"}

    @F.pandas_udf(PREPARED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        read, see = ocr.load() if ocr else None, vision.load() if vision else None
        for columns in batches:
            yield _frame([one(read, see, *x) for x in zip(*columns, strict=True)], PREPARED, columns[0].index)

    return run(data, width, height, channels, kind, context)


def usable(pictures: DataFrame) -> DataFrame:
    """Pictures that are no icons or rules."""
    return pictures.where(I.big_enough(F.col("n_bytes"), F.col("width"), F.col("height")))


def analyse(pictures: DataFrame, hint: Column | None = None, ocr=None, vision=None) -> DataFrame:
    """pictures with modality, findings, report, caption, clinical_context, pixel_metadata, picture, thumbnail (base64),
    text to embed and error, instead of data."""
    blank = F.lit("")
    about = F.concat_ws(" ", F.when(F.col("near_text") != "", F.col("near_text")), F.when(F.col("caption") != "", F.col("caption")))
    raw = [F.col(c) for c in ("data", "width", "height", "channels")]
    d = pictures.withColumn("c", colours(*raw)).withColumn("about", about)
    c = lambda n: F.col(f"c.{n}")
    hints = F.concat(F.coalesce("filename", blank), F.lit(" "), F.col("about"))
    d = d.withColumn("modality", I.modality(hints, hint, c("grey"), c("mean"), c("std"), c("saturation")))
    d = d.withColumn("p", prepared(*raw, F.col("modality"), F.col("about"), ocr, vision)).drop("data")
    s = lambda n: F.col(f"p.{n}")
    seen = F.coalesce(I.parse_findings(s("found")), F.array().cast(f"array<{I.FINDING}>"))
    own = I.pixel_findings(F.col("modality"), *[s(n) for n in ("over180", "over200", "under30", "purple", "sharpness", "mean", "std")])
    d = d.withColumn("findings", F.concat(own, seen)).withColumn("ocr_text", F.coalesce(I.ocr_text(s("ocr")), blank))
    d = d.withColumn("report", I.report(F.col("findings"), F.col("modality"))).withColumn("caption", I.caption(F.col("findings"), F.col("modality"), F.col("caption"), F.col("ocr_text")))
    metadata = F.struct(
        F.col("width"), F.col("height"), F.col("modality"), F.col("page").alias("page_number"), (F.col("width").cast("long") * F.col("height")).alias("pixel_count"), F.round(F.try_divide(F.col("width"), F.col("height")), 3).alias("aspect_ratio"),
        F.round(c("mean"), 2).alias("mean_pixel_intensity"), F.round(c("std"), 2).alias("std_pixel_intensity"), I.regions(F.col("modality")).alias("possible_anatomical_regions"),
    )
    d = d.withColumn("pixel_metadata", metadata).withColumn("clinical_context", F.substring(F.concat_ws(" ", F.when(F.col("about") != "", F.col("about")), F.when(F.col("ocr_text") != "", F.col("ocr_text"))), 1, 500))
    text = I.as_text(F.col("filename"), F.col("page"), F.col("modality"), F.col("caption"), s("width"), s("height"), F.col("ocr_text"), F.col("clinical_context"), F.col("findings"), F.col("report"))
    d = d.withColumns({"text": text, "picture": s("picture"), "thumbnail": F.base64(s("thumbnail")), "picture_width": s("width"), "picture_height": s("height"), "error": F.coalesce(c("error"), s("error"))})
    return d.drop("c", "p", "about")


def image_chunks(analysed: DataFrame) -> DataFrame:
    """Chunks of analysed pictures, those with an error left out."""
    picture_id = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.lit("image"), "page", "image_index"), 256)
    return analysed.where("error is null").select(
        "document_id", "page", "image_index", "text", "modality", "caption", "ocr_text", picture_id.alias("chunk_id"), picture_id.alias("image_id"), F.lit("imaging").alias("section"), F.lit("image").alias("chunk_type"),
        F.lit(True).alias("is_image_chunk"), F.col("picture_width").alias("image_width"), F.col("picture_height").alias("image_height"), F.size("findings").alias("findings_count"),
        F.col("report.overall_severity").alias("overall_severity"), F.col("report.overall_confidence").alias("overall_confidence"), F.col("report.critical_flags").alias("critical_flags"), F.col("report.impression").alias("report_impression"),
    )


def stored_pictures(analysed: DataFrame) -> DataFrame:
    """(image_id, filename, modality, picture) of the prepared pictures, for a table of their own."""
    chunk = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.lit("image"), "page", "image_index"), 256)
    return analysed.where("error is null").select("document_id", chunk.alias("image_id"), F.concat(chunk, F.lit("_"), F.col("modality"), F.lit(".png")).alias("filename"), "modality", "picture", "thumbnail")
