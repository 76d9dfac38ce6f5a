"""Checks on image chunks before they are embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.folder import image_format, image_size

#: Limits in bytes, pixels and shape.
LIMITS = {"min_bytes": 100, "max_bytes": 10 * 1024 * 1024, "min_width": 500, "min_height": 350, "min_pixels": 175_000, "max_width": 4000, "max_height": 3000, "max_pixels": 12_000_000, "min_aspect": 0.1, "max_aspect": 10.0, "provider_pixels": 16_000_000}


def bare_base64(text: Column | str) -> Column:
    """Without line breaks, white space at the ends, and a data: prefix."""
    t = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+|\s+\z", ""), r"[\r\n]", "")
    return F.regexp_replace(plain, "^data:[^,]*,(?=.)", "")


def _sized_reason(size: Column, width: Column, height: Column, limits: dict) -> Column:
    pixels, aspect = width * height, F.try_divide(width.cast("double"), height.cast("double"))
    return (
        F.when((width < limits["min_width"]) | (height < limits["min_height"]) | (pixels < limits["min_pixels"]), "too_small_dims")
        .when((width > limits["max_width"]) | (height > limits["max_height"]) | (pixels > limits["max_pixels"]), "too_large_dims")
        .when((aspect < limits["min_aspect"]) | (aspect > limits["max_aspect"]), "bad_aspect_ratio")
        .when(pixels > limits["provider_pixels"], "exceeds_provider_max")
        .when(size > 20 * 1024 * 1024, "too_large_bytes")
        .otherwise("accepted")
    )


def _bytes_reason(text: Column, size: Column, limits: dict) -> Column:
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) < 10, "empty_base64")
        .when(size.isNull(), "invalid_base64")
        .when(size == 0, "empty_decoded")
        .when(size < limits["min_bytes"], "too_small_bytes")
        .when(size > limits["max_bytes"], "too_large_bytes")
    )


def validate(images: DataFrame, text: str = "base64", limits: dict | None = None) -> DataFrame:
    """``images`` with reason (the first rule that fails, or accepted), image_format, width and height.

    Sizes come from the image's header; one whose header can't be read fails as decode_failed.
    """
    limits = LIMITS | (limits or {})
    rows = images.withColumn("__data", F.try_to_binary(bare_base64(text), F.lit("base64")))
    rows = rows.withColumns({"image_format": image_format("__data"), "__size": image_size("__data")})
    width, height, size = F.col("__size.width"), F.col("__size.height"), F.length("__data")
    late = F.when(F.col("image_format").isNull(), "invalid_format").when(width.isNull(), "decode_failed").otherwise(_sized_reason(size, width, height, limits))
    return rows.withColumns({"reason": F.coalesce(_bytes_reason(F.col(text), size, limits), late), "width": width, "height": height}).drop("__data", "__size")


def size_reason(size: Column, width: Column, height: Column, limits: dict | None = None) -> Column:
    """The same cascade for images whose sizes are known already."""
    limits = LIMITS | (limits or {})
    early = F.when(size < limits["min_bytes"], "too_small_bytes").when(size > limits["max_bytes"], "too_large_bytes")
    return F.coalesce(early, _sized_reason(size, width, height, limits))


def histogram(validated: DataFrame) -> DataFrame:
    return validated.groupBy("reason").agg(F.count("*").alias("n"))
