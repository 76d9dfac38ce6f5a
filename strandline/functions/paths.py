"""Paths, file types, identities, dates and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import as_column

#: The extensions that are read.
TEXT_TYPES = "txt md go py js ts tsx jsx java c cpp h rs rb php cs swift html css scss yaml yml toml sh proto graphql".split()
PDF_TYPES = ["pdf"]
IMAGE_TYPES = ["jpg", "jpeg", "png", "gif"]
SUPPORTED_TYPES = TEXT_TYPES + PDF_TYPES + IMAGE_TYPES
#: Directories that a folder scan leaves out.
PRUNED = ["node_modules", "vendor"]


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(as_column(path), "/[^/]*$", "")


def file_type(path: Column | str) -> Column:
    """The extension in lower case; ``unknown`` without one."""
    found = F.lower(F.regexp_extract(as_column(path), r"\.([^./]*)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


def kind(of_type: Column | str) -> Column:
    """text, pdf or image; null for what isn't read."""
    t = as_column(of_type)
    return F.when(t.isin(TEXT_TYPES), "text").when(t.isin(PDF_TYPES), "pdf").when(t.isin(IMAGE_TYPES), "image")


def scanned(path: Column | str) -> Column:
    """Whether a folder scan keeps the path: no pruned or hidden directory, no hidden file, a type that is read."""
    parts = F.filter(F.split(as_column(path), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda p: p.startswith(".") | p.isin(PRUNED))
    return ~pruned & ~basename(path).startswith(".") & file_type(path).isin(SUPPORTED_TYPES)


def file_id(path: Column | str) -> Column:
    return F.md5(as_column(path))


def chunk_id(of_file: Column | str, index: Column | str) -> Column:
    return F.md5(F.concat(as_column(of_file), F.lit(":chunk:"), as_column(index).cast("string")))


def content_hash(content: Column | str, content_type: Column | str, image_data: Column | str) -> Column:
    """sha256 of the image of an image chunk that has one, else of the content."""
    image = as_column(image_data)
    return F.when((as_column(content_type) == "image") & (F.length(image) > 0), F.sha2(image, 256)).otherwise(F.sha2(as_column(content), 256))


def inside(path: Column | str, root: str) -> Column:
    """Case aside, the path is ``root`` or lies under it."""
    low, top = F.lower(as_column(path)), root.lower().rstrip("/")
    return (low == top) | low.startswith(top + "/")


def is_network(path: Column | str) -> Column:
    return as_column(path).startswith("\\\\") | as_column(path).startswith("//")


#: Fixed value: characters that names of files and folders are made of.
_UNSAFE = r"[^A-Za-z0-9_-]"


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), _UNSAFE, "_")


def plain_name(text: str) -> str:
    return re.sub(_UNSAFE, "_", text)


def normalized(path: Column | str) -> Column:
    return F.lower(F.replace(as_column(path), F.lit("\\"), F.lit("/")))


def windows_to_wsl(path: Column | str) -> Column:
    p = as_column(path)
    moved = F.concat(F.lit("/mnt/"), F.lower(F.substring(p, 1, 1)), F.lit("/"), F.substring(p, 4, 1 << 30))
    return F.when(p.rlike(r"^[A-Za-z]:[/\\]"), F.replace(moved, F.lit("\\"), F.lit("/"))).otherwise(p)


def last_two(path: Column | str) -> Column:
    """The last two segments, which label a root folder."""
    parts = F.filter(F.split(as_column(path), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def human_size(size: Column | str) -> Column:
    n = as_column(size)
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", n / unit), F.lit(" " + name))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "Unknown")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, scaled(1024.0, "KB"))
        .when(n < 1024**3, scaled(1024.0**2, "MB"))
        .otherwise(scaled(1024.0**3, "GB"))
    )


def relative_time(then: Column | str, now: Column | str) -> Column:
    """Just now, minutes, hours, days, else the date."""
    seconds = F.unix_timestamp(as_column(now).cast("timestamp")) - F.unix_timestamp(as_column(then).cast("timestamp"))
    ago = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))
    return (
        F.when(seconds < 60, "Just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).when(seconds < 7 * 86400, ago(86400, "d"))
        .otherwise(F.date_format(as_column(then), "yyyy-MM-dd"))
    )


def age_bucket(then: Column | str, today: Column | str) -> Column:
    day, now = F.to_date(as_column(then)), F.to_date(as_column(today))
    return F.when(day >= now, "Today").when(day >= F.date_sub(now, 1), "Yesterday").when(day >= F.date_sub(now, 7), "Last 7 Days").otherwise("Older")


def pdf_date(text: Column | str) -> Column:
    """A PDF's date: with or without D: and parentheses, in one of four layouts; null if none fits."""
    bare = F.regexp_replace(F.regexp_replace(as_column(text), r"^[()]+|[()]+$", ""), "^D:", "")
    zoned = F.regexp_replace(bare, r"([+-]\d\d)'(\d\d)'$", "$1:$2")
    tries = [
        F.when(bare.rlike(r"^\d{14}[+-]\d\d'\d\d'$"), F.try_to_timestamp(zoned, F.lit("yyyyMMddHHmmssxxx"))),
        F.when(bare.rlike(r"^\d{14}$"), F.try_to_timestamp(bare, F.lit("yyyyMMddHHmmss"))),
        F.when(bare.rlike(r"^\d{8}$"), F.try_to_timestamp(bare, F.lit("yyyyMMdd"))),
        F.when(bare.rlike(r"^\d{4}-\d\d-\d\dT"), bare.try_cast("timestamp")),
    ]
    return F.coalesce(*tries)


def stored_time(text: Column | str) -> Column:
    """A stored timestamp in any of the layouts that the store writes."""
    t = as_column(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), t.try_cast("timestamp"))


def page_of_image(name: Column | str) -> Column:
    """The first page number in a name like page_3_img_1.png; 1 without one."""
    return F.coalesce(F.regexp_extract(as_column(name), r"page_(\d+)", 1).try_cast("int"), F.lit(1))
