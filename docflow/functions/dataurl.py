"""Data URLs and file bytes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of a base64 data URL.
DATA_URL = r"(?s)^data:([^;]+);base64,(.+)\z"


def encode_data_url(content: Column, mime: Column | str) -> Column:
    mime = F.lit(mime) if isinstance(mime, str) else mime
    # Java's encoder breaks base64 text into lines of 76; a data URL has none.
    flat = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), flat)


def decode_data_url(url: Column) -> Column:
    """Struct (mime, content); both NULL where the text is no base64 data URL."""
    mime = F.regexp_extract(url, DATA_URL, 1)
    data = F.regexp_extract(url, DATA_URL, 2)
    ok = url.rlike(DATA_URL)
    return F.struct(F.when(ok, mime).alias("mime"), F.when(ok, F.unbase64(data)).alias("content"))


def sniff_image(content: Column) -> Column:
    """MIME type of an image by its first bytes, else NULL."""
    head = F.hex(F.substring(content, 1, 12))
    # Image signatures.
    return (F.when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
            .when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
            .when(head.startswith("47494638"), F.lit("image/gif"))
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"),
                  F.lit("image/webp"))
            .when(head.startswith("424D"), F.lit("image/bmp")))
