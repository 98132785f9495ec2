"""Column functions on keys, tokens and URLs."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that the standard table lacks.
OFFICE = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
_STANDARD = mimetypes.MimeTypes(filenames=())
#: Media types by extension, from Python's own table and none of the machine's; short forms of packed archives have their archive's.
MIME_TYPES = OFFICE | _STANDARD.types_map[True] | {short: _STANDARD.guess_type("file" + short)[0] for short in _STANDARD.suffix_map if _STANDARD.guess_type("file" + short)[0]}
#: Suffixes that say how a file is packed; the type is that of what is inside.
PACKED = tuple(_STANDARD.encodings_map)
UNKNOWN_TYPE = "application/octet-stream"


def document_hash(key: Column, length: int = 12) -> Column:
    """The first hex digits of the key's SHA-256."""
    return F.substring(F.sha2(key, 256), 1, length)


def file_extension(key: Column) -> Column:
    """The last suffix of the last path segment with its dot; empty for none, and for names that only begin with a dot."""
    return F.regexp_extract(key, r"[^/.][^/]*?(\.[^./]+)/*$", 1)


def mime_type(extension: Column) -> Column:
    """Media type of an extension, with or without dot, in any case; of ``.tar.gz`` and the like that of the archive."""
    dotted = F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))
    inside = F.regexp_replace(dotted, "(?:" + "|".join(x.replace(".", "[.]") for x in PACKED) + ")$", "")
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(inside, "[.][^.]*$", 0))), F.lit(UNKNOWN_TYPE))


def base64url_json(token: Column) -> Column:
    """The JSON object in url-safe base64, padded or not, as map<string,string>; an empty map if it is none."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


def jwt_claims(token: Column) -> Column:
    """The payload of a signed token, for analysis only: the signature is not checked.

    Text of fewer than three segments is taken as the payload itself. Null and empty tokens give null.
    """
    parts = F.split(token, "[.]", -1)
    return F.when(F.coalesce(token, F.lit("")) == "", None).otherwise(F.when(F.size(parts) < 3, base64url_json(token)).otherwise(base64url_json(F.get(parts, 1))))


def token_from_url(url: Column) -> Column:
    """The first value of query parameter ``p`` that isn't empty, decoded; null if there is none."""
    raw = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*?&)??p=([^&#]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))
