"""URL functions as Column expressions: canonical forms, file kinds, stable ids, link building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that tell pages apart, path and address patterns that are no content, media extensions.
PAGE_KEYS = ("start", "limitstart", "view", "id", "Itemid")
NO_CONTENT = r"(?i)/search|/carian|/login|/logout|/warga-arkib|format=|tmpl=|task="
BINARY = r"(?i)\.(?:jpg|jpeg|png|zip|docx?|xlsx?|pptx?|mp[34]|css|js)$"
MEDIA = r"(?i)\.(?:pdf|epub|mobi|azw3?|djvu|jpe?g|png|webp|gif|tiff?|bmp|svg|docx?|xlsx?|pptx?|zip|rar|7z|mp3|mp4|m4a|wav|ogg|webm)$"
EXTENSION_OF = {
    "application/pdf": ".pdf", "application/epub+zip": ".epub", "image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/tiff": ".tif",
    "image/svg+xml": ".svg", "audio/mpeg": ".mp3", "audio/mp4": ".m4a", "video/mp4": ".mp4", "application/zip": ".zip",
}
CATEGORIES = [("pdf|epub|mobi|azw|djvu", "ebook / dokumen"), ("jpg|jpeg|png|webp|gif|tif|bmp|svg", "imej"), ("mp3|m4a|wav|ogg", "audio"), ("mp4|webm", "video")]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(\?[^#]*)?"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _PARTS, 2)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    """The query without its question mark, empty if there is none."""
    return F.substring(F.regexp_extract(url, _PARTS, 3), 2, 1 << 30)


def page_url(url: Column, keys: tuple[str, ...] = PAGE_KEYS) -> Column:
    """Without fragment and with the query keys that tell pages apart only; null if it is no absolute address."""
    kept = F.filter(F.split(query(url), "&"), lambda p: F.substring_index(p, "=", 1).isin(*keys))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike(_PARTS), F.concat(origin(url), path(url), rest))


def is_page(url: Column, host: Column, prefix: str, deny: str = NO_CONTENT) -> Column:
    """Of that origin, below the prefix or a PDF, and neither a tool page nor a binary file."""
    place = path(url)
    return (origin(url) == host) & (place.startswith(prefix) | place.rlike(r"(?i)\.pdf$")) & ~url.rlike(deny) & ~place.rlike(BINARY)


def media_url(url: Column) -> Column:
    """Without fragment; files also lose their query."""
    rest = F.when(path(url).rlike(MEDIA), "").otherwise(F.regexp_extract(url, _PARTS, 3))
    return F.when(url.rlike(_PARTS), F.concat(origin(url), path(url), rest))


def bare_url(url: Column) -> Column:
    """Without fragment and query."""
    return F.when(url.rlike(_PARTS), F.concat(origin(url), path(url)))


def resolve(link: Column, base: Column) -> Column:
    """An absolute address of a link on a page: absolute, protocol-relative, root-relative, query, fragment or relative links."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin(base), link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(origin(base), path(base), link))
        .otherwise(F.concat(origin(base), folder, link))
    )


def extension(url: Column, mime: Column) -> Column:
    """Of the path, else of the MIME type, else .bin"""
    by_mime = F.create_map(*[F.lit(x) for pair in EXTENSION_OF.items() for x in pair])[mime]
    own = F.lower(F.regexp_extract(path(url), r"(\.[^./]+)$", 1))
    return F.coalesce(F.nullif(own, F.lit("")), by_mime, F.lit(".bin"))


def category(ext: Column) -> Column:
    out = F.lit("fail")
    for pattern, name in reversed(CATEGORIES):
        out = F.when(ext.rlike(pattern), name).otherwise(out)
    return out


def document_id(url: Column, page: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of address and page number."""
    return F.substring(F.sha2(F.concat(url, F.coalesce(page.cast("string"), F.lit(""))), 256), 1, 16)


def asset_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def last_segment(url: Column) -> Column:
    """The path's last part, percent-decoded; a plus sign stays."""
    return F.try_url_decode(F.replace(F.element_at(F.split(path(url), "/"), -1), F.lit("+"), F.lit("%2B")))


def safe_filename(name: Column) -> Column:
    return name.rlike(r"(?i)^[a-f0-9]{24}\.[a-z0-9]+$")


def disposition(mime: Column) -> Column:
    """How a stored file may be served."""
    return F.when(mime.rlike("(?i)html|svg|xml|javascript"), "sandbox").when(mime == "application/pdf", "attachment").otherwise("inline")


def local_link(document: Column, kind: Column, asset: Column, page: Column) -> Column:
    """Address of the local copy: documents always, PDF pages only where their file is stored (asset not null)."""
    at = F.when(page.isNotNull() & (page != 0), F.concat(F.lit("#page="), page.cast("string"))).otherwise("")
    return F.when(kind != "pdf", F.concat(F.lit("/api/archive/document/"), F.url_encode(document))).when(asset.isNotNull(), F.concat(F.lit("/api/archive/media/"), asset, at))
