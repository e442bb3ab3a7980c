"""Path, id, glob and URL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsift import constants as K


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(name: Column) -> Column:
    """Extension with its dot; empty for `.gitignore` and for names without a dot."""
    return F.regexp_extract(basename(name), r"^.+(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"^(.+)\.[^.]*$", "$1")


def relative_to(path: Column, root: str) -> Column:
    """Path below `root`, without a leading slash."""
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/?", "")


def folder_of(path: Column, root: str) -> Column:
    """Directory of a file relative to `root`; empty for files directly in it."""
    rel = relative_to(path, root)
    return F.when(rel.contains("/"), dirname(rel)).otherwise(F.lit(""))


def last_segment(path: Column) -> Column:
    """Last segment of a Unix or Windows path, trailing separators ignored."""
    return F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1)


def image_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def cache_key(path: Column, mtime_ms: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, mtime_ms.cast("string")), 256), 1, 32)


def is_raw(path: Column) -> Column:
    return F.lower(extension(path)).isin(*K.RAW_EXTENSIONS)


def is_supported(path: Column) -> Column:
    return F.lower(extension(path)).isin(*K.SUPPORTED_EXTENSIONS)


def sidecar_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".xmp"))


def thumbnail_path(asset_id: Column) -> Column:
    return F.concat(F.lit("thumbnails/"), asset_id, F.lit(".jpg"))


def _char_class(piece: str) -> str:
    """A glob class for Java: an empty one matches nothing, `[^]` anything; `[` and `&` are literal."""
    if piece in ("[]", "[^]"):
        return "(?!)" if piece == "[]" else r"[\s\S]"
    return "[" + piece[1:-1].replace("[", r"\[").replace("&", r"\&") + "]"


def glob_to_regex(pattern: str) -> str:
    """Regular expression of one ignore glob.

    `**` crosses directories, `*` and `?` do not, `[...]` is a class. A pattern with a slash
    must match the whole relative path, any other the last segment. Case never matters.
    """
    text = pattern.replace("\\", "/").strip()
    token = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|(?P<cls>\[[^\]]*\])|(?P<lit>.)", re.S)
    parts = []
    for m in token.finditer(text):
        kind, piece = m.lastgroup, m.group()
        if kind == "deep":
            parts.append(".*")
        elif kind == "star":
            parts.append("[^/]*")
        elif kind == "one":
            parts.append("[^/]")
        elif kind == "cls":
            parts.append(_char_class(piece))
        else:
            parts.append("\\" + piece if piece in ".+^${}()|[\\" else piece)
    body = "".join(parts)
    return f"(?iu)^{body}$" if "/" in text else f"(?iu)(?:^|/){body}$"


def ignore_regex(patterns: list[str]) -> str:
    """All patterns as one alternation, so that a row is tested once."""
    return "|".join(f"(?:{glob_to_regex(p)})" for p in patterns)


def ignore_patterns(text: Column) -> Column:
    """Lines of an ignore file: trimmed, blank lines and `#` comments dropped."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def folder_relationship(source: Column, target: Column) -> Column:
    """How two folders relate: same, output-inside-input, input-inside-output or ok."""

    def norm(c):
        return F.regexp_replace(F.lower(c), r"[/\\]+$", "")

    a, b = norm(source), norm(target)
    empty = F.coalesce(source, F.lit("")).eqNullSafe("") | F.coalesce(target, F.lit("")).eqNullSafe("")
    return (
        F.when(empty, "ok")
        .when(a == b, "same")
        .when(F.startswith(b, F.concat(a, F.lit("/"))), "output-inside-input")
        .when(F.startswith(a, F.concat(b, F.lit("/"))), "input-inside-output")
        .otherwise("ok")
    )


def uri_component(segment: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) alone."""
    out = F.url_encode(segment)
    # url_encode is form encoding: put back what it encodes beyond the set above.
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def file_url(path: Column) -> Column:
    """`file:///` URL with every segment encoded and a drive letter kept."""
    parts = F.transform(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        lambda s: F.when(s.rlike(r"^[A-Za-z]:$"), s).otherwise(uri_component(s)),
    )
    return F.concat(F.lit("file:///"), F.regexp_replace(F.array_join(parts, "/"), "^/", ""))


def normalise_base_url(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    return F.when(bare.rlike(r"/v\d+$"), bare).otherwise(F.concat(bare, F.lit("/v1")))


def distinct_tokens(text: Column) -> Column:
    """Comma or space separated tokens without blanks, first occurrence kept."""
    return F.array_distinct(F.filter(F.split(text, r"[,\s]+"), lambda t: t != ""))
