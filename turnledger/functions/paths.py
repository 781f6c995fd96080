"""Working-directory expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnledger import constants as K


def normalise_cwd(cwd: Column) -> Column:
    """Drive-letter and UNC paths get forward slashes; empty becomes NULL."""
    windows = cwd.rlike(r"^\p{L}:") | cwd.startswith("\\\\")
    return F.nullif(F.when(windows, F.translate(cwd, "\\", "/")).otherwise(cwd), F.lit(""))


def basename(cwd: Column) -> Column:
    return F.when(cwd.isNull() | (cwd == ""), F.lit(K.EMPTY_LABEL)).otherwise(F.element_at(F.split(cwd, "/"), -1))


def encode_cwd(cwd: Column) -> Column:
    """URL-safe base64 without padding (line breaks of long values removed)."""
    packed = F.regexp_replace(F.base64(F.encode(cwd, "UTF-8")), r"[\r\n=]", "")
    return F.translate(packed, "+/", "-_")


def decode_cwd(code: Column) -> Column:
    plain = F.translate(code, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def ancestors(cwd: Column) -> Column:
    """Every proper path prefix of cwd that ends before a slash."""
    parts = F.split(cwd, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))


def suffix(cwd: Column, segments: Column) -> Column:
    """Last segments of the path, slashes at both ends ignored."""
    parts = F.split(F.trim(cwd, F.lit("/")), "/")
    take = F.least(segments, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - take + 1, take), "/")
