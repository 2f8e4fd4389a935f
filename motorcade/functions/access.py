"""Access checks as Column expressions: signed tokens and names of client certificates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorcade.functions.privacy import hmac_sha256

#: Fixed value: the header of a token signed with HMAC-SHA256.
HEADER = '{"alg":"HS256","typ":"JWT"}'


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\s]", "")


def from_base64url(text: Column) -> Column:
    """The text that URL-safe base64 stands for; null where it isn't base64."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), F.lit("="))
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1), F.decode(F.unbase64(padded), "UTF-8"))


def token(payload: Column, key: str) -> Column:
    """A signed token of a JSON payload."""
    body = F.concat(base64url(F.lit(HEADER).cast("binary")), F.lit("."), base64url(payload.cast("binary")))
    return F.concat(body, F.lit("."), base64url(F.unhex(hmac_sha256(body, key))))


def claims(token: Column, key: str, now_s: Column) -> Column:
    """(verdict, sub) of a token: MALFORMED, BAD_ALGORITHM, BAD_SIGNATURE, EXPIRED or OK, and the subject where it is OK."""
    parts = F.split(token, "\\.", -1)
    body = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    header, payload = (from_base64url(F.get(parts, F.lit(i))) for i in (0, 1))
    signed = F.get(parts, F.lit(2)) == base64url(F.unhex(hmac_sha256(body, key)))
    expires = F.get_json_object(payload, "$.exp").try_cast("bigint")
    verdict = (
        F.when(F.size(parts) != 3, "MALFORMED")
        .when(~F.coalesce(F.get_json_object(header, "$.alg") == "HS256", F.lit(False)), "BAD_ALGORITHM")
        .when(~F.coalesce(signed, F.lit(False)), "BAD_SIGNATURE")
        .when(F.coalesce(expires <= now_s, F.lit(True)), "EXPIRED")
        .otherwise("OK")
    )
    return F.struct(verdict.alias("verdict"), F.when(verdict == "OK", F.get_json_object(payload, "$.sub")).alias("sub"))


def common_name(subject: Column) -> Column:
    """CN of a distinguished name such as `CN=gateway-1, O=x`; null where there is none."""
    found = F.regexp_extract(subject, r"(?i)(?:^|,)\s*CN=([^,]*)", 1)
    return F.when(found != "", F.trim(found))


def listed(subject: Column, names: list[str]) -> Column:
    """Whether a certificate's common name is on the list."""
    return F.coalesce(common_name(subject).isin(names), F.lit(False))
