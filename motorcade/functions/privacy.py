"""Masking, pseudonyms and noise as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def mask(x: Column, places: int) -> Column:
    """Rounded half to even at so many places."""
    factor = float(10**places)
    return F.rint(x * factor) / factor


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex: two nested hashes over padded keys that the driver computes."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def base32_of_hex(hexed: Column, letters: int) -> Column:
    """First letters of the base32 form of a hex string: five bits each."""
    out = []
    for i in range(letters):
        start, offset = 5 * i // 4, 5 * i % 4
        three = F.conv(F.substr(hexed, F.lit(start + 1), F.lit(3)), 16, 10).cast("int")
        out.append(F.substr(F.lit(BASE32), F.shiftright(three, 12 - 5 - offset).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def pseudonym(pid: Column, key: str) -> Column:
    """16 letters that can't be linked across keys; an empty pid or key is an error of the caller."""
    if not key:
        raise ValueError("a key is needed")
    return base32_of_hex(hmac_sha256(pid, key), 16)


def laplace(value: Column, sensitivity: float, epsilon: float, u: Column) -> Column:
    """value plus Laplace noise by inverse distribution; u is uniform in (-0.5, 0.5)."""
    if epsilon <= 0 or sensitivity < 0:
        raise ValueError("epsilon must be positive and sensitivity not negative")
    return value - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))


def uniform(secret: str, *cols: Column) -> Column:
    """Uniform in (-0.5, 0.5) from a keyed hash, the same for the same cell: repeating a query gives no second draw."""
    h = F.conv(F.substr(hmac_sha256(F.concat_ws("|", *[c.cast("string") for c in cols]), secret), F.lit(1), F.lit(12)), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48) - 0.5


#: Fixed roles by the places of latitude and longitude that they see.
PRECISE_ROLES = ("PLATFORM_ADMIN", "TENANT_ADMIN", "FLEET_MANAGER")
NEAR_ROLES = ("SAFETY_OFFICER", "FINANCE_ANALYST")
FAR_ROLES = ("PARTNER_RECIPIENT",)


def masked_position(lat: Column, lon: Column, roles: Column) -> Column:
    """(lat, lon) as a role may see it: 6 places for managers, nothing for auditors alone, 3 places for officers and
    analysts, 2 for partners, 3 for everyone else; the strongest role counts."""
    has = lambda *r: F.exists(roles, lambda x: x.isin(*r))
    only_auditor = (F.size(roles) == 1) & F.array_contains(roles, "AUDITOR")

    def at(c: Column) -> Column:
        return F.when(has(*PRECISE_ROLES), mask(c, 6)).when(only_auditor, 0.0).when(has(*NEAR_ROLES), mask(c, 3)).when(has(*FAR_ROLES), mask(c, 2)).otherwise(mask(c, 3))

    return F.struct(at(lat).alias("lat"), at(lon).alias("lon"))
