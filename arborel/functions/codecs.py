"""Text forms of bytes: hex, base64 and UTF-8 as expressions; address codecs, which need checksums, as pandas UDFs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    return F.when(s.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(s)).otherwise(F.raise_error(F.concat(F.lit("no hex: "), s)).cast("binary"))


def to_base64(b: Column) -> Column:
    """Standard alphabet, padded, in one line."""
    return F.regexp_replace(F.base64(b), r"\s", "")


def from_base64(s: Column) -> Column:
    return F.unbase64(s)


def to_utf8(b: Column) -> Column:
    """Bytes as text; invalid ones are an error."""
    return F.validate_utf8(b.cast("string"))


def from_utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def timestamp_text(seconds: Column) -> Column:
    """Seconds since 1970 in UTC, whatever the session's time zone. Years of five digits have no sign before them."""
    rest = F.pmod(seconds, F.lit(86400))
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(((seconds - rest) / 86400).cast("int"), F.lit(0), F.lit(0), rest)
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), r"^\+", "")


def short_hash(b: Column) -> Column:
    return F.lower(F.hex(F.substring(b, 1, 6)))


# The alphabets of the two text forms.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# Version bytes of pay-to-key-hash and pay-to-script-hash addresses, and the readable prefix of segwit ones.
SEGWIT, OP_RETURN, OTHER = 0xB0, 0xF0, 0xFF  # tags of stored addresses
CHAINS = {"btc": (0x00, 0x05, "bc"), "ltc": (0x30, 0x32, "ltc"), "bch": (0x00, 0x05, None)}
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_SUM, BECH32M_SUM = 1, 0x2BC830A3


class AddressError(ValueError):
    """Text or bytes are no address."""


def base58_encode(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def base58_decode(text: str) -> bytes:
    n = 0
    for c in text:
        if (i := BASE58.find(c)) < 0:
            raise AddressError(f"{c!r} is no base58")
        n = n * 58 + i
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def double_sha(data: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def base58check_encode(payload: bytes) -> str:
    return base58_encode(payload + double_sha(payload)[:4])


def base58check_decode(text: str) -> bytes:
    data = base58_decode(text)
    if len(data) < 5 or double_sha(data[:-4])[:4] != data[-4:]:
        raise AddressError(f"wrong checksum in {text}")
    return data[:-4]


def polymod(values) -> int:
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check


def expanded(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def regrouped(data, of: int, to: int, pad: bool) -> list[int]:
    acc = bits = 0
    out = []
    for v in data:
        acc, bits = acc << of | v, bits + of
        while bits >= to:
            bits -= to
            out.append(acc >> bits & (1 << to) - 1)
    if pad and bits:
        out.append(acc << to - bits & (1 << to) - 1)
    elif not pad and (bits >= of or acc << to - bits & (1 << to) - 1):
        raise AddressError("padding of the last group")
    return out


def segwit_encode(prefix: str, version: int, program: bytes) -> str:
    data = [version, *regrouped(program, 8, 5, True)]
    target = BECH32M_SUM if version else BECH32_SUM
    check = polymod([*expanded(prefix), *data, 0, 0, 0, 0, 0, 0]) ^ target
    return prefix + "1" + "".join(BECH32[d] for d in [*data, *(check >> 5 * (5 - i) & 31 for i in range(6))])


def segwit_decode(prefix: str, text: str) -> tuple[int, bytes]:
    if text != text.lower() and text != text.upper():
        raise AddressError("mixed case")
    head, _, tail = text.lower().rpartition("1")
    if head != prefix or len(tail) < 7 or any(c not in BECH32 for c in tail):
        raise AddressError(f"{text} is no address of {prefix}")
    data = [BECH32.index(c) for c in tail]
    if polymod([*expanded(head), *data]) != (BECH32M_SUM if data[0] else BECH32_SUM):
        raise AddressError(f"wrong checksum in {text}")
    program = bytes(regrouped(data[1:-6], 5, 8, False))
    if data[0] > 16 or not (len(program) in (20, 32) if data[0] == 0 else 2 <= len(program) <= 40):
        raise AddressError(f"wrong program in {text}")
    return data[0], program


def address_text(chain: str, data: bytes) -> str:
    """Stored bytes to text: 21 bytes are a version byte and a hash; 22 and 34 the tag B0, a segwit version and its program."""
    key, script, prefix = CHAINS[chain]
    if len(data) == 21 and data[0] in (key, script):
        return base58check_encode(data)
    if prefix and len(data) in (22, 34) and data[0] == SEGWIT and data[1] <= 16:
        return segwit_encode(prefix, data[1], data[2:])
    raise AddressError(f"{len(data)} bytes are no {chain} address")


def address_bytes(chain: str, text: str) -> bytes:
    key, script, prefix = CHAINS[chain]
    if prefix and text.lower().startswith(prefix + "1"):
        version, program = segwit_decode(prefix, text)
        return bytes([SEGWIT, version]) + program
    data = base58check_decode(text)
    if len(data) != 21 or data[0] not in (key, script):
        raise AddressError(f"{text} has no version of {chain}")
    return data


def ergo_text(data: bytes) -> str:
    return "EMPTY" if not data else base58_encode(data)


def ergo_bytes(text: str) -> bytes:
    return b"" if text == "EMPTY" else base58_decode(text)


def _udf(function, kind: str):
    @pandas_udf(kind)
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else function(x))

    return convert


def encode_address(chain: str):
    """Pandas UDF from stored bytes to an address's text."""
    return _udf(ergo_text if chain == "ergo" else lambda b: address_text(chain, bytes(b)), "string")


def decode_address(chain: str):
    return _udf(ergo_bytes if chain == "ergo" else lambda s: address_bytes(chain, s), "binary")


def script_address(script: Column, chain: str = "btc") -> Column:
    """Address bytes of an output script, by its form: a version byte and a key or script hash; B0, version and program of segwit; a tag byte for
    OP_RETURN (F0) and for all others (FF)."""
    key, other, _ = CHAINS[chain]
    h, n = F.hex(script), F.length(script)
    byte = lambda b: F.lit(bytes([b]))
    part = lambda a, k: F.substring(script, a, k)
    out = F.when((n == 25) & h.startswith("76A914") & h.endswith("88AC"), F.concat(byte(key), part(4, 20)))
    out = out.when((n == 23) & h.startswith("A914") & h.endswith("87"), F.concat(byte(other), part(3, 20)))
    if chain != "bch":
        out = out.when(((n == 22) & h.startswith("0014")) | ((n == 34) & h.startswith("0020")), F.concat(byte(SEGWIT), byte(0), F.substring(script, 3, 40)))
        for v in range(1, 17):
            out = out.when((n == 34) & h.startswith(f"{0x50 + v:02X}20"), F.concat(byte(SEGWIT), byte(v), part(3, 32)))
    return out.when(h.startswith("6A"), byte(OP_RETURN)).otherwise(byte(OTHER))


MINT, TRANSFER, BURN = 0, 1, 2


def asset_action_signed(minted: Column) -> Column:
    """Of an amount minted (above 0), burnt (below 0) or moved (0 or null)."""
    return F.when(minted > 0, MINT).when(minted < 0, BURN).otherwise(TRANSFER)


def asset_action_flows(inputs: Column, outputs: Column) -> Column:
    """Of an asset's amounts going in and coming out of a transaction: nothing in is a mint, more in than out a burn."""
    return F.when(F.coalesce(inputs, F.lit(0)) == 0, MINT).when(inputs > F.coalesce(outputs, F.lit(0)), BURN).otherwise(TRANSFER)


def key_bucket(key: int, buckets: int) -> int:
    return key % buckets


def cache_shares(total: int, weights: dict[str, int]) -> dict[str, int]:
    """Whole parts of total by weight; what rounding leaves goes to the largest remainders, then by name."""
    whole = sum(weights.values())
    if not whole:
        return dict.fromkeys(weights, 0)
    out = {k: total * w // whole for k, w in weights.items()}
    left = total - sum(out.values())
    for k in sorted(weights, key=lambda k: (-(total * weights[k] % whole), k))[:left]:
        out[k] += 1
    return out
