"""Scalar functions as Column expressions; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, from bytes to exbibytes.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
SHORT_UNITS = ("B", "K", "M", "G", "T", "P", "E")
DAY = 86_400
MAX_INT = (1 << 63) - 1


def content_id(data: Column) -> Column:
    """Identity of bytes or text: lower-case hex MD5."""
    return F.md5(data.cast("binary"))


def hex64(n: Column) -> Column:
    """A 64-bit integer as 16 lower-case hex digits, big-endian, two's complement."""
    return F.lower(F.lpad(F.hex(n.cast("long")), 16, "0"))


def hex32(n: Column) -> Column:
    """An unsigned 32-bit integer as 8 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(n.cast("long")), 8, "0"))


def int64_of_hex(h: Column) -> Column:
    """Up to 16 hex digits as a signed 64-bit integer."""
    return F.conv(h, 16, -10).cast("long")


def block_id(links: Column, data: Column) -> Column:
    """Identity of a block: MD5 over link count, links, length and uncompressed data.

    links is an array of 32-digit hex ids; the way the data is stored is not part of the identity.
    """
    raw = data.cast("binary")
    head = F.concat(hex32(F.size(links)), F.array_join(links, ""), hex32(F.length(raw)))
    return F.md5(F.concat(F.unhex(head), raw))


def verify_block(id_: Column, links: Column, data: Column) -> Column:
    return F.coalesce(id_ == block_id(links, data), F.lit(False))


def _scaled(size: Column, units: tuple[str, ...]) -> tuple[Column, Column]:
    """The size divided by 1024 for as long as it is above 1000, and how often that was."""
    value, unit = size.cast("double"), F.lit(0)
    for k in range(1, len(units)):
        # the k-th division happens when the value after k - 1 of them is still above 1000
        unit = F.when(value / float(1024 ** (k - 1)) > 1000, F.lit(k)).otherwise(unit)
    return value / F.pow(F.lit(1024.0), unit), unit


def _rounded(value: Column, digits: int) -> Column:
    """A value from 1/2 up to 100 with so many decimals, as C rounds it: by its exact binary value, ties to even."""
    # such a value's fraction is a multiple of 2^-53, so that its product with 100 fits a long
    whole = F.floor(value)
    scaled = ((value - whole) * float(1 << 53)).cast("long") * 10**digits
    below = whole * 10**digits + F.shiftright(scaled, 53)
    rest = scaled.bitwiseAND(F.lit((1 << 53) - 1))
    half = 1 << 52
    units = below + F.when((rest > half) | ((rest == half) & (below % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%d.%0{digits}d", F.floor(units / 10**digits), units % 10**digits)


def human_size(size: Column, units: tuple[str, ...] = UNITS, gap: str = " ") -> Column:
    """Sizes for people: units change above 1000 but divide by 1024; two decimals below 10, one below 100, ties to even."""
    value, unit = _scaled(size, units)
    digits = (
        F.when((unit > 0) & (value < 10), _rounded(value, 2))
        .when((unit > 0) & (value < 100), _rounded(value, 1))
        .otherwise(F.format_string("%.0f", F.bround(value, 0)))
    )
    return F.concat(digits, F.lit(gap), F.element_at(F.array(*[F.lit(u) for u in units]), unit + 1))


def short_human_size(size: Column) -> Column:
    return human_size(size, SHORT_UNITS, "")


def compact_human_size(size: Column) -> Column:
    return human_size(size, UNITS, "")


#: Letters with an upper case of one code point besides the longer one that upper() gives, and that upper case.
_SINGLE = {0xDF: 0x1E9E, **{c: c + 8 for b in (0x1F80, 0x1F90, 0x1FA0) for c in range(b, b + 8)}, 0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC}
#: Letters without one, or with one since Unicode 16 only: they stay.
_STAY = (
    r"\x{149}\x{19B}\x{1F0}\x{264}\x{390}\x{3B0}\x{587}\x{1C8A}\x{1E96}-\x{1E9A}\x{1F50}\x{1F52}\x{1F54}\x{1F56}\x{1F88}-\x{1F8F}\x{1F98}-\x{1F9F}"
    r"\x{1FA8}-\x{1FAF}\x{1FB2}\x{1FB4}\x{1FB6}\x{1FB7}\x{1FBC}\x{1FC2}\x{1FC4}\x{1FC6}\x{1FC7}\x{1FCC}\x{1FD2}\x{1FD3}\x{1FD6}\x{1FD7}"
    r"\x{1FE2}-\x{1FE4}\x{1FE6}\x{1FE7}\x{1FF2}\x{1FF4}\x{1FF6}\x{1FF7}\x{1FFC}\x{A7CD}\x{A7DB}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{10D70}-\x{10D85}"
)
_SPECIAL = "".join(rf"\x{{{c:X}}}" for c in _SINGLE) + _STAY


def simple_upper(text: Column) -> Column:
    """Upper case code point by code point, as DuckDB has it: the number of code points stays."""
    ends = "".join(map(chr, _SINGLE)), "".join(map(chr, _SINGLE.values()))
    pieces = F.regexp_extract_all(text, F.lit(f"[{_SPECIAL}]+|[^{_SPECIAL}]+"), F.lit(0))
    upper = lambda p: F.when(p.rlike(f"^[{_SPECIAL}]"), F.translate(p, *ends)).otherwise(F.upper(p))
    # most texts have nothing beyond Latin-1, which the first pattern finds faster
    return F.when(text.rlike(r"[\x{DF}\x{149}-\x{10FFFF}]") & text.rlike(f"[{_SPECIAL}]"), F.array_join(F.transform(pieces, upper), "")).otherwise(F.upper(text))


def escape_controls(text: Column) -> Column:
    r"""Control characters (below 32, and 127) as \xNN."""
    out = text
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return out


def split_path(path: Column) -> Column:
    """Segments of a path; empty ones and '.' drop out and '..' takes its parent away."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def path_order(path: Column) -> Column:
    """Sort key that puts a directory's content before its later siblings."""
    return F.translate(path, "/", "\x01")


def expand_env(pattern: str, env: dict[str, str]) -> str:
    """$NAME and ${NAME} from env (unset: empty), $$ as a dollar sign; a plan-time constant."""
    import re

    def value(m) -> str:
        name = m[1] or m[2]
        return "$" if name == "$" else env.get(name, "")

    return re.sub(r"\$(?:\{([^}]*)\}|(\$|[A-Za-z0-9_]+))", value, pattern)


def clamp_int(n: Column) -> Column:
    return F.least(n, F.lit(MAX_INT))


def state_time_ns(state_hex: Column) -> Column:
    """The time in a snapshot id: its first eight bytes, nanoseconds."""
    return int64_of_hex(F.substring(state_hex, 1, 16))


def ns_to_timestamp(ns: Column) -> Column:
    """Microsecond timestamp; the last three digits of the nanoseconds are lost."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))


def day_floor(seconds: Column) -> Column:
    return seconds - seconds % DAY


def plausible_time(ns: Column) -> Column:
    """RFC 3339 in UTC if the time is set and its year lies in 2000 to 2050, else blanks."""
    seconds = F.floor(ns / 1_000_000_000).cast("long")
    text = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    year = F.year(F.timestamp_seconds(seconds))
    return F.when((ns != 0) & year.between(2000, 2050), text).otherwise(F.lit(" " * 25))


def nice_date(ns: Column, now_ns: Column) -> Column:
    """Month, day and time; month, day and year if older than 300 days.  Days are padded to two places."""
    at = F.timestamp_seconds(F.floor(ns / 1_000_000_000).cast("long"))
    day = F.lpad(F.dayofmonth(at).cast("string"), 2, " ")
    old = (now_ns - ns) > 300 * DAY * 1_000_000_000
    return F.concat_ws(" ", F.date_format(at, "MMM"), day, F.when(old, F.concat(F.lit(" "), F.date_format(at, "yyyy"))).otherwise(F.date_format(at, "HH:mm")))


def base64_name(data: Column) -> Column:
    """URL-safe base64 without padding, as file names use it."""
    return F.rtrim(F.translate(F.base64(data.cast("binary")), "+/=\r\n", "-_"))


def parse_hash(text: Column) -> Column:
    """A 16-byte id given as 22 base64url characters or as 32 hex digits; null if it is neither."""
    as_base64 = F.when(text.rlike(r"^[A-Za-z0-9_-]{21}[AQgw]$"), F.lower(F.hex(F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.lit("=="))))))
    return F.coalesce(as_base64, F.when(text.rlike(r"^[0-9A-Fa-f]{32}$"), F.lower(text)))


def dataset_file_name(account_h: Column, dataset_h: Column) -> Column:
    return F.concat_ws(".", base64_name(account_h), base64_name(dataset_h))


def sync_id(host: Column, port: Column) -> Column:
    return F.translate(F.concat_ws("-", host, port.cast("string")), ":/", "__")


def index_slot(id_hex: Column) -> Column:
    """Byte offset of an id's home slot: 16 + 24 times the last three bytes."""
    return F.lit(16) + F.lit(24) * F.conv(F.substring(id_hex, -6, 6), 16, 10).cast("long")


def pack_location(file_no: Column, offset: Column) -> Column:
    """14-bit file number and 34-bit offset in one integer."""
    return F.shiftleft(file_no.cast("long"), 34).bitwiseOR(offset.cast("long"))


def unpack_location(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 34).cast("int"), packed.bitwiseAND(F.lit((1 << 34) - 1))


def numbered_file(file_no: Column, ext: str) -> Column:
    return F.concat(F.upper(F.lpad(F.hex(file_no.cast("long")), 8, "0")), F.lit("." + ext))


def safe_file_name(name: Column) -> Column:
    r"""The characters \ / : * ? " < > | become underscores."""
    return F.translate(name, "\\/:*?\"<>|", "_" * 9)


def percent(part: Column, whole: Column) -> Column:
    """Integer percentage; null where the whole is zero."""
    return F.when(whole != 0, F.floor(part * 100 / whole).cast("long"))


def compression_ratio(raw: Column, stored: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise((raw - stored) * 100.0 / raw)


def hexdump_line(offset: Column, data: Column) -> Column:
    """Offset, up to 16 bytes in hex with a wider gap after each eighth, and printable characters."""
    digits = F.lower(F.hex(data))
    spaced = F.regexp_replace(digits, r"([0-9a-f]{2})", r"$1 ")
    eighths = F.regexp_replace(spaced, r"((?:[0-9a-f]{2} ){8})", r"$1 ")
    shown = F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return F.concat(hex32(offset), F.lit("  "), eighths, F.lit("|"), shown, F.lit("|"))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def compare_ids(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes; lower-case hex sorts as its bytes do."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


# Bits that tell a server's message type (capital letters) from a client's (small ones).
SERVER_MASK, CLIENT_MASK = 0xDFDFDFDF, 0x20202020


def server_type(code: Column) -> Column:
    """The server's form of a message type: its four letters as capitals."""
    return code.cast("long").bitwiseAND(F.lit(SERVER_MASK))


def client_type(code: Column) -> Column:
    """The client's form of a message type: its four letters as small ones."""
    return code.cast("long").bitwiseOR(F.lit(CLIENT_MASK))


def four_letters(code: Column) -> Column:
    """The text of a type's four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "ISO-8859-1")
