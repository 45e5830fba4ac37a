"""Log lines: a format of typed fields compiled to Columns, and the expressions that parse, validate and key a line."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
#: The domain pattern and the other patterns of the default format, as configured; fields that a format must
#: have and must not have; and the strptime codes that are translated.
DOMAIN = r"^(?=.{1,253}$)((?!-)[A-Za-z0-9-]{1,63}(?<!-)\.)+[A-Za-z]{2,63}$"
SIZE, TIMESTAMP = r"^\d+b$", "%Y-%m-%dT%H:%M:%S.%fZ"
REQUIRED = ("timestamp", "status_code", "client_ip", "record_type", "domain_name")
FORBIDDEN = ("logline_id", "batch_id")
CODES = {"%Y": "yyyy", "%m": "M", "%b": "MMM", "%B": "MMMM", "%d": "d", "%j": "D", "%H": "H", "%I": "h", "%p": "a", "%M": "m", "%S": "s", "%f": "SSSSSS"}


def _ipv6_pattern() -> str:
    """Eight groups of up to four hex digits, of which :: may stand for one or more zero groups; the last two may be an
    IPv4 address; a zone may follow."""
    group = "[0-9A-Fa-f]{1,4}"
    last = f"(?:{group}:{group}|{IPV4})"
    forms = [f"(?:{group}:){{6}}{last}"]
    for after in range(6):  # groups between :: and the last two
        most = 4 - after
        before = "" if most < 0 else f"(?:(?:{group}:){{0,{most}}}{group})?"
        forms.append(f"{before}::(?:{group}:){{{after}}}{last}")
    forms += [f"(?:(?:{group}:){{0,5}}{group})?::{group}", f"(?:(?:{group}:){{0,6}}{group})?::"]
    return f"(?:{'|'.join(forms)})(?:%[^%/]+)?"


IPV6 = _ipv6_pattern()


def timestamp_pattern(strptime: str) -> str:
    """Spark's pattern for a strptime format; letters outside codes are quoted."""
    out = []
    for part in re.split("(%[a-zA-Z])", strptime):
        if part in CODES:
            out.append(CODES[part])
        elif part.startswith("%"):
            raise ValueError(f"unknown timestamp code {part}")
        else:
            out.append(re.sub("([A-Za-z]+)", r"'\1'", part))
    return "".join(out)


def micros(value: Column, strptime: str) -> Column:
    """Microseconds since 1970 of a wall-clock time in the format, null where it isn't one."""
    wall = F.try_to_timestamp(value, F.lit(timestamp_pattern(strptime))).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), wall)


def is_timestamp(value: Column, strptime: str) -> Column:
    return F.try_to_timestamp(value, F.lit(timestamp_pattern(strptime))).isNotNull()


def is_ipv4(value: Column) -> Column:
    return value.rlike(f"^{IPV4}$")


def is_ip(value: Column, ipv6: bool = True) -> Column:
    """IPv4 or IPv6, by patterns; the long one is tried only where there is a colon."""
    return F.when(value.contains(":"), value.rlike(f"^{IPV6}$")).otherwise(is_ipv4(value)) if ipv6 else is_ipv4(value)


def matches(value: Column, pattern: str) -> Column:
    """Anchored at the start only, as a match from the first character on."""
    return value.rlike(f"^(?:{pattern})")


@dataclass(frozen=True)
class Field:
    """One field of a line. kind: timestamp (arg: strptime format), regex (pattern), ip, ipv4 (IPv4 only), list (allowed; relevant)."""

    name: str
    kind: str
    arg: object = None
    relevant: tuple = ()

    def valid(self, value: Column) -> Column:
        if self.kind == "timestamp":
            return is_timestamp(value, self.arg)
        if self.kind == "regex":
            return matches(value, self.arg)
        if self.kind in ("ip", "ipv4"):
            return is_ip(value, ipv6=self.kind == "ip")
        return value.isin(*self.arg)


@dataclass(frozen=True)
class LineFormat:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError("field names repeat")
        if missing := [n for n in REQUIRED if n not in names]:
            raise ValueError(f"fields are missing: {missing}")
        if bad := [n for n in FORBIDDEN if n in names]:
            raise ValueError(f"fields are not allowed: {bad}")
        for f in self.fields:
            if f.kind not in ("timestamp", "regex", "ip", "ipv4", "list"):
                raise ValueError(f"unknown kind {f.kind}")
            if (f.arg is None) != (f.kind in ("ip", "ipv4")):
                raise ValueError(f"{f.name}: wrong number of arguments")
            if f.kind == "list" and not set(f.relevant) <= set(f.arg):
                raise ValueError(f"{f.name}: relevant values must be allowed ones")

    def split(self, lines: DataFrame, value: str = "value") -> DataFrame:
        """Adds the fields, absent where their number is wrong, and n_fields.

        The parts come out of a generator, so that no later filter is pushed below the split and repeats it for each test.
        """
        text = F.trim(F.coalesce(F.col(value), F.lit("")))
        parts = lines.select("*", F.explode(F.array(F.split(text, r"\s+"))).alias("__parts"))
        count = F.when(F.get("__parts", F.lit(0)) == "", 0).otherwise(F.size("__parts"))
        right = F.size("__parts") == len(self.fields)
        fields = {f.name: F.when(right, F.get("__parts", F.lit(i))) for i, f in enumerate(self.fields)}
        return parts.withColumns({"n_fields": count, **fields}).drop("__parts")

    def tests(self) -> dict[str, Column]:
        """Whether each field is there and passes."""
        return {f.name: F.coalesce(f.valid(F.col(f.name)), F.lit(False)) for f in self.fields}

    def parse(self, lines: DataFrame, value: str = "value") -> DataFrame:
        """Adds the fields, n_fields and invalid_fields (names in order; all are absent where the count is wrong)."""
        bad = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in self.tests().items())))
        found = F.when(F.col("n_fields") == len(self.fields), bad).otherwise(F.array(F.lit("field_count")))
        return self.split(lines, value).withColumn("invalid_fields", found)

    def valid(self, lines: DataFrame, value: str = "value") -> DataFrame:
        """The lines that parse has no invalid field for, with their fields; a line's tests end at the first that fails."""
        ok = F.col("n_fields") == len(self.fields)
        for test in self.tests().values():
            ok = ok & test
        return self.split(lines, value).where(ok).drop("n_fields")

    def failed(self, lines: DataFrame, value: str = "value") -> DataFrame:
        """The other lines, with invalid_fields."""
        return self.parse(lines, value).where(F.size("invalid_fields") > 0)

    def relevant(self) -> Column:
        """Every list field with relevant values has one of them."""
        tests = [F.col(f.name).isin(*f.relevant) for f in self.fields if f.kind == "list" and f.relevant]
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def default_format(ip: str = "ip") -> LineFormat:
    """Eight fields; ip="ipv4" for logs without IPv6."""
    return LineFormat(
        (
            Field("timestamp", "timestamp", TIMESTAMP),
            Field("status_code", "list", ("NOERROR", "NXDOMAIN"), ("NXDOMAIN",)),
            Field("client_ip", ip),
            Field("dns_server_ip", ip),
            Field("domain_name", "regex", DOMAIN),
            Field("record_type", "list", ("A", "AAAA")),
            Field("response_ip", ip),
            Field("size", "regex", SIZE),
        )
    )


DEFAULT = default_format()


def _once(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _network4(ip: Column, prefix: int) -> Column:
    """Whole octets of the prefix stay as they are written; at most one octet is masked."""
    whole, bits = divmod(prefix, 8)
    parts = [F.substring_index(ip, ".", whole)] if whole else []
    if bits:
        octet = F.split_part(ip, F.lit("."), F.lit(whole + 1)).cast("int")
        parts.append(octet.bitwiseAND((0xFF << (8 - bits)) & 0xFF).cast("string"))
    zeros = [F.lit("0")] * (4 - whole - bool(bits))
    text = F.concat(*(c for part in [*parts, *zeros] for c in (F.lit("."), part)))
    return F.when(ip.isNull(), "").otherwise(F.substr(text, F.lit(2)))


def _groups(ip: Column) -> Column:
    """The eight numbers of a valid IPv6 address."""
    number = lambda x: F.conv(x, 16, 10).cast("int")
    some = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def hexadecimal(plain: Column) -> Column:
        octet = F.split(F.element_at(F.split(plain, ":"), -1), r"\.")
        two = F.concat_ws(":", *(F.hex(octet[i].cast("int") * 256 + octet[i + 1].cast("int")) for i in (0, 2)))
        return F.when(plain.contains("."), F.concat(F.regexp_replace(plain, "[^:]*$", ""), two)).otherwise(plain)

    def filled(plain: Column) -> Column:
        head, tail = some(F.split_part(plain, F.lit("::"), F.lit(1))), some(F.split_part(plain, F.lit("::"), F.lit(2)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
        return F.transform(F.concat(head, zeros, tail), number)

    return _once(_once(F.regexp_replace(ip, "%.*$", ""), hexadecimal), filled)


def _network6(ip: Column, prefix: int) -> Column:
    """Masked and written the usual way: lower case, the first longest run of two or more zero groups as ::."""
    masks = F.array(*(F.lit((0xFFFF << (16 - min(16, max(0, prefix - 16 * k)))) & 0xFFFF) for k in range(8)))
    kept = F.zip_with(_groups(ip), masks, lambda g, m: g.bitwiseAND(m))

    def shortened(text: Column) -> Column:
        short = text
        for n in range(2, 9):
            run = rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
            short = F.when(text.rlike(run), F.regexp_replace(F.regexp_replace(text, run, "$1::$2"), ":{3,}", "::")).otherwise(short)
        return short

    def written(kept: Column) -> Column:
        low = [F.element_at(kept, k) for k in (7, 8)]
        dotted = F.concat_ws(".", *(F.shiftright(x, n).bitwiseAND(255).cast("string") for x in low for n in (8, 0)))
        text = F.array_join(F.transform(kept, lambda g: F.lower(F.hex(g))), ":")
        return _once(text, lambda t: F.when(t.startswith("0:0:0:0:0:ffff:"), F.concat(F.lit("::ffff:"), dotted)).otherwise(shortened(t)))

    return _once(kept, written)


def network(ip: Column, prefix4: int = 24, prefix6: int = 64, ipv6: bool = True) -> Column:
    """The network address by masking; the longer expression for IPv6 is taken only where there is a colon."""
    if not 0 <= prefix4 <= 32 or not 0 <= prefix6 <= 128:
        raise ValueError("prefix lengths are 0 to 32 and 0 to 128")
    four = _network4(ip, prefix4)
    return F.when(ip.contains(":"), _network6(ip, prefix6)).otherwise(four) if ipv6 else four


def subnet_id(ip: Column, prefix4: int = 24, prefix6: int = 64, ipv6: bool = True) -> Column:
    size = F.when(ip.contains(":"), F.lit(str(prefix6))).otherwise(str(prefix4))
    return F.concat_ws("_", network(ip, prefix4, prefix6, ipv6), size)


def size_bytes(size: Column) -> Column:
    return F.replace(size, F.lit("b"), F.lit("")).cast("int")
