"""Predicates on urls, ids, passwords, file names and magic bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts never fetched, and file types by extension.
BLOCKED_HOSTS = (
    "localhost", "127.0.0.1", "0.0.0.0", "[::1]", "::1", "[::0]", "::0", "[::ffff:127.0.0.1]", "169.254.169.254", "metadata.google.internal", "metadata.internal",
    "instance-data", "kubernetes.default", "kubernetes.default.svc",
)
FILE_TYPES = {
    "pdf": "pdf", "doc": "word_legacy", "docx": "word", "xls": "excel_legacy", "xlsx": "excel", "ppt": "ppt_legacy", "pptx": "ppt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html",
}
PRIVATE = r"^(?:127|10)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\.|^224\.0\.0\.|^0\.0\.0\.0$|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def url_host(url: Column) -> Column:
    """Host without the port, lower-cased."""
    host = F.regexp_extract(F.lower(url), r"^https?://([^/]*)", 1)
    return F.when(host.startswith("["), F.regexp_replace(host, r"\]:.*$", "]")).otherwise(F.regexp_replace(host, r":[^:]*$", ""))


def mapped_ipv4(address: Column) -> Column:
    """The dotted form of an IPv6 address in ::ffff:0:0/96, or null."""
    dotted = F.regexp_extract(address, r"^[0:]*:ffff:([0-9.]+)$", 1)
    half = [F.lpad(F.regexp_extract(address, r"^[0:]*:ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 4, "0") for k in (1, 2)]
    parts = [F.conv(F.substring(h, at, 2), 16, 10) for h in half for at in (1, 3)]
    return F.when(dotted.rlike(IPV4), dotted).when(address.rlike(r"^[0:]*:ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.concat_ws(".", *parts))


def valid_ipv6(address: Column) -> Column:
    """Eight groups of up to four hexadecimal digits, the last two perhaps dotted, or fewer around one ::."""
    tail = F.regexp_extract(address, r":([0-9]+\.[0-9.]*)$", 1)
    groups = F.filter(F.split(F.regexp_replace(address, r"[0-9]+\.[0-9.]*$", "0:0"), ":", -1), lambda x: x != "")
    short = F.size(F.split(address, "::", -1)) - 1
    ok = F.forall(groups, lambda x: x.rlike("^[0-9a-f]{1,4}$")) & ~address.rlike(":::|^:[^:]|[^:]:$") & ((tail == "") | tail.rlike(IPV4))
    return ok & (((short == 1) & (F.size(groups) <= 7)) | ((short == 0) & (F.size(groups) == 8)))


def internal_address(host: Column) -> Column:
    """Whether a host is an address that is loopback, private, link-local, unspecified or of a carrier's own network."""
    v6 = F.regexp_replace(host, r"^\[+|\]+$", "")
    six = valid_ipv6(v6) & (v6.rlike("^[0:]+$|^[0:]*:0{0,3}1$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^ff[0-9a-f]2:") | F.coalesce(mapped_ipv4(v6).rlike(PRIVATE), F.lit(False)))
    return (host.rlike(IPV4) & host.rlike(PRIVATE)) | (host.startswith("[") & six)


def fetchable(url: Column) -> Column:
    """Whether a url may be fetched: http(s), no credentials, no internal host or network."""
    host = url_host(url)
    ok = F.lower(url).rlike("^https?://") & ~url.contains("@") & (host != "") & ~host.isin(*BLOCKED_HOSTS) & ~host.rlike(r"\.(?:internal|local)$") & ~internal_address(host)
    return F.coalesce(ok, F.lit(False))


def file_type(path: Column) -> Column:
    """Type by extension, or null."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))
    return table[extension]


def base_type(kind: Column) -> Column:
    return F.regexp_replace(kind, "_legacy$", "")


def looks_like_html(text: Column) -> Column:
    """Whether one of the usual first tags is among the first 512 characters."""
    head = F.lower(F.substring(text, 1, 512))
    return head.contains("<!doctype html") | head.contains("<html") | head.contains("<head") | head.contains("<body")


def hex_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{32}$"), F.lit(False))


def optional_hex_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{0,64}$"), F.lit(True))


def valid_password(value: Column) -> Column:
    n = F.octet_length(value)
    return F.coalesce((n >= 8) & (n <= 72) & value.rlike("[A-Za-z]") & value.rlike("[0-9]"), F.lit(False))


def image_magic(data: Column) -> Column:
    """jpeg, png or null, by the first bytes."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png")


def video_magic(data: Column) -> Column:
    """mp4, avi, mkv or null, by the first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.substr(9, 8) == "66747970", "mp4").when(head.startswith("52494646") & (head.substr(17, 8) == "41564920"), "avi").when(head.startswith("1A45DFA3"), "mkv")


def like_any_case(value: Column, part: str) -> Column:
    """Contains part, letters in either case; % and _ in part stay wildcards."""
    return F.coalesce(value, F.lit("")).ilike(f"%{part}%")
