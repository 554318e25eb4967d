"""Column functions on paths, patterns, hosts and texts.  All are native expressions unless their docstring says so."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: what counts as white space at the ends of a text (fixed values)
SPACE = r"[\t-\r \x{85}\p{Z}]"
#: second-level suffixes that take a third label (fixed values)
SECOND_LEVEL = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz co.jp or.jp ne.jp ac.jp go.jp "
    "com.br net.br org.br com.cn net.cn org.cn co.in com.mx com.tr co.za com.ar com.sg com.hk com.tw co.kr co.il com.pl com.ua"
).split()


def trim_space(c: Column) -> Column:
    """Unicode white space cut from both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def extract_token(value: Column) -> Column:
    """Product token of a User-agent value: `*`, or the leading letters, digits, `_` and `-` in lower case."""
    return F.when(value.startswith("*"), F.lit("*")).otherwise(F.lower(F.regexp_extract(value, r"^[A-Za-z0-9_-]*", 0)))


def normalise_encoding(c: Column) -> Column:
    """Percent-encoding in one form: unreserved ASCII decoded, hex digits upper case, other bytes encoded."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|[\x21-\x7E]|.)"), F.lit(0))

    def one(x: Column) -> Column:
        decoded = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))
        encoded = F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
        return (
            F.when(F.length(x) == 3, F.when(decoded.rlike(r"^[A-Za-z0-9\-._~]\z"), decoded).otherwise(F.upper(x)))
            .when(x.rlike(r"^[\x21-\x7E]\z"), x)
            .otherwise(encoded)
        )

    plain = c.rlike(r"^[\x21-\x24\x26-\x7E]*\z")  # no percent sign, nothing to encode
    return F.when(plain, c).otherwise(F.array_join(F.transform(parts, one), ""))


def like_pattern(pattern: Column) -> Column:
    """SQL LIKE pattern of a path pattern in its normal form: `*` any run, a final `$` anchors, prefix otherwise."""
    norm = normalise_encoding(pattern)
    anchored = norm.endswith("$")
    body = F.when(anchored, F.substring(norm, F.lit(1), F.length(norm) - 1)).otherwise(norm)
    escaped = F.regexp_replace(body, r"([\\%_])", r"\\$1")
    return F.concat(F.regexp_replace(escaped, r"\*+", "%"), F.when(anchored, F.lit("")).otherwise(F.lit("%")))


def path_matches(pattern: Column, path: Column) -> Column:
    """Does the pattern match the path, both in normal form, from the start?"""
    return F.like(normalise_encoding(path), like_pattern(pattern))


def normalise_path(value: Column) -> Column:
    """Path and query of a URL or path: trimmed, `/` for nothing, a leading slash otherwise, without fragment of a URL."""
    v = trim_space(value)
    is_url = v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    rest = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)#.*", "")
    of_url = F.when(rest == "", F.lit("/")).when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(v == "", F.lit("/")).when(is_url, of_url).when(v.startswith("/"), v).otherwise(F.concat(F.lit("/"), v))


def is_absolute_url(path: Column) -> Column:
    return path.rlike(r"(?i)^https?://")


def whole_site(path: Column) -> Column:
    return path.rlike(r"^/\**\z")


def plain_path(path: Column) -> Column:
    """Without one final `$` and without `*`."""
    return F.replace(F.regexp_replace(path, r"\$\z", ""), F.lit("*"), F.lit(""))


def sample_path(pattern: Column) -> Column:
    """A concrete path that a pattern stands for."""
    p = plain_path(trim_space(pattern))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def segments(path: Column) -> Column:
    """Lower-case segments before the query, without empty ones."""
    return F.filter(F.split(F.substring_index(F.lower(plain_path(path)), "?", 1), "/"), lambda x: x != "")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def root_domain(host: Column) -> Column:
    """The last two labels, three behind a listed second-level suffix."""
    labels = F.split(strip_www(host), r"\.")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    last3 = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(last2.isin(*SECOND_LEVEL), last3).otherwise(last2)


def url_host(url: Column) -> Column:
    """Host of an http or https URL in lower case, null for anything else (RFC 3986; lenient about the rest)."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+|\[[0-9A-Fa-f:.]+\])", 1))
    return F.when(host != "", host)


def url_port(url: Column) -> Column:
    port = F.regexp_extract(url, r"(?i)^https?://[^/?#]*?:([0-9]+)(?:[/?#]|\z)", 1)
    scheme = F.lower(F.substring_index(url, ":", 1))
    return F.when((port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443")), port)


def url_path(url: Column) -> Column:
    p = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def valid_http_url(url: Column) -> Column:
    """http(s) with a host and without white space: the RFC 3986 reading of what a URL parser accepts."""
    return F.coalesce(url.rlike(r"(?i)^https?:/{0,2}[^/\s?#\\<>^|]+[^\s]*\z"), F.lit(False))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, default port dropped, `/` for an empty path: equal URLs compare equal."""
    scheme = F.lower(F.substring_index(url, ":", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?:/*[^/?#]*", ""), r"^\z", "/")
    return F.concat(scheme, F.lit("://"), url_host(url), F.coalesce(F.concat(F.lit(":"), url_port(url)), F.lit("")), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")


def is_private_ip(host: Column) -> Column:
    return host.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def extract_urls(text: Column) -> Column:
    """http(s) URLs of a text, final punctuation cut, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s<>\"'()\[\]{}|\\^`]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?]+\z", "")))


def extract_hostnames(text: Column) -> Column:
    """Bare host names of a text: labels and a letter suffix that names no file type; each once, lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\w@./-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24})(?![\w@-])"), F.lit(1))
    files = "txt html htm php xml json pdf css js png jpg gif svg gz zip asp aspx jsp csv md yml yaml ini log doc xls".split()
    return F.array_distinct(F.filter(found, lambda x: ~F.element_at(F.split(x, r"\."), -1).isin(*files)))


def clean_parameters(path: Column, names: Column) -> Column:
    """Path without the query parameters of the given names (array), and the removed names: struct<path, removed>."""
    base = F.substring_index(path, "?", 1)
    query = F.when(F.instr(path, "?") > 0, F.substring(path, F.instr(path, "?") + 1, F.length(path)))
    pairs = F.split(query, "&", -1)
    name_of = lambda x: F.substring_index(x, "=", 1)
    kept = F.filter(pairs, lambda x: ~F.array_contains(names, name_of(x)))
    gone = F.transform(F.filter(pairs, lambda x: F.array_contains(names, name_of(x))), name_of)
    empty = F.array().cast("array<string>")
    changed = F.struct(F.when(F.size(kept) > 0, F.concat_ws("?", base, F.array_join(kept, "&"))).otherwise(base).alias("path"), gone.alias("removed"))
    return F.when(query.isNull() | (F.size(gone) == 0), F.struct(path.alias("path"), empty.alias("removed"))).otherwise(changed)


def kib(size: Column) -> Column:
    """Size in KiB with one decimal (ties away from zero), no trailing `.0`."""
    return F.regexp_replace(F.format_string("%.1f", F.round(size.cast("double") / 102.4) / 10), r"\.0\z", "")


def csv_cell(c: Column) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def tsv_cell(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\|`*_<>\[\]])", r"\\$1")


def date_of(iso: Column) -> Column:
    """The day at the start of an ISO time, else null."""
    return F.try_to_date(F.regexp_extract(iso, r"^([0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2})", 1), "y-M-d")


def report_filename(site: Column, day: Column) -> Column:
    """slug-robots-audit-date"""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(site, F.lit("site"))), r"^https?://(www\.)?", ""), r"[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(slug, r"^-+|-+\z", ""), F.lit("-robots-audit-"), F.date_format(day, "yyyy-MM-dd"))


def fnv1a_64(value: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in value:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a_batch(values: list[bytes]) -> list[str]:
    """The same for many texts: one step a place over all texts that are long enough, the last few one by one."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    lengths = np.array([len(values[i]) for i in order], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    flat = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    h = np.full(len(values), 0xCBF29CE484222325, dtype=np.uint64)
    prime, at = np.uint64(0x100000001B3), 0
    active = len(values)
    while True:
        active = int(np.searchsorted(-lengths[:active], -at, side="left"))  # texts longer than `at`
        if active <= FEW_TEXTS:
            break
        h[:active] = (h[:active] ^ flat[starts[:active] + at]) * prime
        at += 1
    out = [""] * len(values)
    for k, i in enumerate(order):
        x = int(h[k])
        for b in values[i][at:] if k < active else b"":
            x = (x ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out[i] = f"{x:016x}" if values[i] else ""
    return out


FEW_TEXTS = 12


@F.pandas_udf(StringType())
def body_hash(texts: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, 16 hex digits (Arrow batches: no native expression gives this hash); empty for no text."""
    return pd.Series(fnv1a_batch([t.encode() if t else b"" for t in texts]), index=texts.index)
