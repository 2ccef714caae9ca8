"""URL and request-template normalisation as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col, trim_control


def host_of(col: ColumnLike) -> Column:
    """Lower-case host without port; bare hosts and protocol-relative urls are accepted."""
    text = F.regexp_replace(as_col(col), "^[\\s\ufeff]+", "")
    return F.lower(F.regexp_extract(text, "^(?:(?i:https?):)?(?://)?([^/:]*)", 1))


def scheme_of(col: ColumnLike) -> Column:
    """``http`` or ``https``, else an empty string."""
    return F.lower(F.regexp_extract(as_col(col), "^[\\s\ufeff]*((?i:https?))://", 1))


def site_of(host: ColumnLike) -> Column:
    """The host without its first label while at least two labels remain."""
    h = F.lower(F.trim(as_col(host)))
    rest = F.regexp_extract(h, "^[^.]*\\.(.+)$", 1)
    return F.when(F.contains(rest, F.lit(".")), rest).otherwise(h)


def first_line(col: ColumnLike) -> Column:
    """The first line that is not blank, trimmed."""
    return trim_control(F.regexp_extract(as_col(col), "[^\\x00-\\x20][^\\r\\n]*", 0))


def abs_url(base: ColumnLike, url: ColumnLike) -> Column:
    """Resolve the first line of ``url`` against ``base``."""
    b, u = F.coalesce(as_col(base), F.lit("")), first_line(F.coalesce(as_col(url), F.lit("")))
    scheme = F.coalesce(F.nullif(F.regexp_extract(b, "^(.+?)://", 1), F.lit("")), F.lit("http"))
    origin = F.regexp_extract(b, "^(.*?://[^/]*)", 1)
    folder = F.regexp_extract(b, "(?s)^(.*/)", 1)
    return (
        F.when(u == "", u)
        .when(u.startswith("http://") | u.startswith("https://"), u)
        .when(u.startswith("//"), F.concat(scheme, F.lit(":"), u))
        .when(u.startswith("/"), F.concat(origin, u))
        .otherwise(F.concat(folder, u))
    )


def collapse_doubled_host(col: ColumnLike) -> Column:
    """Remove a first path segment that is a host of the same site."""
    url = as_col(col)
    shape = "(?s)^(.+?://[^/]*)/([^/]*)(?:/(.*))?$"
    origin, segment = F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)
    rest, host = F.regexp_extract(url, shape, 3), host_of(origin)
    same = (F.lower(segment) == host) | (site_of(segment) == site_of(host))
    doubled = (host != "") & F.contains(segment, F.lit(".")) & same
    return F.when(doubled, F.concat(origin, F.lit("/"), rest)).otherwise(url)


def expand_template(template: ColumnLike, key: ColumnLike, page: ColumnLike) -> Column:
    """Fill ``{{key}}`` (url-encoded), ``{{page}}`` and ``{{page+n}}`` / ``{{page-n}}``."""
    encoded = F.url_encode(F.coalesce(as_col(key), F.lit("")))
    number = as_col(page).cast("long")

    def fill(piece: Column) -> Column:
        inner = F.trim(F.regexp_extract(piece, "^\\{\\{((?s:.*))\\}\\}$", 1))
        shift = F.regexp_replace(F.regexp_extract(inner, "^page\\s*([+-]\\s*[0-9]+)$", 1), "\\s", "")
        return (
            F.when(~piece.startswith("{{") | ~piece.endswith("}}"), piece)
            .when(inner.isin("key", "keyword"), encoded)
            .when(inner == "page", number.cast("string"))
            .when(shift != "", (number + shift.try_cast("long")).cast("string"))
            .otherwise(F.lit(""))
        )

    pieces = F.regexp_extract_all(as_col(template), F.lit("\\{\\{(?s:.*?)\\}\\}|\\{|[^{]++"), F.lit(0))
    return F.array_join(F.transform(pieces, fill), "")


def fill_fields(template: ColumnLike, json: ColumnLike, paths: Sequence[str]) -> Column:
    """Replace ``{$.path}`` by the value of each listed path of a JSON column."""
    out = as_col(template)
    for path in paths:
        value = F.coalesce(F.get_json_object(as_col(json), path), F.lit(""))
        out = F.replace(out, F.lit("{" + path + "}"), value)
    return out


def split_options(col: ColumnLike) -> Column:
    """Split a trailing ``,{json}`` off a request; commas without valid JSON behind them stay."""
    v = F.trim(as_col(col))

    def is_tail(i: Column) -> Column:
        tail = F.trim(v.substr(i + 1, F.length(v)))
        return (v.substr(i, F.lit(1)) == ",") & tail.startswith("{") & F.try_parse_json(tail).isNotNull()

    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), is_tail)
    cut = F.element_at(positions, -1)
    at = F.when(F.size(positions) > 0, cut)
    tail = F.trim(v.substr(at + 1, F.length(v)))
    spec = "method string, body string, charset string, headers string, webView boolean"
    options = F.from_json(tail, spec)
    header_map = F.coalesce(
        F.when(options["headers"].startswith("{"), F.from_json(options["headers"], "map<string,string>")),
        parse_headers(options["headers"]),
        F.expr("cast(map() as map<string,string>)"),
    )
    return F.struct(
        F.when(at.isNotNull(), F.trim(v.substr(F.lit(1), at - 1))).otherwise(v).alias("url"),
        F.coalesce(F.trim(v.substr(at, F.length(v))), F.lit("")).alias("tail"),
        F.coalesce(F.nullif(F.upper(F.trim(options["method"])), F.lit("")), F.lit("GET")).alias("method"),
        options["body"].alias("body"),
        F.coalesce(options["charset"], F.lit("")).alias("charset"),
        header_map.alias("headers"),
        F.coalesce(options["webView"], F.lit(False)).alias("unsupported"),
    )


def parse_headers(col: ColumnLike) -> Column:
    """``Name@value`` lines (real or escaped line breaks) to a map; the last value of a name wins."""
    lines = F.transform(F.split(F.replace(as_col(col), F.lit("\\n"), F.lit("\n")), "\n"), trim_control)
    named = F.filter(lines, lambda x: F.instr(x, "@") > 1)
    pairs = F.filter(
        F.transform(
            named,
            lambda x: F.struct(
                F.trim(F.substring_index(x, "@", 1)).alias("key"),
                F.trim(F.regexp_extract(x, "(?s)^[^@]*@(.*)$", 1)).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )
    later = lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]
    )
    return F.map_from_entries(F.filter(pairs, later))


def trailing_id(col: ColumnLike) -> Column:
    """The first digits of the last path segment (an ``.html`` ending is ignored)."""
    url = F.regexp_replace(as_col(col), "[/?#]+$", "")
    stem = F.regexp_replace(url, "(?s)^(.+)\\.html.*$", "$1")
    return F.regexp_extract(F.regexp_extract(stem, "([^/]*)$", 1), "([0-9]+)", 1)
