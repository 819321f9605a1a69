"""URLs, taken apart and put together with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, register

# scheme, user info, host, port, path, query, fragment (RFC 3986)
SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
STRIPPED_PORTS = {"http": "80", "https": "443", "ftp": "21", "ssh": "22", "telnet": "23"}


class Parts:
    """Columns of the parts of a URL; absent ones are null."""

    def __init__(self, url: Column):
        self.url = url
        self.valid = F.coalesce(url.rlike(SHAPE), F.lit(False)) & (F.regexp_extract(url, SHAPE, 3) != "")
        part = lambda i: F.regexp_extract(url, SHAPE, i)
        some = lambda i: F.when(self.valid & (part(i) != ""), part(i))
        self.scheme = F.lower(some(1))
        self.userinfo, self.query, self.fragment = some(2), some(6), some(7)
        self.host = F.lower(some(3))
        port = some(4)
        usual = F.lit(None).cast("string")
        for scheme, number in DEFAULT_PORTS.items():
            usual = F.when(self.scheme == scheme, F.lit(number)).otherwise(usual)
        self.stated = port
        self.port = F.when(usual.isNull() | (port != usual), port)
        self.path = F.when(self.valid, F.when(part(5) == "", F.lit("/")).otherwise(part(5)))

    def build(self, **changed: Column) -> Column:
        """The URL with some parts changed; what is no URL stays as it is."""
        get = lambda name: changed.get(name, getattr(self, name))
        opt = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
        whole = F.concat(get("scheme"), F.lit("://"), opt("", get("userinfo"), "@"), get("host"), opt(":", get("port")), get("path"), opt("?", get("query")), opt("#", get("fragment")))
        return F.when(self.valid, whole).otherwise(self.url)



def _null() -> Column:
    return F.lit(None).cast("string")


def _no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


@register("url_parse", each="str")
def _url_parse(x: Typed) -> Column:
    p = Parts(x.col)
    user = F.split_part(p.userinfo, F.lit(":"), F.lit(1))
    password = F.when(F.contains(p.userinfo, F.lit(":")), F.split_part(p.userinfo, F.lit(":"), F.lit(2)))
    fields = {"scheme": p.scheme, "username": user, "password": password, "host": p.host, "port": p.port.cast("long"), "path": p.path, "query": p.query, "fragment": p.fragment}
    return F.when(p.valid, F.struct(*[c.alias(k) for k, c in fields.items()]))


@register("url_extract_domain", each="str")
def _domain(x: Typed) -> Column:
    return Parts(x.col).host


@register("url_extract_domain_without_www", each="str")
def _domain_without_www(x: Typed) -> Column:
    return F.when(x.col.isNotNull(), F.coalesce(_no_www(Parts(x.col).host), F.lit("")))


@register("url_extract_path", each="str")
def _path(x: Typed) -> Column:
    return Parts(x.col).path


@register("url_extract_port", each="str")
def _port(x: Typed) -> Column:
    return Parts(x.col).port.cast("long")


@register("url_extract_protocol", each="str")
def _protocol(x: Typed) -> Column:
    return Parts(x.col).scheme


@register("url_extract_query_string", each="str")
def _query(x: Typed) -> Column:
    return Parts(x.col).query


@register("url_set_domain", low=2, each="str")
def _set_domain(x: Typed, host: Typed) -> Column:
    return Parts(x.col).build(host=host.col)


@register("url_set_domain_without_www", each="str")
def _set_domain_without_www(x: Typed) -> Column:
    p = Parts(x.col)
    return p.build(host=_no_www(p.host))


@register("url_set_path", low=2, each="str")
def _set_path(x: Typed, path: Typed) -> Column:
    lead = F.when(F.startswith(path.col, F.lit("/")), path.col).otherwise(F.concat(F.lit("/"), path.col))
    return Parts(x.col).build(path=lead)


@register("url_set_port", low=2, each="str")
def _set_port(x: Typed, port: Typed) -> Column:
    p = Parts(x.col)
    usual = F.lit(False)
    for scheme, number in DEFAULT_PORTS.items():
        usual = usual | ((p.scheme == scheme) & (port.col.cast("string") == number))
    return p.build(port=F.when(~usual, port.col.cast("string")))


@register("url_set_protocol", low=2, each="str")
def _set_protocol(x: Typed, scheme: Typed) -> Column:
    return Parts(x.col).build(scheme=scheme.col)


@register("url_set_query_string", low=3, each="str")
def _set_query(x: Typed, key: Typed, value: Typed) -> Column:
    p = Parts(x.col)
    pairs = F.coalesce(F.split(p.query, "&"), F.array().cast("array<string>"))
    others = F.filter(pairs, lambda kv: F.split_part(kv, F.lit("="), F.lit(1)) != key.col)
    pair = F.concat(key.col, F.lit("="), F.regexp_replace(F.url_encode(value.col.cast("string")), r"\*", "%2A"))
    return p.build(query=F.array_join(F.array_append(others, pair), "&"))


@register("url_strip_fragment", each="str")
def _strip_fragment(x: Typed) -> Column:
    p = Parts(x.col)
    return F.when(p.valid, p.build(fragment=_null())).otherwise(F.regexp_replace(x.col, "#.*$", ""))


@register("url_strip_port", each="str")
def _strip_port(x: Typed) -> Column:
    return Parts(x.col).build(port=_null())


@register("url_strip_port_if_default", each="str")
def _strip_default_port(x: Typed) -> Column:
    p = Parts(x.col)
    usual = F.lit(False)
    for scheme, number in STRIPPED_PORTS.items():
        usual = usual | ((p.scheme == scheme) & (F.coalesce(p.stated, F.lit("")) == number))
    return p.build(port=F.when(~usual, p.port))


@register("url_strip_protocol", each="str")
def _strip_protocol(x: Typed) -> Column:
    p = Parts(x.col)
    return F.when(p.valid, F.regexp_replace(p.build(), "^[^:]+:", "")).otherwise(x.col)


@register("url_strip_query_string", each="str")
def _strip_query(x: Typed) -> Column:
    p = Parts(x.col)
    return F.when(p.valid, p.build(query=_null())).otherwise(F.regexp_replace(x.col, r"\?[^#]*", ""))
