"""URL, link and sitemap functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, decode_entities, safe_segment, spelled, trim_all

_PARTS = r"^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)"
# An anchor's href in double, single or no quotes; a title element; a sitemap's address.
LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+))"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LOC = r"(?i)<loc>\s*([^<]+)</loc>"


def _dots(path: Column) -> Column:
    """A path with . and .. segments resolved, %2e counting as a dot."""
    segments = F.split(path, "/")
    is_dots = lambda x, n: F.replace(F.lower(x), F.lit("%2e"), F.lit(".")) == "." * n
    stack = F.aggregate(
        F.slice(segments, 2, 1 << 30), F.expr("cast(array() as array<string>)"),
        lambda a, x: F.when(is_dots(x, 2), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(is_dots(x, 1), a).otherwise(F.concat(a, F.array(x))),
    )
    last = F.element_at(segments, -1)
    return F.concat(F.lit("/"), F.array_join(stack, "/"), F.when((is_dots(last, 1) | is_dots(last, 2)) & (F.size(stack) > 0), "/").otherwise(""))


# What is percent-encoded in a path and in a user's name or password, and what a host must not hold.
_IN_PATH = r"""[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"""
_IN_USER = r"""[^\x21\x24-\x2E0-9A-Z\x5F\x61-\x7A\x7E]"""
_NOT_IN_HOST = r"""[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7F]"""


def percent_encoded(s: Column, chars: str) -> Column:
    """s with the UTF-8 bytes of each of chars (a class of a pattern) as %XX."""
    coded = spelled(s, f"(?:{chars})+", lambda m: F.regexp_replace(F.hex(F.encode(m, "UTF-8")), "(..)", r"%$1"))
    return F.when(s.rlike(chars), coded).otherwise(s)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is worked out once, however often then uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _authority(s: Column, scheme: Column, idn: bool) -> Column:
    """userinfo@host:port in its normal form; null where it is none."""
    part = lambda k: F.regexp_extract(s, r"^(?:(.*)@)?(\[[0-9A-Fa-f:.]+\]|[^:\[\]]+)(?::([0-9]*))?$", k)
    name, word = F.regexp_extract(s, "^([^:@]*)(?::.*)?@", 1), F.regexp_extract(s, "^[^:@]*:(.*)@", 1)
    name = F.when(s.rlike("^[^:]*@.*@"), F.regexp_extract(s, "^([^:]*)(?::.*)?@", 1)).otherwise(name)
    given = _let(percent_encoded(word, _IN_USER), lambda w: F.concat(percent_encoded(name, _IN_USER), F.when(w != "", F.concat(F.lit(":"), w)).otherwise("")))
    login = F.when(s.contains("@"), _let(given, lambda x: F.when(x != "", F.concat(x, F.lit("@"))).otherwise(""))).otherwise("")

    def site(host: Column) -> Column:
        plain = F.when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host)
        if idn:
            plain = _let(plain, lambda h: F.when(h.rlike("[^\\x00-\\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h)).otherwise(h))
        return _let(plain, lambda h: F.when((h != "") & (h.startswith("[") | ~h.rlike(_NOT_IN_HOST)), F.lower(h)))

    def at(port: Column) -> Column:
        own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        fits = (F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535"))
        return F.when(fits, F.when(own, "").otherwise(F.concat(F.lit(":"), port)))

    return F.concat(login, _let(part(2), site), _let(F.regexp_replace(part(3), "^0+(?=.)", ""), at))


def origin(url: Column) -> Column:
    """Scheme, host in lower case and port (left out where it is the scheme's own); null for other than http and https."""
    u = F.regexp_replace(url, r"^(?i)(https?)(?=:)", F.lit("$1"))
    scheme = F.lower(F.regexp_extract(u, f"(?i){_PARTS}", 1))
    port = F.regexp_extract(u, f"(?i){_PARTS}", 3)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(u, f"(?i){_PARTS}", 2)), F.when(own, "").otherwise(F.concat(F.lit(":"), port))))


# An address in its normal form but for a query, a fragment and a slash at its end.
_SIMPLE = r"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)*(?:/(?!\.|%2[eE])[A-Za-z0-9_~!$&()*+,;=:@%.-]*)*(?:[?#].*)?$"


def normalise(raw: Column, base: Column, idn: bool = False) -> Column:
    """Absolute URL of raw against base, without query, fragment and one trailing slash; null unless it is http or https and has
    a host and port that can be. As browsers do it: back-slashes are slashes, tabs and line breaks go, dots are resolved, the
    scheme and host are lower-case, its own port goes, a user's name and password stay, and other characters of these and of
    the path are percent-encoded. Hosts that are not ASCII stay as written but for case, or (idn) take their ASCII form by
    IDNA 2003. Numeric hosts are not rewritten.
    """
    r = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    bare = F.replace(F.regexp_replace(r, r"(?s)[?#].*$", ""), F.lit("\\"), F.lit("/"))
    base_part = lambda k: F.regexp_extract(base, r"(?i)^(https?)://([^/?#]*)([^?#]*)", k)
    base_scheme = F.lower(base_part(1))
    on_base = lambda path: F.concat(base_scheme, F.lit("://"), base_part(2), path)

    def relative(rest: Column) -> Column:
        folder = F.when(base_part(3) == "", "/").otherwise(F.regexp_replace(base_part(3), "[^/]*$", ""))
        return (
            F.when(rest.startswith("//"), F.concat(base_scheme, F.lit("://"), F.regexp_replace(rest, "^/+", ""))).when(rest.startswith("/"), on_base(rest))
            .when(rest == "", on_base(base_part(3))).otherwise(on_base(F.concat(folder, rest)))
        )

    def absolute(b: Column) -> Column:
        scheme = F.lower(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        full = F.concat(scheme, F.lit("://"), F.regexp_replace(b, "^[A-Za-z]+:/*", ""))
        # http:x against a base of http is x, as http:/x is /x.
        same = (scheme == base_scheme) & ~b.rlike("^[A-Za-z]+://")
        return F.when(scheme == "", relative(b)).when(same, _let(F.regexp_replace(b, "^[A-Za-z]+:", ""), relative)).when(scheme.isin("http", "https"), full)

    def resolved(path: Column) -> Column:
        whole = F.when(path == "", "/").when(path.rlike(r"(?i)/(?:\.|%2e)"), _dots(path)).otherwise(path)
        return _let(_let(whole, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))), lambda p: percent_encoded(p, _IN_PATH))

    def normal(url: Column) -> Column:
        part = lambda k: F.regexp_extract(url, r"(?s)^(https?)://([^/]*)(.*)$", k)
        return F.concat(part(1), F.lit("://"), _let(part(2), lambda s: _authority(s, part(1), idn)), _let(part(3), resolved))

    quick = _let(F.regexp_replace(raw, "[?#].*$", ""), lambda u: F.when(u.rlike("^https?://[^/]+/?$"), F.concat(F.rtrim(u, F.lit("/")), F.lit("/"))).otherwise(F.regexp_replace(u, "/$", "")))
    return F.when(raw.rlike(_SIMPLE), quick).otherwise(_let(_let(bare, absolute), normal))


def is_internal(url: Column, root: Column) -> Column:
    return F.coalesce(origin(url) == origin(root), F.lit(False))


def is_internal_href(href: Column, page_origin: Column) -> Column:
    """Whether a link as written stays on the origin of its page; cheaper than normalising it first."""
    absolute = F.when(href.startswith("//"), F.concat(F.substring_index(page_origin, "//", 1), href)).otherwise(href)
    stays = F.coalesce(origin(absolute) == page_origin, F.lit(False))
    return F.when(href.rlike("(?i)^(?:https?:)?//"), stays).otherwise(~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))


def included(url: Column, include: list[str] = [], exclude: list[str] = []) -> Column:  # noqa: B006
    """No exclude pattern matches, and one of include does (if there are any); upper and lower case are alike."""
    any_of = lambda patterns: F.array_max(F.array(*(url.rlike(f"(?iu){p}") for p in patterns)))
    out = ~any_of(exclude) if exclude else F.lit(True)
    return out & any_of(include) if include else out


def checked(patterns: list[str]) -> list[str]:
    """The patterns, once all of them are known to compile: before any page is read."""
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"invalid pattern {p!r}: {e}") from e
    return patterns


def split_patterns(s: str) -> list[str]:
    return [p.strip() for p in s.split(",") if p.strip()]


def hrefs(html: Column) -> Column:
    """Link targets in document order, repeats included; empty ones, fragments and mailto, tel, javascript and data left out."""
    # The page is searched once; of the three groups of a tag found, one has text.
    found = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda tag: F.concat(*(F.regexp_extract(tag, LINK, k) for k in (1, 2, 3))))
    return F.filter(F.transform(found, trim_all), lambda h: (h != "") & ~h.rlike("(?i)^(?:#|mailto:|tel:|javascript:|data:)"))


def page_title(html: Column, url: Column) -> Column:
    """The title element's text, else the URL's last path segment, its host, or the URL."""
    text = decode_entities(trim_all(F.regexp_replace(F.regexp_extract(html, TITLE, 1), f"[{WS}]+", " ")))
    last = F.regexp_extract(F.regexp_extract(url, f"(?i){_PARTS}", 4), "([^/]+)/*$", 1)
    host = F.lower(F.regexp_extract(url, f"(?i){_PARTS}", 2))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (text, last, host)), url)


def sitemap_locs(xml: Column) -> Column:
    fix = lambda s: F.replace(F.replace(F.replace(s, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), lambda x: fix(trim_all(x))), lambda x: x != "")


def is_sitemap(url: Column) -> Column:
    return url.rlike(r"(?i)sitemap|\.xml(\?|$)")


def mirror_path(url: Column) -> Column:
    """Path of a page's Markdown file: index.md for a root or a directory, else the name with .md for its extension."""
    segments = F.filter(F.split(F.regexp_extract(url, f"(?i){_PARTS}", 4), "/"), lambda s: s != "")
    safe = F.transform(segments, safe_segment)
    last = F.element_at(safe, -1)
    folder = F.concat(F.array_join(safe, "/"), F.lit("/index.md"))
    named = F.array_join(F.concat(F.slice(safe, F.lit(1), F.size(safe) - 1), F.array(F.concat(F.regexp_replace(last, r"\.[^.]+$", ""), F.lit(".md")))), "/")
    return F.when(F.size(segments) == 0, "index.md").when(last.contains("."), named).otherwise(folder)


def is_page_type(content_type: Column) -> Column:
    return content_type.rlike("(?i)html|xml")


def default_output(host: Column, mode: str) -> Column:
    """Name of a crawl's output, by host and mode: single, mirror or jsonl."""
    ending = {"single": ".crawl.md", "jsonl": ".crawl.jsonl"}.get(mode, ".crawl")
    return F.concat(F.regexp_replace(host, "(?i)[^a-z0-9.-]", "_"), F.lit(ending))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, f"(?i){_PARTS}", 2))


def image_source(src: Column) -> Column:
    """src (null for none), url (with a scheme) and content (bytes of a data: address) of an image's address."""
    url = F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(F.nullif(src, F.lit("")))
    data = F.regexp_extract(url, r"(?is)^data:[^,]*,(.*)$", 1)
    plain = F.encode(F.try_url_decode(F.replace(data, F.lit("+"), F.lit("%2B"))), "UTF-8")
    content = F.when(url.rlike(r"(?i)^data:[^,]*;base64,"), F.try_to_binary(data, F.lit("base64"))).when(url.rlike("(?i)^data:"), plain)
    return F.struct(url.alias("url"), content.alias("content"))
