"""Repository, host, URL, identity and title clean-up; nothing secret survives."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import let, short_text

# White space as the producers' runtime defines it.
SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_EDGES = rf"^{SPACE}+|{SPACE}+$"
# scheme, user info, host, port, path, query
URL = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?"
    r"(\[[0-9A-Fa-f:.]+\]|[^\s/?#:@\[\]<>^|\\]+)(?::([0-9]{0,5}))?"
    r"(/[^?#\s]*)?(?:\?([^#\s]*))?(?:#\S*)?$"
)
# the short form of an ssh remote: host, path
SCP = r"^git@([^\s:/?#@]+):([^?#\s]*)(?:[?#]\S*)?$"
# file URLs, absolute, home and relative paths, drive letters, and whatever holds a backslash
LOCAL = r"(?i)^file:|^[/~.]|^[a-z]:|\\"
# [IPv6] with a port, a name with a port, or an IPv6 address as it is; a last dot is no part of it
ADDRESS = r"^(?:\[([^\]]*)\](?::\d+)?|([^:]*?)\.?(?::\d*)?|(.*?))\.?$"
HOST = r"^[a-z0-9_.:%-]{1,253}$"
WEB_SCHEMES = ("http", "https", "ftp", "ws", "wss")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, SPACE_EDGES, "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def url_host(url: Column) -> Column:
    """Host of a URL: lower case where the scheme defines it so; NULL if it is no URL."""
    host = _part(url, 3)
    host = F.when(F.lower(_part(url, 1)).isin(*WEB_SCHEMES), F.lower(host)).otherwise(host)
    return F.when(url.rlike(URL), host)


def repository_name(value: Column) -> Column:
    """`owner/name` on github.com, `host/path` elsewhere; local paths and bare logins are NULL.

    A remote reads as a URL, as git@host:path, or as a plain name. The first two
    give a host and a path, so credentials, ports and queries fall away there.
    """
    def at(host: Column, path: Column) -> Column:
        home = F.lower(host) == "github.com"
        return F.concat(F.when(home, F.lit("")).otherwise(F.concat(host, F.lit("/"))), F.ltrim(path, F.lit("/")))

    def name(remote: Column) -> Column:
        host = F.when(F.lower(_part(remote, 1)) == "ssh", F.lower(_part(remote, 3))).otherwise(url_host(remote))
        short = F.when(remote.rlike(SCP), at(F.lower(F.regexp_extract(remote, SCP, 1)), F.regexp_extract(remote, SCP, 2)))
        plain = F.when(~remote.contains("@") & ~remote.contains("://"), remote)
        full = F.coalesce(F.when(remote.rlike(URL), at(host, _part(remote, 5))), short, plain)
        return F.when(~remote.rlike(LOCAL), F.nullif(F.regexp_replace(full, r"(?i)/*(?:\.git)?$", ""), F.lit("")))

    return let(strip(short_text(value)), name)


def endpoint_host(value: Column) -> Column:
    """Bare lower-case host of an address or URL: no path, port or credentials."""
    def checked(host: Column) -> Column:
        return F.when(host.rlike(HOST), host)

    def host_of(address: Column) -> Column:
        # one alternative of ADDRESS matches; the groups of the others are empty
        return let(F.concat(*[F.regexp_extract(address, ADDRESS, g) for g in (1, 2, 3)]), checked)

    text = F.lower(strip(short_text(value)))
    return let(let(text, lambda t: F.when(t.contains("://"), url_host(t)).otherwise(t)), host_of)


def identity_name(value: Column) -> Column:
    """An account name: one short line without control characters."""
    return let(strip(value), lambda name: F.when(F.length(name).between(1, 128) & ~name.rlike(r"[\x00-\x1f\x7f]"), name))


def clean_title(value: Column) -> Column:
    """Collapsed title of at most 512 characters as given; blank is NULL."""
    return F.nullif(F.when(F.length(value) <= 512, strip(F.regexp_replace(value, SPACE + "+", " "))), F.lit(""))


# What stands for the missing, the masked and the unreadable.
NO_URL, MASKED, WITHHELD = "(none)", "<redacted>", "(unparseable, withheld)"


def redact_url(value: Column) -> Column:
    """Scheme, host and path only; user info and query are masked, the unreadable withheld."""
    scheme = F.lower(_part(value, 1))
    web = scheme.isin(*WEB_SCHEMES)
    path = F.when(web & (_part(value, 5) == ""), F.lit("/")).otherwise(_part(value, 5))
    port = _part(value, 4)
    usual = ((scheme.isin("https", "wss")) & (port == "443")) | ((scheme.isin("http", "ws")) & (port == "80"))
    shown = F.concat(
        scheme, F.lit("://"),
        F.when(_part(value, 2) != "", F.lit(f"{MASKED}@")).otherwise(F.lit("")),
        url_host(value),
        F.when((port == "") | usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        path,
        F.when(_part(value, 6) != "", F.lit(f"?{MASKED}")).otherwise(F.lit("")),
    )
    return (
        F.when(value.isNull() | (value == ""), F.lit(NO_URL))
        .when(value.rlike(URL), shown)
        .otherwise(F.lit(WITHHELD))
    )


def short_session_id(session_id: Column) -> Column:
    return F.when(F.length(session_id) > 12, F.concat(F.substring(session_id, 1, 8), F.lit("…"))).otherwise(session_id)


def session_label(name: Column, session_id: Column) -> Column:
    return F.coalesce(name, short_session_id(session_id))


def work_label(repository: Column, branch: Column) -> Column:
    """`repo@branch`, or whichever half is known."""
    joined = F.concat_ws("@", repository, branch)
    return F.when(joined != "", joined)
